"""One query for each operator, over its whole table, and its DuckDB statement where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline

from . import chat, language_id, language_model, merkle, spelling, surrogates, toxicity, url_filter, vector_codes
from .common import table
from .mixing import mix
from .near_dedup import NearDedup, near_duplicates
from .packing import pack
from .topk import top_k

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """All documents (by text, declared language and source) and all pages (by text, markup and address), judged together."""
    docs, pages = table(spark, folder, "documents"), table(spark, folder, "pages")
    none = F.lit(None).cast("long")
    rows = docs.select("doc_id", none.alias("page_id"), F.col("lang").alias("declared"), F.col("source").alias("host"), "text").unionByName(
        pages.select(none.alias("doc_id"), "page_id", language_id.page_language(F.col("html")).alias("declared"),
                     url_filter.host_of(F.col("url")).alias("host"), language_id.page_text(F.col("html")).alias("text")))
    return language_id.identify(rows, language_id.fit(docs))


def op2_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return surrogates.replace(table(spark, folder, "documents"), corpus_pipeline.SURROGATE_KEY).select("doc_id", "text", "entities")


def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    says = "<|im_end|><|im_start|>assistant ok"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(turns.unionByName(probe))


_OP3 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(24 + length(role) + length(regexp_replace(text, '<([\\|])', '<\\\1', 'g')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


def op4_mix_to_weights(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"))


def op5_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"))


_OP5 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), NearDedup(percent=85))


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"))


def op8_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.compare_with_next(table(spark, folder, "documents"))


def _tree_sql(text: str) -> str:
    """The sections of a text's tree, as in ``merkle.fingerprint``."""
    cut = "string_split(regexp_replace(p, '([.!?][ \\t])', '\\1' || chr(1), 'g'), chr(1))"
    leaf = "CASE WHEN x = '' THEN '' ELSE substr(sha256('l' || x), 1, 16) END"
    lines = f"list_transform(string_split(s, chr(10)), lambda p: array_to_string(list_transform({cut}, lambda x: {leaf}), ','))"
    return f"list_transform(string_split({text}, chr(10) || chr(10)), lambda s: array_to_string({lines}, ';'))"


def _mark_sql(tree: str) -> str:
    paragraph = "list_transform(string_split(s, ';'), lambda p: substr(sha256('p' || p), 1, 16))"
    section = f"substr(sha256('s' || array_to_string({paragraph}, ';')), 1, 16)"
    return f"sha256('r' || array_to_string(list_transform({tree}, lambda s: {section}), '|')) || '|' || array_to_string({tree}, '|')"


def _near_sql(a: str, b: str) -> str:
    leaves = lambda x: f"list_distinct(list_filter(regexp_split_to_array(substr({x}, 66), '[|;,]'), lambda v: v <> ''))"
    both = f"(len({leaves(a)}) + len({leaves(b)}))"
    return f"CASE WHEN substr({a}, 1, 64) = substr({b}, 1, 64) THEN 1.0::DOUBLE WHEN {both} = 0 THEN 0.0 ELSE 2.0 * len(list_intersect({leaves(a)}, {leaves(b)})) / {both} END"


_OP8 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC NULLS LAST, text), first_value(text) OVER (ORDER BY doc_id DESC NULLS LAST, text)) AS next_text,
      length(text) AS n_chars FROM d),
e AS (SELECT *, substr(text, 1, n_chars - n_chars // 2) || substr(next_text, 1, n_chars // 2) AS edited FROM o),
t AS (SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {_tree_sql("text")} AS a, {_tree_sql("edited")} AS b, {_tree_sql("next_text")} AS c FROM e),
f AS (SELECT doc_id, n_chars, edited_sha256, {_mark_sql("a")} AS fingerprint, {_mark_sql("b")} AS edited_fingerprint, {_mark_sql("c")} AS next_fingerprint FROM t)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, {_near_sql("fingerprint", "edited_fingerprint")} AS near_edited,
       {_near_sql("fingerprint", "next_fingerprint")} AS near_next FROM f
"""


def op9_language_model(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return language_model.score(table(spark, folder, "documents"), held_out, order=3)


def op10_pack(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"))


_OP6 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS k, doc_id, {_WORDS} AS w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL)),
s AS (SELECT DISTINCT k, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
pairs AS (SELECT a.k AS x, b.k AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.k <> b.k GROUP BY 1, 2),
e AS (SELECT x, y FROM pairs JOIN n p ON p.k = x JOIN n q ON q.k = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
r(k, seen) AS (SELECT k, k FROM d UNION SELECT r.k, e.y FROM r JOIN e ON e.x = r.seen),
f AS (SELECT k, min(seen) AS head FROM r GROUP BY k)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, h.doc_id AS component_id, d.doc_id = h.doc_id AS kept
FROM f JOIN d ON d.k = f.k JOIN d h ON h.k = f.head LEFT JOIN n ON n.k = f.k
UNION ALL SELECT NULL, 0, NULL, TRUE FROM documents WHERE doc_id IS NULL
"""

def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = toxicity.fit(docs, table(spark, folder, "labels"), ~fold)
    scored = toxicity.score(docs.withColumn("held_out", fold), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "language")


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.encode(table(spark, folder, "embeddings"))


def _nearest_sql(rows: str, books: str) -> str:
    """Each part's smallest distance and entry, as distance * 64 + entry."""
    away = "list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return f"SELECT x.r, x.p, any_value(x.v) AS v, min({away}::BIGINT * 64 + b.c) AS m FROM {rows} x JOIN {books} b USING (p) GROUP BY x.r, x.p"


def _moved_sql(k: int) -> str:
    return f"""
a{k} AS MATERIALIZED ({_nearest_sql("parts", f"c{k}")}),
u{k} AS (SELECT p, m % 64 AS c, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS z FROM (SELECT p, m, v, unnest(range(1, len(v) + 1)) AS i FROM a{k}) GROUP BY 1, 2, 3),
c{k + 1} AS MATERIALIZED (SELECT b.p, b.c, coalesce(n.v, b.v) AS v FROM c{k} b LEFT JOIN (SELECT p, c, list(z ORDER BY i) AS v FROM u{k} GROUP BY 1, 2) n USING (p, c)),"""


_OP12 = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, p, e[p * (len(e) // 16) + 1:(p + 1) * (len(e) // 16)] AS v FROM k, (SELECT unnest(range(16)) AS p)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS c, v FROM parts WHERE r <= 64),
{_moved_sql(0)}{_moved_sql(1)}
a2 AS MATERIALIZED ({_nearest_sql("parts", "c2")}),
f AS (SELECT r, string_agg(lower(lpad(to_hex(m % 64), 2, '0')), '' ORDER BY p) AS code, sum(m // 64)::BIGINT AS error FROM a2 GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, c)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM f JOIN k USING (r), h
"""


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.group_variants(spelling.word_counts(table(spark, folder, "documents"), slip=97))


# The remainders of the CRC-32 polynomial for four bits.
_CRC = ("[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, "
        "3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]")
_HALF_BYTES = "list_transform(range(1, len(h) + 1), lambda i: ('0x' || substr(h, i + CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END, 1))::BIGINT)"
_OP13 = f"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
x AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k FROM runs GROUP BY 1, 2),
b AS (SELECT run, k, hex(encode(doc_id || ':' || run)) AS h FROM x),
s AS (SELECT run, k, xor(list_reduce(list_concat([4294967295::BIGINT], {_HALF_BYTES}),
      lambda c, v: xor(c >> 4, ({_CRC}::BIGINT[])[(xor(c, v) & 15) + 1])), 4294967295::BIGINT) AS crc FROM b),
w AS (SELECT CASE WHEN crc % 97 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, k FROM s),
v AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
d AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
l AS (SELECT DISTINCT d.word AS long, v.word AS short, d.n AS long_n, v.n AS short_n FROM d JOIN v ON v.word = d.less),
e AS (SELECT p.word, q.word AS near, q.n AS near_n FROM d p JOIN d q ON p.i = q.i AND p.less = q.less AND p.word <> q.word
      UNION ALL SELECT long, short, short_n FROM l UNION ALL SELECT short, long, long_n FROM l),
t AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r FROM e),
f AS MATERIALIZED (SELECT v.word, CASE WHEN near_n >= 2 * n THEN near END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
      FROM v LEFT JOIN (SELECT * FROM t WHERE r = 1) t ON t.word = v.word),
way(word, root) AS (SELECT word, word FROM f UNION SELECT way.word, f.form FROM way JOIN f ON f.word = way.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, way.root, f.n, f.n_near, f.form_n FROM f JOIN way USING (word) JOIN f g ON g.word = way.root WHERE g.form IS NULL
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_surrogates": op2_surrogates,
    "op3_chat_format": op3_chat_format,
    "op4_mix_to_weights": op4_mix_to_weights,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_url_filter": op7_url_filter,
    "op8_merkle": op8_merkle,
    "op9_language_model": op9_language_model,
    "op10_pack": op10_pack,
    "op11_toxicity": op11_toxicity,
    "op12_vector_codes": op12_vector_codes,
    "op13_spelling": op13_spelling,
    "pipeline": corpus_pipeline.run,
}

CHECKS: dict[str, str] = {
    "op3_chat_format": _OP3,
    "op5_exact_top_k": _OP5,
    "op6_near_duplicates": _OP6,
    "op8_merkle": _OP8,
    "op12_vector_codes": _OP12,
    "op13_spelling": _OP13,
}
