"""Queries on sandbox reports, the presence table and feature selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import presence as R
from ..operators import selection as L
from ..operators import splits as S
from . import views as V
from .checks import over
from .registry import query

# ---- feature extraction ------------------------------------------------------------------------

EXTRACTS = {
    "api": ["'API:Nt' || event_type", "'API:Reg' || (k % 7)"],
    "registry": [r"'REG:OPENED:HKLM\A' || (k % 11)", r"CASE WHEN k % 2 = 0 THEN 'REG:WRITTEN:HKCU\Run' || (k % 5) END",
                 r"CASE WHEN k % 4 = 0 THEN 'REG:DELETED:HKU\D' || (k % 3) END", r"'REG:READ:HKCR\R' || event_type"],
    "file": [r"'FILE:CREATED:c:\temp\f' || (k % 13) || '.txt'", r"CASE WHEN k % 3 = 0 THEN 'FILE:DELETED:c:\docs\' || event_type END",
             r"'FILE:RECREATED:c:\r' || (k % 6)", r"'FILE:OPENED:d:\o' || (k % 8)", r"'FILE:OPENED:d:\o' || (k % 3)",
             r"CASE WHEN k % 5 = 0 THEN 'FILE:WRITTEN:c:\w' || (k % 9) END", r"'FILE:EXISTS:c:\e' || (k % 4)",
             r"CASE WHEN k % 6 = 0 THEN 'FILE:FAILED:c:\x' || (k % 3) END", r"'FILE:READ:c:\l' || (user_id % 7)"],
    "directory": [r"'DIRECTORY:ENUMERATED:c:\users\u' || (user_id % 6)", r"'DIRECTORY:CREATED:c:\n' || (k % 5)"],
    "string": ["'STRING:str' || k", "'STRING:' || event_type"],
    "network": ["CASE WHEN k % 10 = 1 THEN 'NETWORK:CONNECTS_IP:10.0.0.' || (k % 16) END",
                "'NETWORK:RESOLVES_HOST:c2-' || (k % 4) || '.example'", "CASE WHEN k % 3 = 1 THEN 'NETWORK:CONNECTS_HOST:h' || (k % 6) || '.ex' END"],
    "system": ["'SYSTEM:DLL_LOADED:kernel' || (k % 3) || '.dll'", "'SYSTEM:DLL_LOADED:ntdll.dll'",
               "'SYSTEM:MUTEX:m' || (user_id % 9)", "'SYSTEM:COMMAND_LINE:run ' || event_type", "'SYSTEM:GUID:{a' || (k % 10) || '}'"],
    "dropped": ["'DROP:EXTENSION:ext' || (k % 6)", "'DROP:TYPE:pe32_executable_(gui)'",
                "CASE WHEN k % 2 = 0 THEN 'DROP:TYPE:ascii_text' END"],
    "signature": ["'SIGNATURE:sig_' || event_type"],
}


def _extract_cte(group: str) -> str:
    return " UNION ".join(f"SELECT row_id AS sample_id, {e} AS name FROM tel" for e in EXTRACTS[group])


def _extract_sql(group: str) -> str:
    return over("tel", f"SELECT * FROM ({_extract_cte(group)}) WHERE name IS NOT NULL")


def _extractor(group: str):
    @query(f"feat_{group}", _extract_sql(group))
    def run(spark, sf):
        return R.extract_group(V.reports(spark, sf), group)
    return run


for _group in R.GROUPS:
    _extractor(_group)

NAMED = ", named AS (" + " UNION ALL ".join(
    f"SELECT sample_id, {i} AS g, '{g}' AS feature_group, name FROM ({_extract_cte(g)}) WHERE name IS NOT NULL"
    for i, g in enumerate(R.GROUPS)) + """),
dict AS (SELECT row_number() OVER (ORDER BY g, name) AS feature_id, feature_group, name FROM (SELECT DISTINCT g, feature_group, name FROM named))
"""


@query("feature_dictionary", over("tel", NAMED + "SELECT * FROM dict"))
def feature_dictionary(spark, sf):
    return R.feature_dictionary(R.all_features(V.reports(spark, sf)))


@query("dictionary_ends", over("tel", NAMED + """(SELECT feature_id, feature_group, name, 'first' AS "end" FROM dict ORDER BY feature_id LIMIT 10)
  UNION ALL (SELECT feature_id, feature_group, name, 'last' AS "end" FROM dict ORDER BY feature_id DESC LIMIT 10)"""))
def dictionary_ends(spark, sf):
    return R.dictionary_ends(feature_dictionary(spark, sf))


@query("numbered_columns", over("tel", NAMED + "SELECT sample_id, feature_id FROM named JOIN dict USING (feature_group, name)"))
def numbered_columns(spark, sf):
    named = R.all_features(V.reports(spark, sf))
    return R.numbered_columns(named, R.feature_dictionary(named))


@query("feature_name_join", over("tel", NAMED + "SELECT feature_id, name, count(*) AS samples FROM named JOIN dict USING (feature_group, name) GROUP BY ALL"))
def feature_name_join(spark, sf):
    named = R.all_features(V.reports(spark, sf))
    numbers = R.feature_dictionary(named)
    counts = R.numbered_columns(named, numbers).groupBy("feature_id").agg(F.count(F.lit(1)).alias("samples"))
    return R.feature_name_join(counts, numbers)


@query("dictionary_merge", over("tel", NAMED + """SELECT feature_id, CASE WHEN feature_id % 4 = 0 THEN upper(name) ELSE name END AS name FROM dict"""))
def dictionary_merge(spark, sf):
    numbers = feature_dictionary(spark, sf)
    later = numbers.filter(F.col("feature_id") % 4 == 0).withColumn("name", F.upper("name"))
    return R.dictionary_merge((numbers, later))


@query("dense_numbering", over("presence", "SELECT 313 + row_number() OVER (ORDER BY name) AS feature_id, name FROM (SELECT DISTINCT name FROM presence)"))
def dense_numbering(spark, sf):
    return R.dense_numbering(V.presence(spark, sf), start=314)


MATRIX_NAMES = ("API:Ntclick", "API:Reg3", "API:Reg0", "API:Nterror")


@query("presence_matrix", over("tel", f""", p AS ({_extract_cte('api')})
SELECT sample_id, """ + ", ".join(f"""max(CASE WHEN name = '{n}' THEN 1 ELSE 0 END) AS "{n}" """ for n in MATRIX_NAMES)
    + "FROM p GROUP BY sample_id"))
def presence_matrix(spark, sf):
    reports = V.reports(spark, sf)
    return R.presence_matrix(R.extract_group(reports, "api"), MATRIX_NAMES, reports).orderBy("sample_id")


def _groups(spark, sf):
    events = V.telemetry(spark, sf)
    sample = F.col("row_id").alias("sample_id")
    return (events.filter("k % 2 = 0").select(sample, F.lit(1).alias("a1"), (F.col("k") % 3 == 0).cast("int").alias("a2")),
            events.filter("k % 3 = 0").select(sample, F.lit(1).alias("b1")),
            events.filter("k % 5 <> 0").select(sample, (F.col("user_id") % 2).cast("int").alias("c1")))


GROUPED = """, a AS (SELECT row_id AS sample_id, 1 AS a1, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS a2 FROM tel WHERE k % 2 = 0),
b AS (SELECT row_id AS sample_id, 1 AS b1 FROM tel WHERE k % 3 = 0),
c AS (SELECT row_id AS sample_id, CAST(user_id % 2 AS INTEGER) AS c1 FROM tel WHERE k % 5 <> 0)
"""


@query("group_matrix_outer_join", over("tel", GROUPED + """SELECT sample_id, coalesce(a1, 0) AS a1, coalesce(a2, 0) AS a2,
  coalesce(b1, 0) AS b1, coalesce(c1, 0) AS c1 FROM a FULL JOIN b USING (sample_id) FULL JOIN c USING (sample_id)"""))
def group_matrix_outer_join(spark, sf):
    return R.group_matrix_outer_join(_groups(spark, sf))


@query("selected_matrix_inner_join", over("tel", GROUPED + "SELECT * FROM a JOIN b USING (sample_id) JOIN c USING (sample_id)"))
def selected_matrix_inner_join(spark, sf):
    return R.selected_matrix_inner_join(_groups(spark, sf))


@query("constant_features", over("tel", f", p AS ({_extract_cte('system')}) SELECT name, count(*) AS n FROM p WHERE name IS NOT NULL "
       "GROUP BY name HAVING count(*) = (SELECT count(*) FROM tel)"))
def constant_features(spark, sf):
    reports = V.reports(spark, sf)
    return R.constant_features(R.extract_group(reports, "system"), reports)


@query("duplicate_names", """WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS name FROM documents)
SELECT lower(name) AS name, count(*) AS n FROM w WHERE name <> '' GROUP BY lower(name) HAVING count(*) > 1""")
def duplicate_names(spark, sf):
    words = V.table(spark, sf, "documents").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("name"))
    return R.duplicate_names(words.filter(F.col("name") != "").distinct())


# ---- calls per process -------------------------------------------------------------------------

CALLS = """, calls AS (SELECT row_id AS sample_id, CASE k % 5 WHEN 0 THEN 'WannaCry' WHEN 1 THEN 'Ryuk' WHEN 3 THEN 'LockBit' ELSE 'Normal' END AS class,
  k / 10 AS score, CAST(p AS INTEGER) AS process, user_id / 2 AS "time", 'Api' || ((k + i) % 5) AS api
  FROM tel, (SELECT unnest(range(2)) AS p), (SELECT unnest(range(4)) AS i) WHERE i <= k % 4)
"""


@query("api_vocabulary", over("tel", CALLS + "SELECT DISTINCT api FROM calls"))
def api_vocabulary(spark, sf):
    return R.api_vocabulary(R.api_calls(V.reports(spark, sf)))


@query("api_call_counts", over("tel", CALLS + """SELECT sample_id, class, score, process, "time", """ + ", ".join(
    f"count(*) FILTER (api = 'Api{i}') AS Api{i}" for i in range(5)) + " FROM calls GROUP BY ALL"))
def api_call_counts(spark, sf):
    return R.api_call_counts(R.api_calls(V.reports(spark, sf)), [f"Api{i}" for i in range(5)])


# ---- selection ---------------------------------------------------------------------------------

def mi_sql(labels: str = "plabels", presence: str = "presence") -> str:
    return f""", lab AS (SELECT sample_id, label FROM {labels}), tot AS (SELECT label, count(*)::DOUBLE AS t FROM lab GROUP BY label),
cnt AS (SELECT name, label, count(*)::DOUBLE AS n FROM {presence} JOIN lab USING (sample_id) GROUP BY ALL),
sh AS (SELECT name, sum(n) AS s FROM cnt GROUP BY name), al AS (SELECT sum(t) AS a FROM tot),
cells AS (SELECT sh.name, tot.label, t, s, a, coalesce(n, 0) AS n FROM sh, tot, al
  LEFT JOIN cnt ON cnt.name = sh.name AND cnt.label = tot.label),
mi AS (SELECT name, greatest(sum(CASE WHEN n > 0 THEN n / a * ln(n * a / (s * t)) ELSE 0 END
  + CASE WHEN t - n > 0 THEN (t - n) / a * ln((t - n) * a / ((a - s) * t)) ELSE 0 END), 0) AS mi FROM cells GROUP BY name),
ch AS (SELECT name, sum((n - s * t / a) ** 2 / (s * t / a)) AS chi2, count(*) - 1 AS df FROM cells GROUP BY name)
"""


def _mi(spark, sf):
    return L.mutual_information(V.presence(spark, sf), V.presence_labels(spark, sf))


@query("mutual_information", over("presence", mi_sql() + "SELECT name, round(mi, 6) AS mi FROM mi"))
def mutual_information(spark, sf):
    return _mi(spark, sf).select("name", F.round("mi", 6).alias("mi"))


@query("mi_threshold", over("presence", mi_sql() + "SELECT name, round(mi, 6) AS mi FROM mi WHERE mi >= 0.01"))
def mi_threshold(spark, sf):
    return L.mi_threshold(_mi(spark, sf)).select("name", F.round("mi", 6).alias("mi"))


@query("score_order", over("presence", mi_sql() + "SELECT name, round(mi, 6) AS mi FROM mi ORDER BY mi DESC, name"))
def score_order(spark, sf):
    return mutual_information(spark, sf).orderBy(F.desc("mi"), "name")


@query("top_k_information_gain", over("presence", mi_sql() + "SELECT name, round(mi, 6) AS mi FROM mi ORDER BY round(mi, 6) DESC, name LIMIT 25"))
def top_k_information_gain(spark, sf):
    return L.top_k(mutual_information(spark, sf))


@query("chi_square", over("presence", mi_sql() + "SELECT name, round(chi2, 6) AS chi2, df FROM ch"))
def chi_square(spark, sf):
    scores = L.chi_square(V.presence(spark, sf), V.presence_labels(spark, sf))
    return scores.select("name", F.round("chi2", 6).alias("chi2"), "df")


def _languages(spark, sf):
    lang = F.col("lang")
    return V.table(spark, sf, "documents").select(
        F.col("doc_id").alias("sample_id"), F.when(lang == "en", 0).when(lang == "fr", 1).otherwise(2).alias("label"))


LANGUAGES = """, langs AS (SELECT doc_id AS sample_id, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END AS label FROM documents)
"""


@query("chi_square_p_value", over("presence", LANGUAGES + mi_sql("langs") + "SELECT name, round(chi2, 6) AS chi2, round(exp(-chi2 / 2), 6) AS p_value FROM ch"))
def chi_square_p_value(spark, sf):
    scores = L.chi_square(V.presence(spark, sf), _languages(spark, sf))
    return scores.select("name", F.round("chi2", 6).alias("chi2"), F.round("p_value", 6).alias("p_value"))


@query("pvalue_filter", over("presence", LANGUAGES + mi_sql("(SELECT * FROM langs WHERE sample_id % 2 = 0)") + """
SELECT n.name, round(exp(-chi2 / 2), 6) AS p_value FROM (SELECT DISTINCT name FROM presence) n LEFT JOIN ch USING (name)
WHERE chi2 IS NULL OR exp(-chi2 / 2) < 0.05"""))
def pvalue_filter(spark, sf):
    """Scored on the training half; features absent from it have no p-value and stay."""
    presence = V.presence(spark, sf)
    scores = L.chi_square(presence, _languages(spark, sf).filter("sample_id % 2 = 0"))
    kept = L.pvalue_filter(L.with_absent(scores, presence, p_value=float("nan")))
    return kept.select("name", F.round(F.nanvl("p_value", F.lit(None).cast("double")), 6).alias("p_value"))


def _split_ids(spark, sf):
    """Temporal-style split of the labelled samples by hash order."""
    labels = V.presence_labels(spark, sf)
    return labels.select("sample_id", F.when(S.seeded_order(F.col("sample_id"), 42) < "3333", "test")
                         .otherwise("train").alias("split"))


SPLIT_IDS = """, ids AS (SELECT sample_id, CASE WHEN md5('42|' || sample_id) < '3333' THEN 'test' ELSE 'train' END AS split FROM plabels)
"""


@query("split_semi_join", over("presence", SPLIT_IDS + """SELECT sample_id, count(*) AS features FROM presence
  WHERE sample_id IN (SELECT sample_id FROM ids WHERE split = 'train') GROUP BY sample_id"""))
def split_semi_join(spark, sf):
    train = _split_ids(spark, sf).filter("split = 'train'")
    return L.restrict(V.presence(spark, sf), train).groupBy("sample_id").agg(F.count(F.lit(1)).alias("features"))


@query("select_by_score", over("presence", SPLIT_IDS + mi_sql(
    "(SELECT * FROM plabels WHERE sample_id IN (SELECT sample_id FROM ids WHERE split = 'train'))",
    "(SELECT * FROM presence WHERE sample_id IN (SELECT sample_id FROM ids WHERE split = 'train'))")
    + "SELECT sample_id, name, split FROM presence JOIN ids USING (sample_id) WHERE name IN (SELECT name FROM mi WHERE mi >= 0.01)"))
def select_by_score(spark, sf):
    return L.select_by_score(V.presence(spark, sf), V.presence_labels(spark, sf), _split_ids(spark, sf))


@query("label_join", over("presence", "SELECT label, toxic, count(*) AS cells, count(DISTINCT sample_id) AS samples FROM presence JOIN plabels USING (sample_id) GROUP BY ALL"))
def label_join(spark, sf):
    joined = V.presence(spark, sf).join(V.presence_labels(spark, sf), "sample_id")
    return joined.groupBy("label", "toxic").agg(F.count(F.lit(1)).alias("cells"), F.countDistinct("sample_id").alias("samples"))


@query("feature_target_split", over("presence", "SELECT sample_id, name, toxic FROM presence JOIN plabels USING (sample_id)"))
def feature_target_split(spark, sf):
    """Features and one target, paired by sample id."""
    target = V.presence_labels(spark, sf).drop("label")
    return V.presence(spark, sf).join(target, "sample_id")
