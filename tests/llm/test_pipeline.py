"""Stages against brute force on small documents, and the whole pipeline as their composition."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from .test_near_dedup import brute as near_brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
EN, DE = "the and of house with that window through where thing".split(), "der und haus fenster nicht durch schön straße wohin ding".split()


def sample(n=120):
    rng, rows = random.Random(8), []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        words = [rng.choice(EN if lang == "en" else DE) for _ in range(rng.randrange(8, 70))]
        if i % 10 == 0 and rows:
            words = rows[-1][1].split()  # a copy
        if i % 7 == 0:
            words.insert(3, f"+1 ({200 + i}) 555-{1000 + i}")
        rows.append((i, " ".join(words), lang, rng.choice(["a", "b", "c"])))
    return rows


@pytest.fixture(scope="module")
def edge_rows():
    return [*sample(40), (200, None, "en", "a"), (201, "", None, None), (202, " 12 -- !", "en", "b"), (203, "the house " * 1000, "en", "c"),
            (204, "the window and mail a.b@c.example.org", None, None), (204, "the window and mail a.b@c.example.org", None, None), (None, "where the thing is", "en", "a"),
            (None, "where the thing is", "en", "a"), (205, "der ding", "de", "zz"), (205, "other text of the same id", "de", "zz")]


def held(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def extra(df):
    """Columns with names that the stages use themselves."""
    return df.withColumns({c: F.lit("x") for c in ("row", "doc", "times", "entities", "n", "kept", "accepted", "taken", "d")})


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_empty_table(spark, docs, name, stage):
    out = stage(spark, docs([]), "")
    assert out.count() == 0 and (name == "packing" or out.columns == COLUMNS)


def test_language_stage_keeps_what_has_a_language(spark, docs, edge_rows):
    df = extra(docs(edge_rows))
    out = P.language_stage(spark, df, "")
    assert out.columns == df.columns
    want = held(df)
    for row in list(want):
        if not re.search("[^\\W\\d_]", row[1] or ""):
            del want[row]
    assert held(out) == want


def test_near_duplicate_stage_keeps_one_of_each_group(spark, docs, edge_rows):
    df = extra(docs(edge_rows))
    out = P.near_duplicate_stage(spark, df, "")
    assert out.columns == df.columns
    numbered = dict(enumerate(sorted({(i, t or "") for i, t, *_ in edge_rows if i is not None})))
    kept = [numbered[k][0] for k, (_, _, stays) in near_brute((k, t) for k, (_, t) in numbered.items()).items() if stays]
    got = [r.doc_id for r in out.collect()]
    assert sorted(i for i in got if i is not None) == sorted(kept) and got.count(None) == 2 and kept.count(205) == 2 and kept.count(204) == 1


def test_near_duplicate_stage_keeps_unlike_texts_of_one_id(spark, docs):
    words = [f"w{i}" for i in range(100)]
    rows = [(1, "alpha beta gamma delta epsilon zeta"), (1, "quite another text that has other words"), (1, " ".join(words)), (2, " ".join(words[:99])), (1, " ".join(words))]
    out = P.near_duplicate_stage(spark, extra(docs(rows)), "")
    texts = [r.text for r in out.collect()]
    assert len(texts) == 3 and {rows[0][1], rows[1][1]} < set(texts)


def test_near_duplicate_stage_links_at_80_per_cent(spark, docs):
    """96 shingles each; with the last k words changed, 96 - k of 96 + k are shared: 0.811 for 10, 0.794 for 11."""
    words = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-10] + ["x"] * 5 + [f"y{i}" for i in range(5)])), (3, " ".join(words[:-11] + [f"z{i}" for i in range(11)]))]
    assert near_brute(rows, 80) == {1: (96, 1, True), 2: (96, 1, False), 3: (96, 3, True)}
    assert [r.doc_id for r in P.near_duplicate_stage(spark, docs(rows), "").orderBy("doc_id").collect()] == [1, 3]


def test_surrogate_stage_changes_only_personal_data(spark, docs, edge_rows):
    df = extra(docs(edge_rows))
    out = P.surrogate_stage(spark, df, "")
    assert out.columns == df.columns and out.count() == df.count()
    assert {r.entities for r in out.select("entities").collect()} == {"x"}
    gone = re.compile(r"\+1 \(\d{3}\) 555-\d{4}|a\.b@c\.example\.org")
    clean = {r: n for r, n in held(df).items() if not gone.search(r[1] or "")}
    got = held(out)
    assert all(got[r] == n for r, n in clean.items())
    old = {m for r in held(df) for m in gone.findall(r[1] or "")}
    assert not any(m in (r[1] or "") for r in got for m in old) and all(r[4] == len(r[1]) for r in got if r[1] is not None)


def test_mixing_stage_repeats_what_the_mix_takes(spark, docs, edge_rows):
    df = extra(docs(edge_rows))
    out = P.mixing_stage(spark, df, "")
    assert out.columns == df.columns
    given, got = held(df), held(out)
    assert all(n <= 3 * given[r] and (r[1] or "").split() for r, n in got.items())
    size = {s: sum(len((r[1] or "").split()) * n for r, n in given.items() if r[3] == s) for s in ("a", "b", "c", "zz", None)}
    taken = {s: sum(len(r[1].split()) * n for r, n in got.items() if r[3] == s) for s in size}
    assert all(taken[s] <= 3 * size[s] for s in size) and abs(sum(taken.values()) - sum(size.values())) <= 25


def test_packing_stage_covers_every_token(spark, docs, edge_rows):
    out = P.packing_stage(spark, extra(docs(edge_rows)), "").collect()
    assert sum(r.length for r in out) == sum(len((t or "").split()) for _, t, *_ in edge_rows)


def test_run_is_the_composition_of_the_stages(spark, docs, tmp_path):
    docs(sample()).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in P.run(spark, str(tmp_path)).collect())
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, step, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        step = spark.read.parquet(f"{tmp_path}/{i}")
    assert got == Counter(tuple(r) for r in step.collect()) and got
    kept = {i for i, (_, _, k) in near_brute([(i, t) for i, t, *_ in sample()]).items() if k}
    assert {r[0] for r in got} <= kept
