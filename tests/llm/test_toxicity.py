import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import toxicity as X


def corpus(n, seed=1):
    """Texts of two languages, a third of them with an insult of their language somewhere."""
    draw, rows, marks = random.Random(seed), [], []
    plain = {"en": "the of and river stone water field cloud walking", "de": "der die und fluss stein wasser feld wolke gehen"}
    insult = {"en": ["moronic", "scummy"], "de": ["trottelig", "trotteln"]}
    for i in range(n):
        lang = draw.choice(["en", "de"])
        words = [draw.choice(plain[lang].split()) + draw.choice(["", "", "s", "x"]) for _ in range(draw.randint(3, 60))]
        toxic = draw.random() < 0.33
        if toxic:
            words.insert(draw.randrange(len(words) + 1), draw.choice(insult[lang]))
        rows.append((i, " ".join(words), lang))
        marks.append((i, int(toxic)))
    return rows, marks


@pytest.fixture(scope="module")
def learnt(spark):
    rows, marks = corpus(700)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    return X.fit(docs, labels, F.col("doc_id") % 3 != 1, steps=300), rows, dict(marks)


def test_held_out_accuracy(learnt):
    model, rows, marks = learnt
    held = [(t, marks[i]) for i, t, _ in rows if i % 3 == 1]
    scores, language = model.score([t for t, _ in held])
    right = np.mean((scores >= 0.7) == [m == 1 for _, m in held])
    assert right > 0.97 and ((0 <= scores) & (scores <= 1)).all()
    assert {X.LANGUAGES[i] for i in language} <= {"en", "de", "other"}


def test_insult_at_any_place_of_a_long_text(learnt):
    model, _, _ = learnt
    calm = "the river and the stone of water " * 120_000  # about 4 MB
    middle = calm[:2_097_150].rsplit(" ", 1)[0] + " moronic " + calm[2_097_150:]
    scores, _ = model.score([calm, middle, calm + "moronic", "moronic " + calm])
    assert scores[0] < 0.7 and (scores[1:] >= 0.7).all()


def test_pieces_lose_no_window(monkeypatch):
    text = " ".join(f"w{i}" for i in range(500)) + " " + "z" * 900 + " last  "
    windows = lambda: {tuple(w[a:a + 3]) for w, _, first, _, _ in X.pieces([text]) for a, b in zip(first, [*first[1:], len(w)])
                       for a in range(a, b - 2)}
    whole = windows()
    monkeypatch.setattr(X, "_SLICE", 64)
    assert windows() == whole and len(list(X.pieces([text]))) > 20


def test_texts_null_empty_and_equal(spark, learnt, clashing):
    model = learnt[0]
    rows = [(1, None), (2, ""), (3, " .,- "), (None, "the moronic river"), (5, "the moronic river"), (5, "the moronic river")]
    out = X.score(clashing(rows), model)
    got = out.collect()
    assert len(got) == 6 and "rank" in out.columns and "text" not in out.columns
    by = {}
    for r in got:
        by.setdefault(r.doc_id if r.doc_id in (1, 2, 3) else "same", set()).add(r.score)
    assert all(len(v) == 1 for v in by.values()) and by[1] == by[2] == by[3]
    assert X.score(clashing([]), model).collect() == []


def test_no_labels_to_learn_from(spark, docs):
    some = docs([(1, "the river"), (2, None)])
    for marks, constant in (([], 0.0), ([(1, 0)], 0.0), ([(1, 1)], 1.0), ([(None, 1), (2, None), (1, 7)], 0.0)):
        model = X.fit(some, spark.createDataFrame(marks, "doc_id long, toxic int"), F.lit(True))
        assert {r.score for r in X.score(some, model).collect()} == {constant}


def test_held_out_labels_change_nothing(spark, learnt):
    rows, marks = corpus(700)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    other = spark.createDataFrame([(i, 1 - m if i % 3 == 1 else m) for i, m in marks], "doc_id long, toxic int")
    model = X.fit(docs, other, F.col("doc_id") % 3 != 1, steps=300)
    texts = [t for _, t, _ in rows]
    assert (model.score(texts)[0] == learnt[0].score(texts)[0]).all()


def test_threshold_is_between_the_classes():
    raw = np.array([-3.0, -2.0, -1.0, 2.0, 3.0])
    assert X.threshold(raw, np.array([0, 0, 0, 1, 1]), np.ones(5), 0.7) == 0.5


def test_every_labelled_row_is_learnt_from(spark):
    """Toxic texts are all beyond 30,000 characters, and rows are dealt to several shards."""
    rows, marks = corpus(600, 5)
    calm, toxic = " the river and the stone of water" * 1000, dict(marks)
    texts = {i: t + calm if toxic[i] else t for i, t, _ in rows}
    model = X.fit(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"),
                  F.col("doc_id") % 3 != 1, shard_chars=1_000_000, epochs=4, steps=100)
    held = [i for i in texts if i % 3 == 1]
    scores, _ = model.score([texts[i] for i in held])
    assert np.mean((scores >= 0.7) == [toxic[i] == 1 for i in held]) > 0.95


def test_best_windows_of_long_texts_are_those_of_the_whole(monkeypatch):
    draw = np.random.default_rng(2)
    net = X.Network.new(4, 3, 1, 1.0)
    sizes = np.array([3, 700, 41, 130])
    word, stem = (draw.permutation(sizes.sum()) for _ in range(2))  # no window twice: equal ones may stand for each other
    whole = net.best(word, stem, sizes)
    monkeypatch.setattr(X, "_PART", 64)
    parts = net.best(word, stem, sizes)
    assert np.allclose(whole[0], parts[0]) and (whole[1] == parts[1]).all()


def test_texts_move_once_whatever_the_labels_size(spark, monkeypatch):
    """Without a broadcast join, as with many labels, only one exchange carries texts; rows that share a doc_id, null and unlabelled texts are dealt rightly."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        made, write = [], X.durable
        monkeypatch.setattr(X, "durable", lambda df: made.append(df) or write(df))
        texts = [(i, f"the river number {i}") for i in range(20)] + [(3, "the same number"), (4, None), (None, "nobody"), (50, "not marked")]
        marks = [(i, i % 2) for i in range(20)] + [(3, 0), (60, 1), (7, 5), (None, 1)]
        X.fit(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"), F.lit(True),
              shard_chars=100, epochs=1, steps=1)
        plan = made[0]._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert len(re.findall(r"\) Exchange\nInput \[\d+\]: \[[^\n]*\btext#", plan)) == 1
        key = lambda r: (r[0], r[1] or "", r[2])
        got = sorted(((r.doc_id, r.text, r.toxic) for r in made[0].collect()), key=key)
        assert got == sorted([(i, t, i % 2) for i, t in texts if i is not None and i < 20], key=key)
        assert made[0].groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
