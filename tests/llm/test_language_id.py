import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import language_id
from palisade.llm.language_id import fit, identify, page_language, page_text

WORDS = {"en": "the and of house with that window through where thing".split(), "de": "der und haus fenster nicht durch schön straße wohin ding".split(),
         "fr": "le la maison fenêtre avec où chose être garçon été".split()}


def made(lang, n, rng):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture
def model(spark):
    rng = random.Random(0)
    rows = [(made(x, 30, rng), x) for x in WORDS for _ in range(60)]
    return fit(spark.createDataFrame(rows + [(None, "en"), ("x", None)], "text string, lang string"), train_rows=100)


def judged(spark, rows, model, **more):
    df = spark.createDataFrame(rows, "id int, text string, declared string, host string").withColumns({"share": F.lit(1), "grams": F.lit(2), "lang2": F.lit("q")})
    return {r.id: r for r in identify(df.drop("share", "grams"), model, **more).collect()}


def test_held_out_accuracy(spark, model):
    assert model.languages == ("de", "en", "fr")
    rng = random.Random(9)
    langs = [rng.choice(list(WORDS)) for _ in range(200)]
    got = judged(spark, [(i, made(x, 6, rng), None, None) for i, x in enumerate(langs)], model)
    assert sum(got[i].lang == x for i, x in enumerate(langs)) >= 190
    assert all(r.accepted == (r.confidence >= 0.5) for r in got.values())


def test_other_evidence_decides_short_texts(spark, model):
    rng = random.Random(1)
    rows = [(i, made("de", 20, rng), "de", "www.firma.de") for i in range(40)] + [(100 + i, made("fr", 20, rng), "fr-FR", f"h{i % 3}.exemple.fr") for i in range(40)]
    rows += [(500, "zz", "de", "www.firma.de"), (501, "zz", "fr", "new.exemple.fr"), (502, "zz", None, "new.exemple.fr"), (503, "zz", "FR_ca", None)]
    got = judged(spark, rows, model)
    assert [got[i].lang for i in (500, 501, 502, 503)] == ["de", "fr", "fr", "fr"]
    assert got[501].confidence > got[502].confidence  # one piece of evidence more


def test_cases(spark, model):
    rows = [(1, None, "en", "a.com"), (2, "", None, None), (3, "123 --- !!", "de", ""), (4, "the house " * 60_000, "??", "x"), (5, "the", "en", "h"), (5, "the", "en", "h")]
    df = spark.createDataFrame(rows, "id int, text string, declared string, host string")
    out = sorted(map(tuple, identify(df, model).select("id", "lang", "accepted").collect()))
    assert out[:3] == [(1, "und", False), (2, "und", False), (3, "und", False)] and out[3] == (4, "en", True) and out[4] == out[5]
    assert identify(df.limit(0), model).count() == 0
    assert [r.accepted for r in identify(df.filter("id = 4"), model, wanted=["fr"]).collect()] == [False]
    none = fit(df.selectExpr("text", "cast(null as string) AS lang"))
    assert none.languages == ("und",) and identify(df, none).count() == 6


def test_columns_of_any_name_stay(spark, model):
    df = spark.createDataFrame([(1, "the house", "en", "h", "k", 5)], "id int, text string, declared string, host string, own string, `a b` int")
    assert identify(df, model).columns == ["id", "own", "a b", "lang", "confidence", "text_lang", "accepted"]


def test_pages(spark):
    html = '<!DOCTYPE html><HTML class="x" lang=\'fr-CA\'><style>p{}</style><script>if (a < b) "</p>"</script><!-- no\n--><body>Le <b>gar&ccedil;on</b> &amp; lui</body>'
    row = spark.createDataFrame([(html,), (None,)], "h string").select(page_language(F.col("h")).alias("l"), page_text(F.col("h")).alias("t")).collect()
    assert row[0].l == "fr-CA" and row[0].t.split() == ["Le", "gar&ccedil;on", "&", "lui"] and row[1].t is None


def test_slices_equal_the_whole(monkeypatch):
    rng = random.Random(4)
    for text in ["".join(rng.choice(["a", "B", "é", " ", "1", "-", "ß", "\n"]) for _ in range(rng.randint(0, 90))) for _ in range(200)] + [None, "", "12 -", " a", "a "]:
        whole = np.concatenate([np.zeros(0, np.int64), *language_id._slices(text)])
        for size in (1, 2, 7):
            monkeypatch.setattr(language_id, "_SLICE", size)
            assert np.concatenate([np.zeros(0, np.int64), *language_id._slices(text)]).tolist() == whole.tolist()
        monkeypatch.undo()


def test_cells_of_a_text():
    """Brute force over the definition: bytes of lower-cased letters, one blank for the rest, a blank at either end."""
    def brute(text):
        raw = text.lower().encode()
        line, last = b" ", True
        for byte in raw:
            letter = 97 <= byte <= 122 or byte >= 128
            if letter or last:
                line += bytes([byte]) if letter else b" "
            last = letter
        line += b" "
        return [((line[i] << 16 | line[i + 1] << 8 | line[i + 2]) * 2654435761 % 2**32) >> 16 for i in range(len(line) - 2)]
    for text in ("Das ist, nun ja: schön!", " x", "a1b2  c"):
        assert np.concatenate(list(language_id._slices(text))).tolist() == brute(text)


def test_memory_follows_a_slice(spark, model):
    """A text of 40 MB, added up in the driver's own process so that its memory can be watched."""
    import tracemalloc
    text = "das ist der lange text " * 1_700_000
    tracemalloc.start()
    total = sum(len(cells) for cells in language_id._slices(text))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total > 39_000_000 and peak < 20_000_000
