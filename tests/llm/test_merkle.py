import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from palisade.llm import merkle


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def mark(text):
    tree = []
    for s in (text or "").split("\n\n"):
        lines = [",".join("" if x == "" else sha("l" + x)[:16] for x in re.sub(r"([.!?][ \t])", "\\1\x01", p).split("\x01")) for p in s.split("\n")]
        tree.append(";".join(lines))
    sections = [sha("s" + ";".join(sha("p" + p)[:16] for p in s.split(";")))[:16] for s in tree]
    return sha("r" + "|".join(sections)) + "|" + "|".join(tree)


def near(a, b):
    if a[:64] == b[:64]:
        return 1.0
    x, y = ({v for v in re.split("[|;,]", m[65:]) if v} for m in (a, b))
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def brute(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for k, (i, t) in enumerate(order):
        follow = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + follow[:half]
        a, b, c = mark(t), mark(edited), mark(follow)
        out.append((i, len(t), sha(edited), a, b, near(a, b), near(a, c)))
    return sorted(out, key=repr)


def texts(n, seed):
    rng = random.Random(seed)
    say = lambda: " ".join(rng.choice(["a", "bé", "𝄞x", "End.", "So?", "yes"]) for _ in range(rng.randrange(1, 12)))
    return [rng.choice(["\n", "\n\n", "\n\n\n"]).join(say() for _ in range(rng.randrange(1, 7))) for _ in range(n)]


@pytest.mark.parametrize("spread", ["dense", "sparse"])
def test_equals_brute_force(clashing, spread, monkeypatch):
    rng = random.Random(spread)
    ids = range(300) if spread == "dense" else sorted({rng.choice((10**12, 5, -10**9)) + rng.randrange(200) for _ in range(300)})
    rows = list(zip(ids, texts(len(ids), spread)))
    monkeypatch.setattr(merkle, "with_next", lambda docs, f=merkle.with_next: f(docs, rows_each=10))
    got = sorted(map(tuple, merkle.compare_with_next(clashing(rows)).collect()), key=repr)
    assert got == brute(rows)


def test_cases(docs):
    rows = [(1, None), (2, ""), (3, "one. two"), (3, "one. two"), (3, "other"), (None, "x"), (None, None), (4, "Long. " * 100_000), (5, "\x01a. \x01b"), (6, "a. b")]
    got = sorted(map(tuple, merkle.compare_with_next(docs(rows)).collect()), key=repr)
    assert got == brute(rows)
    assert merkle.compare_with_next(docs([])).count() == 0
    alone = merkle.compare_with_next(docs([(7, "abcd")])).first()
    assert (alone.edited_sha256, alone.near_next) == (sha("abab"), 1.0)


def test_edits_are_located(spark):
    a, b = "h. i\nk\n\nsame\n\nx\ny", "h. j\nk\n\nsame\n\nx\ny\nz"
    row = spark.createDataFrame([(a, b)], "a string, b string").select(merkle.edits(merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))).alias("e")).first()
    assert [tuple(e) for e in row.e] == [(0, 0), (2, 2)]
