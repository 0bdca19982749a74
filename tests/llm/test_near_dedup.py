import random
from itertools import combinations

import numpy as np
import pytest

from palisade.llm.common import word_hashes
from palisade.llm.graph import components
from palisade.llm.near_dedup import NearDedup, least_matches, near_duplicates, near_rows


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def varied(rng, words, rate):
    return [rng.choice("abcdefgh") * 3 if rng.random() < rate else w for w in words]


def family(seed, groups=6, members=25):
    """Chains of copies of copies, some near enough and some not, with exact copies and unlike texts between them."""
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        text = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(3, 160))]
        for _ in range(members):
            rows.append(" ".join(text))
            if rng.random() < 0.7:
                text = varied(rng, text, rng.choice((0.0, 0.005, 0.01, 0.02, 0.06)))
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("block", [512, 4])
def test_equals_brute_force(docs, block):
    rows = family(block)
    assert result(near_duplicates(docs(rows), NearDedup(block=block))) == brute(rows)


def test_cases(clashing):
    long = "Long TEXT " * 60_000
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "ONE"), (6, "one two"), (7, long), (8, long.lower()), (9, "a b c d e f"), (9, "a b c d e f"), (10, "   ")]
    got = result(near_duplicates(clashing([*rows, (None, "one"), (None, None)])))
    assert got.pop(None) == (0, None, True)
    want = brute(dict(rows).items())
    assert got == want and got[5] == (1, 4, False) and got[8] == (2, 7, False) and got[1] == (0, 1, True)


def test_empty_table(docs):
    assert near_duplicates(docs([])).count() == 0


def test_texts_of_one_id_are_documents_of_their_own(docs):
    near = "z b c d e " * 12
    rows = [(1, "a b c d e"), (1, "z b c d f"), (1, "z b c d f"), (2, "z b c d f"), (3, "a b c d e"), (5, near), (5, near + "x"), (4, None), (4, ""), (None, "a b c d e")]
    got = sorted(map(tuple, near_rows(docs(rows)).select("doc_id", "n_shingles", "component_id", "kept", "stays").collect()), key=repr)
    assert got == sorted([(1, 1, 1, True, True), (1, 1, 1, True, True), (2, 1, 1, False, False), (3, 1, 1, False, False), (4, 0, 4, True, True), (4, 0, 4, True, True),
                          (5, 5, 5, True, True), (5, 6, 5, True, True), (None, 0, None, True, True)], key=repr)
    copies = [(5, " ".join(f"w{i}" for i in range(200))), (5, " ".join(f"w{i}" for i in range(201))), (6, " ".join(f"w{i}" for i in range(200)))]
    got = near_rows(docs(copies)).collect()
    assert [r.component_id for r in got] == [5, 5, 5] and sum(r.stays for r in got) == 1 and sorted(r.kept for r in got) == [False, True, True]


def test_words_are_ascii_separated():
    texts = ["Ab  cD\x0b\x1cx", "", None, "é É z", "q" * (1 << 21) + " r"]
    _, counts = word_hashes(texts)
    assert counts.tolist() == [len((t or "").encode().split()) for t in texts]
    one, _ = word_hashes(["a B a"])
    assert one[0] == one[2] != one[1] == word_hashes(["b"])[0][0]
    long, n = word_hashes([" ".join(f"w{i % 1000}" for i in range(400_000))])
    assert n[0] == 400_000 and len(np.unique(long)) == 1000


def test_posterior_threshold():
    from math import comb
    n, t = 32, 0.85
    m = least_matches(n, 85, 1e-3)
    chance = lambda m: sum(comb(n + 1, k) * t**k * (1 - t) ** (n + 1 - k) for k in range(m + 1))
    assert chance(m) >= 1e-3 > chance(m - 1)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (5, 5), (20, 3), (30, 31), (31, 30), (None, 4)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 20: 1, 6: 6, 7: 6, 8: 6, 9: 6, 30: 30, 31: 30, **{i: 100 for i in range(100, 141)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
