import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm.language_model import _numbered, _numbers, _packed, _unpacked, score



def held():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2


def brute(rows, order, strength=300.0):
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), "</s>"]
    grams, contexts = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            w = ["<s>", *tokens(t)]
            for k in range(1, len(w)):
                for n in range(1, order + 1):
                    if n == 1 or k - n + 1 >= 0:
                        grams[tuple(w[k - n + 1:k + 1])] += 1
                        contexts[tuple(w[k - n + 1:k])] += 1
    total, vocabulary = contexts[()], sum(len(g) == 1 for g in grams)

    def p(context, w):
        base = (grams[(w,)] + 1) / (total + vocabulary + 1)
        for n in range(1, len(context) + 1):
            own = context[-n:]
            base = (grams[(*own, w)] + strength * base) / (contexts[own] + strength)
        return base
    out = []
    for i, t in rows:
        w = ["<s>", *tokens(t)]
        plain = sum(math.log10(p((), x)) for x in w[1:])
        full = sum(math.log10(p(tuple(w[max(0, k - order + 1):k]), w[k])) for k in range(1, len(w)))
        out.append((i, held(i), len(w) - 1, sum(grams[(x,)] > 0 for x in w[1:]), total, plain, full))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_equals_brute_force(clashing, order):
    rng = random.Random(order)
    rows = [(i, " ".join(rng.choice(["the", "The", "of", "x", "y", f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(0, 40)))) for i in range(80)]
    rows += [(200, None), (201, " \n"), (None, "the x"), (5, rows[5][1]), (202, "the of x " * 30_000)]
    got = sorted(map(tuple, score(clashing(rows), held(), order=order, least_blocks=5).collect()), key=repr)
    want = sorted(brute(rows, order), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_query_scores_with_trigrams(spark, docs, tmp_path):
    from palisade.llm.queries import op9_language_model
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(1, 30)))) for i in range(60)]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in op9_language_model(spark, str(tmp_path)).collect()}
    assert got == pytest.approx({r[0]: r[6] for r in brute(rows, 3)}, rel=1e-9)


def test_states_add_up_to_one(docs):
    """After a seen word, an unseen word and at the start: the probabilities of the vocabulary, the end and one unknown word."""
    train = [(i, t) for i, t in enumerate(["a b a b c", "b a c", "c c a", "a b"] * 3)]
    for context in ("a", "zzz", ""):
        asked = [(None, f"{context} {w}") for w in ("a", "b", "c", "unknown")] + [(None, context)]
        rows = score(docs(train + asked), held(), least_blocks=2).filter("doc_id is null").collect()
        # take off what comes before and after the word that is asked for, by the scores of brute force
        scores = {t: s[6] for (_, t), s in zip(train + asked, brute(train + asked, 2))}
        assert sorted(r.score for r in rows) == pytest.approx(sorted(scores[t] for _, t in asked))
    assert [sum(_conditional(train, c)) for c in ("<s>", "a", "zzz")] == pytest.approx([1.0] * 3)


def _conditional(rows, context):
    """p(w | context) for every word of the vocabulary, the end and an unknown one, from the formulas."""
    counts, after = Counter(), Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            w = ["<s>", *t.split(), "</s>"]
            counts.update(w[1:])
            after.update(zip(w, w[1:]))
    total, seen = sum(counts.values()), sum(n for (a, _), n in after.items() if a == context)
    for word in [*counts, "unknown"]:
        base = (counts[word] + 1) / (total + len(counts) + 1)
        yield (after[context, word] + 300 * base) / (seen + 300)


def test_no_training_texts(docs):
    r = score(docs([(None, "a b")]), held()).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)
    assert score(docs([]), held()).count() == 0


def test_codes_come_back():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5000):
        keys = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        assert (_unpacked(_packed(keys)) == keys).all()
        values = rng.integers(0, 600, n)
        assert (_numbered(_numbers(values)) == values).all()
