import math
import random

import numpy as np
import pytest

from palisade.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score long, block string"


def brute(rows, k=5, every=50):
    import numpy as np
    own = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ints = [math.floor(256 * float(np.float32(x))) for x in v]
        own[i] = max(own.get(i, ints), ints)
    out = set()
    for q, v in own.items():
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in own.items() if i != q)
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, "x") for i, v in rows], SCHEMA)


def test_equals_brute_force_over_shards(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(16)]) for i in range(600)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # a third are the same vector: ties
    got = {tuple(r) for r in top_k(table(spark, rows), every=20, shard_rows=150, block_rows=20, leaf=16).collect()}
    assert got == brute(rows, every=20)


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -0.001]), (50, None), (100, [nan, 1.0]), (150, [inf, 0.0]), (200, []), (1, [None, 1.0]), (2, [0.5]), (2, [0.25]), (3, [-1.0, 2.0, 3.0]),
            (None, [1.0, 1.0]), (-50, [0.0, 0.0]), (4, [1e12, 1.0])]
    got = {tuple(r) for r in top_k(table(spark, rows)).collect()}
    assert got == brute(rows) and {r[0] for r in got} == {0, 200, -50}
    assert top_k(table(spark, [])).count() == 0
    assert top_k(table(spark, [(0, [1.0])])).count() == 0


def exact(rows, k=5, every=50):
    whole = {i: [int(np.floor(256 * np.float64(x))) for x in v] for i, v in rows}
    out = []
    for q in sorted(i for i in whole if i % every == 0):
        scores = sorted(((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return out


@pytest.mark.parametrize("large", [1e6, 3e6, 5e6])
def test_large_components_are_ranked_exactly(spark, large):
    rows = [(i, [large * (1 + (i % 7) * 1e-9), float(i % 5) - 2, -large if i % 3 else large]) for i in range(130)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, top_k(df, leaf=8, shard_rows=40).collect()))
    assert got == exact(rows)


def test_products_that_wrap_in_64_bits(spark):
    rows = [(0, [1e8, 1.0]), (1, [1e8, 2.0]), (2, [-1e8, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond what a long holds"):
        top_k(df).collect()
    with pytest.raises(Exception, match="beyond 2"):
        top_k(spark.createDataFrame([(0, [1e17]), (1, [1.0])], "vec_id long, embedding array<double>")).collect()
    cancel = [(0, [1e8, 1e8, 1.0]), (1, [1e8, -1e8, 5.0]), (2, [1e8, -1e8, 4.0]), (3, [-1e8, 1e8, 9.0])]  # products pass 2**63, scores do not
    got = sorted(map(tuple, top_k(spark.createDataFrame(cancel, "vec_id long, embedding array<double>")).collect()))
    assert got == exact(cancel) and [r[2] for r in got] == [3, 1, 2]
