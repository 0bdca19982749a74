import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm.vector_codes import Blocks, encode, hilbert_keys

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts, entries, rounds):
    """Codes by comparing every part with every entry, in Python's whole numbers."""
    kept = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(v) for _, v, _ in kept), default=1) // parts) * parts
    step = width // parts
    cut = [[tuple((v + [0] * (width - len(v)))[p * step:(p + 1) * step]) for p in range(parts)] for _, v, _ in kept]
    books = [[row[p] for row in cut[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            owned = {}
            for row in cut:
                owned.setdefault(near(row[p], books[p])[1], []).append(row[p])
            books[p] = [tuple(sum(c) // len(owned[k]) for c in zip(*owned[k])) if k in owned else e for k, e in enumerate(books[p])]
    found = [[near(row[p], books[p]) for p in range(parts)] for row in cut]
    error = [sum(f[0] for f in row) for row in found]
    by_label = {}
    for (_, _, label), e in zip(kept, error):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{f[1]:02x}" for f in row), e, by_label[label], digest) for (i, _, label), row, e in zip(kept, found, error)), key=repr)


def coded(spark, rows, **how):
    return sorted(map(tuple, encode(spark.createDataFrame(rows, SCHEMA), **how).collect()), key=repr)


def vectors(n, width, seed, spread=0.3):
    draw = random.Random(seed)
    return [(i, [draw.gauss(0, spread) for _ in range(width)], draw.choice([0, 1, 2, None])) for i in range(n)]


def test_codes_equal_brute_force_over_small_blocks(spark):
    rows = vectors(300, 8, 1)
    assert coded(spark, rows, parts=4, entries=16, chunk_rows=70, block=5) == brute(rows, 4, 16, 2)


def test_ties_repeats_ragged_and_bad_vectors(spark):
    rows = [(i, [float(i % 3), 1.0, 0.5, -2.0], 1) for i in range(40)]  # few different parts: every distance ties
    rows += [(7, [0.0, 1.0, 0.5, -2.0], None), (None, [1.0, 1.0, 1.0, 1.0], None), (90, [3.0], 2), (91, [], 2), (92, None, 1),
             (93, [1.0, None, 1.0, 1.0], 1), (94, [float("nan"), 1.0, 1.0, 1.0], 1), (95, [float("inf"), 1.0, 1.0, 1.0], 1)]
    assert coded(spark, rows, parts=4, entries=8, chunk_rows=16, block=4) == brute(rows, 4, 8, 2)


@pytest.mark.parametrize("large", [3e5, 1e12])
def test_large_components_are_exact(spark, large):
    rows = [(i, [large, float(i), -large, large * (1 if i < 6 else 1 + 2 ** -20 if large < 1e6 else 1)], 0) for i in range(12)]
    assert coded(spark, rows, parts=2, entries=4) == brute(rows, 2, 4, 2)


def test_what_a_long_cannot_hold_fails_with_a_message(spark):
    with pytest.raises(Exception, match="beyond"):
        coded(spark, [(0, [1e30, 0.0], 0), (1, [0.0, 0.0], 0)], parts=2)
    with pytest.raises(Exception, match="beyond what a long holds"):
        coded(spark, [(0, [-1e14, 0.0], 0), (1, [1e14, 0.0], 0)], parts=2, entries=1, rounds=0)


def test_empty_table_and_clashing_columns(spark):
    assert coded(spark, []) == []
    rows = vectors(50, 4, 3)
    wide = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("v", "row", "code", "error", "rows", "blocks", "entry", "_label")})
    assert sorted(map(tuple, encode(wide, parts=2, entries=4).collect()), key=repr) == brute(rows, 2, 4, 2)


def test_shortlists_keep_every_nearest_entry():
    draw = np.random.default_rng(5)
    rows, entries = draw.integers(-500, 500, (600, 4)), draw.integers(-500, 500, (32, 4))
    part = Blocks.sorted(rows, 16)
    far = ((part.rows[:, None, :] - entries) ** 2).sum(-1)
    nearest, away, _ = part.assign(entries, False)
    assert (nearest == far.argmin(1)).all() and (away == far.min(1)).all()
    listed = np.repeat(part.shortlists(entries), part.ends - part.cuts, axis=0)
    assert listed[np.arange(600), far.argmin(1)].all() and listed.mean() < 0.9


def test_curve_visits_neighbours_one_after_another():
    grid = np.stack(np.meshgrid(np.arange(16), np.arange(16)), -1).reshape(-1, 2)
    path = grid[np.argsort(hilbert_keys(grid))]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
