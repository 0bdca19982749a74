import itertools
import random

import numpy as np
import pytest

from palisade.llm.mixing import fit, mix
from palisade.llm.packing import bounds, pack


def water(sizes, weights, most=3):
    """Targets by filling up one source after the other."""
    total, full, target = sum(sizes), set(), {}
    while True:
        rest = total - sum(most * sizes[i] for i in full)
        free = sum(w for i, w in enumerate(weights) if i not in full)
        target = {i: most * s if i in full else rest * weights[i] / free for i, s in enumerate(sizes)}
        over = {i for i in target if i not in full and target[i] > most * sizes[i]}
        if not over:
            return target
        full |= over


def test_mix(clashing):
    rng = random.Random(5)
    rows = [(i, " ".join("x" * rng.randrange(1, 60)), "en", s) for i, s in enumerate(rng.choices(["b", "a", "Z", "é", None], [60, 5, 8, 20, 7], k=400))]
    rows += [(1000, None, "en", "a"), (1001, "", "en", "b"), (None, "x y", "en", "b"), (1002, "x y", "en", "b"), (1002, "x y", "en", "b")]
    got = mix(clashing(rows)).collect()
    names = ["Z", "a", "b", "é", None]
    size = [sum(len((r[1] or "").split()) for r in rows if r[3] == n) for n in names]
    want = water(size, [5, 2, 1, 5, 2])
    source = {r[0]: r[3] for r in rows}
    assert len(got) == len(rows)
    for i, n in enumerate(names):
        own = [r for r in got if source[r.doc_id] == n]
        assert {r.source_size for r in own} == {size[i]} and all(abs(r.target - want[i]) < 1e-6 for r in own)
        assert abs(sum(r.taken for r in own) - want[i]) <= 1
    assert all(r.taken <= 3 * r.size and (r.taken == 0 if r.size == 0 else r.taken % r.size == 0) for r in got)
    again = mix(clashing(rows[::-1])).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_mix_one_hot_length(docs):
    """Half of all rows are of one source and one length."""
    rows = [(i, "a b c", "en", "hot") for i in range(600)] + [(600 + i, "a " * (i % 40 + 1), "en", f"s{i % 4}") for i in range(600)]
    got = mix(docs(rows)).collect()
    hot = [r for r in got if r.doc_id < 600]
    assert abs(sum(r.taken for r in hot) - hot[0].target) <= 3
    assert mix(docs([])).count() == 0
    assert [r.taken for r in mix(docs([(1, None), (2, " ")])).collect()] == [0, 0]


def test_mix_repeats_small_documents_where_a_large_one_does_not_fit(docs):
    rows = [(0, "w " * 4000, "en", "b"), (1, "w " * 50, "en", "b"), (2, "w " * 30, "en", "b"), (3, "w " * 100, "en", "a")]
    got = {r.doc_id: r.taken for r in mix(docs(rows)).collect()}
    assert got == {0: 0, 1: 150, 2: 90, 3: 300}  # 3880 are wanted of b: less than its large document


@pytest.mark.parametrize("seed", range(6))
def test_fit_finds_the_best_sum(seed):
    rng = random.Random(seed)
    sizes, counts = np.array(sorted(rng.sample(range(1, 60), 5))), np.array([rng.randrange(0, 4) for _ in range(5)])
    budget = rng.randrange(0, 200)
    sums = {sum(a * b for a, b in zip(sizes, c)) for c in itertools.product(*(range(x + 1) for x in counts))}
    took = fit(sizes, counts, budget, seed)
    assert (took <= counts).all() and (took * sizes).sum() == max(s for s in sums if s <= budget)


def test_fit_large_budget():
    sizes, counts = np.array([7, 1000, 90_000]), np.array([10_000, 5000, 40])
    took = fit(sizes, counts, 3_333_331, 1)
    assert (took <= counts).all() and (took * sizes).sum() == 3_333_331


@pytest.mark.parametrize("buckets", [1, 2, 3, 9])
def test_bounds_are_best(buckets):
    rng = random.Random(buckets)
    lengths = sorted(rng.sample(range(1, 100), 8))
    counts = [rng.randrange(1, 50) for _ in lengths]

    def padding(ends):
        return sum(c * (min(e for e in ends if e >= x) - x) for x, c in zip(lengths, counts))
    best = min(padding([*c, lengths[-1]]) for k in range(buckets) for c in itertools.combinations(lengths[:-1], k))
    got = bounds(lengths, counts, buckets)
    assert len(got) <= buckets and padding(got) == best
    assert bounds([], [], 3) == []


def test_pack(clashing):
    rng = random.Random(3)
    rows = [(i, "w " * rng.choice((1, 5, 30, 31, 90, 200))) for i in range(300)] + [(400, None), (401, ""), (402, "w " * 10_000), (403, "a"), (403, "a"), (None, "b")]
    got = pack(clashing(rows), buckets=4, longest=64, budget=256, step=8).collect()
    tokens = {}
    for r in got:
        tokens.setdefault(r.doc_id, []).append(r)
    for i, text in rows:
        n = len((text or "").split())
        own = sorted(tokens[i], key=lambda r: (r.part, r.batch or 0))
        if i != 403:
            assert [(r.part, r.start, r.length) for r in own] == [(k, 64 * k, min(64, n - 64 * k)) for k in range(max(1, -(-n // 64)))]
    assert len(tokens[403]) == 2
    real = [r for r in got if r.length]
    assert all(r.bucket_length is None and r.batch is None for r in got if not r.length)
    batches = {}
    for r in real:
        assert r.length <= r.bucket_length <= 64 and r.bucket_length % 8 == 0
        batches.setdefault((r.bucket_length, r.batch), []).append(r.slot)
    for (length, batch), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and len(slots) * length <= 256
        if (length, batch + 1) in batches:
            assert len(slots) == 256 // length  # only a bucket's last batch has room
    assert pack(clashing([])).count() == 0
    with pytest.raises(ValueError):
        pack(clashing([]), longest=64, budget=32)
