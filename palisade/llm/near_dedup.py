"""Near duplicates: MinHash bands propose pairs, sequential Bayesian tests prune them, full sets confirm the rest.

1. Every text becomes the set of its distinct word shingles, hashed to 64 bits; equal sets become one class with one member
   that stands for it. So thousands of copies cost one row.
2. Bands of a MinHash signature put similar classes into the same bucket. First every member is compared with its bucket's
   least member only, and the links found are contracted to components.
3. Buckets that still hold several components are compared pair by pair, but only across components, in cells of bounded size:
   a large bucket is dealt into blocks and a cell holds two blocks. A pair that shares several bands is taken in its first one.
4. A comparison takes the signatures in batches. After each batch, a pair goes if the posterior probability that its similarity
   reaches the threshold (uniform prior) is below the miss probability. Survivors are confirmed on their full sets.

Nothing is capped: a bucket of any size is compared whole. A link is missed only if no band agrees (a chance of 2e-7 at the
threshold with the default bands, far less above it) or a Bayesian test errs (at most ``miss`` a pair).
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.ordering import row_numbered
from .common import durable, mix64, word_hashes
from .graph import components

_COEFFICIENT = np.uint64(0x9E3779B97F4A7C15)
_SALTS = 32
_ODDS = mix64(np.arange(1, 65, dtype=np.uint64) * _COEFFICIENT) | np.uint64(1)  # one factor for each place in a shingle


@dataclass(frozen=True)
class NearDedup:
    """Parameters: pairs with ``100 * intersection >= percent * union`` of their ``words``-word shingle sets are linked."""

    words: int = 5
    percent: int = 85
    bands: int = 48
    rows: int = 8
    batch: int = 32          # hashes looked at between two tests
    miss: float = 1e-6       # chance that the tests lose a pair at the threshold
    block: int = 512         # rows of a bucket that are compared together
    seed: int = 7

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def shingle_sets(texts: list, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: empty without words, one of all words if there are fewer than ``words``."""
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    for n, end in zip(counts, ends):
        own = hashes[end - n:end]
        if n == 0:
            yield own
            continue
        width = min(int(n), words)
        sums = np.full(n - width + 1, width, np.uint64)
        for k in range(width):
            sums = sums + own[k:n - width + 1 + k] * _ODDS[k]
        yield np.unique(mix64(sums))


def _signature(own: np.ndarray, factors: np.ndarray) -> np.ndarray:
    low = (own & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 256):  # a fixed amount of memory for sets of any size
        np.minimum(least, (low[None, at:at + 256] * factors[:, None]).min(1), out=least)
    # the least values are small numbers: their low bits, once mixed, serve as a 16-bit code of the hash
    return (mix64(least.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def _factors(p: NearDedup) -> np.ndarray:
    return np.random.default_rng(p.seed).integers(0, 1 << 32, p.hashes, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def signatures(docs: DataFrame, p: NearDedup) -> DataFrame:
    """``doc_id, n_shingles, d1, d2, sig``: the set's size, a 128-bit digest of it, and its MinHash codes; no row for empty sets."""
    def run(batches):
        factors = _factors(p)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids, sizes, one, two, sigs = [], [], [], [], []
            for doc, own in zip(batch.column(0).to_pylist(), shingle_sets(texts, p.words)):
                if len(own):
                    ids.append(doc)
                    sizes.append(len(own))
                    one.append(int(own.sum(dtype=np.uint64).view(np.int64)))
                    two.append(int(mix64(own + _COEFFICIENT).sum(dtype=np.uint64).view(np.int64)))
                    sigs.append(_signature(own, factors).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()),
                                              pa.array(two, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "sig"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, sig binary")


def _codes(column: pa.Array, p: NearDedup) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, p.hashes)


def _band_keys(reps: DataFrame, p: NearDedup) -> DataFrame:
    def run(batches):
        weights = mix64(np.arange(1, p.rows + 1, dtype=np.uint64) * _COEFFICIENT) | np.uint64(1)
        salt = mix64(np.arange(1, p.bands + 1, dtype=np.uint64))
        for batch in batches:
            if not batch.num_rows:
                continue
            sums = (_codes(batch.column(2), p).reshape(-1, p.bands, p.rows).astype(np.uint64) * weights).sum(2, dtype=np.uint64)
            keys = mix64(sums + salt).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, p.bands, dtype=np.int32), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["doc_id", "n", "keys"])
    return reps.select("doc_id", "n_shingles", "sig").mapInArrow(run, "doc_id long, n long, keys array<long>")


def least_matches(n: int, percent: int, miss: float) -> int:
    """Fewest of ``n`` agreeing hashes with which the posterior probability of a similarity of ``percent`` or more is ``miss`` or more.

    With a uniform prior, that probability after m agreements is P(Bin(n + 1, percent/100) <= m).
    """
    t, total = percent / 100, 0.0
    if t >= 1:
        return n
    for m in range(n + 1):
        total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t) + (n + 1 - m) * math.log1p(-t))
        if total >= miss:
            return m
    return n


def _tests(p: NearDedup) -> list[tuple[int, int, int]]:
    stops = [*range(p.batch, p.hashes, p.batch), p.hashes]
    early = 0.2 * p.miss / max(1, len(stops) - 1)  # the last test, the sharpest, may err most
    return [(a, b, least_matches(b, p.percent, 0.8 * p.miss if b == p.hashes else early)) for a, b in zip([0, *stops], stops)]


def _survivors(left: np.ndarray, right: np.ndarray, tests: list) -> np.ndarray:
    """Indexes of the rows of ``left`` and ``right`` (or of ``right`` against one row) that pass every test."""
    alive, agree = np.arange(len(right)), np.zeros(len(right), np.int32)
    for a, b, least in tests:
        own = left[a:b] if left.ndim == 1 else left[alive, a:b]
        agree = agree + (own == right[alive, a:b]).sum(1, dtype=np.int32)
        stay = agree >= least
        alive, agree = alive[stay], agree[stay]
        if not len(alive):
            break
    return alive


def _fits(n: str, m: str, p: NearDedup):
    """Sets whose sizes differ too much cannot be similar enough."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * p.percent


def _tested(pairs: DataFrame, sigs: DataFrame, p: NearDedup) -> DataFrame:
    """The pairs (a, b) that pass the sequential tests."""
    side = lambda name: sigs.select(F.col("doc_id").alias(name), F.col("sig").alias(f"sig_{name}"))

    def run(batches):
        tests = _tests(p)
        for batch in batches:
            if batch.num_rows:
                stay = _survivors(_codes(batch.column(2), p), _codes(batch.column(3), p), tests)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(stay)), batch.column(1).take(pa.array(stay))], ["a", "b"])
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sig_a", "sig_b")
    return joined.mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, p: NearDedup) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    side = lambda name: texts.select(F.col("doc_id").alias(name), F.col("text").alias(f"text_{name}"))

    def run(batches):
        recent: OrderedDict[int, np.ndarray] = OrderedDict()
        held = 0

        def whole(doc, text):
            nonlocal held
            if doc not in recent:
                recent[doc] = next(shingle_sets([text], p.words))
                held += recent[doc].nbytes
                while held > 1 << 26 and len(recent) > 2:
                    held -= recent.popitem(last=False)[1].nbytes
            recent.move_to_end(doc)
            return recent[doc]

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for a, b, x, y in zip(*(part.column(i).to_pylist() for i in range(4))):
                    one, two = whole(a, x), whole(b, y)
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    if both * 100 >= p.percent * (len(one) + len(two) - both):
                        out.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a long, b long")


def _cells(live: DataFrame, sigs: DataFrame, p: NearDedup) -> DataFrame:
    """Pairs across components of the buckets in ``live(band, key, doc_id, n, label)`` that pass the tests."""
    sizes = live.groupBy("band", "key").agg(F.ceil(F.count(F.lit(1)) / p.block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    spread = (live.join(sizes, ["band", "key"]).withColumn("own", mine)
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("doc_id", "n", "label", "band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
              .join(sigs.select("doc_id", "sig"), "doc_id"))
    dealt = (spread.repartition("key", "band", "i", "j").sortWithinPartitions("key", "band", "i", "j", "doc_id")
             .select("key", "band", "i", "j", "own", "doc_id", "n", "label", "sig"))

    def pairs(rows: dict) -> list[tuple[int, int]]:
        codes, own, n, label, doc = rows["sig"], rows["own"], rows["n"], rows["label"], rows["doc_id"]
        band, within, out = int(rows["band"][0]), rows["i"][0] == rows["j"][0], []
        for x in range(len(doc) - 1):
            y = np.arange(x + 1, len(doc))
            y = y[(label[y] != label[x]) & (np.minimum(n[y], n[x]) * 100 >= np.maximum(n[y], n[x]) * p.percent)]
            if not within:
                y = y[own[y] != own[x]]
            if len(y) and band:  # a pair belongs to the first band in which it agrees
                early = (codes[y, :band * p.rows] == codes[x, :band * p.rows]).reshape(len(y), band, p.rows)
                y = y[~early.all(2).any(1)]
            if len(y):
                out += [(int(min(doc[x], doc[z])), int(max(doc[x], doc[z]))) for z in y[_survivors(codes[x], codes[y], rows["tests"])]]
        return out

    def run(batches):
        tests, rest = _tests(p), None
        for batch in _ended(batches):
            if batch is not None:
                rest = batch if rest is None else pa.concat_batches([rest, batch])
            if rest is None or not rest.num_rows:
                continue
            name = np.stack([rest.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], 1)
            begin = np.flatnonzero(np.append(True, (name[1:] != name[:-1]).any(1)))
            done = len(name) if batch is None else int(begin[-1])  # the last cell may go on in the next batch
            out = []
            for a, b in zip(begin, np.append(begin[1:], len(name))):
                if a < done and b - a > 1:
                    part = rest.slice(a, b - a)
                    rows = {c: part.column(c).to_numpy(zero_copy_only=False) for c in ("band", "i", "j", "own", "doc_id", "n", "label")}
                    out += pairs(rows | {"sig": _codes(part.column("sig"), p), "tests": tests})
            rest = rest.slice(done)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])
    return dealt.mapInArrow(run, "a long, b long")


def _ended(batches):
    yield from batches
    yield None


def _salted(rows: DataFrame) -> DataFrame:
    """Each row once for every salt, so that a class of very many copies is dealt to several tasks.

    The hint keeps Spark from broadcasting it: its size check does not see that the rows are multiplied.
    """
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long")))).hint("merge")


def text_marks() -> dict:
    """Two hashes of the text, which tell the texts of one doc_id apart; null is a text of its own."""
    return {"m1": F.xxhash64("text"), "m2": F.xxhash64(F.lit("second"), "text")}


def _numbered(docs: DataFrame, repeated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents by a number in the order of doc_id, one for each different text of an id, as ``doc_id`` (the number), ``text``; and number, id and marks."""
    many = docs.join(repeated, "doc_id", "left_semi").withColumns(text_marks()).groupBy("doc_id", "m1", "m2").agg(F.max("text").alias("text"))
    rows = docs.join(repeated, "doc_id", "left_anti").withColumns(text_marks()).select(*many.columns).unionByName(many)
    names = durable(row_numbered(rows.select("doc_id", "m1", "m2"), [], ["doc_id", "m1", "m2"], "key").select("key", "doc_id", "m1", "m2"))
    return rows.join(names, ["doc_id", "m1", "m2"]).select(F.col("key").cast("long").alias("doc_id"), "text"), names


def near_duplicates(docs: DataFrame, p: NearDedup = NearDedup()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document of ``docs(doc_id, text, ...)``.

    ``component_id`` is the least doc_id that links reach; ``kept`` marks rows of that doc_id. Null or blank texts have no
    shingles and stand alone. Texts of any length are taken whole. Rows that share doc_id and text are one document and give one row; rows that share
    a doc_id but not the text are documents of their own. A row without doc_id gives a row of nulls that is kept and linked with nothing. Other
    columns are not looked at; an empty table gives no rows.
    """
    return near_rows(docs, p).select("doc_id", "n_shingles", "component_id", "kept")


def near_rows(docs: DataFrame, p: NearDedup = NearDedup()) -> DataFrame:
    """``near_duplicates`` and, where doc_ids repeat, ``m1, m2`` (hashes of the text) and ``stays``: true for one document of each component."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = docs.filter("doc_id is not null")
    lost = docs.filter("doc_id is null").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    repeated = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    if repeated.isEmpty():
        return _grouped(named, p).withColumn("kept", F.col("doc_id") == F.col("component_id")).unionByName(lost)
    rows, names = _numbered(named, durable(repeated))
    found = _grouped(durable(rows), p).withColumnsRenamed({"doc_id": "key", "component_id": "first"})
    heads = names.select(F.col("key").alias("first"), F.col("doc_id").alias("component_id"))
    out = found.join(names, "key").join(heads, "first").select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"),
                                                               "m1", "m2", (F.col("key") == F.col("first")).alias("stays"))
    return out.unionByName(lost.withColumn("stays", F.lit(True)), allowMissingColumns=True)


def _grouped(named: DataFrame, p: NearDedup) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of documents with different doc_ids."""
    sets = durable(signatures(named, p))
    classes = sets.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS))
    member = durable(sets.select("doc_id", "n_shingles", "d1", "d2", salt.alias("salt")).join(_salted(classes), ["d1", "d2", "salt"], "left")
                     .select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")))
    stand = member.filter("doc_id = rep").select("doc_id")
    reps = sets.join(stand, "doc_id", "left_semi")

    keyed = _band_keys(reps, p).select("doc_id", "n", F.posexplode("keys").alias("band", "key"))
    met = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("m"), F.min("doc_id").alias("lead")).filter("m > 1").drop("m")
    buckets = durable(keyed.join(met, ["band", "key"]))
    texts = durable(named.join(buckets.select("doc_id").distinct(), "doc_id", "left_semi"))
    sigs = durable(reps.join(buckets.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "n_shingles", "sig"))

    lead_n = sigs.select(F.col("doc_id").alias("lead"), F.col("n_shingles").alias("lead_n"))
    first = (buckets.filter("doc_id <> lead").select(F.col("lead"), "doc_id", "n").distinct().join(lead_n, "lead").filter(_fits("n", "lead_n", p))
             .select(F.col("lead").alias("a"), F.col("doc_id").alias("b")))
    near = durable(_confirmed(_tested(first, sigs, p), texts, p))
    early = components(near)

    labelled = buckets.drop("lead").join(early.withColumnRenamed("vertex", "doc_id"), "doc_id", "left") \
        .select("band", "key", "doc_id", "n", F.coalesce("component", "doc_id").alias("label"))
    labelled = durable(labelled)
    split = labelled.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    live = labelled.join(split.drop("low", "high"), ["band", "key"], "left_semi")
    late = _confirmed(_cells(live, sigs, p), texts, p)
    final = components(near.unionByName(late))

    out = (member.withColumn("salt", salt).join(_salted(final.withColumnRenamed("vertex", "rep")), ["rep", "salt"], "left")
           .select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")))
    bare = (named.select("doc_id").join(member.select("doc_id"), "doc_id", "left_anti")
            .select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return out.unionByName(bare)
