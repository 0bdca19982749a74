"""Toxicity of texts: a small convolutional network over words, trained here in numpy.

A word is the sum of two hashed embeddings, of the word and of its first bytes, so unseen words with a known stem are not strangers. Filters of
width one, two and three slide over the words, each filter keeps its largest answer over the whole text, and a linear layer adds these up.
Learning uses all labelled rows, in shards whose changes are averaged; a quarter of them is kept apart to set a threshold for each language, and scores
are moved so that the threshold lies at the same score in all of them. A text's language is told from its function words,
never from a column.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import _hash_slice, durable, mix64, seeded

#: Function words that tell a text's language.
FUNCTION_WORDS = {"en": "the of and to in is that for it with", "de": "der die und das ist nicht ein mit von zu",
                  "fr": "le les et des est pour dans une du au", "es": "el los y que las del por con se una"}
LANGUAGES = (*FUNCTION_WORDS, "other")
WIDTHS = (1, 2, 3)
_WORDS, _STEMS = 1 << 17, 1 << 16
_STEM = 4  # bytes
_SLICE = 1 << 20
_PART = 1 << 17  # words
_ROWS = 1 << 13  # rows of a table that are added up in one group
_GAPS = bytes(x if 97 <= x <= 122 or 48 <= x <= 57 or x >= 128 else 32 for x in range(256))
_FUNCTION = np.array([_hash_slice(w.encode())[0][0] for ws in FUNCTION_WORDS.values() for w in ws.split()])
_SPEAKS = np.repeat(np.arange(len(FUNCTION_WORDS)), [len(ws.split()) for ws in FUNCTION_WORDS.values()])
_ORDER = np.argsort(_FUNCTION)


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words in a piece, of their stems, and where they begin; a word is a run of letters and digits."""
    words, begin = _hash_slice(data)
    raw, stems, inside = np.frombuffer(data + b" " * _STEM, np.uint8), np.zeros(len(words), np.uint64), np.ones(len(words), bool)
    for i in range(_STEM):
        sign = raw[begin + i]
        inside &= sign != 32
        stems |= np.where(inside, sign, 0).astype(np.uint64) << np.uint64(8 * i)
    return words, mix64(stems + np.uint64(1)), begin


def pieces(texts: Sequence[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Words of all texts, about 1 MB at a time: word and stem buckets, the first place of each piece, and the text it belongs to.

    A text beyond 1 MB comes in several pieces, cut behind a word; a piece starts with the last words of the one before, so no window is lost.
    Texts with fewer words than the widest filter are filled up with bucket -1, the empty word; so are texts without words.
    """
    held: list[tuple[int, bytes]] = []
    size = 0

    def out():
        data = b" ".join(x for _, x in held)
        words, stems, begin = _hashed(data)
        ends = np.cumsum([len(x) + 1 for _, x in held])
        counts = np.bincount(np.searchsorted(ends, begin, "right"), minlength=len(held))
        short = np.maximum(WIDTHS[-1] - counts, 0)
        fill = np.repeat(np.cumsum(counts), short)
        word, stem = (np.insert((x % np.uint64(n)).astype(np.int64), fill, -1) for x, n in ((words, _WORDS), (stems, _STEMS)))
        full = counts + short
        spoken = np.insert(words, fill, 0)
        return word, stem, np.cumsum(full) - full, np.array([i for i, _ in held]), spoken

    for i, text in enumerate(texts):
        data = (text or "").lower().encode("utf-8", "surrogatepass").translate(_GAPS).rstrip(b" ")
        at = 0
        while True:
            end = back = at
            while back <= at and end < len(data):  # as much as holds more than the words that are read again
                end = len(data) if len(data) - end <= _SLICE else data.find(b" ", end + _SLICE)
                end = back = len(data) if end < 0 else end
                for _ in range(WIDTHS[-1] - 1):
                    back = at + len(data[at:back].rstrip(b" "))
                    back = max(data.rfind(b" ", at, back) + 1, at)
            if held and size + end - at > _SLICE:
                yield out()
                held, size = [], 0
            held.append((i, data[at:end]))
            size += end - at
            if end >= len(data):
                break
            at = back
    if held:
        yield out()


@dataclass
class Network:
    """Embeddings by bucket, one matrix a filter width (``[place, embedding, filter]``), and the last layer."""

    words: np.ndarray
    stems: np.ndarray
    filters: list
    biases: list
    weights: np.ndarray
    bias: float

    @classmethod
    def new(cls, size: int, filters: int, seed: int, init: float) -> "Network":
        draw = np.random.default_rng(seed)
        normal = lambda *shape: draw.normal(0, 1, shape).astype(np.float32)
        out = cls(init * normal(_WORDS + 1, size), init * normal(_STEMS + 1, size), [normal(w, size, filters) / np.sqrt(w * size) for w in WIDTHS],
                   [np.zeros(filters, np.float32) for _ in WIDTHS], 0.3 * normal(len(WIDTHS) * filters), 0.0)
        out.words[-1] = out.stems[-1] = 0  # the empty word
        return out

    def embedded(self, word: np.ndarray, stem: np.ndarray) -> np.ndarray:
        out = self.words[word] + self.stems[stem]
        return out

    def largest(self, vectors: np.ndarray, first: np.ndarray) -> list:
        """For each width, each filter's answers at all places, those that leave their text at minus infinity, and the largest of each text."""
        found, ends = [], np.append(first[1:], len(vectors))
        for width, table, bias in zip(WIDTHS, self.filters, self.biases):
            answers = vectors @ table[0] + bias
            for j in range(1, width):
                answers[:-j] += vectors[j:] @ table[j]
                answers[ends - j] = -np.inf
            found.append((answers, np.maximum.reduceat(answers, first)))
        return found

    def best(self, word: np.ndarray, stem: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest answer of each filter in each text (of ``sizes`` words), and its place among all words; read ``_PART`` words at a time, so memory follows the longest part."""
        starts = np.cumsum(sizes) - sizes
        parts = [(i, a, min(a + _PART, s + n)) for i, (s, n) in enumerate(zip(starts, sizes)) for a in range(s, max(s + n - WIDTHS[-1] + 1, s + 1), _PART - WIDTHS[-1] + 1)]
        top, where = np.full((len(sizes), len(self.weights)), -np.inf, np.float32), np.zeros((len(sizes), len(self.weights)), np.int64)
        at = 0
        while at < len(parts):
            end, n = at + 1, parts[at][2] - parts[at][1]
            while end < len(parts) and n + parts[end][2] - parts[end][1] <= _PART:
                n += parts[end][2] - parts[end][1]
                end += 1
            some = parts[at:end]
            places = np.concatenate([np.arange(a, b) for _, a, b in some])
            long = np.array([b - a for _, a, b in some])
            first = np.cumsum(long) - long
            found = self.largest(self.embedded(word[places], stem[places]), first)
            for j, (i, a, _) in enumerate(some):
                new = np.concatenate([x[j] for _, x in found])
                spot = np.concatenate([x[first[j]:first[j] + long[j]].argmax(0) for x, _ in found]) + a
                where[i] = np.where(new > top[i], spot, where[i])
                top[i] = np.maximum(new, top[i])
            at = end
        return top, where

    def tables(self) -> list[np.ndarray]:
        """All numbers as tables of rows; a row moves as a whole. Changes reach the network, the last layer's constant apart."""
        return [self.words, self.stems, *(x.reshape(1, -1) for x in (*self.filters, *self.biases, self.weights)), np.array([[self.bias]], np.float32)]

    def raw(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The last layer's sum for each text, and the place of its language in ``LANGUAGES``."""
        n = len(texts)
        top, spoken = np.full((n, len(self.weights)), -np.inf, np.float32), np.zeros((n, len(FUNCTION_WORDS)), np.int64)
        for word, stem, first, of, hashes in pieces(texts):
            found = self.largest(self.embedded(word, stem), first)
            np.maximum.at(top, of, np.concatenate([x for _, x in found], 1))
            place = np.minimum(np.searchsorted(_FUNCTION[_ORDER], hashes), len(_ORDER) - 1)
            hit = np.flatnonzero(_FUNCTION[_ORDER][place] == hashes)
            np.add.at(spoken, (of[np.searchsorted(first, hit, "right") - 1], _SPEAKS[_ORDER][place[hit]]), 1)
        language = np.where(spoken.max(1, initial=0) > 0, spoken.argmax(1), len(FUNCTION_WORDS))
        return np.maximum(top, 0) @ self.weights + self.bias, language


def train(net: Network, rows: Sequence[tuple[np.ndarray, np.ndarray, int]], epochs: int, seed: int, batch: int = 32, rate: float = 0.05, drop: float = 0.6) -> Network:
    """Train ``net`` in place on (word buckets, stem buckets, label) rows, by AdaGrad on the logistic loss; only rows of the embeddings that were met move.

    All rows are seen ``epochs`` times; ``drop`` of the words are left to their stems at each step, by chance.
    """
    draw, size, filters = np.random.default_rng(seed + 1), net.words.shape[1], net.filters[0].shape[2]
    moved = {id(x): np.full(x.shape, 1e-3, np.float32) for x in (net.words, net.stems, net.weights, *net.filters, *net.biases)}
    bias_moved = 1e-3

    def step(table: np.ndarray, gradient: np.ndarray, at=slice(None)) -> None:
        moved[id(table)][at] += gradient ** 2
        table[at] -= rate * gradient / np.sqrt(moved[id(table)][at])

    for _ in range(epochs):
        order = draw.permutation(len(rows))
        for a in range(0, len(order), batch):
            some = [rows[i] for i in order[a:a + batch]]
            word, stem = (np.concatenate([r[k] for r in some]) for k in (0, 1))
            sizes = np.array([len(r[0]) for r in some])
            y = np.array([r[2] for r in some], np.float32) * 0.96 + 0.02  # labels are not always right
            if drop:
                word = np.where(draw.random(len(word)) < drop, -1, word)
            top, best = net.best(word, stem, sizes)
            z = np.maximum(top, 0) @ net.weights + net.bias
            off = ((1 / (1 + np.exp(-z)) - y) / len(some)).astype(np.float32)
            back = np.where(top > 0, off[:, None] * net.weights, 0)
            pulls: list[tuple[np.ndarray, np.ndarray]] = []
            for k, width in enumerate(WIDTHS):
                where, own = (x[:, k * filters:(k + 1) * filters] for x in (best, back))
                change = np.stack([np.einsum("dfe,df->ef", net.embedded(word[where + j], stem[where + j]), own) for j in range(width)])
                pulls += [((where + j).ravel(), (own[:, :, None] * net.filters[k][j].T).reshape(-1, size)) for j in range(width)]
                step(net.filters[k], change)
                step(net.biases[k], own.sum(0))
            step(net.weights, np.maximum(top, 0).T @ off)
            bias_moved += float(off.sum()) ** 2
            net.bias -= rate * float(off.sum()) / bias_moved ** 0.5
            places, pull = np.concatenate([x for x, _ in pulls]), np.concatenate([x for _, x in pulls])
            used = np.abs(pull).max(1) > 0
            for table, bucket in ((net.words, word), (net.stems, stem)):
                met, at = np.unique(bucket[places[used]], return_inverse=True)
                gradient = np.zeros((len(met), size), np.float32)
                np.add.at(gradient, at, pull[used])
                gradient[met < 0] = 0
                step(table, gradient, met)
    return net


def threshold(raw: np.ndarray, labels: np.ndarray, weights: np.ndarray, at: float) -> float:
    """The cut of ``raw`` with the least loss, where a false alarm costs ``at`` and a miss 1 - ``at``; half way between its neighbours."""
    order = np.argsort(raw, kind="stable")
    z, y, w = raw[order], labels[order], weights[order]
    missed = np.concatenate(([0], np.cumsum(w * (y == 1)))) * (1 - at)
    alarms = (np.sum(w * (y == 0)) - np.concatenate(([0], np.cumsum(w * (y == 0))))) * at
    loss = missed + alarms
    loss[1:-1][z[1:] == z[:-1]] = np.inf  # equal values are on one side
    best = np.flatnonzero(loss <= loss.min() + 1e-9)
    best = best[(best > 0) & (best < len(z))] if ((best > 0) & (best < len(z))).any() else best
    gaps = [z[min(i, len(z) - 1)] - z[max(i - 1, 0)] for i in best]
    i = int(best[int(np.argmax(gaps))])
    return float((z[max(i - 1, 0)] + z[min(i, len(z) - 1)]) / 2)


@dataclass
class Model:
    """A network and, for each of ``LANGUAGES``, the cut that becomes a score of ``at``; without both classes to learn from, one score for all."""

    network: Network | None
    cuts: np.ndarray
    slope: float
    at: float
    constant: float = 0.0

    def score(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Scores from 0 to 1 and languages."""
        if self.network is None:
            return np.full(len(texts), self.constant), np.full(len(texts), len(FUNCTION_WORDS))
        raw, language = self.network.raw(texts)
        z = np.clip(self.slope * (raw - self.cuts[language]) + np.log(self.at / (1 - self.at)), -30, 30)
        return np.round(1 / (1 + np.exp(-z)), 6), language


def _buckets(texts: Sequence[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word and stem buckets of each whole text."""
    for text in texts:
        word, stem = (np.concatenate(x).astype(np.int32) for x in zip(*((p[0], p[1]) for p in pieces([text]))))
        yield word, stem


def _apart(ids: pa.Array, seed: int) -> np.ndarray:
    """A quarter of the ids, which sets the thresholds."""
    return (mix64(ids.to_numpy().astype(np.int64).view(np.uint64) + np.uint64(seed)) % np.uint64(4)) == 0


def _added(rows: DataFrame) -> list:
    """Sums over all tasks of the float32 arrays ``sums`` and ``weights`` by ``name`` and ``part``."""
    def run(group: pa.Table) -> pa.Table:
        total = [pa.array([sum(np.frombuffer(x.as_py(), np.float32) for x in group.column(c)).tobytes()], pa.binary()) for c in ("sums", "weights")]
        return pa.table([group.column("name")[:1], group.column("part")[:1], *total], names=group.schema.names)
    return rows.groupBy("name", "part").applyInArrow(run, _SUMS).collect()


_SUMS = "name int, part int, sums binary, weights binary"


def _cut(tables: Sequence[np.ndarray], weights: Sequence[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Tables and a weight a row as rows of ``_SUMS``, ``_ROWS`` rows of a table each."""
    for name, (table, weight) in enumerate(zip(tables, weights)):
        for part, at in enumerate(range(0, len(table), _ROWS)):
            cells = [x[at:at + _ROWS].astype(np.float32).tobytes() for x in (table, weight)]
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in cells)],
                                             ["name", "part", "sums", "weights"])


def _dealt(known: DataFrame, marked: DataFrame, shards: int, seed: int) -> DataFrame:
    """Labelled rows in the order of their shards: doc_id, text, toxic, shard.

    Texts and labels go to their shard in one exchange and meet there, so a text moves once at any size; a join would move it by doc_id first.
    """
    texts = known.filter(F.col("doc_id").isNotNull()).withColumn("mark", F.lit(None).cast("int"))
    marks = marked.select("doc_id", F.lit(None).cast("string").alias("text"), F.col("toxic").alias("mark"))
    both = texts.unionByName(marks).withColumn("shard", F.pmod(seeded(seed, "doc_id"), F.lit(shards)).cast("int"))
    met = both.repartition(shards, "shard").sortWithinPartitions("shard", "doc_id", "text").withColumn(
        "toxic", F.max("mark").over(Window.partitionBy("shard", "doc_id")))
    return met.filter(F.col("mark").isNull() & F.col("toxic").isNotNull()).select("doc_id", "text", "toxic", "shard")


def _met(rows: DataFrame, seed: int) -> list[np.ndarray]:
    """In how many training rows each word and stem bucket is."""
    def run(batches: Iterator) -> Iterator:
        n = [np.zeros((x + 1, 1)) for x in (_WORDS, _STEMS)]
        for batch in batches:
            kept = batch.filter(pa.array(~_apart(batch.column("doc_id"), seed)))
            for pair in _buckets(x.as_py() for x in kept.column("text")):
                for k in (0, 1):
                    n[k][np.unique(pair[k])] += 1
        yield from _cut(n, [np.zeros(len(x)) for x in n])

    met = [np.zeros(x + 1) for x in (_WORDS, _STEMS)]
    for r in _added(rows.select("doc_id", "text").mapInArrow(run, _SUMS)):
        found = np.frombuffer(r["sums"], np.float32)
        met[r["name"]][r["part"] * _ROWS:r["part"] * _ROWS + len(found)] = found
    return met


def _round(rows: DataFrame, net: Network, known: list[np.ndarray], epochs: int, turn: int, seed: int) -> None:
    """Train ``net`` on every shard from the same start and move it by the mean change, of each row over the shards that moved it."""
    shared = rows.sparkSession.sparkContext.broadcast((net, known))

    def run(batches: Iterator) -> Iterator:
        start, keeps = shared.value
        old = start.tables()
        change, weight = [np.zeros_like(x) for x in old], [np.zeros(len(x), np.float32) for x in old]

        def learn(shard: int, texts: list) -> None:
            new = copy.deepcopy(start)
            train(new, texts, epochs, seed + 7919 * turn + 104729 * shard, rate=0.05 / (1 + turn) ** 0.5)
            for total, n, a, b in zip(change, weight, new.tables(), old):
                moved = a - b
                at = np.flatnonzero(np.abs(moved).max(1) > 0)
                total[at] += moved[at] * len(texts)
                n[at] += len(texts)

        held, of = [], None
        for batch in batches:
            kept = batch.filter(pa.array(~_apart(batch.column("doc_id"), seed)))
            for shard, label, pair in zip(kept.column("shard").to_pylist(), kept.column("toxic").to_pylist(), _buckets(x.as_py() for x in kept.column("text"))):
                if shard != of and held:
                    learn(of, held)
                    held = []
                of = shard
                held.append((*(np.where(keeps[k][x], x, -1).astype(np.int32) for k, x in enumerate(pair)), label))
        if held:
            learn(of, held)
        yield from _cut(change, weight)

    tables = net.tables()
    for r in _added(rows.mapInArrow(run, _SUMS)):
        n = np.frombuffer(r["weights"], np.float32)[:, None]
        table = tables[r["name"]][r["part"] * _ROWS:r["part"] * _ROWS + len(n)]
        table += np.frombuffer(r["sums"], np.float32).reshape(len(n), -1) / np.maximum(n, 1)
    net.bias = float(tables[-1][0, 0])
    shared.destroy()


def _answers(rows: DataFrame, net: Network, seed: int, apart: bool) -> np.ndarray:
    """Numbers of rows by language, answer (in steps of 1 / ``_GRID``) and label, as ``[language, step, label, rows]`` lines; only those kept apart, or all."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            kept = batch.filter(pa.array(_apart(batch.column("doc_id"), seed))) if apart else batch
            if kept.num_rows:
                raw, language = shared.value.raw(kept.column("text").to_pylist())
                step = np.clip(np.rint(raw * _GRID), -_FAR, _FAR).astype(np.int64)
                lines, n = np.unique(np.stack([language, step, kept.column("toxic").to_numpy()]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in lines), pa.array(n, pa.int64())], ["language", "step", "toxic", "n"])

    told = rows.mapInArrow(run, "language long, step long, toxic long, n long").groupBy("language", "step", "toxic").agg(F.sum("n").alias("n"))
    return np.array(sorted(tuple(r) for r in told.collect()), np.int64).reshape(-1, 4)


_GRID, _FAR = 256, 1 << 13
_ROUNDS = 4


def fit(docs: DataFrame, labels: DataFrame, learns: Column, at: float = 0.7, shard_chars: int = 1 << 22, size: int = 12, filters: int = 12,
        epochs: int = 8, steps: int = 600, least: int = 15, seed: int = 11, common: int = 4) -> Model:
    """A model from all labelled rows.

    ``labels(doc_id, toxic)`` gives 0 or 1; other values and null ids are left out, and of several labels the larger counts. ``learns`` is a condition on doc_id:
    only where it holds is a label read at all. Every row and every text counts, whole. A quarter of the rows is kept from training and sets the
    thresholds; languages with fewer than ``least`` rows of either class there take that of all. Words and stems in fewer than ``common`` training rows count as the empty word.

    Rows are dealt by a hash of doc_id to shards of about ``shard_chars`` characters. A task trains the network on a shard; where there are several, the network is moved by their
    mean change, in four rounds. All rows are seen ``epochs`` times in all, or as often as makes ``steps`` steps of 32 rows, if that is more. A task holds one shard's word buckets
    (about 1.3 times its text) and three networks of 9 MB; the driver gets the network, once a round, and row counts by language, answer (to 1/256) and label.
    """
    marked = (labels.filter(learns & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
              .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")))
    n = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return Model(None, np.zeros(len(LANGUAGES)), 1.0, at, 1.0 if n.get(1) else 0.0)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(learns)
    sized = known.agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("rows")).first()
    chars = (sized["chars"] or 0) * min(1.0, sum(n.values()) / max(sized["rows"], 1))
    shards = max(1, -(-int(chars) // shard_chars))
    rows = durable(_dealt(known, marked, shards, seed))
    seen = rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    if len(seen) < 2:
        return Model(None, np.zeros(len(LANGUAGES)), 1.0, at, 0.0)
    keeps = [x >= common for x in _met(rows, seed)]
    for x in keeps:
        x[-1] = True  # the empty word is what it is
    network = Network.new(size, filters, seed, 0.02)
    rounds = 1 if shards == 1 else _ROUNDS
    times = max(epochs, -(-steps * 32 // max(sum(r["n"] for r in seen) * 3 // 4, 1)))
    for turn in range(rounds):
        _round(rows, network, keeps, -(-times // rounds), turn, seed)
    lines = _answers(rows, network, seed, True)
    if len(set(lines[:, 2])) < 2:
        lines = _answers(rows, network, seed, False)
    language, raw, y, weights = lines[:, 0], lines[:, 1] / _GRID, lines[:, 2], lines[:, 3].astype(float)
    cuts = np.full(len(LANGUAGES), threshold(raw, y, weights, at))
    for k in range(len(LANGUAGES)):
        mine = language == k
        if min(weights[mine & (y == 0)].sum(), weights[mine & (y == 1)].sum()) >= least:
            cuts[k] = threshold(raw[mine], y[mine], weights[mine], at)
    away = np.abs(raw - cuts[language])
    order = np.argsort(away)
    far = away[order][np.searchsorted(np.cumsum(weights[order]), weights.sum() / 2)]
    return Model(network, cuts, float(4 / max(far, 1e-6)), at)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` but ``text``, and ``score`` (0 to 1) and ``language`` of the whole text.

    Null and empty texts have the score of no words. A text beyond 1 MB is read in pieces that overlap by the widest filter, so memory
    does not grow with it; equal texts score alike. The broadcast model is 9 MB whatever the corpus.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name not in ("text", "score", "language")]

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                scores, language = shared.value.score(some.column(some.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(len(kept))), pa.array(scores, pa.float64()),
                                                  pa.array([LANGUAGES[i] for i in language], pa.string())], [*(f.name for f in kept), "score", "language"])

    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("language", T.StringType())])
    return docs.select(*(F.col(f"`{f.name}`") for f in kept), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
