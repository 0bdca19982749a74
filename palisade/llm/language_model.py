"""Language-model scores from a weighted backoff automaton over words.

States are the contexts seen in training, up to ``order - 1`` symbols long (the start of a text counts as a symbol), and one
state without context. An arc of state h that reads w carries log10 p(w | h) and exists where h w was seen; a failure arc
leads to the state of the shorter context and carries log10 b(h). With Dirichlet smoothing, c for counts and h' for h without its first symbol,

    p(w)     = (c(w) + 1) / (N + V + 1)                     without context; one unknown word takes the rest
    p(w | h) = (c(h w) + strength * p(w | h')) / (c(h) + strength)     if h w was seen
    b(h)     = strength / (c(h) + strength)                 and else p(w | h) = b(h) * p(w | h')

so every state's probabilities add up to 1. A text's tokens are its words and one end token.

The model is as large as the corpus and never broadcast. Documents are dealt to blocks. A block sends each shard of the model the
hashes of its different n-grams with their counts in training texts; the shard adds up all blocks' counts and answers
each block in the block's own order. So one exchange both trains and asks, and a frequent n-gram costs one entry a block. The longest
n-grams, which are most, follow in a second exchange, and only those that another block can have: another block must have the two shorter n-grams
in it, without its last and without its first symbol. For all others the block's own count is the total, so nothing is left out. A block
then walks its texts through the part of the automaton that they reach. Words and n-grams are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import mix64, word_hashes

_START, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)  # hashes of the start of a text and the end token
_NEXT = np.uint64(0xD1342543DE82EF95)
_ZSTD = pa.Codec("zstd", compression_level=1)


class Grams:
    """Hashes of a block's n-grams: ``at[k][i]`` ends with token i and has k + 1 symbols; 0 where the text's start is nearer."""

    def __init__(self, texts: list, order: int) -> None:
        words, counts = word_hashes(texts)
        self.counts = counts + 1
        ends = np.cumsum(self.counts)
        tokens = np.insert(words, np.cumsum(counts), _END)
        self.first = ends - self.counts
        self.at, self.nearer = [tokens], []  # hashes, and by context length the tokens that have the text's start nearer
        for k in range(1, order):
            context = np.empty_like(tokens)  # the k symbols before the token
            context[1:] = self.at[k - 1][:-1]
            context[self.first] = _START if k == 1 else 0
            self.nearer.append(context == 0)
            self.at.append(np.where(context != 0, mix64(context * _NEXT + tokens), np.uint64(0)))


def _packed(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as the first one and the differences, in as many bytes as the largest difference needs.

    Differences are mostly far below the largest, so their highest bytes are much alike and are compressed apart from the others.
    """
    steps = np.diff(keys, prepend=keys[:1])
    wide = max(1, (int(steps.max()).bit_length() + 7) // 8)
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8)
    high = _ZSTD.compress(np.ascontiguousarray(planes[:, wide - 1]), asbytes=True)
    return int(keys[0]).to_bytes(8, "little") + bytes([wide]) + len(keys).to_bytes(8, "little") + planes[:, :wide - 1].tobytes() + high


def _unpacked(data: bytes) -> np.ndarray:
    wide, n = data[8], int.from_bytes(data[9:17], "little")
    rest = 17 + n * (wide - 1)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :wide - 1] = np.frombuffer(data, np.uint8, n * (wide - 1), 17).reshape(n, wide - 1)
    steps[:, wide - 1] = np.frombuffer(_ZSTD.decompress(data[rest:], n, asbytes=True), np.uint8)
    keys = steps.reshape(-1).view("<u8")
    keys[0] = int.from_bytes(data[:8], "little")
    return np.cumsum(keys, dtype=np.uint64)


def _numbers(values: np.ndarray) -> bytes:
    """Counts in one byte each below 255; larger ones have 255 there and eight bytes behind. Most are alike, so they are compressed."""
    plain = len(values).to_bytes(8, "little") + np.minimum(values, 255).astype(np.uint8).tobytes() + values[values >= 255].astype("<i8").tobytes()
    return len(plain).to_bytes(8, "little") + _ZSTD.compress(plain, asbytes=True)


def _numbered(data: bytes) -> np.ndarray:
    plain = _ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    n = int.from_bytes(plain[:8], "little")
    values = np.frombuffer(plain, np.uint8, n, 8).astype(np.int64)
    values[values == 255] = np.frombuffer(plain, "<i8", -1, 8 + n)
    return values


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _totals(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    return every, np.bincount(at, np.concatenate(counts), len(every)).astype(np.int64)


def _states(grams: Grams, keys: list, at: list, k: int) -> np.ndarray:
    """By token: the place of the k symbols before it, which end with the token before; -1 where the text's start is nearer."""
    out = np.empty(len(at[0]), np.int32)
    out[1:] = at[k - 1][:-1]
    out[grams.first] = np.searchsorted(keys[0], _START) if k == 1 else -1
    out[grams.nearer[k - 1]] = -1
    return out


class Automaton:
    """The states and arcs that a block's texts reach, from the block's n-grams and their training counts."""

    def __init__(self, grams: Grams, keys: list, at: list, seen: list, strength: float, tokens: int, vocabulary: int) -> None:
        self.at, self.seen = at, seen
        self.arcs = [np.log10((seen[0] + 1.0) / (tokens + vocabulary + 1.0))]  # by n-gram: log10 p(last symbol | the others)
        self.failures, self.states = [], []
        for k in range(1, len(keys)):
            state = _states(grams, keys, at, k)
            first = np.empty(len(keys[k]), np.int64)
            first[at[k][::-1]] = np.arange(len(at[k]))[::-1]
            shorter = 10.0 ** self._probability(k - 1, at, first)
            total = np.where(state[first] >= 0, seen[k - 1][state[first]], 0)
            with np.errstate(divide="ignore"):
                self.arcs.append(np.where(seen[k] > 0, np.log10((seen[k] + strength * shorter) / (total + strength)), np.nan))
            self.failures.append(np.log10(strength / (seen[k - 1] + strength)))
            self.states.append(state)

    def _probability(self, k: int, at: list, tokens: np.ndarray) -> np.ndarray:
        """log10 probability of some tokens, entering at the state of the k symbols before them."""
        out, moving = np.zeros(len(tokens)), np.arange(len(tokens))
        for length in range(k, 0, -1):
            arc = at[length][tokens[moving]]
            state = self.states[length - 1][tokens[moving]]
            reads = (state >= 0) & (self.seen[length][arc] > 0)
            out[moving[reads]] += self.arcs[length][arc[reads]]
            moving, state = moving[~reads], state[~reads]
            out[moving] += np.where(state >= 0, self.failures[length - 1][np.maximum(state, 0)], 0.0)
        out[moving] += self.arcs[0][at[0][tokens[moving]]]
        return out

    def walk(self) -> np.ndarray:
        """log10 probability of each token, all read from left to right.

        The state before a token is the longest context kept of the symbols before it; where a state has no arc for the
        token, the failure arc is followed and its weight added. The steps of all tokens are taken together.
        """
        return self._probability(len(self.arcs) - 1, self.at, np.arange(len(self.at[0])))


def _training_words(batches: Iterator) -> Iterator:
    """Different tokens of a piece of the table with their training counts, and under null the number of all its tokens.

    What is held is bounded, the shuffle adds up the rest.
    """
    keys, counts, held, every_token = [], [], 0, 0

    def out():
        every, n = _totals(keys, counts)
        return pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), pa.array(n)], ["word", "n"])

    for batch in batches:
        grams = Grams(batch.column(0).to_pylist(), 1)
        tokens = grams.at[0][~np.repeat(np.array(batch.column(1).to_pylist(), bool), grams.counts)]
        every_token += len(grams.at[0])
        if len(tokens):
            every, n = np.unique(tokens, return_counts=True)
            keys.append(every)
            counts.append(n)
            held += len(every)
        if held > 1 << 22:
            yield out()
            keys, counts, held = [], [], 0
    if keys:
        yield out()
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([every_token], pa.int64())], ["word", "n"])


def score(docs: DataFrame, held_out: Column, order: int = 2, strength: float = 300.0, block_tokens: int = 1 << 21, least_blocks: int = 64) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs(doc_id, text, ...)``.

    The model learns from the rows where ``held_out`` is false (null counts as true). A-Z are lower-cased; a null text is
    empty and has the end token only. ``base_score`` is the sum of log10 p(w) without context, ``score`` that of the automaton;
    ``n_known`` counts tokens seen in training. Equal rows are separate documents; an empty table gives no rows, and without
    training texts every token is unknown. Other columns are not looked at. Blocks are dealt by doc_id and text, so rows without doc_id spread; equal rows meet in
    one block. A block has about ``block_tokens`` tokens, of training texts or not, and is held by one task; a text is never split, so one that is
    longer than that sizes its task.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.coalesce(held_out, F.lit(True)).alias("held_out"))
    words = rows.select("text", "held_out").mapInArrow(_training_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    training = F.when(F.col("word").isNotNull(), F.col("n"))
    total, vocabulary, every_token = words.agg(F.coalesce(F.sum(training), F.lit(0)), F.count("word"), F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0))).first()
    shards = blocks = max(least_blocks, -(-every_token // block_tokens))
    placed = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    longest = order - 1

    def read(block: pa.Table, order: int = order):
        """A block's n-grams of up to ``order`` symbols; for each length the different ones, sorted, each token's place among them, and their training counts in the block."""
        grams = Grams(block.column("text").to_pylist(), order)
        train = ~np.array(block.column("held_out").to_pylist(), bool)
        own = np.repeat(train, grams.counts)
        keys, at, counted = [], [], []
        for k in range(order):
            one, grams.at[k] = grams.at[k], None  # a block's arrays are what a task holds: hashes go as soon as they have places
            every, place = np.unique(np.concatenate((one, [_START])) if k == 0 else one, return_inverse=True)
            keys.append(every)
            at.append(place[:len(one)].astype(np.int32))
            del one, place
            counted.append(np.bincount(at[k], own, len(every)).astype(np.int64))
        counted[0][np.searchsorted(keys[0], _START)] = train.sum()  # as a context it was met once a text
        return grams, keys, at, counted

    def asks(block: int, found: list[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple]:
        out = []
        for kind, every, seen in found:
            to = _shard(every, shards)
            cuts = np.flatnonzero(np.diff(to, prepend=-1, append=shards))
            out += [(int(to[a]), block, kind, _packed(every[a:b]), _numbers(seen[a:b])) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]
        return out

    def asked(rows: list[tuple]) -> pa.Table:
        types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names=["shard", "block", "kind", "keys", "counts"])

    def ask(block: pa.Table) -> pa.Table:
        """All n-grams of a block but the longest ones."""
        _, keys, _, counted = read(block, max(1, longest))
        return asked(asks(block.column("block")[0].as_py(), [(k, keys[k], counted[k]) for k in range(max(1, longest))]))

    def answer(asked: pa.Table) -> pa.Table:
        """Twice the total of each n-gram that the blocks ask for, plus one if several blocks ask; what comes without keys is that already."""
        packed = asked.column("keys").to_pylist()
        if packed[0] is None:
            return asked.select(["block", "shard", "kind", "counts"])
        keys = [_unpacked(x) for x in packed]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, np.concatenate([_numbered(x) for x in asked.column("counts").to_pylist()])).astype(np.int64)
        n = 2 * n + (np.bincount(at) > 1)
        return pa.table([asked.column("block"), asked.column("shard"), asked.column("kind"),
                         pa.array([_numbers(n[np.searchsorted(every, x)]) for x in keys], pa.binary())], names=["block", "shard", "kind", "counts"])

    def totals(answers: pa.Table, kind: int) -> np.ndarray:
        parts = sorted((s, c) for k, s, c in zip(*(answers.column(c).to_pylist() for c in ("kind", "shard", "counts"))) if k == kind)
        return np.concatenate([_numbered(c) for _, c in parts]) if parts else np.zeros(0, np.int64)

    def elsewhere(grams: Grams, keys: list, at: list, shorter: np.ndarray) -> np.ndarray:
        """Which of the longest n-grams another block may have, in training or not: those whose first and whose last symbols it has."""
        first = np.empty(len(keys[longest]), np.int64)
        first[at[longest][::-1]] = np.arange(len(at[longest]))[::-1]
        other = shorter & 1 == 1
        context = _states(grams, keys, at, longest)[first]
        return (context >= 0) & other[context] & other[at[longest - 1][first]]

    def ask_longest(block: pa.Table, answers: pa.Table) -> pa.Table:
        """The longest n-grams that other blocks may know; the totals known so far go along."""
        if not block.num_rows:
            return asked([])
        grams, keys, at, counted = read(block)
        name = block.column("block")[0].as_py()
        seen = [totals(answers, k) for k in range(longest)]
        known = [(-1 - name % shards, name, k, None, _numbers(x)) for k, x in enumerate(seen)]
        some = elsewhere(grams, keys, at, seen[-1])
        return asked(known + asks(name, [(longest, keys[longest][some], counted[longest][some])]))

    def walk(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), *[pa.int64()] * 3, pa.float64(), pa.float64())], names=_SCORED)
        grams, keys, at, counted = read(block)
        answered = [totals(answers, k) for k in range(max(1, longest))]
        seen = [x >> 1 for x in answered]
        if longest:
            seen.append(counted[longest])
            seen[longest][elsewhere(grams, keys, at, answered[-1])] = totals(answers, longest) >> 1
        automaton = Automaton(grams, keys, at, seen, strength, total, vocabulary)
        add = lambda x: np.add.reduceat(x, grams.first)  # noqa: E731  every text has a token at least
        return pa.table([block.column("doc_id"), block.column("held_out"), pa.array(grams.counts), pa.array(add((seen[0] > 0)[at[0]].astype(np.int64))),
                         pa.array(np.full(block.num_rows, total, np.int64)), pa.array(add(automaton.arcs[0][at[0]])), pa.array(add(automaton.walk()))],
                        names=_SCORED)

    texts = placed.groupBy("block")
    asking, told = "shard int, block int, kind int, keys binary, counts binary", "block int, shard int, kind int, counts binary"
    answers = texts.applyInArrow(ask, asking).groupBy("shard", "kind").applyInArrow(answer, told)
    if longest:
        answers = texts.cogroup(answers.groupBy("block")).applyInArrow(ask_longest, asking).groupBy("shard", "kind").applyInArrow(answer, told)
    return texts.cogroup(answers.groupBy("block")).applyInArrow(
        walk, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


_SCORED = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
