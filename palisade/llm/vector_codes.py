"""Product codes of vectors: 16 bytes a vector, from codebooks moved to the mean of their parts, all in whole numbers.

Vectors are cut into equal parts, and each part position has its own codebook. Rows are gathered to chunks as they are read, and a chunk
keeps each part position apart: its parts along a Hilbert curve, so neighbours in space are neighbours in the array, cut into flat blocks
of a few rows, each with the box around it (smallest and largest components) and the sum of its rows. These chunks are written once.

Each round then takes a box at a time: an entry whose least distance to the box is above another entry's greatest distance cannot be
nearest to any row in it. What is left is the block's shortlist. A block with one entry left adds its stored sum without a look at its
rows; for the others the exact distances of a few rows to a few entries are taken. Only sums and counts of the entries leave the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import durable

_LARGEST = 1 << 62


def hilbert_keys(points: np.ndarray) -> np.ndarray:
    """Places of whole-number points along a Hilbert curve through their box; of wide points the first 16 components count.

    Coordinates are brought to as many bits as fit into one key of 62 bits. Turning and flipping the cells of each level, coarsest
    first, and Gray-coding the result gives the bits of the key, one for each level and axis.
    """
    n, d = points.shape[0], min(points.shape[1], 16)
    if not n or not d:
        return np.zeros(n, np.uint64)
    bits = min(16, 62 // d)
    at = points[:, :d].astype(np.float64)
    low, span = at.min(0), np.maximum(np.ptp(at, axis=0), 1e-9)
    axes = [np.minimum((column - a) / s * (1 << bits), (1 << bits) - 1).astype(np.uint64) for column, a, s in zip(at.T, low, span)]
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        below = np.uint64((1 << level) - 1)
        for i in range(d):
            upper = (axes[i] >> np.uint64(level)) & one == 1
            swap = np.where(upper, np.uint64(0), (axes[0] ^ axes[i]) & below)
            axes[0] = np.where(upper, axes[0] ^ below, axes[0] ^ swap)
            axes[i] = axes[i] ^ swap
    for i in range(1, d):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros(n, np.uint64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((axes[-1] >> np.uint64(level)) & one == 1, np.uint64((1 << level) - 1), np.uint64(0))
    key = np.zeros(n, np.uint64)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << one) | (((axis ^ turn) >> np.uint64(level)) & one)
    return key


class Blocks:
    """One part position of a chunk: rows along the curve, and each block's box and sum."""

    def __init__(self, rows: np.ndarray, order: np.ndarray, block: int, exact: type) -> None:
        self.order = order
        self.rows = rows.astype(exact)
        self.cuts = np.arange(0, len(rows), block)
        self.ends = np.append(self.cuts[1:], len(rows))
        self.low, self.high = (f.reduceat(rows, self.cuts, axis=0).astype(exact) for f in (np.minimum, np.maximum))
        self.sums = np.add.reduceat(self.rows, self.cuts, axis=0)

    @classmethod
    def sorted(cls, rows: np.ndarray, block: int) -> "Blocks":
        order = np.argsort(hilbert_keys(rows), kind="stable")
        return cls(rows[order], order, block, np.int64)

    def pack(self) -> dict:
        """Bytes as they are stored: integers of the least width that holds them."""
        size = max(1, int(np.abs(self.rows).max(initial=0)).bit_length() + 1)
        kind = next(t for bits, t in ((8, "<i1"), (16, "<i2"), (32, "<i4"), (64, "<i8")) if size <= bits)
        return {"kind": kind, "rows": self.rows.astype(kind).tobytes(), "order": self.order.astype("<i4").tobytes(),
                "low": self.low.astype(kind).tobytes(), "high": self.high.astype(kind).tobytes(), "sums": self.sums.astype("<i8").tobytes()}

    @classmethod
    def unpacked(cls, stored: dict, width: int, block: int, exact: type) -> "Blocks":
        read = lambda name, kind: np.frombuffer(stored[name], kind).reshape(-1, width)
        rows, order = read("rows", stored["kind"]), np.frombuffer(stored["order"], "<i4")
        if exact is object:  # stored sums may have wrapped
            return cls(rows.astype(np.int64), order, block, exact)
        out = cls.__new__(cls)
        out.rows, out.order = rows.astype(np.int64), order
        out.low, out.high = (read(x, stored["kind"]).astype(np.int64) for x in ("low", "high"))
        out.sums = read("sums", "<i8")
        out.cuts = np.arange(0, len(rows), block)
        out.ends = np.append(out.cuts[1:], len(rows))
        return out

    def shortlists(self, entries: np.ndarray) -> np.ndarray:
        """By block and entry: can the entry be nearest to a row of the block? Ties stay in."""
        low, high = self.low[:, None, :], self.high[:, None, :]
        outside = np.maximum(np.maximum(low - entries, entries - high), 0)
        across = np.maximum(np.abs(entries - low), np.abs(high - entries))
        return (outside ** 2).sum(-1) <= (across ** 2).sum(-1).min(1)[:, None]

    def assign(self, entries: np.ndarray, whole_blocks: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's nearest entry, the smallest index of equals, its distance, and which blocks had one entry left.

        With ``whole_blocks`` the rows of those blocks are left out: their distances stay 0.
        """
        listed = self.shortlists(entries)
        single = listed.sum(1) == 1
        nearest = np.repeat(listed.argmax(1), self.ends - self.cuts)
        away = np.zeros(len(self.rows), self.rows.dtype)
        for i in np.flatnonzero(~single if whole_blocks else np.ones(len(single), bool)):
            a, b, short = self.cuts[i], self.ends[i], np.flatnonzero(listed[i])
            far = ((self.rows[a:b, None, :] - entries[short]) ** 2).sum(-1)
            best = far.argmin(1)
            nearest[a:b], away[a:b] = short[best], far[np.arange(b - a), best]
        return nearest, away, single

    def totals(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many rows are nearest to each entry, and their sum."""
        nearest, _, single = self.assign(entries, True)
        n, sums = np.bincount(nearest, minlength=len(entries)), np.zeros(entries.shape, self.rows.dtype)
        np.add.at(sums, nearest[self.cuts[single]], self.sums[single])
        apart = np.repeat(~single, self.ends - self.cuts)
        np.add.at(sums, nearest[apart], self.rows[apart])
        return n, sums


_BLOCKS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), *(T.StructField(n, T.BinaryType()) for n in ("rows", "order", "low", "high", "sums"))]))


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of whole numbers, shorter ones with zeros behind."""
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _stored(rows: DataFrame, width: int, parts: int, chunk_rows: int, block: int) -> DataFrame:
    """``rows(row, v)`` as chunks: their rows as a list, and the blocks of each part position."""
    def build(batches: Iterator) -> Iterator:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            batch = pa.concat_batches(held)
            n, v = batch.num_rows, _matrix(batch.column(1), width)
            row = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column(0))
            blocks = [Blocks.sorted(v[:, i:i + width // parts], block).pack() for i in range(0, width, width // parts)]
            return pa.RecordBatch.from_arrays([row, pa.array([blocks], pa.list_(pa.struct(
                [("kind", pa.string()), *((x, pa.binary()) for x in ("rows", "order", "low", "high", "sums"))])))], ["rows", "blocks"])

        for batch in batches:
            for at in range(0, batch.num_rows, chunk_rows):
                some = batch.slice(at, chunk_rows)
                if size + some.num_rows > chunk_rows and held:
                    yield out()
                    held, size = [], 0
                held.append(some)
                size += some.num_rows
        if held:
            yield out()

    schema = T.StructType([T.StructField("rows", T.ArrayType(rows.schema["row"].dataType)), T.StructField("blocks", _BLOCKS)])
    return durable(rows.select("row", "v").mapInArrow(build, schema))


def encode(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, chunk_rows: int = 8192, block: int = 64) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for each row of ``vectors(vec_id, embedding, label, ...)`` that is kept.

    Components become ``floor(scale * x)``. Dropped are rows whose vector is null or holds null or non-finite components. Codebooks start with the
    ``entries`` rows of smallest vec_id (of equal ids the smaller vector first, null ids last; all rows, if there are fewer) and are moved ``rounds``
    times to the floored mean of the parts nearest to each entry; ties go to the smaller index, and an entry without parts stays. ``code``
    has two hex digits a part, ``error`` is the squared distance over all parts, ``label_error`` its sum over the rows of equal label, null
    being one label, ``codebooks_sha256`` the digest of all final entries. Repeated rows give a row each. Vectors are as wide as the longest,
    rounded up to a multiple of ``parts``, with zeros behind; no vectors, or empty ones only, count as zeros. Components at or beyond 2**62 / scale, and errors
    that a long cannot hold, fail with a message. An empty table gives no rows; other columns are not looked at.

    A chunk holds at most ``chunk_rows`` rows and so bounds a task's memory; the driver gets ``entries`` * width numbers a round.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hex digits a part holds 1 to 256 entries")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double") * scale) < float(_LARGEST), F.floor(x.cast("double") * scale))
                        .otherwise(F.raise_error(F.lit("a component times scale is beyond 2**62"))).cast("long"))
    rows = (vectors.filter(F.col("embedding").isNotNull()).filter(sound)
            .select(F.struct(F.col("vec_id").cast("long").alias("vec_id"), F.col("label")).alias("row"), whole.alias("v")))
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", vectors.schema["label"].dataType),
                           T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    width, high = rows.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    width = -(-max(width or 0, 1) // parts) * parts
    step = width // parts
    exact = np.int64 if 4 * width * int(high or 0) ** 2 < 1 << 62 else object  # else Python's whole numbers
    first = rows.orderBy(F.col("row.vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()  # entries * width numbers
    start = np.zeros((len(first), width), np.int64)
    for line, r in zip(start, first):
        line[:len(r["v"])] = r["v"]
    books = [start[:, i:i + step].astype(exact) for i in range(0, width, step)]
    chunks = _stored(rows, width, parts, chunk_rows, block)

    def moved(books: list) -> list:
        def totals(batches: Iterator) -> Iterator:
            n, sums = np.zeros((parts, len(first)), np.int64), [np.zeros(b.shape, exact) for b in books]
            for batch in batches:
                for blocks in batch.column("blocks"):
                    for p, one in enumerate(blocks):
                        more, added = Blocks.unpacked(one.as_py(), step, block, exact).totals(books[p])
                        n[p] += more
                        sums[p] += added
            at = np.flatnonzero(n.ravel())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(at, step)), pa.array(np.tile(np.arange(step), len(at))), pa.array(np.repeat(n.ravel()[at], step)),
                 pa.array([Decimal(int(x)) for x in np.concatenate(sums)[at].ravel()], pa.decimal128(38))], ["entry", "place", "n", "total"])

        added = (chunks.select("blocks").mapInArrow(totals, "entry long, place long, n long, total decimal(38,0)")
                 .groupBy("entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect())
        new = [b.copy() for b in books]
        for r in added:
            part, entry = divmod(r["entry"], len(first))
            new[part][entry, r["place"]] = int(r["total"]) // r["n"]
        return new

    for _ in range(rounds if len(first) else 0):
        books = moved(books)
    digest = hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()

    def coded(batches: Iterator) -> Iterator:
        for batch in batches:
            for rows, blocks in zip(batch.column("rows"), batch.column("blocks")):
                n = len(rows)
                codes, error = np.zeros((n, parts), np.uint8), np.zeros(n, exact)
                for p, one in enumerate(blocks):
                    part = Blocks.unpacked(one.as_py(), step, block, exact)
                    nearest, away, _ = part.assign(books[p], False)
                    codes[part.order, p] = nearest
                    error[part.order] += away
                if n and int(error.max()) >= 1 << 63:
                    raise OverflowError("an error is beyond what a long holds")
                digits = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays([*rows.values.flatten(), pa.array([digits[i:i + 2 * parts] for i in range(0, len(digits), 2 * parts)], pa.string()),
                                                  pa.array(error.astype(np.int64))], schema.names)

    done = durable(chunks.mapInArrow(coded, schema))
    by_label = done.groupBy("label").agg(F.sum("error").alias("label_error"))
    return (done.join(by_label.withColumnRenamed("label", "_label"), F.col("label").eqNullSafe(F.col("_label")))
            .select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")))
