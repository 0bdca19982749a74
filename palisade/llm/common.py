"""Word rules, 64-bit hashing inside tasks, and exact ranks within groups that may be very large."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import durable, scratch_path, shared_dir

__all__ = ["WORD", "durable", "group_rank", "mix64", "scratch_path", "seeded", "shared_dir", "table", "word_count", "word_hashes"]

WORD = r"[^\x20\x09-\x0D]+"  # a word: a run of anything but ASCII white space
_GAP = r"[\x20\x09-\x0D]+"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SLICE = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts 0. Separators are squeezed first, so only they are counted."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), _GAP, " ")
    spaces = F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit("")))
    inner = spaces - F.startswith(squeezed, F.lit(" ")).cast("int") - F.endswith(squeezed, F.lit(" ")).cast("int")
    return (F.when(squeezed == "", 0).when(squeezed == " ", 0).otherwise(inner + 1)).cast("long")


def seeded(seed: int | str, *columns: str | Column) -> Column:
    """A pseudo-random long of the columns' values, the same in every run."""
    return F.xxhash64(F.lit(str(seed)), *columns)


def group_rank(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], name: str = "rank", pieces: int = 1024) -> DataFrame:
    """Exact 1-based position of each row in its group, by the pseudo-random long ``order`` and then ``ties``.

    Each group is cut into ``pieces`` ranges of ``order``: a window ranks the rows of one range, and the ranges' counts
    give the rows before it. A group of any size is so spread over many tasks; the count table has at most ``pieces`` rows
    a group. ``keys`` must not be null.
    """
    cut = df.withColumn("_piece", F.shiftright(F.col(order), 64 - (pieces - 1).bit_length()))
    cells = cut.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_piece").orderBy(order, *ties)
    return (cut.withColumn("_in", F.row_number().over(inside)).join(cells, [*keys, "_piece"])
            .withColumn(name, (F.col("_in") + F.col("_before")).cast("long")).drop("_piece", "_in", "_before"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit integers, so that all output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, _SLICE + 4096)
            self.up, self.down = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64))), dtype=np.uint64)
                                  for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_POWERS = _Powers(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * _ODD)
_VALUE[_SPACE] = 0


def _hash_slice(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.zeros(0, np.uint64), begin
    up, down = _POWERS.upto(len(raw))
    sums = np.add.reduceat(_VALUE[raw] * up, begin)
    return mix64(sums * down[begin] + (end - begin).astype(np.uint64) * _ODD), begin


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in a row, with A-Z lower-cased, and the number of words of each text.

    Works on the UTF-8 bytes of about 1 MB at a time, whatever the texts' lengths.
    """
    encoded = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    counts = np.zeros(len(encoded), np.int64)
    found: list[np.ndarray] = []
    held: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            hashes, begin = _hash_slice(b"\n".join(encoded[i] for i in held))
            ends = np.cumsum([len(encoded[i]) + 1 for i in held])
            counts[held] += np.bincount(np.searchsorted(ends, begin, "right"), minlength=len(held))
            found.append(hashes)
            held.clear()
            size = 0

    for i, one in enumerate(encoded):
        if len(one) > _SLICE:
            flush()
            at = 0
            while at < len(one):  # cut a very long text behind a separator
                end = min(len(one), at + _SLICE)
                while end < len(one) and not _SPACE[one[end - 1]]:
                    end += 1
                hashes, _ = _hash_slice(one[at:end])
                counts[i] += len(hashes)
                found.append(hashes)
                at = end
            continue
        if size + len(one) > _SLICE:
            flush()
        held.append(i)
        size += len(one) + 1
    flush()
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), counts
