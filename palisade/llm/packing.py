"""Packing into batches of a token budget, inside length buckets whose bounds minimise padding.

Texts longer than the longest sequence are cut into sequences. A global histogram of lengths (at most one row for each step of
length up to the longest sequence) goes to the driver, where dynamic programming finds the bounds with the least padding.
Inside a bucket the sequences take exact seeded ranks, and so many neighbours form a batch as the budget holds at the bucket's length.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import durable, group_rank, seeded, word_count


def bounds(lengths: Sequence[int], counts: Sequence[int], buckets: int) -> list[int]:
    """At most ``buckets`` upper bounds, among ``lengths`` (ascending), with the least sum of count * (bound - length)."""
    lengths, counts = np.asarray(lengths, np.float64), np.asarray(counts, np.float64)
    n = len(lengths)
    if not n:
        return []
    number = np.concatenate(([0.0], np.cumsum(counts)))
    cost, came = number[1:] * lengths, []  # of everything up to i in one bucket, without the lengths' own constant sum
    for _ in range(1, min(buckets, n)):
        best, at = np.empty(n), np.empty(n, np.int64)
        for i in range(n):  # the last bucket holds j+1..i
            option = np.concatenate((cost[:i], [np.inf])) + (number[i + 1] - np.concatenate((number[1:i + 1], [number[i + 1]]))) * lengths[i]
            at[i] = int(np.argmin(option)) if i else 0
            best[i] = min(option[at[i]], cost[i])
            if best[i] == cost[i]:
                at[i] = -1  # no more buckets are needed
        came.append(at)
        cost = best
    found, i = [], n - 1
    for at in reversed(came):
        if at[i] >= 0:
            found.append(int(lengths[i]))
            i = int(at[i])
    return [*sorted({*found, int(lengths[i])})]


def pack(docs: DataFrame, buckets: int = 8, longest: int = 4096, budget: int = 32768, step: int = 8, seed: int = 13,
         length: Column | None = None) -> DataFrame:
    """``doc_id, part, start, length, bucket_length, batch, slot``: one row for each sequence of ``docs(doc_id, text, ...)``.

    A document of n tokens gives ceil(n / longest) sequences, cut every ``longest`` tokens. Tokens are words unless another long
    column counts them. Lengths are padded to the bucket's bound, a multiple of ``step``; ``batch`` counts from 0 in each
    bucket and holds at most ``budget`` tokens with padding; ``slot`` is the place in the batch. Documents without tokens (null or blank texts)
    give one row of length 0 with null bucket, batch and slot. Equal rows are separate documents; an empty table gives no rows.
    """
    if longest > budget or longest % step:
        raise ValueError("a batch must hold the longest sequence, and its length be a multiple of the step")
    tokens = (word_count(F.col("text")) if length is None else length).cast("long")
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(tokens, F.lit(0)).alias("tokens"))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("tokens") / longest) - 1, F.lit(0))))
    cut = (counted.withColumn("part", parts).withColumn("start", F.col("part") * longest)
           .withColumn("length", F.least(F.lit(longest).cast("long"), F.col("tokens") - F.col("start"))).drop("tokens"))
    cut = durable(cut)
    rounded = (F.ceil(F.col("length") / step) * step).cast("long")
    histogram = cut.filter("length > 0").groupBy(rounded.alias("at")).count().orderBy("at").collect()  # at most longest / step rows
    ends = bounds([r["at"] for r in histogram], [r["count"] for r in histogram], buckets) or [longest]
    bucket = F.array_min(F.filter(F.array(*(F.lit(e).cast("long") for e in ends)), lambda e: e >= F.col("length")))
    placed = cut.filter("length > 0").withColumn("bucket_length", bucket).withColumn("order", seeded(seed, "doc_id", "part"))
    ranked = group_rank(placed, ["bucket_length"], "order", ["doc_id", "part", "length"], pieces=4096)
    holds = F.floor(F.lit(budget) / F.col("bucket_length"))
    batched = ranked.withColumn("batch", F.floor((F.col("rank") - 1) / holds).cast("long")).withColumn("slot", ((F.col("rank") - 1) % holds).cast("int"))
    none = cut.filter("length = 0").select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("bucket_length", "long"), ("batch", "long"), ("slot", "int"))))
    columns = ["doc_id", "part", "start", "length", "bucket_length", "batch", "slot"]
    return batched.select(*columns).unionByName(none.select(*columns))
