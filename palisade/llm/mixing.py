"""Mixing sources to target weights: whole passes, proportional counts by exact length, then a bounded knapsack for the rest.

A source's target is spent in three steps. Whole passes over the source take what they can. Of the rest, every length gets
its proportional number of documents, rounded down, from a histogram of exact lengths; a seeded order of lengths then adds
single documents until the remaining budget is small. That budget is fitted by a bounded-knapsack (subset-sum) program over the
lengths and their unused counts. Where that cannot be met by
taking documents once more, repeats fill it up. Last, each length's documents are taken in a seeded order until its count is reached.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordering import row_numbered
from .common import durable, group_rank, seeded, word_count


def targets(sources: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """Add ``target`` to ``sources(source, source_size)``: a weighted share of all sizes, at most ``most`` times the source's size.

    Sources take ``weights`` in turn, by code point, null last. The excess of full sources is shared again by weight: a target is
    least(most * size, level * weight), and the level rises until nothing is left over. The driver sees two sums a step.
    """
    turn = F.element_at(F.array(*(F.lit(int(w)) for w in weights)), ((F.col("rn") - 1) % len(weights) + 1).cast("int"))
    known = durable(row_numbered(sources, [], [F.col("source").asc_nulls_last()]).withColumn("weight", turn).drop("rn"))
    cap = F.col("source_size") * most
    total, weight = known.agg(F.sum("source_size"), F.sum("weight")).first()
    rest, free = total or 0, weight or 1
    while True:
        full = cap < F.lit(float(rest)) * F.col("weight") / F.lit(float(free))
        spent, left = known.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        now = (total or 0) - (spent or 0), left or 1
        if now == (rest, free):
            break
        rest, free = now
    level = F.lit(float(rest)) * F.col("weight") / F.lit(float(free))
    return known.withColumn("target", F.least(cap.cast("double"), level)).drop("weight")


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int, seed: int) -> np.ndarray:
    """How many documents of each size to take, so that the sizes' sum is ``budget`` or as little below as can be found.

    ``counts`` are what may be taken of each size. Exact (a subset sum) once the budget is within the program's width, which
    follows the largest size; before that, single documents of sizes in a seeded order use it up.
    """
    taken = np.zeros(len(sizes), np.int64)
    usable = np.flatnonzero((sizes > 0) & (counts > 0) & (sizes <= budget))
    if budget <= 0 or not len(usable):
        return taken
    order = usable[np.random.default_rng(seed).permutation(len(usable))]
    width = int(min(max(1 << 16, 4 * int(sizes[usable].max())), 1 << 20))
    while budget > width:
        before = budget
        for i in order:
            if budget <= width:
                break
            if taken[i] < counts[i] and sizes[i] <= budget:
                taken[i] += 1
                budget -= int(sizes[i])
        if budget == before:
            break
    if budget > width:
        return taken  # nothing that is left fits
    items, reached = [], 1  # bit s of reached: the sum s can be made
    by = np.full(budget + 1, -1, np.int64)
    mask = (1 << (budget + 1)) - 1
    for i in order:
        size, left, part = int(sizes[i]), int(counts[i] - taken[i]), 1
        left = min(left, budget // size)
        while left > 0:
            part = min(part, left)
            left -= part
            new = (reached << (size * part)) & mask & ~reached
            if new:
                raw = np.frombuffer(new.to_bytes((budget >> 3) + 1, "little"), np.uint8)
                by[np.flatnonzero(np.unpackbits(raw, bitorder="little")[:budget + 1])] = len(items)
                reached |= new
                items.append((i, part))
            part *= 2
        if reached >> budget & 1:
            break
    at = reached.bit_length() - 1
    while at > 0:
        i, part = items[by[at]]
        taken[i] += part
        at -= int(sizes[i]) * part
    return taken


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: int = 11, size: Column | None = None) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs(doc_id, text, source, ...)``.

    ``size`` counts a document's words unless another long column is given; a null text has none. ``taken`` is the number of words the mix
    takes of the document, repeats counted: a multiple of its size, at most ``most`` times. Null is a source like others. Documents
    without words take nothing; equal rows are separate documents; an empty table gives no rows. Other columns are not looked at.
    """
    size = word_count(F.col("text")) if size is None else size
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.cast("long").alias("size"))
    rows = rows.withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).withColumn("order", seeded(seed, "doc_id", "name"))
    rows = durable(rows)
    counts = durable(rows.groupBy("name", "source", "size").agg(F.count(F.lit(1)).alias("count")))
    sources = targets(counts.groupBy("name", "source").agg(F.sum(F.col("size") * F.col("count")).alias("source_size")), weights, most)
    spent = F.floor(F.col("target")).cast("long")
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(spent / F.col("source_size")))).otherwise(0).cast("long")
    sources = sources.withColumn("passes", passes).withColumn("budget", spent - F.col("passes") * F.col("source_size"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        budget, whole = int(pdf.budget.iloc[0]), int(pdf.source_size.iloc[0])
        sizes, have = pdf["size"].to_numpy(), pdf["count"].to_numpy()
        share = np.array([int(c) * budget // whole if whole else 0 for c in have], np.int64)
        share[sizes == 0] = 0
        share += fit(sizes, have - share, budget - int((share * sizes).sum()), seed)
        left = budget - int((share * sizes).sum())
        if left > 0:  # only then are documents taken once more than others of their length
            share += fit(sizes, have * (most - int(pdf.passes.iloc[0])) - share, left, seed + 1)
        return pd.DataFrame({"name": pdf.name, "size": sizes, "count": have, "picked": share})

    # one group a source: a row for each different length, never for each document
    picks = (counts.join(sources.drop("source"), "name").select("name", "size", "count", "source_size", "budget", "passes")
             .groupBy("name").applyInPandas(choose, "name string, size long, count long, picked long"))
    plan = durable(picks.join(sources.drop("source", "budget"), "name"))
    ranked = group_rank(rows, ["name", "size"], "order", ["doc_id"]).join(plan.hint("merge"), ["name", "size"])  # its file is far smaller than its rows
    once = F.floor(F.col("picked") / F.col("count")).cast("long")
    taken = F.col("size") * (F.col("passes") + once + (F.col("rank") <= F.col("picked") - once * F.col("count")).cast("long"))
    return ranked.select("doc_id", "size", "source_size", "target", taken.alias("taken"))
