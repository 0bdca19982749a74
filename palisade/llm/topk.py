"""Exact top-k inner products: a ball tree in each shard, searched best bound first, with the k-th score handed on.

Vectors are dealt to shards of a bounded number of rows, queries to blocks of a bounded number, and a task holds one shard and one
block. First each query searches its own shard; the k-th score found there goes with the query to all other shards, where
no node is opened whose bound is below it. A node's bound for a query q is ``q . centre + |q| * radius``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import durable

_FOUND = "query_id long, vec_id long, score long"


class BallTree:
    """Nodes hold contiguous rows; children split a node's rows at the median along its widest direction."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, leaf: int) -> None:
        order = np.argsort(ids, kind="stable")  # equal vectors so stay in id order and small ids meet in one leaf
        rows, ids = rows[order], ids[order]
        spans, self.kids, place = [(0, len(ids))], [], np.arange(len(ids))
        centres, radii = [], []
        for node, (a, b) in enumerate(spans):  # grows while it is read
            own = rows[place[a:b]].astype(np.float64)
            centre = own.mean(0)
            away = np.sqrt(((own - centre) ** 2).sum(1))
            centres.append(centre)
            radii.append(away.max())
            if b - a <= leaf:
                self.kids.append(0)
                continue
            far = own[away.argmax()]
            other = own[((own - far) ** 2).sum(1).argmax()]
            place[a:b] = place[a:b][np.argsort(own @ (other - far), kind="stable")]
            middle = (a + b) // 2
            self.kids.append(len(spans))
            spans += [(a, middle), (middle, b)]
        self.spans, self.rows, self.ids = spans, rows[place], ids[place]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.reach = np.sqrt((self.centres ** 2).sum(1))
        self.least = [int(self.ids[a:b].min()) for a, b in spans]

    def search(self, queries: np.ndarray, ids: np.ndarray, k: int, known: list) -> Iterator[tuple[int, int, int]]:
        """``(query, row, score)`` of each query's k best rows here, but for those that ``known``, a (score, id) or None a query, beats."""
        wide = queries.astype(np.float64)
        length = np.sqrt((wide ** 2).sum(1))[:, None]
        top = wide @ self.centres.T + length * self.radii
        top = np.floor(top + 1e-12 * length * (self.reach + self.radii) + 1e-6)  # scores are whole numbers; what rounding may take is added
        for q, own, bound, beat in zip(queries, ids, top, known):
            best: list[tuple[int, int]] = []  # (-score, id), best first
            heap = [(-bound[0], self.least[0], 0)]
            while heap:
                high, least, node = heapq.heappop(heap)
                worst = best[-1] if len(best) == k else None
                if beat is not None and (worst is None or (-beat[0], beat[1]) < worst):
                    worst = -beat[0], beat[1]
                if worst is not None and high > worst[0]:
                    break  # nothing in any open node scores as high
                if worst is not None and (high, least) > worst:
                    continue  # it can only tie, with larger ids
                kid = self.kids[node]
                if kid:
                    for x in (kid, kid + 1):
                        heapq.heappush(heap, (-min(bound[x], -high), self.least[x], x))
                    continue
                a, b = self.spans[node]
                scores = self.rows[a:b] @ q
                there = self.ids[a:b]
                good = there != own
                if worst is not None:
                    good &= scores >= -worst[0]
                less = -scores[good] if scores.dtype == object else -scores[good].astype(np.int64)
                best = sorted([*best, *zip(less.tolist(), there[good].tolist())])[:k]
            for score, row in best:
                yield int(own), int(row), -int(score)


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors):
        row[:len(v)] = v
    return out


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, shard_rows: int = 8192, block_rows: int = 4096,
          leaf: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best rows by integer inner product, ties to the smaller id.

    Components become ``floor(scale * x)``. Queries are the rows of ``vectors(vec_id, embedding, ...)`` whose id ``every`` divides; the
    query's own row is no candidate. Vectors that are null or hold a null or non-finite component, and rows without id, take no part. A
    shorter vector counts as one with zeros behind. Rows that share an id are one vector, the greatest. With fewer than k
    other rows there are fewer results; an empty table gives none. Other columns are not looked at. Components whose products pass what 64 bits hold
    are multiplied as Python's whole numbers; components at or beyond 2**62 / scale, and results that a long cannot hold, fail with a message.
    """
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double") * scale) < float(1 << 62), F.floor(x.cast("double") * scale))
                        .otherwise(F.raise_error(F.lit("a component times scale is beyond 2**62"))).cast("long"))
    rows = (vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(sound)
            .select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
            .groupBy("vec_id").agg(F.max("v").alias("v")))
    rows = durable(rows)
    n, wanted, width, high = rows.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0), F.max(F.size("v")),
                                      F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    shards, blocks, width = max(1, -(-n // shard_rows)), max(1, -(-wanted // block_rows)), width or 0
    largest = width * int(high or 0) ** 2
    kind = np.float64 if largest < 2 ** 52 else np.int64 if largest < 2 ** 62 else object  # exact in each: the first is fastest, the last has no end
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    queries = (rows.filter(F.col("vec_id") % every == 0)
               .withColumn("block", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks)).cast("int")))
    here = rows.withColumn("block", every_block)

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        tree = BallTree(_matrix(left.v, width).astype(kind), left.vec_id.to_numpy(), leaf)
        known = [None if pd.isna(s) else (int(s), int(i)) for s, i in zip(right.kth, right.kth_id)]
        found = list(tree.search(_matrix(right.q, width).astype(kind), right.query_id.to_numpy(), k, known))
        if any(abs(score) >= 1 << 63 for _, _, score in found):
            raise OverflowError("a score is beyond what a long holds")
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")

    def searched(asked: DataFrame) -> DataFrame:
        asked = asked.select(F.col("shard").alias("to_shard"), F.col("block").alias("of_block"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "kth", "kth_id")
        return here.groupBy("shard", "block").cogroup(asked.groupBy("to_shard", "of_block")).applyInPandas(search, _FOUND)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    own = durable(searched(queries.withColumns({"kth": F.lit(None).cast("long"), "kth_id": F.lit(None).cast("long")}))
                  .withColumn("rank", F.row_number().over(best)))
    if shards == 1:
        return own.select("query_id", "rank", "vec_id", "score")
    kth = own.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"), F.col("vec_id").alias("kth_id"))
    others = (queries.withColumnRenamed("shard", "home").join(kth, "vec_id", "left").withColumn("shard", every_shard).filter("shard <> home")
              .select("vec_id", "v", "shard", "block", "kth", "kth_id"))
    return (own.select("query_id", "vec_id", "score").unionByName(searched(others)).withColumn("rank", F.row_number().over(best))
            .filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
