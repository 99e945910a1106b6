"""Exact top-k search by inner product with a k-d tree for each shard.

Vectors are scaled and floored to integers, so scores are exact. Rows are dealt to shards by the hash of their id, queries to
blocks; a task holds one shard and one block, and a shard meets every block (a stated set of queries against all rows, in
blocks). In a task the shard becomes a k-d tree: median splits along the widest side, tight bounding boxes around what each
node holds. A query visits nodes best first by the largest inner product that a box admits and stops when no box can beat its
kth score. The kth score is propagated: a first pass searches one shard for each block, and its kth scores are where the
search of the other shards starts. A last step keeps the k best of each query over its shards' lists.

Vectors that are null, or hold null or non-finite components, take no part; nor do rows without an id. Only vectors of equal
length are compared. Rows that repeat an id are candidates each, none for a query of that id; a query is answered once for
each id (of several vectors the one smallest in order counts). Ties go to the smaller id. Products that may pass 2^53 are
worked out in Python integers; a score that a long can't hold is an error. Fewer than k candidates are all returned; no
queries or an empty table give an empty result. Columns other than id and vector are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written


@dataclass(frozen=True)
class Settings:
    k: int = 10
    scale: int = 1024
    shard_rows: int = 8192
    block_queries: int = 16_384  # a row is shuffled once for each block, so blocks are large
    leaf: int = 128


#: Below any score: no kth one is known yet.
LEAST = -(1 << 63)


class Tree:
    """K-d tree over integer vectors: nodes in arrays; a leaf holds a range of the reordered rows."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int):
        order, self.kids, self.span, lows, highs = np.arange(len(points)), [], [], [], []
        todo = [(0, len(points), -1)]
        while todo:
            lo, hi, parent = todo.pop()
            own = points[order[lo:hi]]
            me = len(self.span)
            if parent >= 0:
                self.kids[parent].append(me)
            self.kids.append([])
            self.span.append((lo, hi))
            lows.append(own.min(0))
            highs.append(own.max(0))
            if hi - lo > leaf and own.shape[1] and highs[-1][wide := (highs[-1] - lows[-1]).argmax()] > lows[-1][wide]:
                mid = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(own[:, wide], mid)]
                todo += [(lo, lo + mid, me), (lo + mid, hi, me)]
        self.points, self.ids = points[order], ids[order]
        self.low, self.high = np.array(lows), np.array(highs)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries, nodes): the largest inner product that each node's box admits."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, own_id: int, bound: np.ndarray, k: int, kth: int) -> list[tuple[int, int]]:
        """Up to k (score, -id), the best of those that score at least kth."""
        best: list[tuple] = []
        heap = [(-bound[0], 0)]
        while heap:
            top, node = heapq.heappop(heap)
            if -top < kth:
                break
            if kids := self.kids[node]:
                for c in kids:
                    if bound[c] >= kth:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            lo, hi = self.span[node]
            scores = self.points[lo:hi] @ query
            for i in np.flatnonzero((scores >= kth) & (self.ids[lo:hi] != own_id)):
                item = (int(scores[i]), -int(self.ids[lo + i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k and best[0][0] > kth:
                kth = best[0][0]
        return best


def matrix(vectors: pd.Series, scale: int) -> np.ndarray:
    """floor(scale * x), whole numbers as float64."""
    v = np.floor(np.stack(vectors.to_list()).astype(np.float64) * scale) if len(vectors) else np.zeros((0, 0))
    return v


def exact(points: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as they are where inner products stay below 2^53, else as Python integers."""
    top = max(np.abs(points).max(initial=0), np.abs(queries).max(initial=0))
    if points.shape[1] * top * top < 2**53:
        return points, queries
    whole = np.frompyfunc(int, 1, 1)
    return whole(points), whole(queries)


def top_k(rows: DataFrame, is_query: F.Column, settings: Settings | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), id_col, score; is_query: a condition over id_col."""
    s = settings or Settings()
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    plain = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("v"), is_query.alias("q")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(plain).withColumn("dim", F.size("v"))
    counts = usable.groupBy("dim").agg(F.count("*").alias("rows"), F.count_if("q").alias("queries")).collect()  # a row for each length of vectors
    if not any(r["queries"] for r in counts):
        return rows.sparkSession.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    shards = F.create_map(*(F.lit(x) for r in counts for x in (r["dim"], -(-r["rows"] // s.shard_rows))))
    blocks = F.create_map(*(F.lit(x) for r in counts for x in (r["dim"], max(1, -(-r["queries"] // s.block_queries)))))
    usable = usable.withColumn("shards", shards[F.col("dim")]).withColumn("blocks", blocks[F.col("dim")])
    points = usable.select("dim", "id", "v", F.pmod(F.xxhash64("id", "v"), "shards").cast("int").alias("shard"), "blocks")
    queries = usable.where("q").groupBy("id").agg(F.min(F.struct("dim", "v", "shards", "blocks")).alias("x")).select("id", "x.*")
    queries = written(queries.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")), "queries")
    home = F.pmod(F.col("block"), F.col("shards")).cast("int")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            p, q = exact(matrix(left["v"], s.scale), matrix(right["v"], s.scale))
            tree = Tree(p, left["id"].to_numpy(), s.leaf)
            own, start = right["id"].to_numpy(), right["kth"].to_numpy()
            for at in range(0, len(q), 256):
                bounds = tree.bounds(q[at : at + 256])
                for i, b in enumerate(bounds, at):
                    out += [(own[i], -n, score) for score, n in tree.search(q[i], own[i], b, s.k, int(start[i]))]
        return pd.DataFrame(out, columns=["query_id", "id", "score"]).astype("int64")

    def searched(p: DataFrame, q: DataFrame) -> DataFrame:
        return p.groupBy("dim", "shard", "block").cogroup(q.groupBy("dim", "shard", "block")).applyInPandas(run, "query_id long, id long, score long")

    dealt = points.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1).cast("array<int>"))).select("dim", "shard", "block", "id", "v")
    # first pass: each block's home shard
    homes = queries.select("dim", "block", home.alias("shard")).distinct()
    first_queries = queries.select("dim", home.alias("shard"), "block", "id", "v", F.lit(LEAST).cast("long").alias("kth"))
    first = written(searched(dealt.join(homes, ["dim", "shard", "block"], "left_semi"), first_queries), "first")
    kth = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= s.k).select(F.col("query_id").alias("id"), "kth")
    rest = queries.join(kth, "id", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1).cast("array<int>"))).where(F.col("shard") != home)
    second = searched(dealt, rest.select("dim", "shard", "block", "id", "v", F.coalesce("kth", F.lit(LEAST).cast("long")).alias("kth")))
    both = first.union(second)  # at most k rows for each query and shard
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= s.k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op2_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 10
"""
