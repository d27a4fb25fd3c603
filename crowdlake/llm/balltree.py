"""Operator 3: exact top-k inner products by ball trees, branch and bound.

Rows are dealt into shards of bounded size by a hash of their id; each shard's task builds a ball tree over its rows. A node's best possible
score for a query is ``q . centre + |q| * radius``; nodes are visited in descending order of that bound, and a node whose bound is below the query's
k-th score so far is cut off with all below it. Queries come in blocks. The first round sends each query to one shard; the
k-th score that it finds there goes along to all other shards in the second round, so their trees start with a bound that is already
shared. Scores are exact: components are whole numbers and all sums stay far below 2**53.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without an id; only vectors of one
length meet; identical repeated rows count once; a query's candidates are the rows with another id. Fewer than k candidates give all of them; equal scores go to
the smaller id. Empty tables give no rows. Columns other than the two named are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

LEAF = 128
#: Rows of a shard and queries of a block: what one task holds at a time.
SHARD, BLOCK = 8_192, 4_096


def vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, v``: rows with an id and a vector of finite doubles."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
            .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(~bad))


class BallTree:
    """Median splits along the direction between two far points; nodes in level order, leaves hold at most ``LEAF`` rows."""

    def __init__(self, x: np.ndarray):
        self.x, self.order = x, np.arange(len(x))
        self.lo, self.hi, self.left, self.right = [], [], [], []
        self._build(0, len(x))
        self.centre = np.array([x[self.order[a:b]].mean(0) for a, b in zip(self.lo, self.hi)])
        self.radius = np.array([np.sqrt(((x[self.order[a:b]] - c) ** 2).sum(1).max()) for a, b, c in zip(self.lo, self.hi, self.centre)]) * (1 + 1e-12) + 1e-9
        self.rows = x[self.order]

    def _build(self, a: int, b: int) -> int:
        node = len(self.lo)
        self.lo.append(a)
        self.hi.append(b)
        self.left.append(-1)
        self.right.append(-1)
        if b - a > LEAF:
            part = self.x[self.order[a:b]]
            far = part[np.argmax(((part - part[0]) ** 2).sum(1))]
            other = part[np.argmax(((part - far) ** 2).sum(1))]
            side = part @ (other - far)
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(side, mid)]
            self.left[node] = self._build(a, a + mid)
            self.right[node] = self._build(a + mid, b)
        return node

    def search(self, q: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best ``(score, id)`` per query (rows padded with -inf), better than or equal to ``floor``; ``own`` is left out."""
        n = len(q)
        score, found = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        ids = ids[self.order]
        norm = np.sqrt((q ** 2).sum(1))
        # Bounds from the root down: a node is live for the queries whose floor its bound reaches, among those for which its parent is.
        leaves, bounds = [], []
        level = [(0, np.arange(n))]
        while level:
            below = []
            for node, who in level:
                bound = q[who] @ self.centre[node] + norm[who] * self.radius[node] + 1e-6
                on = bound >= floor[who]
                if not on.any():
                    continue
                if self.left[node] < 0:
                    b = np.full(n, -np.inf)
                    b[who[on]] = bound[on]
                    leaves.append(node)
                    bounds.append(b)
                else:
                    below += [(self.left[node], who[on]), (self.right[node], who[on])]
            level = below
        if not leaves:
            return score, found
        bounds = np.stack(bounds, 1)
        order = np.argsort(-bounds, axis=1, kind="stable")
        for step in range(len(leaves)):
            nth = order[:, step]
            live = np.flatnonzero(bounds[np.arange(n), nth] >= np.maximum(floor, score[:, -1]))
            live = live[np.isfinite(bounds[live, nth[live]])]
            if not len(live):
                break
            by = nth[live]
            for leaf in np.unique(by):
                who = live[by == leaf]
                a, b = self.lo[leaves[leaf]], self.hi[leaves[leaf]]
                s = q[who] @ self.rows[a:b].T
                s[own[who][:, None] == ids[a:b][None, :]] = -np.inf
                s[s < floor[who][:, None]] = -np.inf
                both = np.concatenate([score[who], s], 1)
                name = np.concatenate([found[who], np.broadcast_to(ids[a:b], s.shape)], 1)
                best = np.lexsort((name, -both), axis=1)[:, :k]
                score[who], found[who] = np.take_along_axis(both, best, 1), np.take_along_axis(name, best, 1)
        return score, found


def _search_shards(pairs: DataFrame, k: int) -> DataFrame:
    """For each group of a shard's rows and one block of queries (``side`` 0 and 1): the k best rows per query."""
    def load(table):
        x = table.column("v").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        return table.column("vec_id").to_numpy(), x, table.column("floor").to_numpy()

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        ids, x, _ = load(table.filter(pa.array(side == 0)))
        qid, q, floor = load(table.filter(pa.array(side == 1)))
        if len(ids) and len(qid):
            score, found = BallTree(x).search(q, qid, ids, k, floor)
        else:
            score, found = np.empty((0, k)), np.empty((0, k), np.int64)
        row, col = np.nonzero(np.isfinite(score))
        return pa.table({"query_id": qid[row], "vec_id": found[row, col], "score": score[row, col].astype(np.int64)})

    return pairs.groupBy("dim", "shard", "block").applyInArrow(run, "query_id long, vec_id long, score long")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = SHARD, block_rows: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of integer-valued vectors: for each of ``queries`` the ``k`` highest of ``rows`` (both ``vec_id, v``)."""
    def dealt(df: DataFrame, name: str, most: int):
        """Rows with a number below ``n``, the same however often it is computed, so that each holds about ``most`` rows of one dimension."""
        count = df.groupBy("dim").agg(F.ceil(F.count("*") / most).cast("long").alias(f"{name}s"))  # a row per vector length
        return df.join(count, "dim").withColumn(name, F.pmod(F.xxhash64("vec_id", F.lit(name)), F.col(f"{name}s")))

    clean = materialize(rows.select("vec_id", "v", F.size("v").alias("dim")).distinct(), "vectors")
    asked = materialize(queries.select("vec_id", "v", F.size("v").alias("dim")).distinct(), "queries")
    base = materialize(dealt(clean, "shard", shard_rows), "shards")
    asks = materialize(dealt(asked, "block", block_rows).join(base.select("dim", "shards").distinct(), "dim"), "blocks")
    none = F.lit(float("-inf"))

    def meet(asking: DataFrame) -> DataFrame:
        """Every shard's rows beside each block that asks there."""
        where = asking.select("dim", "shard", "block").distinct()
        mine = base.join(where, ["dim", "shard"]).select("dim", "shard", "block", F.lit(0).alias("side"), "vec_id", "v", none.alias("floor"))
        return _search_shards(mine.unionByName(asking.select("dim", "shard", "block", F.lit(1).alias("side"), "vec_id", "v", "floor")), k)

    home = "pmod(xxhash64(vec_id, 'home'), shards)"
    first = materialize(meet(asks.withColumn("shard", F.expr(home)).withColumn("floor", none)), "first-round")
    kth = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), F.col("low").cast("double").alias("low"))
    others = (asks.join(kth, "vec_id", "left").withColumn("floor", F.coalesce("low", none))
              .withColumn("shard", F.explode(F.expr(f"filter(sequence(0L, shards - 1), s -> s <> {home})"))))
    second = meet(others.select("dim", "shard", "block", "vec_id", "v", "floor"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # at most k rows a shard
    return (first.unionByName(second).distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
