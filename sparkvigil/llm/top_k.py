"""Exact top k by inner product: a ball tree in each shard, searched by branch and bound.

Shards are the blocks of vectors.py. A query meets the shards in two turns. The
directory (one centre and radius for each shard) gives an upper bound of the
inner product for each query and shard. First a query visits the AHEAD shards of
the highest bounds; the k-th best score found there is shared with all other
shards: a shard is visited in the second turn only if its bound reaches that
score. Inside a shard, nodes of the tree are bounded by level, leaves come in
descending order of their bounds, and the current k-th score drops nodes at each
step. Bounds are raised by more than rounding can take from them, and a node is
left out only below the k-th score, so ties and results are exact.

Defined results: those of vectors.py; a query with fewer than k other rows gets
all; no usable row or no query gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import forgotten, written
from .vectors import LAST, Block, blocks, first, meet, norms, queries, references, scores, slack, stacked

LEAF = 128
AHEAD = 4
#: A part of the directory has about so many shards.
DIRECTORY = 4096
_FOUND = "query long, query_id long, row long, id long, score long"


class Tree:
    """A balanced ball tree over rows x: each level halves the nodes of the one above along the way to their farthest rows."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order, nodes, self.levels = np.arange(len(x)), [(0, len(x))], []
        while True:
            c = np.array([x[self.order[a:b]].mean(0) for a, b in nodes])
            r = np.array([norms(x[self.order[a:b]] - m).max() for (a, b), m in zip(nodes, c, strict=True)])
            self.levels.append((c, r))
            if max(b - a for a, b in nodes) <= leaf:
                self.leaves = nodes
                return
            halves = []
            for (a, b), m in zip(nodes, c, strict=True):
                own = self.order[a:b]
                far = x[own[norms(x[own] - m).argmax()]]
                along, mid = (x[own] - m) @ (far - m), max(1, (b - a) // 2)
                self.order[a:b] = own[np.argpartition(along, min(mid, b - a - 1))]
                halves += [(a, a + mid), (a + mid if b - a > 1 else a, b)]
            nodes = halves


def search(tree: Tree, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, q: np.ndarray, own: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query, score, place) of each query's best k with scores of at least kth (-inf: any), and the number of products."""
    size, kth = norms(q), kth.copy()
    bound = np.full((len(q), 1), np.inf)
    for c, r in tree.levels:
        if len(c) > bound.shape[1]:
            bound = np.repeat(bound, 2, axis=1)
        at = np.flatnonzero((bound > -np.inf).any(0))
        part = q @ c[at].T + size[:, None] * r[at]
        part += slack(size[:, None] * (norms(c[at]) + r[at]))
        bound[:, at] = np.where(part < kth[:, None], -np.inf, np.minimum(bound[:, at], part))
    order, made = np.argsort(-bound, axis=1, kind="stable"), 0
    fq, fs, fp = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, int)
    for turn in range(order.shape[1]):
        leaf = order[:, turn]
        top = bound[np.arange(len(q)), leaf]
        on = np.flatnonzero((top > -np.inf) & (top >= kth))
        if not len(on):
            break
        new = []
        for n in np.unique(leaf[on]):
            who, where = on[leaf[on] == n], tree.order[slice(*tree.leaves[n])]
            s = scores(q[who], x[where])
            made += s.size
            i, j = np.nonzero((s >= kth[who][:, None]) & (rows[where][None, :] != own[who][:, None]))
            new.append((who[i], s[i, j], where[j]))
        fq, fs, fp = (np.concatenate([old, *(t[m] for t in new)]) for m, old in enumerate((fq, fs, fp)))
        best = first(fq, fs, ids[fp], rows[fp], k)
        fq, fs, fp = fq[best], fs[best], fp[best]
        full = np.flatnonzero(np.bincount(fq, minlength=len(q)) == k)
        kth[full] = np.maximum(kth[full], fs[np.searchsorted(fq, full, "right") - 1])
    return fq, fs, fp, made


def _ball(x: np.ndarray) -> dict:
    c = x.mean(0)
    return {"centre": c.tobytes(), "radius": float(norms(x - c).max())}


def _bounds(states: list[tuple], b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    shards, dims = np.array([s[0] for s in states]), np.array([s[1] for s in states])
    qd = b.column("dim").to_numpy()
    for d in np.unique(qd):
        at, who = np.flatnonzero(dims == d), np.flatnonzero(qd == d)
        if not len(at):
            continue
        q, c, r = stacked(b.column("q").take(pa.array(who)), d), np.array([states[i][2] for i in at]).reshape(len(at), d), np.array([states[i][3] for i in at])
        size = norms(q)[:, None]
        u = q @ c.T + size * r + slack(size * (norms(c) + r))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("query").to_numpy()[who], len(at))), pa.array(np.tile(shards[at], len(who))), pa.array(u.ravel())], names=["query", "shard", "bound"])


def _hold(row: dict) -> tuple[Block, Tree]:
    return (b := Block(row)), Tree(b.x)


def _serve(k: int):
    def serve(states: list[tuple[Block, Tree]], b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block, tree in states:
            q, own = stacked(b.column("q"), block.dim), b.column("query").to_numpy()
            kth = b.column("kth").fill_null(-LAST).to_numpy().astype(np.float64)
            kth[kth <= -LAST] = -np.inf
            i, s, p, _ = search(tree, block.x, block.ids, block.rows, q, own, kth, k)
            yield pa.RecordBatch.from_arrays([pa.array(own[i]), b.column("query_id").take(pa.array(i)), pa.array(block.rows[p]), pa.array(block.ids[p], mask=~block.known[p]), pa.array(s)], names=["query", "query_id", "row", "id", "score"])

    return serve


def top_k(table: DataFrame, k: int = 5, every: int = 50, vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row whose vec_id is divisible by `every`."""
    held = blocks(table, references(table, vector), _ball, "centre binary, radius double", vector)
    asked = queries(held, every)
    parts = max(1, -(-held.count() // DIRECTORY))
    catalog = held.select(F.pmod(F.xxhash64("shard"), F.lit(parts)).alias("part"), "shard", "dim", "centre", "radius")
    everywhere = asked.select("query", "dim", "q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    bounds = meet(catalog, everywhere, "part", "part", lambda r: (r["shard"], r["dim"], np.frombuffer(r["centre"], np.float64), r["radius"]), _bounds, "query long, shard long, bound double")
    bounds = written(bounds.withColumn("turn", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "shard"))), "bounds")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")

    def turn(visits: DataFrame, kth: DataFrame) -> DataFrame:
        return meet(held.drop("centre", "radius"), visits.join(kth, "query").select("shard", "query", "query_id", "q", "kth"), "shard", "shard", _hold, _serve(k), _FOUND)

    ahead = written(turn(bounds.where(F.col("turn") <= AHEAD), asked.withColumn("kth", F.lit(None).cast("long"))), "ahead")
    ranked = ahead.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    shared = asked.join(ranked.where(F.col("rank") == k).select("query", F.col("score").alias("kth")), "query", "left")
    rest = turn(bounds.where(F.col("turn") > AHEAD).join(shared.select("query", F.col("kth").alias("least")), "query").where("least is null or bound >= least").drop("least"), shared)
    out = written(ranked.drop("rank").unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score"), "top")
    forgotten(held, asked, bounds, ahead)
    return out


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Every query against every row, for small tables.
OP12_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""
