"""Hard negatives by angular triangle filtering.

Each vector is stored with its norm and its angles to fixed reference directions
(rows of the table itself, at most 16). By the triangle inequality an anchor at
angle a and a row at angle b from a reference are between |a - b| and a + b apart
(2 pi - a - b beyond pi), so each reference gives an interval of their cosine;
the narrowest of all, times both norms and widened by more than rounding can
change, bounds the integer score. Only rows whose interval overlaps the window
that is asked for are scored in integers, and only these scores decide.

Blocks of vectors are tested as a whole first, by the least and largest angle
and norm in them, then their rows one by one. Positives come in two turns: the
AHEAD most promising blocks of an anchor first, then those whose bound reaches the
k-th score found. A positive of score p opens the window of negatives from
p/2 to 95p/100; negatives come in the same two turns, with the window's lower end
raised to the k-th score of the first. All blocks hold all labels, so a hot label is no hot key.

Defined results: those of vectors.py; null labels take no part; labels are
shifted to (label + 1) % 10 where vec_id is divisible by 7; a window of a negative
p is empty; an anchor without positives or a positive without negatives gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import forgotten, written
from .vectors import Block, angles, blocks, directions, first, meet, norms, queries, references, scores, slack, stacked

AHEAD = 4
DIRECTORY = 4096
#: Anchors of a kernel step.
STEP = 32
_FOUND = "query long, query_id long, row long, id long, score long"


def between(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest cosine of (anchor, row) for angles `a` (anchors x references) and `low` to `high` (rows x references).

    The cosine falls from 0 to pi, so the intervals of all references are cut as angles first.
    """
    near, far = np.zeros((len(a), len(low))), np.full((len(a), len(low)), np.pi)
    for j in range(a.shape[1]):
        x, lo, hi = a[:, j][:, None], low[:, j], high[:, j]
        if low is high:
            np.maximum(near, np.abs(lo - x), out=near)
            total = x + lo
            np.minimum(far, total, out=far)
            np.minimum(far, 2 * np.pi - total, out=far)
        else:
            np.maximum(near, np.maximum(lo - x, x - hi), out=near)
            np.minimum(far, np.where(x + hi <= np.pi, x + hi, np.where(x + lo >= np.pi, 2 * np.pi - x - lo, np.pi)), out=far)
    return np.cos(np.maximum(far, near), out=far), np.cos(near, out=near)


def bounds(q: np.ndarray, a: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the score for anchors q and rows (or blocks) with norms from `least` to `most`."""
    lo, hi = between(a, low, high)
    size = norms(q)[:, None]
    wide = slack(size * most)
    return size * np.minimum(lo * least, lo * most) - wide, size * np.maximum(hi * least, hi * most) + wide


def _angular(refs: dict[int, np.ndarray]):
    def extra(x: np.ndarray) -> dict:
        a, n = angles(x, directions(refs, x.shape[1])), norms(x)
        return {"angles": a.tobytes(), "norms": n.tobytes(), "low": a.min(0).tobytes(), "high": a.max(0).tobytes(), "least": float(n.min()), "most": float(n.max())}

    return extra


_EXTRA = "angles binary, norms binary, low binary, high binary, least double, most double"


def _hold(row: dict) -> tuple[Block, np.ndarray, np.ndarray]:
    b = Block(row)
    return b, b.numbers("angles").reshape(len(b.ids), -1), b.numbers("norms")


def _hold_entry(row: dict) -> tuple:
    return row["shard"], row["dim"], np.frombuffer(row["low"], np.float64), np.frombuffer(row["high"], np.float64), row["least"], row["most"]


def _block_bounds(refs: dict[int, np.ndarray]):
    def serve(states: list[tuple], b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        dims, qd = np.array([s[1] for s in states]), b.column("dim").to_numpy()
        shards = np.array([s[0] for s in states])
        for d in np.unique(qd):
            at, who = np.flatnonzero(dims == d), np.flatnonzero(qd == d)
            if not len(at):
                continue
            q = stacked(b.column("q").take(pa.array(who)), d)
            low, high, least, most = (np.array([states[i][m] for i in at]) for m in (2, 3, 4, 5))
            lo, hi = bounds(q, angles(q, directions(refs, int(d))), low, high, least, most)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("query").to_numpy()[who], len(at))), pa.array(np.tile(shards[at], len(who))), pa.array(lo.ravel()), pa.array(hi.ravel())], names=["query", "shard", "lo", "hi"])

    return serve


def _steps(states: list[tuple], b: pa.RecordBatch, refs: dict[int, np.ndarray]) -> Iterator[tuple]:
    """Anchors of a batch by STEP, in order of their nearest reference and angle, with each held block."""
    for block, a, n in states:
        q = stacked(b.column("q"), block.dim)
        qa = angles(q, directions(refs, block.dim))
        order = np.lexsort((qa.min(1), qa.argmin(1)))
        for i in range(0, len(q), STEP):
            who = order[i : i + STEP]
            lo, hi = bounds(q[who], qa[who], a, a, n, n)
            yield block, who, q[who], lo, hi


def _scored(block: Block, q: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, place, score) of the pairs in `on`; anchors of a step share the rows that any of them needs."""
    cols = np.flatnonzero(on.any(0))
    if not len(cols):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64)
    i, j = np.nonzero(on[:, cols])
    return i, cols[j], scores(q, block.x[cols])[i, j]


def _positives(k: int, refs: dict[int, np.ndarray]):
    def serve(states: list[tuple], b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own, labels, ids = b.column("query").to_numpy(), b.column("query_label").to_numpy(), b.column("query_id")
        kth = b.column("kth").cast(pa.float64()).fill_null(-np.inf).to_numpy()
        for block, who, q, _, hi in _steps(states, b, refs):
            i, j, s = _scored(block, q, (hi >= kth[who][:, None]) & (block.labels == labels[who][:, None]) & (block.rows != own[who][:, None]))
            best = first(i, s, block.ids[j], block.rows[j], k)
            i, j, s = who[i[best]], j[best], s[best]
            yield pa.RecordBatch.from_arrays([pa.array(own[i]), ids.take(pa.array(i)), pa.array(block.rows[j]), pa.array(block.ids[j], mask=~block.known[j]), pa.array(s)], names=["query", "query_id", "row", "id", "score"])

    return serve


def _negatives(k: int, refs: dict[int, np.ndarray]):
    """An anchor's windows come as lists from and to; each window gets its own best k."""

    def serve(states: list[tuple], b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own, labels = b.column("query").to_numpy(), b.column("query_label").to_numpy()
        lists = b.column("windows")
        n = lists.value_lengths().to_numpy()
        at = np.append(0, np.cumsum(n))
        flat = lists.flatten()
        wlo, whi, positive = (flat.field(name).to_numpy(zero_copy_only=False) for name in ("lo", "hi", "positive"))
        for block, who, q, lo, hi in _steps(states, b, refs):
            low, high = (np.array([f(w[at[x] : at[x + 1]]) for x in who]) for f, w in ((np.min, wlo), (np.max, whi)))
            i, j, s = _scored(block, q, (hi >= low[:, None]) & (lo <= high[:, None]) & (block.labels != labels[who][:, None]))
            for m in range(n[who].max()):
                mine = np.minimum(at[who] + m, at[who + 1] - 1)
                keep = np.flatnonzero((n[who] > m)[i] & (s >= wlo[mine][i]) & (s <= whi[mine][i]))
                p, r = i[keep], j[keep]
                best = first(p, s[keep], block.ids[r], block.rows[r], k)
                p, r, v = p[best], r[best], s[keep][best]
                yield pa.RecordBatch.from_arrays([pa.array(own[who[p]]), pa.array(positive[mine[p]]), pa.array(block.rows[r]), pa.array(block.ids[r], mask=~block.known[r]), pa.array(v)], names=["query", "positive", "row", "id", "score"])

    return serve


def hard_negatives(table: DataFrame, positives: int = 5, negatives: int = 3, every: int = 50, low: int = 50, high: int = 95, vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors with an id divisible by `every`.

    A negative has another label and low * positive <= 100 * score <= high * positive.
    """
    label = F.when(F.col("vec_id") % 7 == 0, ((F.col("label").cast("decimal(20, 0)") + 1) % 10).cast("long")).otherwise(F.col("label"))
    refs = references(table, vector)
    held = blocks(table, refs, _angular(refs), _EXTRA, vector, label)
    anchors = queries(held, every)
    parts = max(1, -(-held.count() // DIRECTORY))
    catalog = held.select(F.pmod(F.xxhash64("shard"), F.lit(parts)).alias("part"), "shard", "dim", "low", "high", "least", "most")
    everywhere = anchors.select("query", "dim", "q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    near = meet(catalog, everywhere, "part", "part", _hold_entry, _block_bounds(refs), "query long, shard long, lo double, hi double")
    near = written(near.withColumn("turn", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("hi"), "shard"))), "bounds")
    order = (F.desc("score"), F.col("id").asc_nulls_last(), "row")
    best = Window.partitionBy("query").orderBy(*order)
    stored = held.drop("low", "high", "least", "most")

    def turn(visits: DataFrame, asked: DataFrame) -> DataFrame:
        return meet(stored, visits.join(asked, "query").select("shard", "query", "query_id", "query_label", "q", "kth"), "shard", "shard", _hold, _positives(positives, refs), _FOUND)

    ahead = written(turn(near.where(F.col("turn") <= AHEAD), anchors.withColumn("kth", F.lit(None).cast("long"))), "ahead")
    ranked = ahead.withColumn("n", F.row_number().over(best)).where(F.col("n") <= positives)
    shared = anchors.join(ranked.where(F.col("n") == positives).select("query", F.col("score").alias("kth")), "query", "left")
    rest = turn(near.where(F.col("turn") > AHEAD).join(shared.select("query", F.col("kth").alias("least")), "query").where("least is null or hi >= least").drop("least"), shared)
    found = written(ranked.drop("n").unionByName(rest).withColumn("n", F.row_number().over(best)).where(F.col("n") <= positives), "positives")

    p = F.col("score").cast("decimal(38, 0)")
    window = F.struct(F.ceil(p * low / 100).cast("long").alias("lo"), F.floor(p * high / 100).cast("long").alias("hi"), F.col("row").alias("positive"))
    windows = written(found.where("score >= 0").select("query", window.alias("w")).select("query", "w.*"), "windows")
    each = Window.partitionBy("query", "positive").orderBy(*order)

    def mine(visits: DataFrame, windows: DataFrame) -> DataFrame:
        """The best of each window among the blocks of `visits` that overlap any window of their anchor."""
        asked = windows.groupBy("query").agg(F.collect_list(F.struct("lo", "hi", "positive")).alias("windows"), F.min("lo").alias("from"), F.max("hi").alias("to"))
        visits = visits.select("query", "shard", "lo", "hi").join(asked, "query").where("hi >= `from` and lo <= `to`").select("query", "shard", "windows").join(anchors, "query").select("shard", "query", "query_label", "q", "windows")
        return meet(stored, visits, "shard", "shard", _hold, _negatives(negatives, refs), "query long, positive long, row long, id long, score long")

    early = written(mine(near.where(F.col("turn") <= AHEAD), windows), "early").withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= negatives)
    least = early.where(F.col("rank") == negatives).select("query", "positive", F.col("score").alias("least"))
    raised = windows.join(least, ["query", "positive"], "left").withColumn("lo", F.greatest("lo", F.coalesce("least", "lo"))).drop("least")
    mined = early.drop("rank").unionByName(mine(near.where(F.col("turn") > AHEAD), raised)).withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= negatives)
    out = mined.select("query", "positive", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(
        found.select("query", F.col("row").alias("positive"), F.col("query_id").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["query", "positive"]
    )
    out = written(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    forgotten(held, anchors, near, ahead, found, windows)
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Every anchor against every row, for small tables.
OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS n
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(n AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE n <= 3
"""
