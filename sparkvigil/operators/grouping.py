"""Verdict groups: windows anchored at their first verdict, terminal closes, late arrivals within a grace period."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.walks import Jumps, anchored


class _Windows(Jumps):
    """Anchors are verdicts that open a group: state (1, its first ts, 0) while it is open, (0, close, first ts) once a terminal verdict closed it."""

    added = "window_start_ts long, late_arrival boolean"

    def __init__(self, window_s: int, grace_s: int):
        self.window, self.grace = window_s, grace_s

    def _closing(self, rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For a group opened at each row: the row past its window, the first terminal row, and whether that comes first."""
        t, n = rows["ts"], len(rows["ts"])
        past = np.searchsorted(t, t + self.window, "right")
        at = np.where(rows["_end"].astype(bool), np.arange(n), n)
        end = np.minimum.accumulate(at[::-1])[::-1]
        return past, end, end < past

    def _next(self, t: np.ndarray, past: int, end: int) -> int:
        return int(np.searchsorted(t, t[end] + self.grace, "right")) if end < past else int(past)

    def enter(self, state: tuple | None, rows: dict[str, np.ndarray]) -> int:
        t = rows["ts"]
        if state is None:
            return 0
        if not state[0]:
            return int(np.searchsorted(t, state[1] + self.grace, "right"))
        return self._next(t, np.searchsorted(t, state[1] + self.window, "right"), self._closing(rows)[1][0])

    def after(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        t, (past, end, closed) = rows["ts"], self._closing(rows)
        return np.where(closed, np.searchsorted(t, t[np.minimum(end, len(t) - 1)] + self.grace, "right"), past)

    def leave(self, rows: dict[str, np.ndarray], at: np.ndarray) -> list[tuple]:
        t, (_, end, closed) = rows["ts"], self._closing(rows)
        return [(0, int(t[end[i]]), int(t[i])) if closed[i] else (1, int(t[i]), 0) for i in at]

    def passed(self, state: tuple | None, rows: dict[str, np.ndarray]) -> tuple | None:
        end = self._closing(rows)[1][0]
        return (0, int(rows["ts"][end]), state[1]) if state[0] and end < len(rows["ts"]) else state

    def reach(self, rows: dict[str, np.ndarray]) -> int:
        t, (past, end, closed) = rows["ts"], self._closing(rows)
        grace = int(np.searchsorted(t, t[0] + self.grace, "right"))
        return max(int(past[0]), self._next(t, past[0], end[0]), grace) + 1

    def told(self, state: tuple | None, rows: dict[str, np.ndarray], anchors: np.ndarray) -> dict[str, np.ndarray]:
        t, (_, end, closed) = rows["ts"], self._closing(rows)
        i = np.arange(len(t))
        own = np.maximum.accumulate(np.where(anchors, i, -1))
        group, late = t[np.maximum(own, 0)], closed[np.maximum(own, 0)] & (i > end[np.maximum(own, 0)])
        if state is not None:
            before = own < 0
            group = np.where(before, state[1] if state[0] else state[2], group)
            late = np.where(before, (i > end[0]) if state[0] else True, late)
        return {"window_start_ts": group, "late_arrival": late}


def assigned(verdicts: DataFrame, window_s: int = 300, grace_s: int = 60) -> DataFrame:
    """Verdicts with group_id, the start of its window, and late_arrival. Keys are (cluster_event_id, deploy_ref).

    A verdict more than window_s after the group's first closes it and opens the
    next, a terminal one closes its own; only when nothing is open may a verdict
    join the last closed group, within grace_s of its close. The row that opens a
    group decides where the next one opens, so a key's verdicts are many blocks
    (functions/walks.py). A verdict without ts joins no group (nulls); a null
    `terminal` is false.
    """
    keys = ["event_key", "deploy_ref"]
    v = verdicts.withColumns({"event_key": F.coalesce("cluster_event_id", F.lit("")), "ts": F.col("ts").cast("long")}).select(*keys, "ts", "seq", "tick", "terminal", "families", "alpha", F.coalesce("terminal", F.lit(False)).cast("int").alias("_end"))
    flat = anchored(v, keys, ["ts", "seq"], ["ts", "_end"], _Windows(window_s, grace_s)).drop("_end")
    parts = F.when(F.col("event_key") != "", F.concat_ws("-", F.lit("group"), "event_key", "deploy_ref", "window_start_ts")).otherwise(F.concat_ws("-", F.lit("group"), "deploy_ref", "window_start_ts"))
    return flat.withColumn("group_id", F.when(F.col("window_start_ts").isNotNull(), parts))


def summarised(assigned_rows: DataFrame, saturation: int = 3) -> DataFrame:
    """One row for each group: size, root cause (earliest tick, then most alpha), confidence by distinct firing families."""
    firing = F.size("families") > 0
    cause = F.min_by("seq", F.when(firing, F.struct("tick", (-F.col("alpha")).alias("a"), "ts", "seq")))
    fams = F.array_distinct(F.flatten(F.collect_list(F.when(firing, F.col("families")))))
    g = assigned_rows.groupBy("group_id", "event_key", "deploy_ref", "window_start_ts").agg(F.count("*").alias("n_verdicts"), F.sum(firing.cast("int")).alias("n_firing"), F.sum(F.col("late_arrival").cast("int")).alias("n_late"), F.max("ts").alias("last_ts"), F.when(F.sum(firing.cast("int")) > 0, cause).alias("root_seq"), F.size(fams).alias("n_families"))
    return g.withColumn("confidence", F.least(F.lit(1.0), F.col("n_families") / saturation))


def feed_request(groups: DataFrame) -> DataFrame:
    """The JSON line that a downstream feed gets for each group."""
    return groups.select("group_id", F.to_json(F.struct("group_id", F.col("deploy_ref").alias("deploy_id"), "window_start_ts", F.col("n_families").alias("firing_family_count"), "confidence")).alias("request"))


def frozen_intervals(events: DataFrame, hold_s: int = 300) -> DataFrame:
    """Event-time intervals during which residuals must not learn: [ts, ts + hold], overlapping ones merged."""
    w = Window.partitionBy("shard").orderBy("event_ts")
    e = events.select("shard", "event_ts", (F.col("event_ts") + hold_s).alias("until"))
    e = e.withColumn("_m", F.max("until").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    e = e.withColumn("_g", F.sum(F.when(F.col("event_ts") > F.coalesce("_m", F.lit(-1)), 1).otherwise(0)).over(w))
    return e.groupBy("shard", "_g").agg(F.min("event_ts").alias("since"), F.max("until").alias("until")).drop("_g")


def unfrozen(samples: DataFrame, intervals: DataFrame) -> DataFrame:
    """Samples outside every frozen interval of their shard: by the latest end of the intervals that began, so samples and intervals are merged, not joined."""
    both = samples.withColumns({"_k": F.lit(1), "_until": F.lit(None).cast("bigint")}).unionByName(intervals.select("shard", F.col("since").alias("ts"), F.lit(0).alias("_k"), F.col("until").cast("bigint").alias("_until")), allowMissingColumns=True)
    w = Window.partitionBy("shard").orderBy("ts", "_k").rowsBetween(Window.unboundedPreceding, 0)
    marked = both.withColumn("_end", F.max("_until").over(w)).where("_k = 1")
    return marked.where("_end is null or ts > _end").select(*samples.columns)
