"""Online forms of the folds: Structured Streaming with per-key state.

Each operator is a stateful processor of transformWithStateInPandas (state in
RocksDB), so a stream resumes where it stopped. Rows of a batch are sorted by
their order column inside a key; results equal the batch operators' for input
that comes in order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

BET_CLIP, WEALTH_FLOOR = 1 - 1e-6, math.log(1e-12)


def _frame(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    parts = list(rows)
    return pd.concat(parts).sort_values(by, kind="stable") if parts else pd.DataFrame()


class _Fold(StatefulProcessor):
    """A fold with one state row for each key."""

    state_schema = ""
    by: list[str] = ["tick"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.state_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        out, held = self.fold(key, _frame(rows, self.by), held)
        if held is not None:
            self.state.update(held)
        if len(out):
            yield out

    def close(self) -> None:
        pass


class CounterRates(_Fold):
    """Rates of a counter's consecutive samples (value, ts), in order of arrival."""

    state_schema, by = "value double, ts double", ["arrival"]

    def fold(self, key, df, held):
        out = []
        for r in df.itertuples():
            if held is not None:
                v, t = held
                dt = r.ts - t
                wrap = dt > 0 and r.value < v and v > 0.9 * 4294967295
                rate = None if dt <= 0 or r.value < v and not wrap else ((4294967296 - v + r.value) if wrap else r.value - v) / dt
                out.append((key[0], r.arrival, rate, dt, wrap, dt > 0 and r.value < v and not wrap))
            held = (float(r.value), float(r.ts))
        return pd.DataFrame(out, columns=["series", "arrival", "rate", "elapsed", "wrapped", "reset"]), held


class Betting(_Fold):
    """Log-wealth after each value; rows carry mean, variance and phi of their series."""

    state_schema = "log_m double, bet double, n double, mean double, second double, last double"

    def fold(self, key, df, held):
        log_m, bet, n, mean, second, last = held or (0.0,) * 6
        out = []
        for r in df.itertuples():
            scale, c = 3 * math.sqrt(max(r.variance, 0.0)), r.x - r.mean
            if not math.isnan(c):
                z = max(-1.0, min(1.0, (c - r.phi * last) / scale)) if scale > 0 else 0.0
                raw = mean / second if second > 0 else 0.0
                if abs(raw) <= BET_CLIP:
                    bet = raw
                else:
                    inner = 1 + bet * mean
                    bet = max(-BET_CLIP, min(BET_CLIP, bet + mean / inner / max(second, 1e-6))) if abs(inner) >= 1e-9 else 0.0
                gain = 1 + bet * z
                log_m = max(WEALTH_FLOOR, log_m + math.log(gain)) if gain > 0 else WEALTH_FLOOR
                n += 1
                mean, second, last = mean + (z - mean) / n, second + (z * z - second) / n, c
            out.append((key[0], r.tick, log_m))
        return pd.DataFrame(out, columns=["series", "tick", "log_m"]), (log_m, bet, n, mean, second, last)


class Mixture(_Fold):
    """Gaussian mixture wealth of the whitened running sum."""

    state_schema = "s double, t double, last double, fired boolean"

    def fold(self, key, df, held):
        s, t, last, fired = held or (0.0, 0.0, 0.0, False)
        out = []
        for r in df.itertuples():
            c = r.x - r.mean
            s, t, last = s + c - r.phi * last, t + 1, c
            d = r.variance * t + r.variance
            log_m = min(120.0, s * s / (2 * d) + 0.5 * math.log(r.variance / d))
            fired = fired or log_m >= math.log(20)
            out.append((key[0], r.tick, log_m, fired))
        return pd.DataFrame(out, columns=["series", "tick", "log_m", "fired"]), (s, t, last, fired)


class Tiers(_Fold):
    """Samples since the last change of seed, and the confidence they give."""

    state_schema = "seed string, n long"

    def fold(self, key, df, held):
        seed, n = held or (None, 0)
        out = []
        for r in df.itertuples():
            n = n + 1 if seed is None or seed == str(r.seed) else 1
            seed = str(r.seed)
            out.append((key[0], r.tick, n, "strict" if n >= 60 else "warm_start" if n >= 20 else "none"))
        return pd.DataFrame(out, columns=["series", "tick", "n_samples", "confidence"]), (seed, n)


class Groups(_Fold):
    """Group start and lateness of each verdict of a key (see operators.grouping)."""

    state_schema, by = "open long, closed_at long, closed_group long", ["ts", "seq"]
    window_s, grace_s = 300, 60

    def fold(self, key, df, held):
        opened, closed_at, closed = (None if v is None or v < 0 else v for v in held) if held else (None, None, None)
        out = []
        for r in df.itertuples():
            t = int(r.ts)
            rotates = opened is not None and t - opened > self.window_s
            late = opened is None and closed_at is not None and t - closed_at <= self.grace_s
            group = closed if late else t if opened is None or rotates else opened
            if rotates:
                closed_at, closed = t, opened
            if not late:
                opened = group
                if r.terminal:
                    opened, closed_at, closed = None, t, group
            out.append((*key, r.seq, group, late))
        return pd.DataFrame(out, columns=["event_key", "deploy_ref", "seq", "window_start_ts", "late_arrival"]), tuple(-1 if v is None else v for v in (opened, closed_at, closed))


class ClosedGroups(StatefulProcessor):
    """Each verdict group once, when it is final: by the verdict that rotates it, or by an event-time timer.

    A group is final when the next one of its key opens, when the watermark has
    passed the last second of its window while it was open, or the last second of
    the grace after a terminal verdict. The state holds at most one open and one
    closed group of a key and is cleared when both are told, so idle keys leave
    nothing behind. Rows come with `ts` in seconds and `event_time`, the watermarked
    timestamp; rows behind the watermark have been dropped before.
    """

    window_s, grace_s = 300, 60
    _FIELDS = ("open_start", "open_n", "open_firing", "open_last", "closed_at", "closed_start", "closed_n", "closed_firing", "closed_late", "closed_last")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("groups", ", ".join(f"{f} long" for f in self._FIELDS))

    def _load(self) -> dict:
        return dict(zip(self._FIELDS, self.state.get() if self.state.exists() else [-1] * len(self._FIELDS), strict=True))

    def _save(self, g: dict) -> None:
        if g["open_start"] < 0 and g["closed_at"] < 0:
            self.state.clear()
        else:
            self.state.update(tuple(g[f] for f in self._FIELDS))

    def _frame(self, out: list) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=["event_key", "deploy_ref", "window_start_ts", "last_ts", "n_verdicts", "n_firing", "n_late", "reason"])

    def _tell_closed(self, key, g: dict, out: list) -> None:
        if g["closed_at"] >= 0:
            out.append((*key, g["closed_start"], g["closed_last"], g["closed_n"], g["closed_firing"], g["closed_late"], "terminal_verdict"))
            g["closed_at"] = -1

    def _tell_open(self, key, g: dict, out: list) -> None:
        if g["open_start"] >= 0:
            out.append((*key, g["open_start"], g["open_last"], g["open_n"], g["open_firing"], 0, "window_elapsed"))
            g["open_start"] = -1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        g, out = self._load(), []
        for r in _frame(rows, ["ts", "seq"]).itertuples():
            t, firing = int(r.ts), int(r.firing)
            rotates = g["open_start"] >= 0 and t - g["open_start"] > self.window_s
            if rotates:
                self._tell_open(key, g, out)
            elif g["open_start"] < 0 and g["closed_at"] >= 0 and t - g["closed_at"] <= self.grace_s:
                g |= {"closed_n": g["closed_n"] + 1, "closed_firing": g["closed_firing"] + firing, "closed_late": g["closed_late"] + 1, "closed_last": t}
                continue
            if g["open_start"] < 0:
                self._tell_closed(key, g, out)
                g |= {"open_start": t, "open_n": 0, "open_firing": 0}
                self.handle.registerTimer((t + self.window_s + 1) * 1000)
            g |= {"open_n": g["open_n"] + 1, "open_firing": g["open_firing"] + firing, "open_last": t}
            if r.terminal:
                g |= {"closed_at": t, "closed_start": g["open_start"], "closed_n": g["open_n"], "closed_firing": g["open_firing"], "closed_late": 0, "closed_last": t, "open_start": -1}
                self.handle.registerTimer((t + self.grace_s + 1) * 1000)
        self._save(g)
        yield from self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, g, out = expiredTimerInfo.getExpiryTimeInMs() // 1000, self._load(), []
        if g["closed_at"] >= 0 and g["closed_at"] + self.grace_s < now:
            self._tell_closed(key, g, out)
        if g["open_start"] >= 0 and g["open_start"] + self.window_s < now:
            self._tell_open(key, g, out)
        self._save(g)
        yield from self._frame(out)

    def close(self) -> None:
        pass


def closed_groups(verdicts: DataFrame, window_s: int = 300, grace_s: int = 60, late: str = "0 seconds") -> DataFrame:
    """The stream of final verdict groups: event_key, deploy_ref, window_start_ts, last_ts, n_verdicts, n_firing, n_late, reason.

    Verdicts: cluster_event_id, deploy_ref, ts (seconds), seq, terminal, families.
    Rows that come more than `late` behind the newest are dropped.
    """
    from pyspark.sql import functions as F

    v = verdicts.select(F.coalesce("cluster_event_id", F.lit("")).alias("event_key"), "deploy_ref", F.col("ts").cast("long").alias("ts"), "seq", F.coalesce("terminal", F.lit(False)).alias("terminal"), (F.size("families") > 0).cast("int").alias("firing"), F.timestamp_seconds("ts").alias("event_time")).where("ts is not null")
    p = ClosedGroups()
    p.window_s, p.grace_s = window_s, grace_s
    out = "event_key string, deploy_ref string, window_start_ts long, last_ts long, n_verdicts long, n_firing long, n_late long, reason string"
    return v.withWatermark("event_time", late).groupBy("event_key", "deploy_ref").transformWithStateInPandas(statefulProcessor=p, outputStructType=out, outputMode="Append", timeMode="EventTime")


OUTPUT = {
    CounterRates: "series long, arrival long, rate double, elapsed double, wrapped boolean, reset boolean",
    Betting: "series long, tick long, log_m double",
    Mixture: "series long, tick long, log_m double, fired boolean",
    Tiers: "series long, tick long, n_samples long, confidence string",
    Groups: "event_key string, deploy_ref string, seq long, window_start_ts long, late_arrival boolean",
}


def stateful(df: DataFrame, keys: list[str], processor: type[_Fold], **settings) -> DataFrame:
    """The streaming frame with a processor's output; needs the RocksDB state store provider."""
    p = processor()
    for k, v in settings.items():
        setattr(p, k, v)
    return df.groupBy(*keys).transformWithStateInPandas(statefulProcessor=p, outputStructType=OUTPUT[processor], outputMode="Append", timeMode="None")


def windowed_counts(df: DataFrame, width: str = "5 minutes", late: str = "1 minute") -> DataFrame:
    """Fired rows by tumbling window and kind, with a watermark for late rows; ts is a timestamp with zone."""
    from pyspark.sql import functions as F

    return df.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def append_only(df: DataFrame, path: str, checkpoint: str):
    """Starts a stream that appends Parquet; resumes from its checkpoint."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
