"""Minimum covariance determinant of cells of any size.

The steps are those of FastMCD: random starts of p + 1 rows, two concentration
steps each, the best ten concentrated until their determinant stays, the best of
these reweighted. A cell of at most `WHOLE` rows is fitted in one task. A larger
one is cut into blocks of rows, and each concentration step is a few jobs over
blocks: squared distances under all starts at once; the cutoff that keeps h rows,
exactly, by counting leading bits of the distances (a histogram for each start and
job, until the h-th smallest stands alone); then sums of products of the rows
within it. No task holds a cell, and both ways fit the same rows: the random
numbers pick ranks, and rows that tie at the cutoff share the weight that is left.

Rows with a missing or infinite component take no part. Cells with fewer than
max(per_dim * p, p + 1) rows, or without a start of full rank, are shrunk towards
a multiple of the identity (Ledoit and Wolf) instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.walks import numbered
from .cut import cut
from .matrix import _wilson_hilferty, consistency, ledoit_wolf, mulberry32

#: Rows of a cell that one task fits, and of a block of a larger cell.
WHOLE, BLOCK = 1 << 14, 1 << 12
STARTS, BEST, STEPS, SEED, ALPHA, PER_DIM = 500, 10, 20, 0xFA5DA, 0.75, 5
#: Random numbers for each start; each beyond p + 1 replaces one that came twice or widens a start that is singular.
DRAWS = 4
#: Leading bits of a distance that the jobs of a cutoff look at, one after the other.
BITS = (16, 26, 36, 46, 56, 64)


def _positive(c: np.ndarray) -> bool:
    try:
        np.linalg.cholesky(c)
        return True
    except np.linalg.LinAlgError:
        return False


def _moments(x: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    w = np.ones(len(x)) if w is None else w
    m = w @ x / w.sum()
    z = x - m
    return m, (z * w[:, None]).T @ z / w.sum()


def drawn(n: int, p: int, starts: int = STARTS, seed: int = SEED) -> np.ndarray:
    """The ranks, from 0, that the random numbers pick among n rows."""
    return (mulberry32(seed, starts * (p + 1) * DRAWS) * n).astype(np.int64)


def first_estimates(picks: np.ndarray, rows: dict[int, np.ndarray], n: int, p: int, starts: int = STARTS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mean and covariance of each start: the next p + 1 distinct picks, and more while they are singular. Starts that the picks do not suffice for are left out."""
    out, at = [], 0
    for _ in range(starts):
        own: dict[int, None] = {}
        while at < len(picks) and (len(own) < p + 1 or not _positive(_moments(np.array([rows[i] for i in own]))[1])) and len(own) < n:
            own[int(picks[at])] = None
            at += 1
        m, c = _moments(np.array([rows[i] for i in own])) if own else (None, None)
        if m is not None and len(own) > p and _positive(c):
            out.append((m, c))
    return out


def squared(x: np.ndarray, m: np.ndarray, c: np.ndarray) -> np.ndarray:
    z = np.linalg.solve(np.linalg.cholesky(c), (x - m).T)
    return (z * z).sum(0)


def concentrated(x: np.ndarray, m: np.ndarray, c: np.ndarray, h: int) -> tuple[float, np.ndarray, np.ndarray] | None:
    """(log-determinant, mean, covariance) of the h rows nearest to an estimate."""
    d = squared(x, m, c)
    limit = np.partition(d, h - 1)[h - 1]
    below, ties = d < limit, d == limit
    return _estimate(*_moments(x, below + ties * ((h - below.sum()) / ties.sum())))


def _estimate(m: np.ndarray, c: np.ndarray) -> tuple[float, np.ndarray, np.ndarray] | None:
    return (2 * np.log(np.diag(np.linalg.cholesky(c))).sum(), m, c) if np.isfinite(c).all() and _positive(c) else None


def _flat(estimates: list[tuple[np.ndarray, np.ndarray]]) -> list[float]:
    return np.concatenate([np.append(m, c.ravel()) for m, c in estimates]).tolist() if estimates else []


def _unpacked(flat: list[float], p: int) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(e[:p], e[p:].reshape(p, p)) for e in np.array(flat, float).reshape(-1, p + p * p)]


def shrunk(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, str, float]:
    m = x.mean(0)
    return m, ledoit_wolf(x - m)[0], "ledoit_wolf", 0.0


def fit(x: np.ndarray, alpha: float = ALPHA, starts: int = STARTS, seed: int = SEED, per_dim: int = PER_DIM) -> tuple[np.ndarray, np.ndarray, str, float]:
    """(mean, covariance, method, share of outliers) of the rows of a cell, in order."""
    n, p = x.shape
    if n < max(per_dim * p, p + 1):
        return shrunk(x)
    h = max(p + 1, int(np.ceil(alpha * n)))
    found = []
    for m, c in first_estimates(drawn(n, p, starts, seed), dict(enumerate(x)), n, p, starts):
        one = concentrated(x, m, c, h)
        if two := one and concentrated(x, *one[1:], h):
            found.append(two)
    best = None
    for now in sorted(found, key=lambda f: f[0])[:BEST]:
        for _ in range(STEPS):
            if (after := concentrated(x, *now[1:], h)) is None:
                break
            still, now = abs(after[0] - now[0]) < 1e-10, after
            if still:
                break
        if best is None or now[0] < best[0]:
            best = now
    if best is None:
        return shrunk(x)
    near = squared(x, best[1], best[2] * consistency(alpha, p)) <= _wilson_hilferty(1.95996398454005, p)
    m, c = _moments(x[near]) if near.sum() > p else (None, None)
    if m is None or not _positive(c):
        return shrunk(x)
    return m, c * consistency(0.975, p), "mcd", float(1 - near.mean())


def _distances(x: np.ndarray, r: dict) -> np.ndarray:
    """Bits of the squared distances, estimates x rows: they are not negative, so their bits are in their order."""
    return np.array([squared(x, m, c) for m, c in _unpacked(r["estimates"], x.shape[1])]).view(np.int64)


def _estimated(sums: list[float], p: int) -> list[tuple[float, np.ndarray, np.ndarray] | None]:
    """The estimates that `products` tell; None where one is singular."""
    out = []
    for v in np.array(sums[:-1], float).reshape(-1, 1 + p + p * p):
        m = v[1 : 1 + p] / max(v[0], 1e-300)
        out.append(_estimate(m, v[1 + p :].reshape(p, p) / max(v[0], 1e-300) - np.outer(m, m)) if v[0] > p else None)
    return out


class _Cells:
    """Blocks of large cells, rows less their cell's mean, and the jobs over them.

    A state is a row for each cell: n, h, and its estimates, flat. No cell's rows
    or histograms are ever in one task; what a task holds for a cell is its
    estimates, at most STARTS.
    """

    def __init__(self, rows: DataFrame, p: int, block: int):
        self.p = p
        self.kind = dict(rows.dtypes)["cell"]
        packed = rows.groupBy("cell", F.floor((F.col("rank") - 1) / block).alias("b")).agg(F.flatten(F.collect_list("x")).alias("xs"))
        self.blocks = cut(packed.drop("b"))

    def each(self, states: DataFrame, run, schema: str) -> DataFrame:
        """`run(rows, state)` for each block with its cell's state gives columns of equal length, beside the cell."""
        names, p = [s.split()[0] for s in schema.split(", ")], self.p

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                state = b.drop_columns(["xs"]).to_pylist()
                for r, xs in zip(state, b.column("xs"), strict=True):
                    out = run(xs.values.to_numpy().reshape(-1, p), r)
                    yield pa.RecordBatch.from_arrays([pa.array([r["cell"]] * len(out[0]), b.schema.field("cell").type), *(pa.array(c) for c in out)], names=["cell", *names])

        return self.blocks.join(states, "cell").mapInArrow(blocks, f"cell {self.kind}, {schema}")

    def cutoffs(self, states: DataFrame) -> DataFrame:
        """Adds for each estimate the bits of the h-th least distance (limit), or the end of a range of bits that h rows fill, and the weight of rows at it."""
        k = (F.size("estimates") / (self.p + self.p**2)).cast("int")
        none = lambda t: F.array_repeat(F.lit(None).cast(t), k)
        states = states.withColumns({"prefix": F.array_repeat(F.lit(0).cast("long"), k), "below": F.array_repeat(F.lit(0).cast("long"), k), "limit": none("long"), "weight": none("double")})
        before = 0
        for bits in BITS:
            counted = self.each(states, self._counter(before, bits), "start int, bin long, c long").groupBy("cell", "start", "bin").agg(F.sum("c").alias("c"))
            w = Window.partitionBy("cell", "start").orderBy("bin")
            told = counted.withColumn("upto", F.sum("c").over(w)).join(states.select("cell", "h", "below"), "cell").withColumn("under", F.get("below", F.col("start")))
            told = told.where("under + upto >= h and under + upto - c < h").select("cell", "start", F.struct("bin", (F.col("under") + F.col("upto") - F.col("c")).alias("below"), "c").alias("hit"))
            hits = told.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("start", "hit"))).alias("hits"))
            states = states.join(hits, "cell", "left").withColumn("now", F.transform(F.sequence(F.lit(0), F.size("limit") - 1), self._narrowed(before, bits)))
            states = cut(states.select("cell", "n", "h", "estimates", *(F.col(f"now.{c}").alias(c) for c in ("prefix", "below", "limit", "weight"))))
            if not states.where(F.exists("limit", lambda x: x.isNull())).limit(1).count():
                break
            before = bits
        return states

    def _counter(self, before: int, bits: int):
        width, rest = np.uint64(bits - before), np.uint64(64 - bits)

        def count(x: np.ndarray, r: dict) -> tuple:
            starts, bins, counts = [], [], []
            for i, d in enumerate(_distances(x, r).view(np.uint64)):
                if r["limit"][i] is not None:
                    continue
                own = d[(d >> (rest + width)) == np.uint64(r["prefix"][i])] if before else d
                v, n = np.unique((own >> rest) & np.uint64((1 << int(width)) - 1), return_counts=True)
                starts.append(np.full(len(v), i, np.int32))
                bins.append(v.astype(np.int64))
                counts.append(n)
            return tuple(np.concatenate(a) if a else np.zeros(0, t) for a, t in ((starts, np.int32), (bins, np.int64), (counts, np.int64)))

        return count

    @staticmethod
    def _narrowed(before: int, bits: int):
        """What is known of an estimate after `bits` bits: its limit, if h rows end with the bin or no bit is left, else the bin as prefix."""

        def at(i: Column) -> Column:
            hit, was = F.col("hits")[i], F.get("limit", i)
            prefix = F.shiftleft(F.get("prefix", i), bits - before).bitwiseOR(hit["bin"])
            high = F.shiftleft(prefix, 64 - bits).bitwiseOR(F.lit((1 << (64 - bits)) - 1).cast("long")) if bits < 64 else prefix
            full = hit["below"] + hit["c"] == F.col("h")
            share = F.when(full, 1.0).otherwise((F.col("h") - hit["below"]) / hit["c"])
            last = full | F.lit(bits == 64)
            return F.struct(
                F.when(was.isNull(), prefix).otherwise(F.get("prefix", i)).alias("prefix"), F.when(was.isNull(), hit["below"]).otherwise(F.get("below", i)).alias("below"),
                F.coalesce(was, F.when(last, high)).alias("limit"), F.coalesce(F.get("weight", i), F.when(last, share)).alias("weight"),
            )

        return at

    def products(self, states: DataFrame) -> DataFrame:
        """(cell, s): for each estimate, summed over the rows within its limit: weight, weighted rows, weighted products; and in the end the fourth powers of all rows' lengths."""

        def run(x: np.ndarray, r: dict) -> tuple:
            d, xx = _distances(x, r), (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
            w = (d < np.array(r["limit"])[:, None]) + (d == np.array(r["limit"])[:, None]) * np.array(r["weight"], float)[:, None]
            flat = np.hstack([w.sum(1)[:, None], w @ x, w @ xx]).ravel()
            return ([np.append(flat, ((x * x).sum(1) ** 2).sum()).tolist()],)

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict = {}
            for b in batches:
                for cell, s in zip(b.column("cell").to_pylist(), b.column("s"), strict=True):
                    held[cell] = held.get(cell, 0) + s.values.to_numpy()
                    kind = b.schema.field("cell").type
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.array([v.tolist() for v in held.values()])], names=["cell", "s"])

        schema = f"cell {self.kind}, s array<double>"  # one sum for each task and cell, then one for each cell
        return self.each(states, run, "s array<double>").mapInArrow(added, schema).repartition("cell").mapInArrow(added, schema)

    def step(self, states: DataFrame, merge, schema: str) -> DataFrame:
        """One concentration step: `merge(state, new estimates)` gives the columns of `schema` of each cell's next state."""
        return self.closed(states, self.products(self.cutoffs(states.select("cell", "n", "h", "estimates"))), merge, schema)

    def closed(self, states: DataFrame, sums: DataFrame, merge, schema: str) -> DataFrame:
        names, p = [s.split()[0] for s in schema.split(", ")], self.p

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = b.to_pylist()
                out = [merge(r, _estimated(r["s"], p)) for r in rows]
                yield pa.RecordBatch.from_arrays([b.column("cell"), *(pa.array([o[i] for o in out]) for i in range(len(names)))], names=["cell", *names])

        return states.join(sums, "cell").mapInArrow(run, f"cell {self.kind}, {schema}")


def _large(rows: DataFrame, p: int, alpha: float, starts: int, seed: int, block: int) -> DataFrame:
    """(cell, mean, cov, method, outliers) of cells with rank, n and centred x; `centre` is added by the caller."""
    cells = _Cells(rows, p, block)
    h = F.greatest(F.lit(p + 1), F.ceil(F.lit(alpha) * F.col("n"))).cast("long")
    sizes = cut(rows.groupBy("cell").agg(F.max("n").alias("n")).withColumn("h", h))

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, n in enumerate(b.column("n").to_pylist()):
                ranks = np.unique(drawn(n, p, starts, seed)) + 1
                yield pa.RecordBatch.from_arrays([b.column("cell").take(pa.array([i] * len(ranks))), pa.array(ranks)], names=["cell", "rank"])

    picks = sizes.mapInArrow(picked, f"cell {cells.kind}, rank long")
    given = rows.select("cell", "rank", "x").join(picks, ["cell", "rank"]).groupBy("cell").agg(F.collect_list(F.struct("rank", "x")).alias("given"))  # at most starts * (p + 1) * DRAWS rows

    def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            est = [_flat(first_estimates(drawn(n, p, starts, seed), {g["rank"] - 1: np.array(g["x"]) for g in given}, n, p, starts)) for n, given in zip(b.column("n").to_pylist(), b.column("given").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("cell", "n", "h")), pa.array(est, pa.list_(pa.float64()))], names=["cell", "n", "h", "estimates"])

    whole = "n long, h long, estimates array<double>"
    state = cut(sizes.join(given, "cell").mapInArrow(started, f"cell {cells.kind}, {whole}"))
    alive = lambda r, new: (r["n"], r["h"], _flat([e[1:] for e in new if e]))
    state = cut(cells.step(state.where(F.size("estimates") > 0), alive, whole))

    def ten(r: dict, new: list) -> tuple:
        best = sorted((e for e in new if e), key=lambda e: e[0])[:BEST]
        return r["n"], r["h"], _flat([e[1:] for e in best]), [float(e[0]) for e in best], [False] * len(best), _flat([e[1:] for e in best])

    def on(r: dict, new: list) -> tuple:
        """The candidates that still move; `estimates` holds theirs, `all` everybody's."""
        every, det, still, at = _unpacked(r["all"], p), list(r["det"]), list(r["still"]), 0
        for i in range(len(every)):
            if still[i]:
                continue
            e, at = new[at], at + 1
            still[i] = e is None or abs(e[0] - det[i]) < 1e-10
            if e is not None:
                det[i], every[i] = float(e[0]), e[1:]
        return r["n"], r["h"], _flat([e for e, s in zip(every, still, strict=True) if not s]), det, still, _flat(every)

    full = f"{whole}, det array<double>, still array<boolean>, all array<double>"
    state = cut(cells.step(state.where(F.size("estimates") > 0), ten, full))
    for _ in range(STEPS):
        moving = state.where(F.size("estimates") > 0)
        if not moving.limit(1).count():
            break
        state = cut(cells.step(moving, on, full).unionByName(state.where(F.size("estimates") == 0)))

    bits = int(np.array([_wilson_hilferty(1.95996398454005, p)]).view(np.int64)[0])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for every, det in zip(b.column("all").to_pylist(), b.column("det").to_pylist(), strict=True):
                m, c = _unpacked(every, p)[int(np.argmin(det))]
                out.append(np.append(m, (c * consistency(alpha, p)).ravel()).tolist())
            yield pa.RecordBatch.from_arrays([b.column("cell"), b.column("n"), b.column("h"), pa.array(out), pa.array([[bits]] * len(out)), pa.array([[1.0]] * len(out))], names=["cell", "n", "h", "estimates", "limit", "weight"])

    best = state.where(F.size("det") > 0).mapInArrow(chosen, f"cell {cells.kind}, {whole}, limit array<long>, weight array<double>")
    # a cell without an estimate takes part with all of its rows, for the shrunk covariance
    everything = F.array(*(F.lit(float(v)) for v in np.append(np.zeros(p), np.eye(p).ravel())))
    rest = sizes.join(best.select("cell"), "cell", "left_anti").select("cell", "n", "h", everything.alias("estimates"), F.array(F.lit(0).cast("long")).alias("limit"), F.array(F.lit(0.0)).alias("weight"))
    result = "mean array<double>, cov array<array<double>>, method string, outliers double"

    def reweighted(r: dict, new: list) -> tuple:
        if new[0] is None:
            return None, None, "ledoit_wolf", 0.0
        return new[0][1].tolist(), (new[0][2] * consistency(0.975, p)).tolist(), "mcd", 1 - r["s"][0] / r["n"]

    final = best.unionByName(rest)
    out = cut(cells.closed(final, cells.products(final), reweighted, result))
    weak = sizes.join(out.where("cov is null").select("cell"), "cell", "left_semi").select("cell", "n", "h", everything.alias("estimates"), F.array(F.lit((1 << 63) - 1)).alias("limit"), F.array(F.lit(1.0)).alias("weight"))

    def pulled(r: dict, _: list) -> tuple:
        n, s = r["n"], np.array(r["s"])
        m, second = s[1 : 1 + p] / n, s[1 + p : 1 + p + p * p].reshape(p, p) / n - np.outer(s[1 : 1 + p], s[1 : 1 + p]) / n**2
        target = np.trace(second) / p * np.eye(p)
        d2 = ((second - target) ** 2).sum()
        lam = min(max(0.0, (s[-1] - n * (second**2).sum()) / (n * n)), d2) / d2 if d2 > 0 else 0.0
        return m.tolist(), (lam * target + (1 - lam) * second).tolist(), "ledoit_wolf", 0.0

    return out.where("cov is not null").unionByName(cells.closed(weak, cells.products(weak), pulled, result))


def cell_covariances(df: DataFrame, cell: str, by: list[str], dims: list[str], alpha: float = ALPHA, starts: int = STARTS, seed: int = SEED, per_dim: int = PER_DIM, whole: int = WHOLE, block: int = BLOCK) -> DataFrame:
    """n, mean, cov, method and outliers (their share) of each cell, rows in order of `by`; see the module's text."""
    p, fine = len(dims), " and ".join(f"`{d}` is not null and not isnan(`{d}`) and abs(`{d}`) < double('infinity')" for d in dims)
    rows = numbered(df.where(fine).select(F.col(cell).alias("cell"), *by, *(F.col(d).cast("double").alias(d) for d in dims)), ["cell"], by)
    told = rows.groupBy("cell").agg(F.count("*").alias("n"), F.array(*(F.avg(d) for d in dims)).alias("centre"))
    rows = cut(rows.join(told.withColumnRenamed("cell", "_c"), F.col("cell").eqNullSafe(F.col("_c"))).select("cell", "rank", "n", "centre", F.zip_with(F.array(*dims), "centre", lambda a, b: a - b).alias("x")))
    kind, result = dict(rows.dtypes)["cell"], "mean array<double>, cov array<array<double>>, method string, outliers double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fits = [fit(np.array([g["x"] for g in sorted(given, key=lambda g: g["rank"])]), alpha, starts, seed, per_dim) for given in b.column("given").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("cell"), *(pa.array([f(x) for x in fits]) for f in (lambda x: x[0].tolist(), lambda x: x[1].tolist(), lambda x: x[2], lambda x: x[3]))], names=["cell", "mean", "cov", "method", "outliers"])

    small = rows.where(F.col("n") <= whole).groupBy("cell").agg(F.collect_list(F.struct("rank", "x")).alias("given"))  # at most `whole` rows
    out = small.mapInArrow(run, f"cell {kind}, {result}")
    large = rows.where((F.col("n") > whole) & (F.col("n") >= max(per_dim * p, p + 1)))
    if large.limit(1).count():
        out = out.unionByName(_large(large, p, alpha, starts, seed, block))
    centres = rows.groupBy("cell").agg(F.first("n").alias("n"), F.first("centre").alias("centre")).withColumnRenamed("cell", "_c")
    out = out.join(centres, F.col("cell").eqNullSafe(F.col("_c"))).drop("_c")
    return out.select(F.col("cell").alias(cell), "n", F.zip_with("mean", "centre", lambda a, b: a + b).alias("mean"), "cov", "method", "outliers")
