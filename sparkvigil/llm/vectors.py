"""Vector tables as packed blocks, and the meeting of blocks with queries, for exact searches.

A block holds up to BLOCK_NUMBERS components of vectors of one dimension. Blocks
are cut from a range partitioning by (dimension, nearest reference direction,
angle to it, row), so their sizes do not depend on how often a vector, label or
id occurs, and each lies in a narrow window of angles. Components become
floor(256 * x) when a block is read; scores are inner products of these whole
numbers, exact at any size (beyond 2^53 with Python's integers, kept within the
range of a long).

Defined results: rows take part if the vector is there and each component times
256 is finite; vectors of unlike dimension never meet; each row stands for
itself even if its id occurs again; null ids take part and come last in ties.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, written

FACTOR = 256
BLOCK_NUMBERS = 1 << 17
REFERENCES = 16
#: A task of a turn serves so many queries for one block.
QUERIES_A_TASK = 1 << 16
MOST_PARTS = 20_000
LAST = np.iinfo(np.int64).max
_BLOCK = "shard long, kind string, dim int, ids binary, known binary, labels binary, v binary"


def usable(x: Column) -> Column:
    return F.coalesce(F.size(x) >= 0, F.lit(False)) & ~F.coalesce(F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double") * FACTOR) == float("inf"))), F.lit(False))


def whole(v: np.ndarray) -> np.ndarray:
    return np.floor(FACTOR * v.astype(np.float64))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, as longs."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    out = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
    return np.clip(out, -LAST, LAST).astype(np.int64)


def slack(size: np.ndarray) -> np.ndarray:
    """What rounding of norms, angles and products can add to a bound of that size (angles near 0 and pi are good to 2e-8)."""
    return 1 + 1e-6 * size


def references(table: DataFrame, vector: str = "embedding") -> dict[int, np.ndarray]:
    """At most REFERENCES unit vectors by dimension: of each class of hashes, the vector of the least hash, so that copies count once."""
    h = F.xxhash64(vector)
    rows = table.where(usable(F.col(vector))).groupBy(F.pmod(h, F.lit(REFERENCES)).alias("c")).agg(F.min_by(vector, h).alias("v")).orderBy("c").collect()
    out: dict[int, list] = {}
    for r in rows:
        v = whole(np.array(r.v, np.float64))
        if len(v) and v.any():
            v = v / np.abs(v).max()
            out.setdefault(len(v), []).append(v / np.linalg.norm(v))
    return {d: np.array(v) for d, v in out.items()}


def directions(known: dict[int, np.ndarray], dim: int) -> np.ndarray:
    """The reference directions of a dimension; one without any has its first axis."""
    return known[dim] if dim in known else np.eye(1, dim)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def angles(x: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Angles of rows to the references; a zero vector is at a right angle to all."""
    return np.arccos(np.clip((x @ refs.T) / np.maximum(norms(x), 1e-300)[:, None], -1, 1))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column of one dimension."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _placed(refs: dict[int, np.ndarray]) -> Callable:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, dims = b.column("v"), b.column("dim").to_numpy()
            cell, angle = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                a = angles(whole(matrix(v.take(pa.array(at)), d)), directions(refs, int(d)))
                cell[at], angle[at] = a.argmin(1), a.min(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(angle)], names=[*b.schema.names, "cell", "angle"])

    return place


def _packed(extra: Callable[[np.ndarray], dict], names: list[str], most: int) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, held, size, dim = TaskContext.get().partitionId() << 32, [], 0, -1

        def block() -> pa.RecordBatch:
            nonlocal shard
            t = pa.Table.from_batches(held).combine_chunks()
            ids = t["id"]
            v = matrix(t["v"].combine_chunks(), dim)
            row = {"shard": shard, "kind": v.dtype.name, "dim": np.int32(dim), "ids": ids.fill_null(LAST).to_numpy().tobytes(), "known": ids.is_valid().to_numpy().tobytes(), "labels": t["label"].to_numpy().tobytes(), "v": np.ascontiguousarray(v).tobytes()} | extra(whole(v))
            shard += 1
            return pa.RecordBatch.from_arrays([pa.array([row[n]]) for n in names], names=names)

        for b in batches:
            dims, i = b.column("dim").to_numpy(), 0
            while i < b.num_rows:
                if held and (dims[i] != dim or size >= max(1, most // max(dim, 1))):
                    yield block()
                    held, size = [], 0
                dim = int(dims[i])
                end = min(b.num_rows, i + max(1, most // max(dim, 1)) - size, i + int(np.argmax(np.append(dims[i:] != dim, True))))
                held.append(b.slice(i, end - i))
                size, i = size + end - i, end
        if held:
            yield block()

    return pack


def blocks(table: DataFrame, refs: dict[int, np.ndarray], extra: Callable[[np.ndarray], dict], schema: str, vector: str = "embedding", label: Column | None = None) -> DataFrame:
    """The table's vectors as written blocks; `extra` gives more columns (`schema`) from a block's whole numbers. Null labels take no part if labels are asked for."""
    spark = table.sparkSession
    bounded_batches(spark)
    kind = "double" if dict(table.dtypes)[vector] == "array<double>" else "float"
    rows = table.select(F.col("vec_id").cast("long").alias("id"), (F.lit(0) if label is None else label).cast("long").alias("label"), F.col(vector).cast(f"array<{kind}>").alias("v"), F.size(vector).alias("dim")).where(usable(F.col("v")) & F.col("label").isNotNull())
    numbers = rows.agg(F.sum(F.col("dim").cast("long"))).first()[0] or 0
    rows = rows.mapInArrow(_placed(refs), f"id long, label long, v array<{kind}>, dim int, cell int, angle double").withColumn("row", F.monotonically_increasing_id())
    parts = min(MOST_PARTS, max(1, -(-numbers // BLOCK_NUMBERS)))
    dealt = rows.repartitionByRange(parts, "dim", "cell", "angle", "row").sortWithinPartitions("dim", "cell", "angle", "row").drop("cell", "angle", "row")
    full = f"{_BLOCK}{', ' * bool(schema)}{schema}"
    return written(dealt.mapInArrow(_packed(extra, [x.split()[0] for x in full.split(", ")], BLOCK_NUMBERS), full), "blocks")


class Block:
    """A block read again: ids (null: LAST), known, labels, whole numbers x, and row numbers."""

    def __init__(self, row: dict):
        self.shard, self.dim, self.row = row["shard"], row["dim"], row
        self.ids, self.known, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool), np.frombuffer(row["labels"], np.int64)
        self.x = whole(np.frombuffer(row["v"], row["kind"]).reshape(len(self.ids), self.dim))
        self.rows = (self.shard << 20) + np.arange(len(self.ids))

    def numbers(self, name: str) -> np.ndarray:
        return np.frombuffer(self.row[name], np.float64)


def queries(of: DataFrame, every: int) -> DataFrame:
    """(query, query_id, query_label, dim, q) of rows whose id is divisible by `every`, written; q holds whole numbers."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                k = Block(r)
                at = np.flatnonzero(k.known & (k.ids % every == 0))
                yield pa.RecordBatch.from_arrays([pa.array(k.rows[at]), pa.array(k.ids[at]), pa.array(k.labels[at]), pa.array(np.full(len(at), k.dim, np.int32)), pa.array([x.tobytes() for x in k.x[at]], pa.binary())], names=["query", "query_id", "query_label", "dim", "q"])

    return written(of.select("shard", "dim", "ids", "known", "labels", "v", "kind").mapInArrow(pick, "query long, query_id long, query_label long, dim int, q binary"), "queries")


def stacked(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), dim)


def meet(held: DataFrame, visits: DataFrame, held_key: str, key: str, hold: Callable, serve: Callable, schema: str, most: int = QUERIES_A_TASK) -> DataFrame:
    """`serve(states, visits)` for each batch of visits with the states `hold(row)` of all held rows of its key.

    Rows of a key arrive sorted, the held ones first, and visits stream past
    them: a task keeps one key's held rows and one batch. A key with more than
    about `most` visits is dealt into parts, with its held rows in each.
    """
    parts = max(1, -(-visits.count() // most)) if most else 1
    names, columns = held.columns, visits.columns
    left = held.select(F.col(held_key).alias("_key"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"), F.lit(0).alias("_kind"), F.struct(*names).alias("_held"), F.lit(None).cast(visits.select(F.struct(*columns).alias("x")).schema["x"].dataType).alias("_visit"))
    right = visits.select(F.col(key).alias("_key"), F.pmod(F.col("query"), F.lit(parts)).cast("int").alias("_part"), F.lit(1).alias("_kind"), F.lit(None).cast(left.schema["_held"].dataType).alias("_held"), F.struct(*columns).alias("_visit"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, states = None, []
        for b in batches:
            keys, part, kind = b.column("_key").to_numpy(zero_copy_only=False), b.column("_part").to_numpy(), b.column("_kind").to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
            for i, j in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if i == j:
                    continue
                if (keys[i], part[i]) != now:
                    now, states = (keys[i], part[i]), []
                if kind[i] == 0:
                    states += [hold(r) for r in b.column("_held").slice(i, j - i).to_pylist()]
                elif states:
                    rows = pa.RecordBatch.from_arrays(b.column("_visit").slice(i, j - i).flatten(), names=columns)
                    yield from (x for x in serve(states, rows) if x.num_rows)

    return left.unionByName(right).repartition("_key", "_part").sortWithinPartitions("_key", "_part", "_kind").mapInArrow(walk, schema)


def first(q: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of each q's k best (highest score, then smaller id, then smaller row), ordered so."""
    at = np.lexsort((rows, ids, -score, q))
    s = q[at]
    start = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, int)
    rank = np.arange(len(s)) - np.repeat(start, np.diff(np.append(start, len(s))))
    return at[rank < k]
