"""Connected components of a link table, as joins and partial aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import forgotten, written


def least_labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least vertex that links (u, v) among vertices 0 .. n - 1 reach, for each vertex."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        on = (label[u] != low) | (label[v] != low)
        if not on.any():
            return label
        u, v, low = u[on], v[on], low[on]
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while (label[label] != label).any():
            label = label[label]


def _stars(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The links of each run of at most about `most` links as stars: (vertex, least vertex of its component there)."""

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
        ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = ids[least_labels(place[: len(u)], place[len(u) :], len(ids))]
        on = ids != root
        return pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(root[on])], names=["u", "v"])

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= most:
            yield star(held)
            held, size = [], 0
    if size:
        yield star(held)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root), written: root is the smallest id that links (u, v) reach from id; ids without a link are left out.

    Links become stars inside each partition first; then come alternating
    large-star and small-star rounds (Kiveris et al., 2014), one job each: every
    vertex links its larger neighbours, then itself and its smaller ones, to its
    least neighbour, until only stars are left. A hot vertex is a hot join key
    of two plain tables, which adaptive execution splits; minima are combined
    before the shuffle. Null ids have no links.
    """
    edges = written(links.where("u is not null and v is not null and u <> v").select("u", "v").mapInArrow(_stars, "u long, v long"), "edges")
    state = None
    for _ in range(rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        if not now[0] or now == state:
            break
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        near = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = near.groupBy("u").agg(F.min("v").alias("m"))
        new = near.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        before, edges = edges, written(new.where("u > v").distinct(), "edges")
        forgotten(before)
    roots = written(edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()), "roots")
    forgotten(edges)
    return roots
