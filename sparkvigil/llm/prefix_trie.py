"""Prefix trie of conversations in tables addressed by minimal perfect hashes.

A prefix of d turns has a 128-bit digest, the sum of turn hash times P^i over its
turns i in two lanes of 64 bits, so digests of blocks of turns can be put
together: turns are ranked and summed in ranges of (conversation, turn), and each
range gets what the ranges before it leave of its first conversation (one row a
range to the driver, at most MOST_RANGES). No task holds a conversation.

Paths (conversation, depth, digest, parent's digest) are dealt into shards by
conversation and SEGMENT of depths. A shard enumerates its distinct digests, gives
each a slot by a minimal perfect hash (slots.py; the key is kept at its slot and
compared, and parent, turn hash and length must agree for all rows of a slot and
between shards), and scatters counts into flat arrays. Sums of the shards give the
nodes. Then each node's own numbers lie on the path of its smallest member, shards
add them up through the array of parent slots, from the deepest level on, and a
segment passes its total to the end of the segment above. A prefix that very many
conversations share is one slot in each shard: a row from each, not one from each
conversation.

Defined results: rows without conv_id are left out; null roles and texts are
empty; turns that share a number follow the SHA-256 of role and text; repeated
rows are turns of their own; further columns are ignored; an empty table gives no
nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .slots import Slots
from .store import forgotten, written

HEAD = 5
SEGMENT = 1024
SHARD_ROWS = 1 << 17
RANGE_ROWS = 1 << 18
MOST_RANGES = 20_000
CHUNK = 1 << 16
_U, _M = np.uint64, (1 << 64) - 1
P = 0xD1342543DE82EF95
_FULL = "conv long, depth long, ends boolean, d1 long, d2 long, p1 long, p2 long, turn long, chars long"


def powers(e: np.ndarray) -> np.ndarray:
    """P^e modulo 2^64; negative exponents by the inverse of P."""
    out, left = np.ones(len(e), _U), np.abs(e).astype(_U)
    up, down = _U(P), _U(pow(P, -1, 1 << 64))
    base = np.where(e < 0, down, up)
    while left.any():
        out = np.where(left & _U(1), out * base, out)
        base, left = base * base, left >> _U(1)
    return out


def _u(c: pa.Array) -> np.ndarray:
    return c.to_numpy(zero_copy_only=False).astype(np.int64).view(_U)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rank and digest of each turn among those of its conversation in this range."""
    from pyspark import TaskContext

    block, now, rank, sums = TaskContext.get().partitionId(), None, 0, np.zeros(2, _U)
    for b in batches:
        if not b.num_rows:
            continue
        conv = b.column("conv").to_numpy()
        h = np.frombuffer(b"".join(b.column("h").to_pylist()), _U).reshape(-1, 4)
        start = np.append(True, conv[1:] != conv[:-1])
        if conv[0] != now:
            rank, sums = 0, np.zeros(2, _U)
        else:
            start[0] = False
        at = np.maximum.accumulate(np.where(start, np.arange(len(conv)), -1))  # -1: goes on from the batch before
        r = np.arange(len(conv)) - np.maximum(at, 0) + 1 + np.where(at < 0, rank, 0)
        total = np.cumsum(h[:, :2] * powers(r)[:, None], axis=0)
        lanes = total - np.where((at > 0)[:, None], total[at - 1], _U(0)) + np.where((at < 0)[:, None], sums[None, :], _U(0))
        now, rank, sums = conv[-1], int(r[-1]), lanes[-1].copy()
        yield pa.RecordBatch.from_arrays(
            [b.column("conv"), pa.array(np.full(len(conv), block, np.int32)), pa.array(r), pa.array(lanes[:, 0].view(np.int64)), pa.array(lanes[:, 1].copy().view(np.int64)), *(pa.array(h[:, i].copy().view(np.int64)) for i in (0, 1, 2)), b.column("chars")],
            names=["conv", "block", "rank", "s1", "s2", "t1", "t2", "turn", "chars"],
        )


def _carries(ranked: DataFrame) -> dict[int, tuple[int, int, int, int]]:
    """block: (its first conversation, and rank and digest that earlier blocks leave of it)."""
    last = F.max_by(F.struct("conv", "rank", "s1", "s2"), F.struct("conv", "rank")).alias("last")
    out, held = {}, None
    for x in ranked.groupBy("block").agg(F.min("conv").alias("first"), last).orderBy("block").collect():
        more = held and held[0] == x.first
        if more:
            out[x.block] = held
        conv, rank, s = x.last.conv, x.last.rank, [x.last.s1 & _M, x.last.s2 & _M]
        if more and conv == x.first:
            shift = pow(P, held[1], 1 << 64)
            rank, s = held[1] + rank, [(c + shift * y) & _M for c, y in zip(held[2:], s, strict=True)]
        held = (conv, rank, *s)
    return out


def _carried(carries: dict) -> Callable:
    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, conv, rank = b.column("block").to_numpy(), b.column("conv").to_numpy(), b.column("rank").to_numpy().copy()
            s = [_u(b.column(c)).copy() for c in ("s1", "s2")]
            for k in np.unique(block):
                if int(k) in carries:
                    first, n, *lanes = carries[int(k)]
                    at = np.flatnonzero((block == k) & (conv == first))
                    rank[at] += n
                    for lane, c in zip(s, lanes, strict=True):
                        lane[at] = lane[at] * _U(pow(P, n, 1 << 64)) + _U(c)
            yield pa.RecordBatch.from_arrays([b.column("conv"), pa.array(rank), *(pa.array(x.view(np.int64)) for x in s), *(b.column(c) for c in ("t1", "t2", "turn", "chars"))], names=["conv", "rank", "s1", "s2", "t1", "t2", "turn", "chars"])

    return carry


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests in the rebuilt conversation: base + P^shift * (own - cut), and those of the parents."""
    for b in batches:
        depth, shift = b.column("depth").to_numpy(), powers(b.column("shift").to_numpy().astype(np.int64))
        here = powers(depth)
        d = [_u(b.column(f"b{i}")) + shift * (_u(b.column(f"s{i}")) - _u(b.column(f"c{i}"))) for i in (1, 2)]
        p = [x - np.where(depth > 0, here * _u(b.column(f"t{i}")), _U(0)) for i, x in zip((1, 2), d, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("depth"), b.column("ends"), *(pa.array(x.view(np.int64)) for x in (*d, *p)), b.column("turn"), b.column("chars")], names=[x.split()[0] for x in _FULL.split(", ")])


def rebuilt(table: DataFrame) -> DataFrame:
    """One written row for each conversation and depth from 0 on."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = table.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("h"), F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row")
    )
    parts = min(MOST_RANGES, max(1, -(-turns.count() // RANGE_ROWS)))
    order = ("conv", "turn", "h", "row")
    ranked = written(turns.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv", "h", "chars").mapInArrow(_summed, "conv long, block int, rank long, s1 long, s2 long, t1 long, t2 long, turn long, chars long"), "ranked")
    own = ranked.mapInArrow(_carried(_carries(ranked)), "conv long, rank long, s1 long, s2 long, t1 long, t2 long, turn long, chars long")
    head = F.struct("rank", "s1", "s2", "t1", "t2", "turn", "chars")
    convs = written(own.groupBy("conv").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("rank") <= HEAD, head))).alias("head")), "heads")
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % (HEAD + 1)).cast("int")
    known = convs.withColumns({"h": h, "base": F.col("conv") - F.col("conv") % 100}).join(convs.select(F.col("conv").alias("base"), F.col("head").alias("base_head")), "base", "left")
    none = F.lit(0).cast("long")
    at = lambda a, i, f: F.when(i > 0, F.element_at(a, F.greatest(i, F.lit(1)))[f]).otherwise(none)
    known = known.withColumn("k", F.least("h", F.coalesce(F.size("base_head"), F.lit(0)))).withColumn("cut", F.least(F.col("h").cast("long"), F.col("n")).cast("int"))
    known = known.select(
        "conv", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), none)).alias("len"), F.slice("base_head", F.lit(1), F.col("k")).alias("shared"),
        at(F.col("base_head"), F.col("k"), "s1").alias("b1"), at(F.col("base_head"), F.col("k"), "s2").alias("b2"), at(F.col("head"), F.col("cut"), "s1").alias("c1"), at(F.col("head"), F.col("cut"), "s2").alias("c2"),
    )
    names = ["conv", "depth", "ends", "shift", "s1", "s2", "c1", "c2", "b1", "b2", "t1", "t2", "turn", "chars"]
    zero = {c: none for c in ("shift", "s1", "s2", "c1", "c2", "b1", "b2", "t1", "t2", "turn", "chars")}
    root = known.select("conv", "len").withColumns(zero | {"depth": none})
    top = known.select("conv", "len", F.explode("shared").alias("x")).select("conv", "len", "x.*").withColumns({c: none for c in ("shift", "c1", "c2", "b1", "b2")} | {"depth": F.col("rank")})
    rest = own.join(known.select("conv", "h", "k", "len", "b1", "b2", "c1", "c2"), "conv").where("rank > h").withColumns({"shift": (F.col("k") - F.col("h")).cast("long"), "depth": F.col("rank") - F.col("h") + F.col("k")})
    paths = root.unionByName(top.drop("rank")).unionByName(rest.drop("rank", "h", "k")).withColumn("ends", F.col("depth") == F.col("len")).select(*names)
    out = written(paths.mapInArrow(_digests, _FULL), "paths")
    forgotten(ranked, convs)
    return out


def _columns(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
    got = [b for b in batches if b.num_rows]
    return {n: c.to_numpy() for n, c in zip(got[0].schema.names, pa.Table.from_batches(got).columns, strict=True)} if got else {}


def _slots(c: dict[str, np.ndarray]) -> tuple[Slots, np.ndarray]:
    a, b = c["d1"].view(_U), c["d2"].view(_U)
    at = np.lexsort((b, a))
    new = at[np.append(True, (a[at][1:] != a[at][:-1]) | (b[at][1:] != b[at][:-1]))]
    table = Slots(a[new], b[new])
    return table, table.find(a, b)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's nodes with their members there."""
    c = _columns(batches)
    if not c:
        return
    table, slot = _slots(c)
    size, kept = len(table.a), {}
    for name in ("depth", "p1", "p2", "turn", "chars"):
        kept[name] = np.empty(size, np.int64)
        kept[name][slot] = c[name]
        if (kept[name][slot] != c[name]).any():
            raise ValueError("two prefixes share a digest")
    least = np.full(size, np.iinfo(np.int64).max)
    np.minimum.at(least, slot, c["conv"])
    yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (table.a, table.b)), *(pa.array(x) for x in kept.values()), pa.array(np.bincount(slot, minlength=size)), pa.array(least)], names=["d1", "d2", *kept, "n", "conv"])


def _accumulated(batches: Iterator[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
    """Sums over a shard's subtrees, within a segment of depths."""
    c = _columns(batches)
    if not c:
        return
    table, slot = _slots(c)
    size = len(table.a)
    depth, parent = np.empty(size, np.int64), np.empty(size, np.int64)
    depth[slot] = c["depth"]
    parent[slot] = np.where(c["depth"] % segment == 0, -1, table.find(c["p1"].view(_U), c["p2"].view(_U)))
    sums = np.zeros((size, 2), np.int64)
    for i, name in enumerate(("leaves", "saved")):
        np.add.at(sums[:, i], slot, c[name])
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        up = level[parent[level] >= 0]
        np.add.at(sums, parent[up], sums[up])
    on = np.flatnonzero(sums.any(1))
    yield pa.RecordBatch.from_arrays([*(pa.array(x[on].view(np.int64)) for x in (table.a, table.b)), pa.array(sums[on, 0]), pa.array(sums[on, 1])], names=["d1", "d2", "leaves", "saved"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of a node as comma-ended strings of about CHUNK bytes."""
    for b in batches:
        d1, d2, conv = (b.column(n).to_numpy() for n in ("d1", "d2", "conv"))
        cuts = np.flatnonzero((d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])) + 1
        out = []
        for i, j in zip([0, *cuts], [*cuts, len(conv)], strict=True):
            out += [(d1[k], d2[k], conv[k], ",".join(map(str, conv[k : min(j, k + CHUNK // 20)].tolist())) + ",") for k in range(i, j, CHUNK // 20)]
        yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*out, strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())], names=["d1", "d2", "conv", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state, out = None, None, []
    for b in batches:
        for d1, d2, ids in zip(*(b.column(n).to_pylist() for n in ("d1", "d2", "ids")), strict=True):
            if (d1, d2) != now:
                out += [(*now, state[0].hexdigest())] if now else []
                now, state = (d1, d2), [hashlib.sha256(), b""]
            state[0].update(state[1] + ids[:-1].encode())
            state[1] = b","
        if len(out) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*out, strict=True)], names=["d1", "d2", "sha"])
            out = []
    out += [(*now, state[0].hexdigest())] if now else []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*out, strict=True)], names=["d1", "d2", "sha"])


def prefix_trie(table: DataFrame) -> DataFrame:
    """Nodes of the rebuilt conversations' prefixes; columns as op13's contract has them."""
    paths = rebuilt(table)
    rows = paths.count()
    size = SEGMENT
    shards, segment = max(1, -(-rows // SHARD_ROWS)), F.floor(F.col("depth") / size)
    parts = paths.withColumn("segment", segment).repartition(shards, "conv", "segment").drop("segment", "ends").mapInArrow(_counted, "d1 long, d2 long, depth long, p1 long, p2 long, turn long, chars long, n long, conv long")
    same = ["depth", "p1", "p2", "turn", "chars"]
    nodes = parts.groupBy("d1", "d2").agg(F.sum("n").alias("n_convs"), F.min("conv").alias("conv_id"), *(f(c).alias(f"{c}_{n}") for c in same for n, f in (("lo", F.min), ("hi", F.max))))
    agree = F.lit(True)
    for c in same:
        agree = agree & (F.col(f"{c}_lo") == F.col(f"{c}_hi"))
    nodes = nodes.select("d1", "d2", "conv_id", F.when(agree, F.col("n_convs")).otherwise(F.raise_error(F.lit("two prefixes share a digest"))).alias("n_convs"), *(F.col(f"{c}_lo").alias(c) for c in same))
    nodes = written(nodes.drop("turn"), "nodes")
    below = nodes.where("depth > 0")
    children = below.groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"))
    nodes_full = written(nodes.join(children, ["d1", "d2"], "left").fillna(0, ["n_children"]).join(parents, ["p1", "p2", "depth"], "left").withColumn("own", (F.col("n_convs") - 1) * F.col("chars")), "numbers")

    told = nodes_full.select("d1", "d2", F.col("conv_id").alias("conv"), (F.col("n_children") == 0).cast("long").alias("leaves"), F.col("own").alias("saved"))
    on_path = written(paths.select("conv", "depth", "d1", "d2", "p1", "p2", segment.alias("segment")).join(told, ["conv", "d1", "d2"], "left").fillna(0, ["leaves", "saved"]), "numbered")
    totals = on_path.where(F.col("depth") >= size).groupBy("conv", "segment").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    later = Window.partitionBy("conv").orderBy(F.desc("segment"))
    seeds = totals.select("conv", (F.col("segment") - 1).alias("segment"), F.sum("l").over(later).alias("l"), F.sum("s").over(later).alias("s"))
    end = F.col("depth") % size == size - 1
    ends = on_path.where(end).join(seeds, ["conv", "segment"], "left").fillna(0, ["l", "s"]).withColumns({"leaves": F.col("leaves") + F.col("l"), "saved": F.col("saved") + F.col("s")}).drop("l", "s")
    sums = on_path.where(~end).unionByName(ends).repartition(shards, "conv", "segment").drop("conv", "segment").mapInArrow(lambda batches: _accumulated(batches, size), "d1 long, d2 long, leaves long, saved long")
    sums = sums.groupBy("d1", "d2").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    last = paths.where("ends").select("d1", "d2", "conv")
    ranges = min(MOST_RANGES, max(1, -(-rows // RANGE_ROWS)))
    packed = last.repartitionByRange(ranges, "d1", "d2", "conv").sortWithinPartitions("d1", "d2", "conv").mapInArrow(_packed, "d1 long, d2 long, conv long, ids string")
    shas = packed.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "conv").mapInArrow(_hashed, "d1 long, d2 long, sha string")
    out = nodes_full.join(sums, ["d1", "d2"], "left").join(shas, ["d1", "d2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(0).cast("long")).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0).cast("long")).alias("saved_tokens"), F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    )
    out = written(out, "trie")
    forgotten(paths, nodes, nodes_full, on_path)
    return out


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: Prefixes as concatenated hashes of their turns, for small tables.
OP13_SQL = """
WITH t AS (
  SELECT conv_id, length(coalesce(text, '')) AS chars, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS r
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)),
           lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
b AS (
  SELECT c.conv_id, 0 AS part, r, k, chars FROM c JOIN t ON t.conv_id = c.base AND r <= h
  UNION ALL SELECT c.conv_id, 1, r, k, chars FROM c JOIN t ON t.conv_id = c.conv_id AND r > h),
s AS (SELECT conv_id, chars, row_number() OVER w AS d, string_agg(k, '') OVER w AS p FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY part, r)),
m AS (SELECT conv_id, chars, d, p FROM s UNION ALL SELECT conv_id, 0, 0, '' FROM c),
z AS (SELECT conv_id, max(d) AS d FROM m GROUP BY conv_id),
e AS (SELECT p, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS sha FROM m JOIN z USING (conv_id, d) GROUP BY p),
n AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM m GROUP BY p, d),
k AS (SELECT left(p, 64 * (d - 1)::INT) AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (p)),
u AS (SELECT left(p, 64 * i::INT) AS p, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * chars) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM f) GROUP BY 1)
SELECT f.conv_id, f.d AS depth, g.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM f JOIN u USING (p) LEFT JOIN f g ON f.d > 0 AND g.p = left(f.p, 64 * (f.d - 1)::INT) LEFT JOIN e ON e.p = f.p
"""
