"""MinHash near-duplicates by a chosen-path set similarity join.

A document's set holds the hashes of its distinct shingles of `k` words. Texts
with the same set form one class, and only the smallest doc_id of a class goes
on. Then, after Christiani, Pagh and Sivertsen (2018), each of `trees`
independent trees branches the documents by minwise tokens: the path of a node
fixes which minhash coordinates its members are branched by, 1/threshold of
them in the mean, and members with the same minwise token share a child. A turn
treats all nodes of a level:

1. Nodes are dealt into blocks of bounded members, one block for all but the
   largest. A block's sketches (two bits of 192 minhashes) give a minimum
   spanning forest of the pairs that may be links, so a family of copies is
   connected by one pair a member, never expanded into pairs.
2. The forest's pairs are confirmed on full sets and give components, which
   label the members.
3. Small nodes, of one block, are compared exhaustively: all pairs of different
   labels that may be links are confirmed, or, where these are many, the node's
   full sets are compared in tiles.
4. Of a larger node, the members outside its most frequent label are compared
   with all others in tiles if they are at most `node_limit`; else the node is
   branched again. Paths of unlike members part at each level, so the number of
   turns is the logarithm of the largest node; what should be left after
   `max_rounds` is compared in tiles.

The filter on sketches lets 6.2 standard deviations pass: it loses a pair at the
threshold with a chance of 1e-9; every other pair is confirmed on the full sets
of 48-bit hashes. The chance to miss a pair at the threshold in all trees is
(1 - threshold)^trees at the first level, 6e-9 by default, and grows with the
depth of the node where it would be met.

Defined results: null or empty text, or text without words, has an empty set
and no link; with fewer than k words the whole sequence is the one shingle;
rows that share a doc_id are one vertex with the links of all; a null doc_id
has no links and stays; further columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .kernels import Words, mapper, min_per_row, mix, packed, rows_of, shingles, text_bytes, trim, trimmed, unique_per_row
from .store import bucketed, documents, forgotten, written

COORDINATES, HASHES, WIDTH = 64, 192, 6
SKETCH = 2 * HASHES // 8  # bytes
TILE_SHINGLES = 500_000  # on each side of a tile
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(19))
_ODD = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint64) * _U(2) + _U(1)).astype(np.uint32)

_SIGNATURE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("sketch", pa.binary()), ("roots", pa.list_(pa.int64())), ("minwise", pa.binary()), ("shingles", pa.binary())])
_SIGNATURE_DDL = "doc_id long, n long, f1 long, f2 long, sketch binary, roots array<bigint>, minwise binary, shingles binary"


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, with offsets."""
    w = Words(data, off)
    h, at = shingles(w.hash, w.first, k)
    row = np.searchsorted(w.first, at, "right") - 1 if len(at) else np.zeros(0, np.int64)
    return unique_per_row(h, row, len(off) - 1)


def _signatures(k: int, trees: int):
    def work(batch: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> dict:
        h, to = shingle_sets(data, off, k)
        n = len(to) - 1
        low = (h >> _U(32)).astype(np.uint32)
        least = np.empty((n, HASHES), np.uint32)
        for i, odd in enumerate(_ODD):
            y = low * odd
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            least[:, i] = min_per_row(y, to, np.uint32(0))
        planes = np.concatenate([np.packbits((least >> np.uint32(i) & np.uint32(1)).astype(np.uint8), axis=1) for i in (0, 1)], axis=1)
        minwise = np.ascontiguousarray(least[:, :COORDINATES])
        tree = np.arange(trees, dtype=np.uint64)
        roots = mix(mix(tree[None, :] + _U(1)) ^ (minwise[:, np.arange(trees) % COORDINATES].astype(np.uint64) + (tree << _U(32))))
        raw = h[:, None].view(np.uint8)[:, 8 - WIDTH :] if len(h) else np.zeros((0, WIDTH), np.uint8)
        m = mix(h ^ _U(0xA24BAED4963EE407))
        return {
            "doc_id": batch.column(0), "n": np.diff(to), "f1": _wrapping(mix(h), to), "f2": _wrapping(m, to), "sketch": packed(planes.ravel(), np.arange(n + 1) * SKETCH),
            "roots": pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * trees), pa.array(roots.view(np.int64).ravel())),
            "minwise": packed(minwise.ravel(), np.arange(n + 1) * COORDINATES), "shingles": packed(raw, to),
        }

    return mapper(work, _SIGNATURE, limit=1 << 18)


def _wrapping(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    s = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=s[1:])
    return (s[off[1:]] - s[off[:-1]]).view(np.int64)


def _branch(threshold: float, limit: int):
    """Children of nodes: rows (path, minwise, others, ...) to rows with the child's path.

    A node with far more members than the limit is branched by several levels at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in trimmed(batches):
            if not b.num_rows:
                continue
            path = b.column("path").to_numpy(zero_copy_only=False).view(np.uint64)
            raw, _ = text_bytes(b.column("minwise"))
            least = raw.view(np.uint32).reshape(-1, COORDINATES)
            rows = np.arange(len(path))
            levels = np.clip(np.log2(b.column("others").to_numpy(zero_copy_only=False) / limit).astype(np.int64) + 1, 1, 6)
            done = []
            for level in range(1, int(levels.max()) + 1):
                seed = mix(path ^ _U(0x8CB92BA72F3D8DD7))
                more = mix(seed + _U(1)) < _U(int((1 / threshold - 1) * 2**64))
                first, second = seed % _U(COORDINATES), (seed >> _U(8)) % _U(COORDINATES)
                second = np.where(second == first, (second + _U(1)) % _U(COORDINATES), second)
                c, r, s = np.concatenate([first, second[more]]), np.concatenate([rows, rows[more]]), np.concatenate([seed, seed[more]])
                path = mix(s ^ mix(least[r, c.astype(np.int64)].astype(np.uint64) + (c << _U(32))))
                end = levels[r] == level
                done.append((r[end], path[end]))
                rows, path = r[~end], path[~end]
            rows, path = (np.concatenate(x) for x in zip(*done, strict=True))
            cols = {x: b.column(x).take(pa.array(rows)) for x in ("doc_id", "n", "sketch")}
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(path.view(np.int64))], names=[*cols, "path"])

    return run


# pairs of a block that may be links


class Alike:
    """The filter on sketches: pairs of the similarity meet it, but for one in 1e9."""

    def __init__(self, percent: int):
        p = 0.75 * (1 - percent / 100)  # the chance that two bits of a minhash differ
        self.percent = percent
        self.most = int(HASHES * p + 6.2 * (HASHES * p * (1 - p)) ** 0.5) + 1
        self.never = 2 * HASHES

    def distance(self, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
        """Minhashes whose bits differ, `never` for pairs that cannot be links; sketches are words of both planes side by side."""
        x = a ^ b
        half = x.shape[-1] // 2
        d = np.bitwise_count(x[..., :half] | x[..., half:]).sum(-1, dtype=np.int64)
        return np.where((100 * np.minimum(na, nb) >= self.percent * np.maximum(na, nb)) & (d <= self.most), d, self.never)


def spanning(u: np.ndarray, v: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Indexes of the edges (u, v) of a minimum spanning forest of n vertices by d (Boruvka)."""
    order = np.argsort(d, kind="stable")
    u, v = u[order], v[order]
    label, live, taken = np.arange(n), np.arange(len(u)), []
    while True:
        a, b = label[u[live]], label[v[live]]
        on = a != b
        live, a, b = live[on], a[on], b[on]
        if not len(live):
            break
        best = np.full(n, len(u))
        np.minimum.at(best, a, live)
        np.minimum.at(best, b, live)
        root = np.flatnonzero(best < len(u))
        e = best[root]
        taken.append(e)
        up = np.arange(n)
        up[root] = np.where(label[u[e]] == root, label[v[e]], label[u[e]])
        two = (up[up] == np.arange(n)) & (np.arange(n) < up)
        up[two] = np.flatnonzero(two)
        while (up[up] != up).any():
            up = up[up]
        label = up[label]
    return order[np.unique(np.concatenate(taken))] if taken else np.zeros(0, np.int64)


def _prim(words: np.ndarray, n: np.ndarray, alike: Alike) -> tuple[np.ndarray, np.ndarray]:
    """The spanning forest of one large block, a row of distances at a time."""
    m = len(n)
    near, source = np.full(m, alike.never), np.zeros(m, np.int64)
    out, at = np.zeros(m, bool), 0
    u, v = [], []
    for _ in range(m - 1):
        out[at] = True
        d = alike.distance(words, n, words[at], n[at])
        closer = d < near
        near[closer], source[closer] = d[closer], at
        at = int(np.where(out, alike.never + 1, near).argmin())
        if near[at] < alike.never:
            u.append(source[at])
            v.append(at)
    return np.array(u, np.int64), np.array(v, np.int64)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], least: int = 1 << 15) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in tables of whole groups, of about `least` rows each, with the offsets of the groups."""

    def edges(t: pa.Table) -> np.ndarray:
        new = np.ones(t.num_rows, bool)
        new[1:] = False
        for k in keys:
            x = t.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.append(np.flatnonzero(new), t.num_rows)

    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.num_rows
        if size >= least:
            t = pa.Table.from_batches(held)
            off = edges(t)
            if len(off) > 2:
                yield t.slice(0, off[-2]), off[:-1]
                rest = t.slice(off[-2]).combine_chunks()
                held, size = rest.to_batches(), rest.num_rows
    if held:
        t = pa.Table.from_batches(held)
        yield t, edges(t)


def _members(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = text_bytes(t.column("sketch"))[0].view(np.uint64).reshape(-1, SKETCH // 8)
    return t.column("doc_id").to_numpy(), t.column("n").to_numpy(), words


def _near_pairs(off: np.ndarray, n: np.ndarray, words: np.ndarray, alike: Alike, chosen: np.ndarray, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of the pairs in the chosen groups that may be links, and have different labels."""
    size = np.diff(off)
    row = rows_of(off)
    after = off[1:][row] - 1 - np.arange(len(row))  # members behind it in its group
    parts = [(np.zeros(0, np.int64),) * 3]
    live = np.flatnonzero(chosen[row])
    for step in range(1, int(size[chosen].max(initial=0))):
        live = live[after[live] >= step]
        i, j = live, live + step
        if label is not None:
            on = label[i] != label[j]
            i, j = i[on], j[on]
        d = alike.distance(words[i], n[i], words[j], n[j])
        on = d < alike.never
        parts.append((i[on], j[on], d[on]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _pairs(doc: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.minimum(doc[i], doc[j])), pa.array(np.maximum(doc[i], doc[j]))]


def _forest(percent: int, small: int = 64):
    """Pairs (u, v) of the spanning forests of blocks; rows are sorted by path and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alike = Alike(percent)
        for t, off in whole_groups(trimmed(batches), ("path", "block")):
            doc, n, words = _members(t)
            i, j, d = _near_pairs(off, n, words, alike, np.diff(off) <= small)
            e = spanning(i, j, d, t.num_rows)
            parts = [(i[e], j[e])]
            for g in np.flatnonzero(np.diff(off) > small):
                a, z = off[g], off[g + 1]
                i, j = _prim(words[a:z], n[a:z], alike)
                parts.append((a + i, a + j))
            i, j = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays(_pairs(doc, i, j), names=["u", "v"])

    return run


def _residue(percent: int, small: int = 64):
    """Pairs (u, v) of different labels in nodes of one block, or the path of a node where they are many; rows are sorted by path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alike = Alike(percent)
        for t, off in whole_groups(trimmed(batches), ("path",)):
            doc, n, words = _members(t)
            label, path = t.column("label").to_numpy(), t.column("path").to_numpy()
            size = np.diff(off)
            mixed = np.maximum.reduceat(label, off[:-1]) != np.minimum.reduceat(label, off[:-1])
            i, j, _ = _near_pairs(off, n, words, alike, mixed & (size <= small), label)
            parts, dense = [(i, j)], []
            for g in np.flatnonzero(mixed & (size > small)):
                a, z = off[g], off[g + 1]
                found, many = [], 0
                for at in range(a, z - 1):
                    k = np.arange(at + 1, z)
                    k = k[label[k] != label[at]]
                    k = k[alike.distance(words[k], n[k], words[at], n[at]) < alike.never]
                    found.append((np.full(len(k), at), k))
                    many += len(k)
                    if many > 4 * (z - a):
                        dense.append(path[a])
                        break
                else:
                    parts += found
            i, j = (np.concatenate(x) for x in zip(*parts, strict=True))
            u, v = _pairs(doc, i, j)
            blank = pa.nulls(len(dense), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.nulls(len(u), pa.int64()), pa.array(dense, pa.int64())]), pa.concat_arrays([u, blank]), pa.concat_arrays([v, blank])], names=["path", "u", "v"])

    return run


# full sets


def _confirm(percent: int, most: int = 1 << 21):
    """Pairs whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in trimmed(batches):
            step = max(1, int(most / max(1, b.nbytes / max(1, b.num_rows))))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                (da, oa), (db, ob) = text_bytes(part.column("a")), text_bytes(part.column("b"))
                rows = np.concatenate([rows_of(oa // WIDTH), rows_of(ob // WIDTH)])
                wide = np.zeros((len(rows), 8), np.uint8)
                wide[:, :WIDTH] = np.concatenate([da, db]).reshape(-1, WIDTH)
                key = wide.view(np.uint64).ravel()
                order = np.lexsort((key, rows))
                key, rows = key[order], rows[order]
                both = np.bincount(rows[1:][(key[1:] == key[:-1]) & (rows[1:] == rows[:-1])], minlength=part.num_rows)
                union = np.diff(oa) // WIDTH + np.diff(ob) // WIDTH - both
                yield pa.RecordBatch.from_arrays([part.column("u"), part.column("v")], names=["u", "v"]).filter(pa.array(100 * both >= percent * union))

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of at least that similarity on full sets; the sets lie bucketed by doc_id and are not shuffled themselves."""
    a = sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("b"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(_confirm(percent), "u long, v long")


def _compare_tile(percent: int, width: int = 4096):
    """Links of a tile: its rows of side 0 against those of side 1, one link for each pair of labels.

    Sizes of intersections are products of the two sides' membership matrices,
    made a few thousand shared shingles at a time.
    """

    def run(table: pa.Table) -> pa.Table:
        side = np.asarray(table.column("side"))
        parts = []
        for k in (0, 1):
            t = table.filter(pa.array(side == k))
            raw, off = text_bytes(t.column("shingles"))
            wide = np.zeros((len(raw) // WIDTH, 8), np.uint8)
            wide[:, :WIDTH] = raw.reshape(-1, WIDTH)
            parts.append((np.asarray(t.column("doc_id")), np.asarray(t.column("label")), wide.view(np.uint64).ravel(), rows_of(off // WIDTH), np.diff(off) // WIDTH))
        (da, la, ka, ra, na), (db, lb, kb, rb, nb) = parts
        shared = np.intersect1d(ka, kb)
        both = np.zeros((len(da), len(db)), np.float32)
        for at in range(0, len(shared), width):
            some = shared[at : at + width]
            grids = []
            for key, row, n in ((ka, ra, len(da)), (kb, rb, len(db))):
                place = np.minimum(np.searchsorted(some, key), len(some) - 1)
                hit = some[place] == key
                g = np.zeros((n, len(some)), np.float32)
                g[row[hit], place[hit]] = 1
                grids.append(g)
            both += grids[0] @ grids[1].T
        i, j = np.nonzero((100 * both >= percent * (na[:, None] + nb[None, :] - both)) & (la[:, None] != lb[None, :]))
        pair = np.stack([np.minimum(la[i], lb[j]), np.maximum(la[i], lb[j])], axis=1)
        _, first = np.unique(pair, axis=0, return_index=True) if len(pair) else (None, np.zeros(0, np.int64))
        out = pa.table({"u": pa.array(da[i[first]], pa.int64()), "v": pa.array(db[j[first]], pa.int64())})
        del parts, ka, kb, ra, rb, both, pair, i, j
        trim()  # a worker that waits for its next tile, or for none, keeps nothing
        return out

    return run


def tile_links(rows: DataFrame, sets: DataFrame, percent: int, tile: int) -> DataFrame:
    """Links (u, v) between the rows of a node outside its major label and all its rows, one for each pair of labels of a tile.

    rows: path, size, others, all_n and others_n (shingles of either), major,
    doc_id, label. Both sides are dealt into tiles of about `tile` rows, or
    TILE_SHINGLES shingles where that is less, so a large node is many tasks and its pairs are
    never rows.
    """
    na = F.greatest(F.ceil(F.col("others") / tile), F.ceil(F.col("others_n") / TILE_SHINGLES)).cast("int")
    nb = F.greatest(F.ceil(F.col("size") / tile), F.ceil(F.col("all_n") / TILE_SHINGLES)).cast("int")
    r = rows.select("path", "doc_id", "label", "major", na.alias("na"), nb.alias("nb")).join(sets, "doc_id")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n, salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col(n)).cast("int")
    a = r.where("label <> major").select("path", deal("na", 1).alias("ta"), every("nb").alias("tb"), F.lit(0).alias("side"), "doc_id", "label", "shingles")
    b = r.select("path", every("na").alias("ta"), deal("nb", 2).alias("tb"), F.lit(1).alias("side"), "doc_id", "label", "shingles")
    return a.unionByName(b).groupBy("path", "ta", "tb").applyInArrow(_compare_tile(percent), "u long, v long")



def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 85, trees: int = 10, block: int = 2048, block_shingles: int = 8_000_000, node_limit: int = 4096, tile: int = 1024, max_rounds: int = 40) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the component's smallest doc_id) of each document."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sigs = bucketed(docs.select("doc_id", "text").repartition(buckets, "doc_id").mapInArrow(_signatures(k, trees), _SIGNATURE_DDL), "doc_id", buckets)
    classes = written(sigs.where("n > 0 and doc_id is not null").groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "sketch", "roots")).alias("x")).select("f1", "f2", "n", "x.*"), "classes")
    rep = classes.select("f1", "f2", "n", F.col("doc_id").alias("rep"))
    members = written(sigs.select("doc_id", "n", "f1", "f2").join(rep, ["f1", "f2", "n"], "left").select("doc_id", "n", "rep"), "members")
    first = members.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("last")).where("u <> last").select("doc_id", "u")
    twins = members.join(first, "doc_id").where("rep <> u").select("u", F.col("rep").alias("v"))  # classes of rows that share a doc_id
    sets = sigs.select("doc_id", "shingles")
    nodes = classes.select("doc_id", "n", "sketch", F.explode("roots").alias("path"))
    roots = None

    def united(links: DataFrame) -> None:
        """Adds links to the components so far."""
        nonlocal roots
        before = roots
        roots = components(links if before is None else links.unionByName(before.select(F.col("id").alias("u"), F.col("root").alias("v"))))
        forgotten(before)

    for turn in range(max_rounds):
        sizes = nodes.groupBy("path").agg(F.count("*").alias("size"), F.sum("n").alias("all_n")).where("size > 1")
        blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("all_n") / block_shingles)).cast("int")
        alive = nodes.join(sizes, "path").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("doc_id", "path"), F.col("blocks")).cast("int"))
        before, alive = nodes, written(alive, "nodes")
        forgotten(before)
        forest = alive.select("path", "block", "doc_id", "n", "sketch").repartition("path", "block").sortWithinPartitions("path", "block")
        links = confirmed(forest.mapInArrow(_forest(percent), "u long, v long").distinct(), sets, percent)
        united(links.unionByName(twins) if turn == 0 else links)
        told = alive.join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("root", "doc_id")).drop("root", "block")
        before, told = alive, written(told, "labelled")
        forgotten(before)
        small = told.where("blocks = 1").select("path", "doc_id", "n", "sketch", "label").repartition("path").sortWithinPartitions("path")
        residue = written(small.mapInArrow(_residue(percent), "path long, u long, v long"), "residue")
        links = confirmed(residue.where("path is null").select("u", "v").distinct(), sets, percent)
        dense = residue.where("path is not null").select("path").distinct()
        wide = told.join(dense, "path", "left_semi").unionByName(told.where("blocks > 1"))
        shares = wide.groupBy("path", "label").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
        mixed = shares.groupBy("path").agg(F.max(F.struct("c", "label", "n")).alias("m"), F.sum("c").alias("size"), F.sum("n").alias("all_n")).where("m.c < size")
        mixed = written(mixed.select("path", F.col("m.label").alias("major"), (F.col("size") - F.col("m.c")).alias("others"), (F.col("all_n") - F.col("m.n")).alias("others_n")), "mixed")
        left = None
        if not mixed.isEmpty():
            most = node_limit if turn < max_rounds - 1 else 1 << 62
            rows = told.join(mixed, "path")
            links = links.unionByName(tile_links(rows.where(f"others <= {most}"), sets, percent, tile))
            left = rows.where(f"others > {most}").join(sigs.select("doc_id", "minwise"), "doc_id").select("doc_id", "n", "sketch", "path", "others", "minwise")
            left = written(left.mapInArrow(_branch(percent / 100, node_limit), "doc_id long, n long, sketch binary, path long"), "children")
        united(links)
        forgotten(told, residue, mixed)
        if left is None or left.isEmpty():
            break
        nodes = left
    out = written(members.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", "n", F.coalesce("root", "rep").alias("component_id")), "components")
    forgotten(sigs, classes, members, roots)
    root = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), root.alias("component_id"), F.coalesce(F.col("doc_id") == root, F.lit(True)).alias("kept"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


#: All pairs of documents that share a shingle, for small tables.
OP9_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+4], ' ') END AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.u, r.root FROM r JOIN e ON e.v = r.id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(root) AS component_id, d.doc_id = min(root) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.id = d.doc_id GROUP BY d.doc_id, n.n
"""
