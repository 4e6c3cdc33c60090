"""Exact-substring dedup by suffix sorting: bytes of strings of `length` bytes that also start earlier.

Earlier is a smaller doc_id, or an earlier start in the same document. Every
window of `length` bytes has an anchor: the leftmost of its k-grams with the
smallest hash, a function of the window's own bytes, so equal windows have equal
anchors at equal places. A document's windows fall into runs with one anchor.

1. Runs are dealt by anchor hash. Runs with equal bytes are the same windows:
   all but the earliest are covered. Anchors that occur once need nothing more,
   and of anchors whose runs differ, one run of each kind is asked for.
2. The bytes asked for are cut from the texts and dealt into shards by anchor
   hash, so equal windows meet in one shard. A shard's suffixes are sorted by
   induced sorting, which carries their common prefixes along (induced_sort),
   and of each class of suffixes that share `length` bytes all windows but the
   earliest are covered.
3. A document's covered windows are joined with its text.

Shuffled are 26 bytes for each run (about `length` / 3 bytes of text), the bytes
of runs that differ at a shared anchor, and the texts once. Equal runs of a slice
are settled before the shuffle: one of them goes to its anchor, so a passage of
any share of the documents costs its anchor's task a run for each slice, not for
each document. Runs that differ at one anchor, the edges of such a passage, meet
in one shard.

Defined results: null text is empty; texts under `length` bytes lose nothing;
matches never cross documents; rows that share a doc_id are texts of their own,
in the order of their text, so the second of two equal rows loses all; a null
doc_id loses nothing and covers nothing; further columns, of any name, are
ignored or kept as they are; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .induced_sort import FULL, repeats
from .kernels import mix, packed, prefix_hash, slices, span_hash, trimmed
from .store import documents, written

GRAM = 32
SHARD_BYTES = 1 << 20  # of texts that are sorted at once
QUEUE_POSITIONS = 1 << 17  # that the queues of a sort hold in memory; the others are on disk
TASK_BYTES = 32 << 20  # of the shards that one task sorts, one after the other
SLICE = 1 << 18  # bytes of text at once: the windows of a slice take some 200 bytes for each
_U = np.uint64


def runs(data: np.ndarray, off: np.ndarray, length: int, gram: int = GRAM):
    """(row, first window, windows less one, place of the anchor, anchor hash, hash of the run) of each run."""
    n, span = len(data), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = prefix_hash(data)
    at = np.arange(n - gram + 1)
    h = span_hash(sums, at, at + gram)
    bits = _U(max(1, int(n).bit_length()))
    key = (h >> bits << bits) | at.astype(np.uint64)
    m = len(key) - span + 1
    pad = -len(key) % span
    grid = np.concatenate([key, np.full(pad, ~_U(0))]).reshape(-1, span)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    del key
    anchor = (np.minimum(right[:m], left[span - 1 : span - 1 + m]) & ((_U(1) << bits) - _U(1))).astype(np.int64)
    del grid, left, right
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[:m]
    start = np.arange(m)
    inside = start + length <= off[1:][row]
    new = np.ones(m, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
    new &= inside
    first = np.flatnonzero(new)
    which = np.cumsum(new)[inside] - 1
    size = np.bincount(which, minlength=len(first))
    place = anchor[first]
    return row[first], first, size - 1, place, h[place], mix(span_hash(sums, first, first + size - 1 + length) ^ ((place - first).astype(np.uint64) << _U(8)))


_PACK = "bucket int, docs binary, doc binary, first binary, more binary, anchor binary, whole binary"


def _deal(length: int, buckets: int):
    """Runs of the texts, packed by bucket of their anchors; a run that its batch has earlier goes without hashes to say it is covered."""
    names = ["bucket", "docs", "doc", "first", "more", "anchor", "whole"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in trimmed(slices(batches, limit=SLICE)):
            docs = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            row, first, more, _, anchor, whole = runs(data, off, length)
            if not len(row):
                continue
            first = first - off[row]
            o = np.lexsort((first, docs[row], whole, anchor))
            again = np.zeros(len(o), bool)
            again[1:] = (anchor[o][1:] == anchor[o][:-1]) & (whole[o][1:] == whole[o][:-1])
            # rows that share a doc_id are keyed apart, so a run that is again there is another place
            late, o = o[again], np.sort(o[~again])
            if len(late):
                cols = [packed(x[late], np.array([0, len(late)])) for x in (row.astype("<u4"), first.astype("<u4"), more.astype(np.uint8))]
                any_bucket = int(mix(anchor[:1])[0] % _U(buckets))
                yield pa.RecordBatch.from_arrays([pa.array([any_bucket], pa.int32()), pa.array([docs.astype("<i8").tobytes()], pa.binary()), *cols, *[pa.array([b""], pa.binary())] * 2], names=names)
            row, first, more, anchor, whole = row[o], first[o], more[o], anchor[o], whole[o]
            bucket = (anchor >> _U(20)) % _U(buckets)
            order = np.lexsort((first, docs[row], bucket))
            edge = np.searchsorted(bucket[order], np.arange(buckets + 1).astype(np.uint64))
            keep = edge[1:] > edge[:-1]
            to = np.append(edge[:-1][keep], edge[-1])
            k = int(keep.sum())
            same = pa.array([docs.astype("<i8").tobytes()] * k, pa.binary())
            cols = [packed(x[order], to) for x in (row.astype("<u4"), first.astype("<u4"), more.astype(np.uint8), anchor.astype("<u8"), whole.astype("<u8"))]
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(keep), pa.int32()), same, *cols], names=names)

    return run


_ASKED = "doc_id long, first long, more int, anchor long"


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All runs of a partition's anchors: covered ones (anchor null), and those to be compared."""
    parts = []
    for b in trimmed(batches):
        for docs, *cols in zip(*[b.column(i) for i in range(1, 7)], strict=True):
            ids = np.frombuffer(docs.as_buffer(), "<i8")
            if not len(cols[3].as_buffer()):  # equal to an earlier run of its slice
                doc, first, more = (np.frombuffer(c.as_buffer(), k) for c, k in zip(cols, ("<u4", "<u4", "u1"), strict=False))
                yield pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(first.astype(np.int64)), pa.array(more.astype(np.int32)), pa.nulls(len(doc), pa.int64())], names=["doc_id", "first", "more", "anchor"])
                continue
            doc, first, more, anchor, whole = (np.frombuffer(c.as_buffer(), k) for c, k in zip(cols, ("<u4", "<u4", "u1", "<u8", "<u8"), strict=True))
            parts.append((ids[doc], first, more, anchor, whole))
    if not parts:
        return
    doc, first, more, anchor, whole = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    o = np.argsort(anchor, kind="stable")
    many = np.zeros(len(o), bool)
    eq = anchor[o][1:] == anchor[o][:-1]
    many[1:] |= eq
    many[:-1] |= eq
    o = o[many]
    doc, first, more, anchor, whole = doc[o], first[o], more[o], anchor[o], whole[o]
    o = np.lexsort((first, doc, whole, anchor))
    doc, first, more, anchor, whole = doc[o], first[o], more[o], anchor[o], whole[o]
    n = len(o)
    new_a, new_w = np.ones(n, bool), np.ones(n, bool)
    new_a[1:] = anchor[1:] != anchor[:-1]
    new_w[1:] = new_a[1:] | (whole[1:] != whole[:-1])
    kinds = np.bincount(np.cumsum(new_a) - 1, new_w)[np.cumsum(new_a) - 1] if n else np.zeros(0)
    # equal runs of rows with the same doc_id and place are the same place
    head = np.flatnonzero(new_w)
    w = np.cumsum(new_w) - 1
    earliest = (doc == doc[head][w]) & (first == first[head][w]) if n else np.zeros(0, bool)
    covered, asked = ~earliest, earliest & (kinds > 1)
    pick = np.flatnonzero(covered | asked)
    for at in range(0, len(pick), 50_000):
        p = pick[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(doc[p]), pa.array(first[p].astype(np.int64)), pa.array(more[p].astype(np.int32)), pa.array(anchor[p].view(np.int64), mask=covered[p])], names=["doc_id", "first", "more", "anchor"])


_PIECES = "shard int, docs binary, first binary, more binary, bytes binary"


def _cut(length: int, shards: int):
    """Rows (doc_id, text, asked) to the bytes of the runs asked for, packed by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in trimmed(slices(batches, limit=SLICE)):
            asked = batch.column(2)
            size = np.array([len(x) if x.is_valid else 0 for x in asked])
            if not size.sum():
                continue
            flat = asked.flatten()
            first, more, anchor = (np.asarray(flat.field(i)) for i in range(3))
            row = np.repeat(np.arange(len(size)), size)
            docs = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            shard = (mix(anchor.view(np.uint64)) % _U(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            row, first, more, shard = row[order], first[order], more[order], shard[order]
            n = more.astype(np.int64) + length
            to = np.concatenate([[0], np.cumsum(n)])
            out = data[np.arange(to[-1]) + np.repeat(off[row] + first - to[:-1], n)]
            edge = np.searchsorted(shard, np.arange(shards + 1))
            keep = edge[1:] > edge[:-1]
            at = np.append(edge[:-1][keep], edge[-1])
            cols = [packed(docs[row].astype("<i8"), at), packed(first.astype("<i8"), at), packed(more.astype("<u1"), at), packed(out, to[at])]
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(keep), pa.int32()), *cols], names=["shard", "docs", "first", "more", "bytes"])

    return run


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[np.ndarray, ...]]]:
    """Rows sorted by shard: the pieces of each shard."""
    now, held = None, []
    for b in trimmed(batches):
        for shard, *cols in zip(b.column(0).to_pylist(), *b.columns[1:], strict=True):
            if shard != now and held:
                yield held
                held = []
            now = shard
            held.append(tuple(np.frombuffer(c.as_buffer(), k) for c, k in zip(cols, ("<i8", "<i8", "u1", "u1"), strict=True)))
    if held:
        yield held


def _sort(length: int, limit: int):
    """Pieces sorted by shard: windows that also start earlier, as (doc_id, first, more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _by_shard(batches):
            yield from one(parts)

    def one(parts: list) -> Iterator[pa.RecordBatch]:
        doc, first, more, text = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        n = more.astype(np.int64) + length
        to = np.concatenate([[0], np.cumsum(n)])
        owner = np.full(len(text), -1, np.int32)
        own = np.repeat(to[:-1], more.astype(np.int64) + 1) + _steps(more.astype(np.int64) + 1)
        owner[own] = np.repeat(np.arange(len(n), dtype=np.int32), more.astype(np.int64) + 1)
        order, group = repeats(text, length, limit)
        mine = owner[order] >= 0
        order, group = order[mine], group[mine]
        again = np.zeros(len(order), bool)
        again[1:] = group[1:] == group[:-1]
        again[:-1] |= again[1:]
        order, group = order[again], group[again]
        piece = owner[order]
        d, p = doc[piece], first[piece] + (order - to[piece])
        o = np.lexsort((p, d, group))
        group, d, p, order = group[o], d[o], p[o], order[o]
        head = np.ones(len(o), bool)
        head[1:] = group[1:] != group[:-1]
        h = np.flatnonzero(head)
        w = np.cumsum(head) - 1
        late = (d != d[h][w]) | (p != p[h][w]) if len(o) else head
        d, p = d[late], p[late]
        o = np.lexsort((p, d))
        d, p = d[o], p[o]
        start = np.ones(len(o), bool)
        start[1:] = (d[1:] != d[:-1]) | (p[1:] > p[:-1] + 1)
        a = np.flatnonzero(start)
        z = np.append(a[1:], len(o)) - 1 if len(a) else a
        for i in range(0, len(a), 50_000):
            x, y = a[i : i + 50_000], z[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(d[x]), pa.array(p[x]), pa.array((p[y] - p[x]).astype(np.int32))], names=["doc_id", "first", "more"])

    return run


def _steps(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. size - 1 for each size, one after the other."""
    to = np.cumsum(sizes)
    return np.arange(to[-1] if len(to) else 0) - np.repeat(to - sizes, sizes)


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _result(length: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in trimmed(slices(batches, limit=SLICE)):
            lists = batch.column(2)
            size = np.array([len(x) if x.is_valid else 0 for x in lists])
            gone = np.zeros(len(data) + 1, np.int32)
            if size.sum():
                flat = lists.flatten()
                first, more = (np.asarray(flat.field(i)) for i in range(2))
                at = off[np.repeat(np.arange(len(size)), size)] + first
                np.add.at(gone, at, 1)
                np.add.at(gone, at + more + length, -1)
            gone = np.cumsum(gone)[: len(data)] > 0
            begin = gone.copy()
            if len(begin):
                begin[1:] &= ~gone[:-1]
                heads = off[:-1][off[:-1] < len(data)]
                begin[heads] = gone[heads]
            count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[off])
            kept = data[~gone].tobytes()
            to = np.concatenate([[0], np.cumsum(~gone)])[off].tolist()
            texts = [kept[a:z] for a, z in zip(to, to[1:], strict=False)]
            cols = [batch.column(0), pa.array(np.diff(off)), pa.array(count(gone).astype(np.int64)), pa.array(count(begin).astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in texts])]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                cols.append(pa.array([x.decode("utf-8", "ignore") for x in texts], pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def keyed(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Adds a key: the doc_id where ids are distinct, else a number for each row in the order of doc_id and text; also the table written for that."""
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs.withColumn(key, F.col("doc_id")), None
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text").withColumn(key, F.monotonically_increasing_id())
    laid = written(laid.withColumn(key, F.when(F.col("doc_id").isNotNull(), F.col(key))), "keyed")
    return laid, laid


def repeated_windows(docs: DataFrame, length: int = 100, memory_positions: int = QUEUE_POSITIONS) -> DataFrame:
    """(doc_id, first, more): windows first .. first + more of a document also start earlier; doc_ids are distinct, 33 to 254 bytes are a window."""
    if not GRAM < length < FULL:
        raise ValueError(f"length is {length}, not in {GRAM + 1} .. {FULL - 1}")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("doc_id", "text")
    dealt = texts.where("doc_id is not null").mapInArrow(_deal(length, parts), _PACK)
    settled = written(dealt.repartition(parts, "bucket").mapInArrow(_settle, _ASKED), "settled")
    asked = settled.where("anchor is not null").groupBy("doc_id").agg(F.collect_list(F.struct("first", "more", "anchor")).alias("asked"))
    size = settled.where("anchor is not null").agg(F.sum(F.col("more") + length)).first()[0] or 0
    shards = max(parts, -(-size // SHARD_BYTES))
    tasks = max(parts, -(-size // TASK_BYTES))
    pieces = texts.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(_cut(length, shards), _PIECES)
    late = written(pieces.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(_sort(length, memory_positions), "doc_id long, first long, more int"), "late")
    return settled.where("anchor is null").select("doc_id", "first", "more").unionByName(late)


def _found(docs: DataFrame, length: int, found: str) -> DataFrame:
    """The rows with their covered windows in the column `found`."""
    key = _fresh(docs, "row_key")
    rows, _ = keyed(docs, key)
    late = repeated_windows(rows.select(F.col(key).alias("doc_id"), "text"), length)
    windows = late.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("first", "more")).alias(found))
    return rows.join(windows, key, "left").drop(key)


def remove_repeats(docs: DataFrame, length: int = 100, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept_text of each document."""
    rows = _found(docs.select("doc_id", "text"), length, "found").select("doc_id", "text", "found")
    return rows.mapInArrow(_result(length, keep_text), _RESULT + (", kept_text string" if keep_text else ""))


def _shortened(length: int, names: list[str], found: str):
    inner = _result(length, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = pa.Table.from_batches(inner(iter([b.select(["doc_id", "text", found])])))
            texts = got.column("kept_text").combine_chunks()
            cols = {c: b.column(c) for c in names} | {"text": texts}
            if "n_chars" in cols:
                cols["n_chars"] = pc.cast(pc.utf8_length(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)

    return run


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """The documents, all columns, with the repeated bytes out of their text (and a character cut in two with them)."""
    found = _fresh(docs, "found")
    return _found(docs, length, found).mapInArrow(_shortened(length, docs.columns, found), docs.schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


__all__ = ["op2_suffix_dedup", "remove_repeats", "repeated_windows", "runs"]
