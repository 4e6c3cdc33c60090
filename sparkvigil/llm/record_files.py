"""Token-id record files: length-delimited binary records with masked checksums.

Each record is the length of its payload (unsigned 64-bit little-endian), the
masked CRC-32C of those eight bytes, the payload (ids as little-endian unsigned
integers of 16 bits where the vocabulary allows it, else of 32; the manifest has
the width) and the payload's masked CRC-32C. Beside each data file lies an
index of (doc_id, byte offset of the record, number of ids) triples of 64-bit
integers, by which records are read in any order.

Texts are range-partitioned by doc_id, so the files are in ascending order and
no task holds more than its range. A task writes under a name of its own and
reports it when complete; only reported files are in the manifest, so a lost or
repeated task leaves nothing that is read. Reading checks every checksum.

Ids are those of the library's plain call without added special tokens: an added
token's text inside a document is that token. No such text has a blank inside, so
it never crosses a cut of the segments.

Defined results: null text is empty and gets the end id alone; rows that share a
doc_id stay rows of their own, in the order of their text; null doc_ids come
first; further columns are ignored; an empty table gives no records.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .crc32c import crc32c, masked
from .kernels import kept_in_worker, slices, trimmed
from .segments import Encoder
from .store import documents, shared_folder, written

NULL_ID = -(1 << 63)
_MANIFEST = "data string, width long, first_doc long, n_records long, n_tokens long"
_encoders: dict[str, Encoder] = kept_in_worker("record_files")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_bpe(path: str) -> Encoder:
    """This process's encoder for a file of the tokenizers library (byte-level BPE)."""
    if path not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        if any(x.rstrip or re.search(r"\s", x.content) for x in t.get_added_tokens_decoder().values()):
            raise ValueError("an added token takes in a blank after its start, where texts are cut")
        _encoders[path] = Encoder(_joint(t))
        _encoders[path].vocabulary = t.get_vocab_size()
    return _encoders[path]


def _joint(t, run: int = 500):
    """Encodes many segments by one call: those between single blanks are joined, and the ids split by the tokens' lengths in bytes."""
    size = np.zeros(t.get_vocab_size(), np.int64)
    for token, i in t.get_vocab().items():
        size[i] = len(token)  # one character stands for one byte
    for i, token in t.get_added_tokens_decoder().items():
        size[i] = len(token.content.encode())

    def alone(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in t.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        fit = [i for i, x in enumerate(texts) if len(x) > 1 and x[0] == " " and not x[1].isspace() and not x[-1].isspace()]
        runs = [fit[i : i + run] for i in range(0, len(fit), run)]
        for part, e in zip(runs, t.encode_batch_fast(["".join([texts[i] for i in r]) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = np.cumsum(size[ids])
            want = np.cumsum([len(texts[i].encode()) for i in part])
            to = np.searchsorted(ends, want)
            if len(ids) and to[-1] < len(ids) and (ends[to] == want).all():
                raw, to = ids.tobytes(), np.concatenate([[0], 4 * (to + 1)]).tolist()
                for i, a, z in zip(part, to, to[1:], strict=False):
                    out[i] = raw[a:z]
        rest = [i for i, v in enumerate(out) if v is None]
        for i, v in zip(rest, alone([texts[i] for i in rest]), strict=True):
            out[i] = v
        return out

    return encode


def frame(payload: np.ndarray, off: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Records of the byte runs payload[off[i]:off[i + 1]], and their offsets in the result."""
    size = np.diff(off)
    n = len(size)
    at = np.concatenate([[0], np.cumsum(size + 16)])
    out = np.empty(at[-1], np.uint8)
    head = size.astype("<u8").view(np.uint8)
    head_crc = masked(crc32c(head, np.arange(n + 1) * 8)).astype("<u4").view(np.uint8)
    body_crc = masked(crc32c(payload, off)).astype("<u4").view(np.uint8)
    out[(at[:-1, None] + np.arange(8)).ravel()] = head
    out[(at[:-1, None] + np.arange(8, 12)).ravel()] = head_crc
    out[(at[1:, None] + np.arange(-4, 0)).ravel()] = body_crc
    out[np.arange(off[-1]) + np.repeat(at[:-1] + 12 - off[:-1], size)] = payload
    return out.tobytes(), at


def unframe(raw: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Payload bytes and offsets of records that start at `at`; raises where a checksum differs."""
    data = np.frombuffer(raw, np.uint8)
    n = len(at)
    head = data[(at[:, None] + np.arange(8)).ravel()]
    size = head.view("<u8").astype(np.int64)
    off = np.concatenate([[0], np.cumsum(size)])
    crc = lambda places: data[places.ravel()].view("<u4")
    if (masked(crc32c(head, np.arange(n + 1) * 8)) != crc(at[:, None] + np.arange(8, 12))).any():
        raise ValueError("a record's length has a wrong checksum")
    payload = data[np.arange(off[-1]) + np.repeat(at + 12 - off[:-1], size)]
    if (masked(crc32c(payload, off)) != crc((at + 12 + size)[:, None] + np.arange(4))).any():
        raise ValueError("a record's payload has a wrong checksum")
    return payload, off


def _writer(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(tokenizer)
        width = 2 if encoder.vocabulary <= 1 << 16 else 4
        out, name = None, f"{folder}/{uuid.uuid4().hex}"
        first = n_records = n_tokens = place = 0
        for batch, data, off in trimmed(slices(batches), "record_files"):
            if out is None:
                system, path = fs.FileSystem.from_uri(name)
                system.create_dir(os.path.dirname(path), recursive=True)
                out, index = system.open_output_stream(path + ".rec"), system.open_output_stream(path + ".idx")
                first = batch.column(0)[0].as_py()
            ids, to = encoder.ids(data, off)
            n = len(to) - 1
            ends = to[1:] + np.arange(1, n + 1)
            full = np.empty(to[-1] + n, "<u4")
            full[ends - 1] = end_id
            full[np.arange(to[-1]) + np.repeat(np.arange(n), np.diff(to))] = ids
            to = np.concatenate([[0], ends])
            raw, at = frame(full.astype(f"<u{width}").view(np.uint8), to * width)
            docs = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            index.write(np.stack([docs, place + at[:-1], np.diff(to)], axis=1).astype("<i8").tobytes())
            out.write(raw)
            place, n_records, n_tokens = place + len(raw), n_records + n, n_tokens + int(to[-1])
        if out is not None:
            out.close()
            index.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([width]), pa.array([first], pa.int64()), pa.array([n_records]), pa.array([n_tokens])], names=["data", "width", "first_doc", "n_records", "n_tokens"])

    return run


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Writes the files and gives the manifest: one row for each file, first_doc giving the order."""
    spark = docs.sparkSession
    ranged = docs.select("doc_id", "text").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id", "text")
    return written(ranged.mapInArrow(_writer(folder, tokenizer, end_id), _MANIFEST), "manifest")


def _reader(limit: int = 8 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, width, before in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                system, path = fs.FileSystem.from_uri(name)
                with system.open_input_file(path + ".idx") as f:
                    index = np.frombuffer(f.read(), "<i8").reshape(-1, 3)
                i = 0
                with system.open_input_file(path + ".rec") as f:
                    size = f.size()
                    end = np.append(index[1:, 1], size)
                    while i < len(index):
                        j = max(i + 1, int(np.searchsorted(end, index[i, 1] + limit, "right")))
                        raw = f.read_at(int(end[j - 1] - index[i, 1]), int(index[i, 1]))
                        payload, off = unframe(raw, index[i:j, 1] - index[i, 1])
                        n = np.diff(off) // width
                        if (n != index[i:j, 2]).any():
                            raise ValueError("index and records differ")
                        whole, to = payload.view(f"<u{width}").astype("<u4").tobytes(), (off * 4 // width).tolist()
                        crc = [zlib.crc32(whole[a:z]) for a, z in zip(to, to[1:], strict=False)]
                        docs = index[i:j, 0]
                        starts = before + np.cumsum(n) - n
                        yield pa.RecordBatch.from_arrays([pa.array(docs, mask=docs == NULL_ID), pa.array(starts), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        before += int(n.sum())
                        i = j

    return run


def read_records(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all records before), n_tokens and ids_crc32 of each record."""
    order = Window.orderBy(F.asc_nulls_first("first_doc"), "data").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = manifest.select("data", "width", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("before"))
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(parts).mapInArrow(_reader(), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_record_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    folder = shared_folder(spark)
    folder = folder if "://" in folder else folder.replace("file:", "", 1)
    return read_records(write_records(documents(spark, sf_dir), folder, tokenizer or tokenizer_path("byte_bpe_50k.json"), 2))
