"""SentencePiece encoding and decoding with the N best segmentations.

The piece lattice of a text has a node at each character boundary and an edge
for each piece. No piece of these models has a word-start mark after another
character, so the lattice falls apart at the starts of words, and distinct words
are searched once. Forward Viterbi gives each node its best score from the
start; these are exact heuristics for an A-star search from the end, which
therefore meets complete segmentations in order of their scores. A slice's
distinct words go through both passes together, one agenda row for each word;
very long words, and words whose agenda overflows, go through the same search
one by one. The N best of a text combine those of its words: with N results at
most N - 1 words can differ from their best, those with the smallest losses.
Each of the N has its pieces, not its score alone.

Scores are the model's own; an unknown character is spelled by its bytes, with
the score of the worst piece less 10. A text gets one blank in front, as the
model's normalisation says; blanks are the word-start marks.

Defined results: null or empty text has no pieces, score 0 and no alternatives;
ties keep the order of discovery, which depends on the word alone; a text with
the mark character itself (U+2581) decodes to a blank there, so `round_trip` is
false; repeated rows stay; further columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .kernels import add_per_row, kept_in_worker, prefix_hash, rows_of, slices, span_hash, trimmed
from .segments import Encoder, gather
from .store import documents

MARK = "▁"
AGENDA, SHORT = 96, 28
_models: dict[tuple, tuple["Pieces", Encoder]] = kept_in_worker("pieces")


class Pieces:
    """Vocabulary of a SentencePiece model file, and its search."""

    def __init__(self, path: str, best: int):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.best = best
        self.byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.pieces = {sp.id_to_piece(i).replace(MARK, " ").encode(): (i, sp.get_score(i)) for i in plain}
        if any(b" " in p.lstrip(b" ") for p in self.pieces):
            raise ValueError("a piece has a word-start mark inside")
        self.longest = max(map(len, self.pieces))
        self.unknown = min((s for _, s in self.pieces.values() if s > -1e8), default=0.0) - 10
        self.text_of = {i: p for p, (i, _) in self.pieces.items()} | {i: bytes([b]) for b, i in self.byte_id.items()}
        raw = list(self.pieces)
        data = np.frombuffer(b"".join(raw), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(p) for p in raw])])
        h = span_hash(prefix_hash(data), off[:-1], off[1:])
        order = np.argsort(h)
        self.keys, self.ids = h[order], np.array([self.pieces[p][0] for p in raw])[order]
        self.scores = np.array([self.pieces[p][1] for p in raw])[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(h >> np.uint64(42)).astype(np.int64)] = True

    # one word
    def edges(self, word: bytes) -> list[list[tuple[int, float]]]:
        """For each end, the (start, score) of the edges into it."""
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        starts = [i for i in range(n) if word[i] & 0xC0 != 0x80] + [n]
        for a, nxt in zip(starts, starts[1:], strict=False):
            known = False
            for z in range(a + 1, min(n, a + self.longest) + 1):
                if (p := self.pieces.get(word[a:z])) is not None:
                    ends[z].append((a, p[1]))
                    known |= z == nxt
            if not known:
                ends[nxt].append((a, self.unknown))
        for e in ends:
            e.sort(reverse=True)
        return ends

    def search(self, word: bytes) -> list[tuple[float, list[int]]]:
        """The best segmentations, as (score, starts of the pieces)."""
        ends = self.edges(word)
        n = len(word)
        forward = [0.0] + [-np.inf] * n
        for z in range(1, n + 1):
            for a, s in ends[z]:
                forward[z] = max(forward[z], forward[a] + s)
        out, count = [], 0
        agenda = [(-forward[n], 0, n, 0.0, ())]
        while agenda and len(out) < self.best:
            _, _, at, g, path = heapq.heappop(agenda)
            if at == 0:
                out.append((g, list(path)))
                continue
            for a, s in ends[at]:
                count += 1
                heapq.heappush(agenda, (-(forward[a] + g + s), count, a, g + s, (a, *path)))
        return out

    def spelled(self, word: bytes, starts: list[int]) -> list[int]:
        out = []
        for a, z in zip(starts, [*starts[1:], len(word)], strict=True):
            p = self.pieces.get(word[a:z])
            out += [p[0]] if p is not None else [self.byte_id[b] for b in word[a:z]]
        return out

    def value(self, word: bytes, found: list[tuple[float, list[int]]]) -> bytes:
        """What is kept of a word: the N scores, whether it decodes to itself, the N numbers of ids, the ids of the N."""
        each = [self.spelled(word, starts) for _, starts in found]
        ids = each[0]
        scores = [s for s, _ in found] + [-np.inf] * (self.best - len(found))
        same = b"".join(self.text_of[i] for i in ids) == word.replace(MARK.encode(), b" ") and MARK.encode() not in word
        sizes = [len(x) for x in each] + [0] * (self.best - len(each))
        return np.array([*scores, same, *sizes], "<f8").tobytes() + np.array([i for x in each for i in x], "<u4").tobytes()

    # all words of a slice
    def values(self, words: list[str]) -> list[bytes]:
        raw = [w.encode() for w in words]
        out: list = [None] * len(raw)
        short = sorted((i for i, w in enumerate(raw) if len(w) <= SHORT), key=lambda i: len(raw[i]))
        for at in range(0, len(short), 4096):
            part = short[at : at + 4096]
            for i, v in zip(part, self._together([raw[i] for i in part]), strict=True):
                out[i] = v
        for i, w in enumerate(raw):
            if out[i] is None:
                out[i] = self.value(w, self.search(w))
        return out

    def _together(self, raw: list[bytes]) -> list:
        m = len(raw)
        size = np.array([len(w) for w in raw])
        width = int(size.max())
        longest = min(self.longest, width)
        off = np.concatenate([[0], np.cumsum(size)])
        data = np.frombuffer(b"".join(raw), np.uint8)
        sums = prefix_hash(data)
        row = rows_of(off)
        place = np.arange(len(data)) - off[row]
        start = (data & 0xC0) != 0x80
        # into[w, z, l]: score of the piece of l bytes that ends at z
        into = np.full((m, width + 1, longest + 1), -np.inf)
        piece = np.full((m, width + 1, longest + 1), -1, np.int32)
        agenda = min(AGENDA, 8 + 6 * width)
        known = np.zeros(len(data), bool)
        nxt = np.full(len(data), 0)
        boundary = np.append(start, True)
        for n in range(1, longest + 1):
            a = np.flatnonzero(start & (place + n <= size[row]))
            end = a + n
            ok = (place[a] + n == size[row[a]]) | boundary[end]
            a, end = a[ok], end[ok]
            if n <= 4:
                new = a[nxt[a] == 0]
                nxt[new] = n
            h = span_hash(sums, a, end)
            hit = self.maybe[(h >> np.uint64(42)).astype(np.int64)]
            a, h = a[hit], h[hit]
            k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            good = self.keys[k] == h
            a, k = a[good], k[good]
            into[row[a], place[a] + n, n] = self.scores[k]
            piece[row[a], place[a] + n, n] = self.ids[k]
            known[a[nxt[a] == n]] = True
        lone = np.flatnonzero(start & ~known)
        into[row[lone], place[lone] + nxt[lone], nxt[lone]] = self.unknown
        forward = np.full((m, width + 1), -np.inf)
        forward[:, 0] = 0
        for z in range(1, width + 1):
            n = min(z, longest)
            forward[:, z] = (forward[:, z - n : z][:, ::-1] + into[:, z, 1 : n + 1]).max(1)
        f = np.full((m, agenda), -np.inf)
        g = np.zeros((m, agenda))
        at = np.zeros((m, agenda), np.int8)
        parent = np.zeros((m, agenda), np.int16)
        f[:, 0], at[:, 0], parent[:, 0] = forward[np.arange(m), size], size, -1
        used = np.ones(m, np.int64)
        scores = np.full((m, 2 * self.best + 1), -np.inf)
        scores[:, self.best], scores[:, self.best + 1 :] = 1, 0
        count, found = np.zeros(m, np.int64), np.full((m, self.best), -1, np.int64)
        overflow = np.zeros(m, bool)
        live = np.arange(m)
        lengths = np.arange(1, longest + 1)
        while len(live):
            top = f[live].argmax(1)
            fine = np.isfinite(f[live, top])
            live, top = live[fine], top[fine]
            if not len(live):
                break
            f[live, top] = -np.inf
            node = at[live, top].astype(np.int64)
            w, h = live[node == 0], top[node == 0]
            found[w, count[w]] = h
            scores[w, count[w]] = g[w, h]
            count[w] += 1
            go = node > 0
            w, h, z = live[go], top[go], node[go]
            score = into[w, z][:, 1:]
            r, c = np.nonzero(np.isfinite(score))
            back = z[r] - lengths[c]
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            slot = used[w[r]] + rank
            keep = slot < agenda
            overflow[w[r[~keep]]] = True
            r, c, back, slot = r[keep], c[keep], back[keep], slot[keep]
            total = g[w[r], h[r]] + score[r, c]
            f[w[r], slot], g[w[r], slot], at[w[r], slot], parent[w[r], slot] = total + forward[w[r], back], total, back, h[r]
            np.add.at(used, w[r], 1)
            live = live[(count[live] < self.best) & ~overflow[live]]
        # the pieces of each result, by its chain of hypotheses from the start
        found[overflow] = -1
        of, kth = np.nonzero(found >= 0)
        w, h, chain, steps = of, found[of, kth], np.arange(len(of)), []
        while True:
            up = parent[w, h]
            on = up >= 0
            w, h, chain, up = w[on], h[on], chain[on], up[on].astype(np.int64)
            a, z = at[w, h].astype(np.int64), at[w, up].astype(np.int64)
            steps.append((chain, w, a, z, piece[w, z, z - a]))
            h = up
            if not len(w):
                break
        chain, w, a, z, k = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.argsort(chain, kind="stable")
        chain, w, a, z, k = chain[order], w[order], a[order], z[order], k[order]
        size = np.where(k >= 0, 1, z - a)
        to = np.concatenate([[0], np.cumsum(size)])
        ids = np.repeat(k, size)
        raw_at = np.repeat(off[w] + a - to[:-1], size) + np.arange(len(ids))
        spell = np.array([self.byte_id.get(b, 0) for b in range(256)], np.int32)
        ids = np.where(ids >= 0, ids, spell[data[np.minimum(raw_at, len(data) - 1)]]).astype("<u4").tobytes()
        ends = to[np.searchsorted(chain, np.arange(len(of) + 1))]
        scores[of, self.best + 1 + kth] = np.diff(ends)
        ends = 4 * ends[np.searchsorted(of, np.arange(m + 1))]
        mark = MARK.encode()
        if mark in data.tobytes():
            scores[[mark in x for x in raw], self.best] = 0
        head, step = scores.astype("<f8").tobytes(), 8 * scores.shape[1]
        return [None if o else head[i * step : (i + 1) * step] + ids[ends[i] : ends[i + 1]] for i, o in enumerate(overflow.tolist())]


def pieces(path: str, best: int) -> tuple[Pieces, Encoder]:
    """This process's vocabulary and its encoder of words."""
    if (path, best) not in _models:
        p = Pieces(path, best)
        _models[path, best] = p, Encoder(p.values, keep=400_000)
    return _models[path, best]


def with_blanks(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each non-empty text with one blank in front."""
    size = np.diff(off)
    to = np.concatenate([[0], np.cumsum(size + (size > 0))])
    out = np.full(to[-1], 0x20, np.uint8)
    out[np.arange(len(data)) + np.repeat(to[:-1] + 1 - off[:-1], size)] = data
    return out, to


def n_best(p: Pieces, encoder: Encoder, data: np.ndarray, off: np.ndarray):
    """(ids, id offsets, scores of the N best, round trip) of each text."""
    return n_best_pieces(p, encoder, data, off)[:4]


def n_best_pieces(p: Pieces, encoder: Encoder, data: np.ndarray, off: np.ndarray):
    """The same, and (ids, id offsets) of the results after the best, those of a text one after the other."""
    data, off = with_blanks(data, off)
    values, which, first = encoder.distinct(data, off)
    n, best = len(off) - 1, p.best
    head = (2 * best + 1) * 8
    top = np.frombuffer(b"".join([v[:head] for v in values]), "<f8").reshape(-1, 2 * best + 1)
    flat = np.frombuffer(b"".join([v[head:] for v in values]), np.uint32)
    at = np.concatenate([[0], np.cumsum(top[:, best + 1 :].ravel())]).astype(np.int64)  # result k of value v: v * best + k
    ids, to = gather(flat, at, which * best, first)
    base = add_per_row(top[which, 0], first)
    fine = add_per_row((top[which, best] == 0).astype(np.int64), first) == 0
    scores = np.full((n, best), -np.inf)
    scores[:, 0] = base
    chosen = np.zeros((best, len(which)), np.int8)  # result of each word in the k-th of its text
    if best > 1 and len(which):
        loss = (top[:, :1] - top[:, 1:best])[which]
        row = rows_of(first)
        order = np.lexsort((loss[:, 0], row))
        rank = np.arange(len(order)) - first[row[order]]
        near = order[(rank < best - 1) & np.isfinite(loss[order, 0])]
        by_row = np.searchsorted(row[near], np.arange(n + 1)).tolist()
        options = [[(x, r) for r, x in enumerate(xs, 1) if x < np.inf] for xs in loss[near].tolist()]
        near = near.tolist()
        for i in range(n):
            sums = [(0.0, ())]
            for q in range(by_row[i], by_row[i + 1]):
                j = near[q]
                sums = sorted([*sums, *((s + x, (*c, (j, r))) for s, c in sums for x, r in options[q])], key=_loss)[:best]
            for k, (s, c) in enumerate(sums[1:], 1):
                scores[i, k] = base[i] - s
                for j, r in c:
                    chosen[k, j] = r
    text, kth = np.nonzero(np.isfinite(scores[:, 1:]))
    size = np.diff(first)[text]
    begin = np.concatenate([[0], np.cumsum(size)])
    word = np.arange(begin[-1]) + np.repeat(first[text] - begin[:-1], size)
    return ids, to, scores, fine, gather(flat, at, which[word] * best + chosen[np.repeat(kth + 1, size), word], begin)


def _loss(x: tuple) -> float:
    return x[0]


_DDL = "doc_id long, n_pieces long, score double, losses array<double>, ids_crc32 long, round_trip boolean, alternatives array<struct<score: double, n_pieces: long, ids_crc32: long>>"


def _crc(ids: np.ndarray, to: np.ndarray) -> pa.Array:
    raw = ids.astype("<u4").tobytes()
    return pa.array([zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)], pa.int64())


def _encode(path: str, best: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, encoder = pieces(path, best)
        for batch, data, off in trimmed(slices(batches), "pieces"):
            ids, to, scores, fine, (more, ends) = n_best_pieces(p, encoder, data, off)
            losses = [[float(s[0] - x) for x in s[1:] if np.isfinite(x)] for s in scores]
            there = np.isfinite(scores[:, 1:])
            edge = pa.array(np.append(0, np.cumsum(there.sum(1))).astype(np.int32))
            each = pa.StructArray.from_arrays([pa.array(scores[:, 1:][there]), pa.array(np.diff(ends)), _crc(more, ends)], names=["score", "n_pieces", "ids_crc32"])
            cols = {"doc_id": batch.column(0), "n_pieces": pa.array(np.diff(to)), "score": pa.array(scores[:, 0]), "losses": pa.array(losses, pa.list_(pa.float64())), "ids_crc32": _crc(ids, to), "round_trip": pa.array(fine), "alternatives": pa.ListArray.from_arrays(edge, each)}
            if keep_ids:
                cols["ids"] = pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(ids.astype(np.int32)))
                cols["alternative_ids"] = pa.ListArray.from_arrays(edge, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(more.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def encode(docs: DataFrame, model: str, best: int = 3, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, score of the best, losses of the next ones, CRC-32 of the ids, round_trip, score, number of pieces and CRC-32 of the next ones and, if asked for, the ids of all."""
    return docs.select("doc_id", "text").mapInArrow(_encode(model, best, keep_ids), _DDL + (", ids array<int>, alternative_ids array<array<int>>" if keep_ids else ""))


def decode(model: str, ids: list[int]) -> str:
    """Text of ids: pieces joined, bytes read as UTF-8, the blank in front taken off."""
    p, _ = pieces(model, 1)
    return b"".join(p.text_of[i] for i in ids).decode("utf-8", "replace").removeprefix(" ")


def _decode(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode(model, x or []) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return run


def decoded(df: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids)."""
    return df.select("doc_id", "ids").mapInArrow(_decode(model), "doc_id long, text string")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), model_path())


__all__ = ["Pieces", "decode", "decoded", "encode", "model_path", "n_best", "n_best_pieces", "op10_sentencepiece", "pieces"]
