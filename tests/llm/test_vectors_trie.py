"""Exact searches over vectors and the prefix trie, against brute force and SQL."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from sparkvigil.llm import hard_negatives, prefix_trie, top_k, vectors
from sparkvigil.llm.slots import Slots

RNG = np.random.default_rng(5)


@pytest.mark.parametrize("module, name, sql, table", [(hard_negatives, "op11_hard_negatives", "OP11_SQL", "embeddings"), (top_k, "op12_exact_top_k", "OP12_SQL", "embeddings"), (prefix_trie, "op13_prefix_trie", "OP13_SQL", "conversations")])
def test_whole_query(spark, sf_dir, module, name, sql, table):
    df = getattr(module, name)(spark, sf_dir)
    c = duckdb.connect()
    c.sql(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    want = c.sql(getattr(module, sql))
    assert Counter(map(tuple, df.collect())) == Counter(tuple(r[want.columns.index(n)] for n in df.columns) for r in want.fetchall()) and df.count()


def odd_vectors():
    near = RNG.normal(size=(6, 8))
    rows = [(i, [float(np.float32(x)) for x in near[i % 6] + RNG.normal(size=8) * (0.001 if i % 3 else 0.5)], int(i % 3)) for i in range(220)]
    rows += [(300, None, 1), (350, [], 1), (400, [], 1), (401, [1.0, None] + [0.0] * 6, 1), (450, [math.nan] + [0.0] * 7, 1), (500, [math.inf] + [0.0] * 7, 1), (550, [0.0] * 8, 1), (600, [1.0, 2.0, 3.0], 1), (601, [1.0, 2.0, 2.5], 2)]
    rows += [(None, rows[0][1], 1), (None, None, None), (650, rows[3][1], None), (700, [1e18] * 8, 2), (701, [-1e18] * 8, 2), (50, rows[50][1], 2), (50, rows[50][1], 2), (-100, rows[7][1], -1)]
    rows += [(1000 + i, rows[1][1], 0) for i in range(60)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int, rank int, row long, score string, query long, id int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, x, 9, 9, "s", 9, 9) for i, v, x in rows], SCHEMA).repartition(parts)


def usable_brute(rows):
    f = np.float32
    return [(n, i, [math.floor(256 * float(f(x))) for x in v], c) for n, (i, v, c) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def dot(a, b):
    return max(-vectors.LAST, min(vectors.LAST, sum(x * y for x, y in zip(a, b, strict=True))))


def order(s, i):
    return (-s, i is None, i or 0)


def top_brute(rows, k=5):
    use, out = usable_brute(rows), Counter()
    for n, i, v, _ in use:
        if i is not None and i % 50 == 0:
            found = sorted(((dot(v, w), j) for m, j, w, _ in use if m != n and len(w) == len(v)), key=lambda x: order(*x))[:k]
            out.update((i, r + 1, j, s) for r, (s, j) in enumerate(found))
    return out


@pytest.mark.parametrize("numbers, parts", [(1 << 17, 1), (64, 5)])
def test_top_k_odd(spark, monkeypatch, numbers, parts):
    monkeypatch.setattr(vectors, "BLOCK_NUMBERS", numbers)
    monkeypatch.setattr(top_k, "DIRECTORY", 7)
    rows = odd_vectors()
    assert Counter(map(tuple, top_k.top_k(frame(spark, rows, parts)).collect())) == top_brute(rows)


def negatives_brute(rows):
    use = [(n, i, v, (c + 1 if c + 1 < 0 else (c + 1) % 10) if i is not None and i % 7 == 0 else c) for n, i, v, c in usable_brute(rows) if c is not None]
    out = Counter()
    for n, i, v, c in use:
        if i is None or i % 50:
            continue
        others = sorted(((dot(v, w), j, x) for m, j, w, x in use if m != n and len(w) == len(v)), key=lambda t: order(*t[:2]))
        for p, j, x in [t for t in others if t[2] == c][:5]:
            near = [t for t in others if t[2] != c and 50 * p <= 100 * t[0] <= 95 * p][:3]
            out.update((i, j, r + 1, m, p, s) for r, (s, m, _) in enumerate(near))
    return out


@pytest.mark.parametrize("numbers", [1 << 17, 64])
def test_hard_negatives_odd(spark, monkeypatch, numbers):
    monkeypatch.setattr(vectors, "BLOCK_NUMBERS", numbers)
    monkeypatch.setattr(hard_negatives, "DIRECTORY", 7)
    rows = odd_vectors()
    want = negatives_brute(rows)
    assert len(want) > 20 and Counter(map(tuple, hard_negatives.hard_negatives(frame(spark, rows)).collect())) == want


def test_no_vectors(spark):
    for rows in ([], [(50, None, 1)], [(51, [1.0], 1)], [(50, [1.0], 1)]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
        assert not top_k.top_k(df).collect() and not hard_negatives.hard_negatives(df).collect()


def test_bounds_hold_and_prune():
    x = np.floor(256 * np.concatenate([c + 0.05 * RNG.normal(size=(300, 16)) for c in RNG.normal(size=(12, 16))] + [np.zeros((1, 16))]))
    q = np.concatenate([x[::97], -x[:3]])
    refs = np.array([v / np.linalg.norm(v) for v in x[[5, 700, 1500, 2000]]])
    a, n, s = vectors.angles(x, refs), vectors.norms(x), vectors.scores(q, x)
    lo, hi = hard_negatives.bounds(q, vectors.angles(q, refs), a, a, n, n)
    assert (lo <= s).all() and (s <= hi).all()
    kth = np.sort(s, axis=1)[:, -5]
    assert (hi >= kth[:, None]).mean() < 0.5  # most rows are never scored
    tree, ids, none = top_k.Tree(x, 32), np.arange(len(x)), np.full(len(q), -1)
    i, got, _, made = top_k.search(tree, x, ids, ids, q, none, np.full(len(q), -np.inf), 5)
    assert [sorted(got[i == j]) for j in range(len(q))] == [sorted(np.sort(s[j])[-5:]) for j in range(len(q))]
    again = top_k.search(tree, x, ids, ids, q, none, kth.astype(float), 5)
    assert (again[1] == got).all() and again[3] <= made < s.size / 2


def test_slots():
    a, b = RNG.integers(0, 1 << 63, (2, 5000), dtype=np.uint64)
    t = Slots(a, b)
    assert sorted(t.find(a, b)) == list(range(5000)) and (t.find(b, a) == -1).all()
    assert not len(Slots(a[:0], b[:0]).find(a[:0], b[:0])) and Slots(a[:0], b[:0]).find(a[:2], b[:2]).tolist() == [-1, -1]


def trie_brute(rows):
    by = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            by.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x))
    by = {c: [t[3:] for t in sorted(v)] for c, v in by.items()}
    full = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = tuple(by.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:])
    ids, paths = {(None, None): 0}, {}
    for c, p in full.items():
        paths[c] = [0]
        for t in p:
            paths[c].append(ids.setdefault((paths[c][-1], t), len(ids)))
    members, up = {}, {i: (p, len(t[1]) if t else 0) for (p, t), i in ids.items()}
    for c, p in paths.items():
        for i in p:
            members.setdefault(i, []).append(c)
    if not full:
        return Counter()
    children = Counter(p for i, (p, _) in up.items() if p is not None)
    depth = {i: d for p in paths.values() for d, i in enumerate(p)}
    leaves, saved = Counter(), Counter()
    for i in sorted(members, key=lambda i: -depth[i]):
        leaves[i] += not children[i]
        saved[i] += (len(members[i]) - 1) * up[i][1]
        if up[i][0] is not None:
            leaves[up[i][0]] += leaves[i]
            saved[up[i][0]] += saved[i]
    ends = {i: ",".join(map(str, sorted(c for c in m if paths[c][-1] == i))) for i, m in members.items()}
    return Counter(
        (min(m), depth[i], None if up[i][0] is None else min(members[up[i][0]]), len(m), children[i], leaves[i], saved[i], hashlib.sha256(ends[i].encode()).hexdigest()) for i, m in members.items()
    )


def odd_conversations():
    r, rows = random.Random(3), []
    say = lambda: r.choice(["hi", "yes", "", None, "a longer reply", "été 🙂"])
    for c in [*range(0, 40), *range(100, 130), -7, -100, -101, 1234567890123, 205, 206, 299]:
        rows += [(c, t if t else r.choice([0, None]), r.choice(["user", "assistant", None]), say()) for t in range(r.choice([1, 1, 2, 3, 8]))]
    for c in (400, 401, 402, 477):
        rows += [(c, t, "user", f"turn {t % 7}") for t in range(90)]
    rows += [(500, 1, "user", "x")] * 25 + [(None, 1, "user", "lost")] * 3 + [(501, t, "user", "x") for t in range(30)] + [(502, None, None, "x" * 100_000)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("segment, ranges, shard", [(1024, 1 << 18, 1 << 17), (4, 40, 50)])
def test_trie_odd(spark, monkeypatch, segment, ranges, shard):
    for name, value in (("SEGMENT", segment), ("RANGE_ROWS", ranges), ("SHARD_ROWS", shard)):
        monkeypatch.setattr(prefix_trie, name, value)
    rows = odd_conversations()
    df = spark.createDataFrame([(c, t, r, x, 1, 2, 3, "h") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, conv long, depth long, row long, h string").repartition(5)
    assert Counter(map(tuple, prefix_trie.prefix_trie(df).collect())) == trie_brute(rows)


def test_trie_empty(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert not prefix_trie.prefix_trie(spark.createDataFrame([], schema)).collect()
    assert Counter(map(tuple, prefix_trie.prefix_trie(spark.createDataFrame([(1, 0, "user", "x")], schema)).collect())) == trie_brute([(1, 0, "user", "x")])
