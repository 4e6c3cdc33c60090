"""Each operator against a brute-force version, and over the odd cases its docstring defines."""

import hashlib
import html
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvigil.llm import decontaminate, language_id, main_text, near_dedup, pieces, pitman_yor, quality_rules, record_files, suffix_dedup, warc_revisits
from sparkvigil.llm.components import components
from sparkvigil.llm.crc32c import crc32c, masked
from sparkvigil.llm.induced_sort import repeats, suffix_array, suffixes
from sparkvigil.llm.kernels import Words
from sparkvigil.llm.store import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "the quick brown fox jumps over the lazy dog and runs far away from here today " * 2500
#: nulls, empty and blank texts, a very long one, copies, ties of doc_id, and columns whose names the operators use inside.
ODD = [
    (1, None, "en"), (2, "", "en"), (3, "  \t\n ", None), (4, LONG, "en"), (5, LONG, "en"), (6, "one two", "fr"), (7, "One  TWO", None), (8, "a b c d e", "en"), (8, "a b c d e", "en"),
    (9, "été à Genève\n\nété à Genève\n", "fr"), (10, "x", None), (None, "no id here at all, but with words", "en"), (11, "日本語のテキスト です 123", "ja"), (12, "\x00odd     bytes 🙂", "en"), (13, "### *** $$$", "en"),
]
SCHEMA = "doc_id long, text string, lang string, n long, path string, size int, first long, label string, held_out boolean, source string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, x, 7, "p", 3, 9, "l", False, "s") for d, t, x in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return {r.doc_id: r.text for r in documents(spark, sf_dir).collect()}


# quality rules


def quality_brute(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_quality_measures(spark, odd, none, real, sf_dir):
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in quality_rules.measures(documents(spark, sf_dir)).collect():
        assert tuple(r[c] for c in cols) == quality_brute(real[r.doc_id])
    got = sorted((r.doc_id or 0, *(r[c] for c in cols)) for r in quality_rules.measures(odd).collect())
    assert got == sorted((d or 0, *quality_brute(t)) for d, t, _ in ODD)
    assert quality_rules.measures(none).count() == 0


def test_binomial_bound():
    for k, n, delta in ((0, 50, 0.01), (3, 200, 0.001), (40, 300, 0.05)):
        p = quality_rules.binomial_upper(k, n, delta)
        assert abs(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) - delta) < 1e-6
    for k, n, delta in ((900, 3000, 0.001), (20_000, 1_000_000, 1e-4)):  # all terms, none left out
        p = quality_rules.binomial_upper(k, n, delta)
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
        assert abs(math.fsum(map(math.exp, logs)) / delta - 1) < 1e-6
    assert quality_rules.binomial_upper(5, 5, 0.1) == 1.0


def test_cutoffs_are_certified(spark):
    rng = random.Random(3)
    good = ["".join(rng.choice("abcdefgh") + ("\n" if i % 9 == 8 else " ") for i in range(60)) for _ in range(800)]
    bad = ["# $ % & " * 3 + x for x in good[:200]]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good + bad)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 800)) for i in range(1000)] + [(None, 1), (5000, None)], "doc_id long, quality int")
    out = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs, labels).collect()}
    assert sum(not out[i] for i in range(800)) <= 16 and not any(out[i] for i in range(800, 1000))
    assert {r.doc_id for r in quality_rules.passing(docs, labels).collect()} == {i for i, k in out.items() if k}


def test_all_rules_together_keep_the_promise(spark):
    """Six rules, each with a tail of good texts of its own: together they may lose 2 %, not each."""
    rng = np.random.default_rng(8)
    n = 30_000
    bad = rng.random(n) < 0.3
    junk = {c: np.where(rng.random(n) < np.where(bad, 0.3, 0.015), rng.integers(300, 900, n), rng.integers(0, 200, n)) for c in ("n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_distinct", "word_chars")}
    rows = [(i, 1000, 20 * int(junk["word_chars"][i]), int(junk["n_symbols"][i]), int(junk["n_dup_lines"][i]), min(290, int(junk["n_repeat_words"][i])), 1000, int(junk["n_upper"][i]), 1000, 1000 - int(junk["n_distinct"][i]), "\1" if i % 2 else "") for i in range(n)]
    found = spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long, n_distinct long, stratum string")
    labels = spark.createDataFrame([(i, int(not b)) for i, b in enumerate(bad.tolist())], "doc_id long, quality int")
    cutoffs, own = quality_rules.thresholds(found, labels, least_precision=0.5)
    assert own == {"", "\1"}  # the null language is a stratum of its own
    kept = {r.doc_id for r in quality_rules.judged(found, cutoffs, own).where("kept").collect()}
    for half in (0, 1):
        good = [i for i in range(half, n, 2) if not bad[i]]
        assert sum(i not in kept for i in good) <= 0.02 * len(good)
    assert cutoffs and sum(i not in kept for i in range(n) if bad[i]) > 200
    # the same from plain loops over the rows
    rules = {"symbols": "n_symbols", "dup_lines": "n_dup_lines", "upper": "n_upper", "few_kinds": "n_distinct", "long_words": "word_chars"}
    caught = {i for i in range(n) if any(junk[rules[r]][i] > c for (s, r), c in cutoffs.items() if r in rules and s == ("\1" if i % 2 else "")) or min(290, junk["n_repeat_words"][i]) > cutoffs.get(("\1" if i % 2 else "", "repeat_words"), 9999)}
    assert kept == set(range(n)) - caught


def test_quality_without_labels(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.quality_rules(none, labels).count() == 0
    out = quality_rules.quality_rules(odd, labels).collect()
    assert len(out) == len(ODD) and all(r.kept == (not r.base_failed) for r in out)


# near-duplicates


def sets_brute(rows):
    out = {}
    for d, t in rows:
        w = WORD.findall(lower(t))
        s = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        out.setdefault(d, []).append(s)
    return out


def components_brute(rows, percent):
    sets = sets_brute(rows)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        for x, y in itertools.product(sets[a], sets[b]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {d: find(d) for d in sets}


def test_near_duplicates(spark, real, sf_dir):
    want = components_brute(real.items(), 85)
    got = {r.doc_id: (r.component_id, r.kept) for r in near_dedup.op9_near_dedup(spark, sf_dir).collect()}
    assert got == {d: (c, c == d) for d, c in want.items()}


def test_near_duplicates_large_family(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for i in range(400):  # edits of one text, near and not so near, in nodes that must be branched again
        w = list(base)
        for _ in range(rng.choice((1, 2, 4, 7))):
            w[rng.randrange(120)] = f"x{i}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = components_brute(enumerate(texts), 85)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, block=90, node_limit=150, tile=64).collect()}
    assert got == want


def test_near_duplicates_odd(odd, none):
    out = near_dedup.near_duplicates(odd).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(ODD) and by[1].n_shingles == by[3].n_shingles == 0 and by[1].kept and by[None].kept
    assert by[5].component_id == 4 and not by[5].kept and by[7].component_id == 6 and by[8].component_id == 8
    assert near_dedup.near_duplicates(none).count() == 0


def test_components(spark):
    rng = random.Random(0)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(60)] + [(None, 3)]
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    root = {x: x for link in links for x in link if None not in link}
    for _ in range(400):
        for u, v in links:
            if u is not None:
                root[u] = root[v] = min(root[u], root[v])
    ends = {x for u, v in links if u is not None and u != v for x in (u, v)}
    assert got == {x: root[x] for x in ends}


# suffix dedup


def removed_brute(rows, length):
    seen, out = set(), []
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_array():
    rng = np.random.default_rng(0)
    for _ in range(300):
        t = rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(0, 60))).astype(np.uint8)
        b, d = t.tobytes(), int(rng.choice([8, 10, 16]))
        order = suffix_array(t, d, limit=int(rng.choice([5, 1000]))).tolist()  # the small limit spills
        keys = [b[i : i + d] for i in order]
        assert sorted(order) == list(range(len(t))) and keys == sorted(keys)
        order, shared = suffixes(t, d, int(rng.choice([3, 1000])))
        ends = [b[i:] for i in order.tolist()]
        assert shared.tolist() == [0, *(min(d, len(os.path.commonprefix([x, y]))) for x, y in itertools.pairwise(ends))][: len(t)]
        order, group = repeats(t, d)
        seen = {}
        for i, g in zip(order.tolist(), group.tolist(), strict=True):
            if i + d <= len(b):
                assert seen.setdefault(b[i : i + d], g) == g
        assert len(set(seen.values())) == len(seen)


def test_suffix_dedup(spark, real, sf_dir):
    want = sorted(removed_brute(sorted(real.items()), 100))
    assert sorted(tuple(r) for r in suffix_dedup.op2_suffix_dedup(spark, sf_dir).collect()) == want


def test_suffix_dedup_against_sql(sf_dir, real):
    from sparkvigil.llm.sql import OP2_SQL

    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert sorted(c.sql(OP2_SQL).fetchall()) == sorted(removed_brute(sorted(real.items()), 100))


def test_suffix_dedup_odd(spark, odd, none):
    rows = [(d, t) for d, t, _ in ODD if d not in (None, 8)]
    out = suffix_dedup.remove_repeats(odd, keep_text=True)
    got = sorted(tuple(r)[:5] for r in out.where("doc_id <> 8").collect())
    assert got == sorted(removed_brute(sorted(rows, key=lambda r: r[0]), 100))
    assert out.count() == len(ODD) and suffix_dedup.remove_repeats(none).count() == 0
    twice = odd.sparkSession.createDataFrame([(1, LONG[:300]), (1, "z" * 5 + LONG[:300]), (1, LONG[:300]), (2, LONG[100:700])], "doc_id long, text string")
    got = sorted(tuple(r)[1:4] for r in suffix_dedup.remove_repeats(twice).collect())
    assert got == sorted(r[1:4] for r in removed_brute([(0, LONG[:300]), (1, LONG[:300]), (2, "z" * 5 + LONG[:300]), (3, LONG[100:700])], 100))
    big = odd.sparkSession.createDataFrame([(1 << 62, LONG[:300]), (1 << 62, LONG[:300])], "doc_id long, text string")
    once = removed_brute([(1, LONG[:300])], 100)[0][2]  # the text repeats itself
    assert sorted(r.n_removed for r in suffix_dedup.remove_repeats(big).collect()) == [once, 300]
    odd = odd.withColumns({c: F.lit(5) for c in ("found", "row_key", "Found_")})
    cut = suffix_dedup.without_repeats(odd)
    assert cut.columns == odd.columns and cut.where("doc_id = 5").first().text == ""


# main text


def test_common_lines():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
        found = [x for x, on in zip(a, main_text.common_lines(a, b), strict=True) if on]
        rest = iter(b)
        assert len(found) == d[-1][-1] and all(x in rest for x in found)


def test_main_text_of_articles(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in main_text.op3_html_main_text(spark, sf_dir).collect():
        art = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id].html, re.S)[1]
        lines = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", p))).strip() for p in re.split(r"</?(?:p|h1|br|article)>", art))
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


@pytest.mark.parametrize(
    "body, text",
    [
        ('<p>see <a href="/hidden-valley">the valley</a> now</p>', "see the valley now"), ('<div style="overflow: hidden"><p>body</p></div>', "body"), ('<p title="a hidden gem">text</p>', "text"), ('<p data-hidden="1">text</p>', "text"),
        ("<p>a</p><p hidden>b</p><div HIDDEN=''><p>c</p></div><p aria-hidden=true>d</p>", "a"), ('<article><p id="social">Social care</p><p class="related">Related</p></article>', "Social care\nRelated"),
        ('<article><p>own</p></article><div class="reader-comments"><article><p>rc</p></article></div>', "own"), ("<p data-x=don't>text</p>", "text"), ('<p title="a > b" class=\'x > y\'>text</p><p a="open>more</p>', "text\nmore"), ('<article><div class="share"><p>Share this</p></div><p>kept</p></article>', "kept"),
    ],
)
def test_main_text_of_attributes(spark, body, text):
    page = f"<html><body>{body}</body></html>"
    assert [r.text for r in main_text.extract_main_text(spark.createDataFrame([(1, "http://a.example/x", page)], "page_id long, url string, html string")).collect()] == [text]


def test_main_text_without_article_tags(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r.page_id: r.text for r in main_text.extract_main_text(pages).collect()}
    plain = pages.withColumn("html", F.regexp_replace("html", "(</?)article", "$1div"))
    got = {r.page_id: r.text for r in main_text.extract_main_text(plain).collect()}
    assert got.keys() == want.keys() and sum(got[k] == want[k] for k in want) >= 0.98 * len(want)


def test_main_text_by_difference(spark):
    top, end = "<body><div>Site name</div><div>Sections</div>", "<div>Contact us</div></body>"
    rows = [(i, f"http://h.example/a/{i}", f"{top}<p>Story {i} &amp; more</p><p>It was   long {i}</p>{end}") for i in range(40)]
    rows += [(100 + i, f"http://g.example/{i % 7}/{i}", f"<div>menu of {i % 3}</div><article><h1>t</h1><div>share</div><p>same for all</p><p>own {i}, a story that is longer than the lines around it</p></article>") for i in range(60)]
    rows += [(210, None, None), (211, "http://[", ""), (212, "http://x.example/", "<p>alone<script>1<2</script><form>f</form><div class='comment-list'>c</div>" + "<p>long text</p>" * 3000), (213, "http://z.example/", "<p>alone</p>"), (213, "http://z.example/", "<p>alone</p>")]
    rows += [(220, "http://y.example/", "<article><div class='entry-header'><h1>Title</h1></div><p>a</p><p>x <math>y=1</math> z</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"lines": F.lit(1), "key": F.lit(2), "range": F.lit("r")})
    got = []
    try:
        for parts in (1, 5):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got.append(sorted((r.page_id, r.text) for r in main_text.extract_main_text(df.coalesce(1)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got[0] == got[1] and len(got[0]) == len(rows)
    out = dict(got[0])
    assert out[210] == out[211] == "" and out[212].startswith("alone\nlong text") and out[213] == "alone" and out[220] == "Title\na\nx y=1 z"
    assert all(out[i] == f"Story {i} & more\nIt was long {i}" for i in range(40))
    assert all(out[100 + i] == f"t\nsame for all\nown {i}, a story that is longer than the lines around it" for i in range(60))
    # the whole operator again, page by page
    cut = [(i, *main_text.host_and_path(u), main_text.candidates(main_text.page_lines(h or "")), [x for x, _ in main_text.page_lines(h or "")]) for i, u, h in rows]
    cut = [x for _, x in sorted(((h, p, n), x) for n, x in enumerate(cut) for h, p in [x[1:3]])]
    for n, (i, host, path, lines, _) in enumerate(cut):
        near = [(x[2], x[4]) for x in cut[max(0, n - 2) : n] + cut[n + 1 : n + 3] if x[1] == host]
        gone = main_text.template_lines([x for x, _ in lines], [len(x) for x, _ in lines], path, near)
        assert out[i] == "\n".join(x for (x, d), g in zip(lines, gone, strict=True) if not (d and g))
    assert main_text.extract_main_text(df.limit(0)).count() == 0


# language identification


def test_viterbi_is_exact():
    rng = np.random.default_rng(0)

    class Fake(language_id.Model):
        def __init__(self, k, penalty):
            self.langs, self.penalty = list("abcd")[:k], penalty

    for _ in range(100):
        k, first = int(rng.integers(1, 4)), np.concatenate([[0], np.cumsum(rng.integers(0, 7, 5))])
        e, m = rng.normal(0, 1, (first[-1], k)), Fake(k, float(rng.choice([0.2, 0.7, 2])))
        label = m.labels(e, first)
        for a, z in zip(first, first[1:], strict=False):
            score = lambda p, x: sum(x[j, s] for j, s in enumerate(p)) - m.penalty * sum(p[j] != p[j - 1] for j in range(1, len(p)))  # noqa: B023, E731
            best = max(score(p, e[a:z]) for p in itertools.product(range(k), repeat=int(z - a)))
            assert abs(score(label[a:z], e[a:z]) - best) < 1e-9


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = language_id.op4_language_id(spark, sf).join(documents(spark, sf).select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.98 and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)


def test_language_odd(odd, none):
    folds = language_id.with_fold(odd, 4)
    model = language_id.train(folds)
    assert model.langs == ["en", "fr", "ja"]
    out = language_id.predict(folds, model).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(ODD) and by[1].lang_pred == by[2].lang_pred == by[13].lang_pred == "und" and by[11].lang_pred == "ja"
    empty = language_id.train(language_id.with_fold(none, 4))
    assert {r.lang_pred for r in language_id.predict(folds, empty).collect()} == {"und"}
    assert language_id.predict(language_id.with_fold(none, 4), model).count() == 0


def test_symbols_beyond_the_first_plane_are_no_letters(spark):
    rows = [(0, "the cat and the dog", "en"), (1, "le chat et le chien", "fr"), (3, "🙂🙃 😀", "fr"), (4, "🙂🙂🙂🙂🙂🙂 the dog", "en"), (5, "𝐭𝐡𝐞 𠀀", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", F.lit(False))
    by = {r.doc_id: r for r in language_id.predict(docs, language_id.train(docs.where("doc_id < 2"))).collect()}
    assert (by[3].lang_pred, by[3].score) == ("und", 0) and by[4].lang_pred == "en" and by[5].lang_pred != "und"
    for t in ("🙂", "a🙂", "𠀀", "é𝐭x", "\U0010ffff"):
        letter, _ = language_id.letters(np.frombuffer(t.encode(), np.uint8))
        assert letter.sum() == sum(c.isalpha() for c in t)


# benchmark decontamination


def test_decontamination(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(400)}"
    items = [[word() for _ in range(rng.randrange(16, 40))] for _ in range(30)] + [["five", "words", "of", "an", "item"], ["too", "short"]]
    docs, planted = [], set()
    for d in range(300):
        w = [word() for _ in range(rng.randrange(5, 150))]
        if d % 3 == 0:
            i = rng.randrange(31)
            p = list(items[i])
            if i < 30:
                for j in range(3, len(p), 9):
                    p[j] = "other"
            at = rng.randrange(len(w))
            w[at:at] = p
            planted.add((d, i))
        docs.append((d, " ".join(w).title() if d % 2 else "\n".join(w)))
    docs += [(None, None), (900, ""), (901, "too short")]
    a = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(70, None)], "item_id long, text string").withColumn("doc_id", F.lit(1))
    small = decontaminate.contaminated(a, b)
    assert {(r.doc_id, r.item_id) for r in small.collect()} == planted
    assert sorted(small.collect()) == sorted(decontaminate.contaminated(a, b, broadcast_words=0).collect())
    assert decontaminate.contaminated(a.limit(0), b).count() == 0 and decontaminate.contaminated(a, b.limit(0)).count() == 0


def test_both_ways_know_null_and_repeated_ids(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    docs = spark.createDataFrame([(None, f"x {text} y"), (None, text), (3, text), (3, "nothing here at all but words"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(None, text), (7, text), (7, f"{text} pi"), (8, None)], "item_id long, text string")
    ways = [decontaminate.contaminated(docs, items, broadcast_words=w).collect() for w in (400_000, 0)]
    assert sorted(map(str, ways[0])) == sorted(map(str, ways[1])) and len(ways[0]) == 9


@pytest.mark.parametrize("n", range(5, 22))
def test_decontamination_misses_no_pattern(n):
    import pyarrow as pa

    item = [f"i{j}" for j in range(n)]
    for before, after in (([], []), (["x"] * 3, ["y"] * 2)):
        if before and n < 13:
            continue  # a shorter passage of a longer item is no overlap
        items = decontaminate.Items([1], pa.array([" ".join(before + item + after)]), 5)
        texts = [" ".join("other" if j in off else w for j, w in enumerate(item)) for k in range(n // 5 + 1) for off in itertools.combinations(range(1, n - 1), k)]
        raw = [t.encode() for t in texts]
        w = Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        found = decontaminate.overlaps(w.hash, w.first, items, 0.8, 13)
        assert [(r, size) for r, _, _, size, _ in found] == [(r, n) for r in range(len(texts))]


# language model


def test_pitman_yor(spark, real, sf_dir):
    words = {d: [*WORD.findall(lower(t)), None] for d, t in real.items()}
    out_of = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in real}
    c = Counter(w for d, ws in words.items() if not out_of[d] for w in ws)
    n, v = sum(c.values()), len(c)
    rows = pitman_yor.op6_pitman_yor(spark, sf_dir).collect()
    assert len(rows) == len(real)
    for r in rows:
        ws = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out_of[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r.base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6 * len(ws)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_one_model_for_all_partitions(spark, sf_dir):
    docs = language_id.with_fold(documents(spark, sf_dir).select("doc_id", "text"), 7)
    got = []
    try:
        for parts, tokens in ((1, 1 << 21), (13, 5000)):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got.append({r.doc_id: r.score for r in pitman_yor.pitman_yor_scores(docs.repartition(parts), contexts=300, shard_tokens=tokens).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got[0].keys() == got[1].keys() and all(abs(got[0][d] - got[1][d]) < 1e-6 * (1 + abs(got[0][d])) for d in got[0])


def test_every_word_is_a_context(spark, sf_dir):
    """`contexts` says which totals go to all tasks, not which words have a restaurant; sweeps differ in nothing but random numbers."""
    docs = language_id.with_fold(documents(spark, sf_dir).select("doc_id", "text"), 7)
    few, all_ = ({r.doc_id: r.score for r in pitman_yor.pitman_yor_scores(docs, contexts=n, sweeps=12, burn_in=4, shard_tokens=5000).collect()} for n in (2, 65_535))
    assert few.keys() == all_.keys() and abs(sum(few.values()) / sum(all_.values()) - 1) < 0.002
    # after a word seen once, its follower is likely: "zq1 zq2" was in training, "zq1 zq3" was not
    rows = [(i, f"zq{i} zr{i} " + "a b c d " * 5, False) for i in range(300)] + [(1000, "zq5 zr5", True), (1001, "zq5 zr6", True)]
    got = {r.doc_id: r.score for r in pitman_yor.pitman_yor_scores(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean"), contexts=3).collect()}
    assert got[1000] > got[1001] + 1


def test_probabilities_add_up():
    rng = np.random.default_rng(4)
    n, restaurants = 50, 4
    count = rng.integers(0, 9, (restaurants - 1, n))
    tables = np.where(count > 0, rng.integers(1, np.maximum(count, 1) + 1), 0)
    guests = tables.sum(0) + rng.integers(0, 3, n)
    root = np.where(guests > 0, rng.integers(1, np.maximum(guests, 1) + 1), 0)
    t = pitman_yor.Totals(restaurants)
    at = np.repeat(np.arange(1, restaurants), n)
    t.add(pitman_yor.CUSTOMERS, at, count.ravel())
    t.add(pitman_yor.TABLES, at, tables.ravel())
    t.add(pitman_yor.ROOT, np.arange(6), np.array([guests.sum(), root.sum(), 5, 4, 3, 2]))
    m = pitman_yor.Model(dict(zip(*t.rows(), strict=True)), restaurants, n, (1.0, 2.0))
    up, unseen = m.parent(guests, root), m.parent(np.zeros(1), np.zeros(1))
    assert abs(up.sum() + unseen[0] - 1) < 1e-12
    for c in range(1, restaurants):
        context = np.full(n, c)
        total = m.predictive(context, count[c - 1], tables[c - 1], up).sum() + m.predictive(context[:1], np.zeros(1), np.zeros(1), unseen)[0]
        assert abs(total - 1) < 1e-12


def test_stirling_numbers_beyond_the_table(monkeypatch):
    monkeypatch.setattr(pitman_yor, "KNOWN", 200)
    for d in (0.3, 0.6, 0.85):
        exact = pitman_yor.log_stirling(600, d)[600]
        t = np.arange(6, 400)
        error = pitman_yor.log_seatings(np.full(len(t), 600), t, d) - exact[t]
        assert np.abs(np.diff(error)).max() < 0.03


def test_table_counts_have_their_distribution():
    rng = np.random.Generator(np.random.PCG64(1))
    theta, d, others, parent, c = 1.3, 0.6, 4, 0.2, 5
    got = np.bincount(pitman_yor.sample_tables(np.full(60_000, c), np.ones(60_000, np.int64), np.full(60_000, others), np.full(60_000, math.log(parent)), theta, d, rng.integers(0, 1 << 63, 60_000, dtype=np.uint64)), minlength=c + 1) / 60_000
    weight = Counter()

    def partitions(seated, sizes, w):  # all seatings of c customers at tables of one dish
        if seated == c:
            t = len(sizes)
            weight[t] += w * parent**t * math.prod(theta + d * (others + i) for i in range(t))
            return
        for k, s in enumerate(sizes):
            partitions(seated + 1, [*sizes[:k], s + 1, *sizes[k + 1 :]], w * (s - d))
        partitions(seated + 1, [*sizes, 1], w)

    partitions(1, [1], 1.0)
    want = [weight[t] / sum(weight.values()) for t in range(c + 1)]
    assert np.abs(got - want).max() < 0.01


def test_pitman_yor_odd(odd, none):
    rows = pitman_yor.pitman_yor_scores(language_id.with_fold(odd.select("doc_id", "text"), 7)).collect()
    assert len(rows) == len(ODD) and all(np.isfinite(r.score) and r.score < 0 for r in rows)
    assert pitman_yor.pitman_yor_scores(language_id.with_fold(none, 7)).count() == 0


# record files


def test_crc32c():
    assert crc32c(np.frombuffer(b"123456789", np.uint8), np.array([0, 9]))[0] == 0xE3069283
    data, off = np.random.default_rng(1).integers(0, 256, 1000).astype(np.uint8), np.array([0, 0, 3, 67, 131, 400, 1000])

    def slow(b):
        c = 0xFFFFFFFF
        for x in b:
            c ^= int(x)
            for _ in range(8):
                c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    assert [slow(data[a:z]) for a, z in zip(off, off[1:], strict=False)] == crc32c(data, off).tolist()
    assert masked(np.array([0], np.uint32))[0] == 0xA282EAD8


def test_record_files(spark, odd, none, real, sf_dir, tmp_path):
    from tokenizers import Tokenizer

    path = record_files.tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True

    def want(rows):
        at = 0
        for d, text in rows:
            ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
            yield d, at, len(ids), zlib.crc32(ids.tobytes())
            at += len(ids)

    assert sorted(tuple(r) for r in record_files.op7_record_files(spark, sf_dir).collect()) == list(want(sorted(real.items())))
    rows = sorted(((d, x) for d, x, _ in ODD), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    got = record_files.read_records(record_files.write_records(odd, str(tmp_path / "odd"), path, 2)).orderBy("start").collect()
    assert [tuple(r) for r in got] == list(want(rows))
    assert record_files.read_records(record_files.write_records(none, str(tmp_path / "none"), path, 2)).count() == 0


def test_added_token_in_a_text(spark, tmp_path):
    from tokenizers import Tokenizer

    path, end = record_files.tokenizer_path("byte_bpe_50k.json"), "<|endoftext|>"
    texts = [f"a {end} b", end, f" {end}", f"{end} ", f"a{end}b", f"x  {end}  y", f"{end}{end} {end}", f"one\n{end}\ntwo three", f"<|endof text|> {end[:-1]} b", f"<{end}> é{end}é {end}s the end"]
    t = Tokenizer.from_file(path)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = record_files.read_records(record_files.write_records(docs, str(tmp_path / "added"), path, 2)).orderBy("doc_id").collect()
    want = [np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4") for x in texts]
    assert [(r.n_tokens, r.ids_crc32) for r in got] == [(len(w), zlib.crc32(w.tobytes())) for w in want]
    assert want[0].tolist() == [64, 220, 50256, 275, 2]


def test_damaged_record():
    payload, off = np.arange(40, dtype=np.uint8), np.array([0, 8, 40])
    raw, at = record_files.frame(payload, off)
    assert record_files.unframe(raw, at[:-1])[0].tobytes() == payload.tobytes()
    for place in (2, 9, 15, len(raw) - 1):
        bad = bytearray(raw)
        bad[place] ^= 1
        with pytest.raises((ValueError, IndexError, MemoryError)):
            record_files.unframe(bytes(bad), at[:-1])


# SentencePiece


def test_n_best_is_exact():
    p, _ = pieces.pieces(pieces.model_path(), 3)
    words = [" the", " thntblere", "   x", " éàü", "\n\n", "abc日本", " a", " a▁b", " wheaan,", "🙂🙂x", " ", " heonthation", " aaaaaaaa"]
    for w in words:
        raw, ends = w.encode(), p.edges(w.encode())
        paths = {0: [0.0]}
        for z in range(1, len(raw) + 1):
            paths[z] = [x + s for a, s in ends[z] for x in paths[a]]
        best = sorted(paths[len(raw)], reverse=True)[:3]
        assert np.allclose([s for s, _ in p.search(raw)], best)
        together = np.frombuffer(p._together([raw])[0][:24], "<f8")
        assert np.allclose(together[np.isfinite(together)], best)


def test_long_pieces_together():
    p, _ = pieces.pieces(pieces.model_path(), 3)
    long = [w.decode() for w in p.pieces if 16 < len(w) <= pieces.SHORT]
    words = [w for x in long for w in (x, x + "а", x + "xy", " " + x.lstrip()) if len(w.encode()) <= pieces.SHORT] + [" Биография", " Становништво", " the", " Београд"]
    assert long
    for raw, v in zip([w.encode() for w in words], p._together([w.encode() for w in words]), strict=True):
        want = p.search(raw)
        if v is not None:
            assert v == p.value(raw, want) or np.allclose(np.frombuffer(v[:24], "<f8"), [s for s, _ in want] + [-np.inf] * (3 - len(want)))
    best = [np.frombuffer(v[:8], "<f8")[0] for v in p.values([" Биография", " Становништво"])]
    assert np.allclose(best, [p.search(w.encode())[0][0] for w in (" Биография", " Становништво")])


def test_n_best_of_texts():
    p, enc = pieces.pieces(pieces.model_path(), 3)
    text = " on the ham"
    raw = np.frombuffer(text.strip().encode(), np.uint8)
    _, _, scores, _ = pieces.n_best(p, enc, raw, np.array([0, len(raw)]))
    each = [[s for s, _ in p.search(w.encode())] for w in (" on", " the", " ham")]
    assert np.allclose(scores[0], sorted((sum(x) for x in itertools.product(*each)), reverse=True)[:3])


def test_alternatives_have_their_pieces(spark):
    model = pieces.model_path()
    p, _ = pieces.pieces(model, 3)
    texts = ["on the ham", "heonthation", "a", "", "aaaaaaaa thntblere the the", "日本語 éàü x", "heonthation" * 9]
    rows = pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, keep_ids=True).collect()
    for r in rows:
        text = texts[r.doc_id]
        all_ids = [r.ids, *r.alternative_ids]
        assert len({tuple(x) for x in all_ids}) == len(all_ids) == 1 + len(r.losses) == 1 + len(r.alternatives)
        for ids, score in zip(all_ids, [r.score, *(a.score for a in r.alternatives)], strict=True):
            assert pieces.decode(model, ids) == text
            spelled = [p.text_of[i] for i in ids]
            known = sum(p.pieces[x][1] for x in spelled if x in p.pieces)
            assert any(x not in p.pieces for x in spelled) or abs(known - score) < 1e-6 * (1 + abs(score))
        for ids, a, loss in zip(r.alternative_ids, r.alternatives, r.losses, strict=True):
            assert (a.n_pieces, a.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and abs(r.score - a.score - loss) < 1e-6
    assert len(rows) == len(texts) and sum(len(r.alternatives) for r in rows) > 6


def test_sentencepiece_round_trip(spark, odd, none, real, sf_dir):
    model = pieces.model_path()
    out = pieces.encode(documents(spark, sf_dir), model, keep_ids=True)
    assert {r.doc_id: r.text for r in pieces.decoded(out, model).collect()} == real and out.where("not round_trip").count() == 0
    rows = pieces.encode(odd, model, keep_ids=True)
    back = {(r.doc_id, r.text) for r in pieces.decoded(rows, model).collect()}
    assert back == {(d, t or "") for d, t, _ in ODD} and rows.count() == len(ODD)
    assert pieces.encode(none, model).count() == 0


# WARC revisits


def test_revisits_against_sql(spark, sf_dir):
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    df = warc_revisits.op1_warc_revisits(spark, sf_dir)
    want = Counter(c.sql(f"select {', '.join(df.columns)} from ({warc_revisits.OP1_SQL})").fetchall())
    assert Counter(tuple(r) for r in df.collect()) == want


def test_revisits_of_odd_times(spark):
    kind = "record_id long, url string, ts long, type string, headers map<string,string>"
    rows = [(i, "http://h/", i, "response" if i % 2 else "revisit", {"etag": '"x"'}) for i in range(1, 200)] + [(1000, "http://h/", 1 << 40, "revisit", {"etag": '"x"'})]
    rows += [(2000 + i, "http://h/", None, ("revisit", "response")[i % 2], None) for i in range(50)]
    out = {r.record_id: (r.target_id, r.verdict) for r in warc_revisits.resolve_revisits(spark.createDataFrame(rows, kind), slots=16).collect()}
    assert out[1000] == (199, "resolved") and all(out[i] == ((i - 1, "resolved") if i > 2 else (1, "resolved")) for i in range(2, 200, 2))
    assert all(out[2000 + i] == (None, "orphan") for i in range(0, 50, 2)) and len(out) == 99 + 1 + 25


def test_revisit_verdicts(spark):
    u = "HTTP://www.Example.com:80/a/?b=2&utm_source=x&a=1#f"
    rows = [
        (1, "https://example.com/a?a=1&b=2", 10, "response", {"ETag": '"x"', "Content-Length": "5", "Date": "d1"}),
        (2, u, 10, "revisit", {"etag": 'W/"x"', "Date": "d2", "Content-Length": "0"}),
        (3, u, 20, "response", {"etag": '"y"'}), (4, u, 30, "revisit", {"etag": '"x"'}), (5, u, 31, "revisit", None), (6, u, 5, "revisit", {"etag": '"x"'}),
        (7, None, 40, "revisit", {}), (8, None, 1, "response", {}), (9, u, None, "revisit", {}), (10, u, None, "response", {}), (11, u, 9, "request", {}),
        (12, "http://h/", 1, "response", {"Last-Modified": "m"}), (13, "http://h", 900000, "revisit", {"last-modified": "m"}), (13, "http://h", 900000, "revisit", {"last-modified": "m"}),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, type string, headers map<string,string>").withColumn("slot", F.lit(1)).withColumn("target", F.lit(2))
    for slots in (1, 7, 4096):
        out = warc_revisits.resolve_revisits(df, slots).collect()
        by = {r.record_id: r for r in out}
        assert len(out) == 8
        assert {k: (r.verdict, r.target_id) for k, r in by.items()} == {2: ("resolved", 1), 4: ("mismatch", 3), 5: ("unverified", 3), 6: ("orphan", None), 7: ("orphan", None), 9: ("orphan", None), 13: ("resolved", 12)}
        assert by[2].headers == {"etag": 'W/"x"', "content-length": "5", "date": "d2"} and by[4].headers is None and by[5].headers == {"etag": '"y"'}
    assert warc_revisits.resolve_revisits(df.limit(0)).count() == 0


def test_words_match_the_pattern():
    texts = ["a\x0bb\x0cc\rd", "", " x ", "é ü z", "\x1ca"]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    w = Words(np.frombuffer(b"".join(raw), np.uint8), off)
    assert np.diff(w.first).tolist() == [len(WORD.findall(t)) for t in texts]
