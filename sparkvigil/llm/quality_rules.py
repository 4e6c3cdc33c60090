"""Quality rules with risk-controlled thresholds.

Each text gets word and line measures. Rules compare one measure with a cutoff.
The cutoffs are chosen on the labelled documents alone, which are dealt into two
halves by a hash of doc_id. The strata are languages, a null language being one
of its own.

The first half learns what each rule is good for in a stratum: of its cutoffs,
from the loosest to the strictest, the one with the most bad rejections less a
price for each good one, so that a stricter cutoff must catch bad documents with
`least_precision` at least; a rule that gains nothing stays off. That gives a path
of cutoff vectors, from no rejection to all these targets in equal steps.

The second half, which the path does not depend on, walks it: at each step the
exact binomial (Clopper-Pearson) upper bound of the share of good documents that
*any* rule rejects must stay under `max_false_rejection`. The walk ends at its
first failure (fixed-sequence testing, so no correction is due inside it), and
the strata share the error `delta` by Bonferroni. With probability 1 - delta no
stratum loses a higher share of its good documents than stated, by all its rules
together.

Defined results: null or empty text has no words and fails the base rule; null
labels are no labels; a doc_id labelled twice counts with its lowest quality;
strata beyond the `max_strata` with most labels are pooled as one; further
columns of either table are ignored; an empty table gives no rows. Without
labels no cutoff is certified and only the base rule decides.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import WS, Words, add_per_row, mapper, mix, shingles, slices, span_hash, trimmed
from .store import documents, written

POOL, UNKNOWN = "\0", "\1"  # the strata beyond `max_strata`, and the null language; no language has these names
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

_FEATURES = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_distinct")] + [("stratum", pa.string())])

#: Measures in thousandths, all of them high for junk.
RULES = {
    "symbols": "1000 * n_symbols / greatest(n_words, 1)",
    "dup_lines": "1000 * n_dup_lines / greatest(n_lines, 1)",
    "repeat_words": "1000 * n_repeat_words / greatest(n_words, 1)",
    "upper": "1000 * n_upper / greatest(n_letters, 1)",
    "few_kinds": "1000 - 1000 * n_distinct / greatest(n_words, 1)",
    "long_words": "50 * word_chars / greatest(n_words, 1)",
}
#: Cutoffs tried, from the loosest to the strictest.
GRID = tuple(range(1000, 15, -15))
#: Steps of a path of cutoff vectors.
STEPS = len(GRID)


def text_measures(data: np.ndarray, off: np.ndarray, window: int = 8) -> dict[str, np.ndarray]:
    """Counts for each text of a buffer; see the module's text."""
    n = len(off) - 1
    w = Words(data, off, lower=False)
    starts_code_point = (data & 0xC0) != 0x80
    upper = (data >= 65) & (data <= 90)
    lower = (data >= 97) & (data <= 122)
    row = np.repeat(np.arange(n), np.diff(w.first))
    # words in windows that the text has twice or more
    sh, at = shingles(w.hash, w.first, window)
    ok = at + window <= w.first[1:][row[at]] if len(at) else np.zeros(0, bool)
    sh, at = sh[ok], at[ok]
    key = mix(sh + row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    repeated = at[order[same[:-1] | same[1:]]]
    cover = np.zeros(len(w) + window + 1, np.int64)
    np.add.at(cover, repeated, 1)
    np.add.at(cover, repeated + window, -1)
    covered = np.cumsum(cover)[: len(w)] > 0
    # lines
    newline = data == 10
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    ends = np.flatnonzero(newline)
    line_start = np.unique(np.concatenate([off[:-1][off[1:] > off[:-1]], ends + 1]))
    line_start = line_start[line_start < len(data)]
    nxt = np.append(line_start[1:], len(data))
    stop = np.minimum(nxt, off[np.searchsorted(off, line_start, "right")]) if len(line_start) else nxt
    last = stop - 1
    stop = np.where((last >= line_start) & newline[np.maximum(last, 0)], last, stop) if len(line_start) else stop
    words_before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~WS[data], out=words_before[1:])
    has = words_before[stop] > words_before[line_start] if len(line_start) else np.zeros(0, bool)
    line_start, stop = line_start[has], stop[has]
    line_row = np.searchsorted(off, line_start, "right") - 1
    lh = mix(span_hash(w.sums, line_start, stop) + line_row.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(lh, kind="stable")
    dup = np.zeros(len(lh), bool)
    dup[order[1:]] = lh[order[1:]] == lh[order[:-1]]
    wk = mix(w.hash + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(wk, kind="stable")
    new = np.ones(len(wk), bool)
    new[order[1:]] = wk[order[1:]] != wk[order[:-1]]
    return {
        "n_words": np.diff(w.first),
        "word_chars": add_per_row((starts_code_point & ~WS[data]).astype(np.int64), off),
        "n_symbols": add_per_row(SYMBOLS[data].astype(np.int64), off),
        "n_dup_lines": np.bincount(line_row[dup], minlength=n),
        "n_repeat_words": add_per_row(covered.astype(np.int64), w.first),
        "n_lines": np.bincount(line_row, minlength=n),
        "n_upper": add_per_row(upper.astype(np.int64), off),
        "n_letters": add_per_row((upper | lower).astype(np.int64), off),
        "n_distinct": np.bincount(row[new], minlength=n),
    }


def _measure(batch: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> dict:
    return {"doc_id": batch.column(0), "stratum": batch.column(2)} | text_measures(data, off)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and the measures of each document."""
    return docs.select("doc_id", F.col("text"), F.coalesce("lang", F.lit(UNKNOWN)).alias("stratum")).mapInArrow(mapper(_measure, _FEATURES), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long, n_distinct long, stratum string")


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction on the side where that converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 100_000):
        for part in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + part * d or 1e-300)
            c = 1 + part / c or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def binomial_upper(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the p at which at most k of n has probability delta."""
    if k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        # P(X <= k) = I(1 - p; n - k, k + 1)
        if mid <= 0 or beta_cdf(n - k, k + 1, 1 - mid) > delta:
            lo = mid
        else:
            hi = mid
    return hi


def targets(counts: dict[tuple[str, str], list[tuple[int, int, int]]], max_false_rejection: float, least_precision: float) -> dict[tuple[str, str], int]:
    """Place in GRID of the cutoff that each (stratum, rule) aims at; counts: (measure, good, bad) with each value once."""
    out, price = {}, least_precision / (1 - least_precision)
    for at, rows in counts.items():
        good, best = sum(g for _, g, _ in rows), (0.0, None)
        for i, cut in enumerate(GRID):
            k = sum(g for v, g, _ in rows if v > cut)
            if k > max_false_rejection * good:
                break
            bad = sum(b for v, _, b in rows if v > cut)
            if bad - price * k > best[0]:
                best = (bad - price * k, i)
        if best[1] is not None:
            out[at] = best[1]
    return out


def on_path(target: int, step: int) -> int:
    """The place in GRID of a rule at a step of the path from 0 to STEPS."""
    return target * step // STEPS


def certified(rejected: dict[str, dict[int, int]], max_false_rejection: float, delta: float) -> dict[str, int]:
    """The last step of each stratum's path that holds; rejected: good documents of a stratum by the step that first rejects them."""
    out = {}
    for stratum, first in rejected.items():
        good, k = sum(first.values()), 0
        for step in range(STEPS + 1):
            k += first.get(step, 0)
            if not good or binomial_upper(k, good, delta / len(rejected)) > max_false_rejection:
                break
            out[stratum] = step
    return out


def thresholds(found: DataFrame, labels: DataFrame, max_false_rejection: float = 0.02, delta: float = 0.05, max_strata: int = 256, least_precision: float = 0.95) -> tuple[dict, set[str]]:
    """Cutoffs from the labelled rows of `found`, and the strata that have their own.

    What reaches the driver is one row for each stratum, rule and step of the
    grid: at most (max_strata + 1) * len(RULES) * (len(GRID) + 1) rows.
    """
    lab = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = found.join(lab, "doc_id").where("n_words >= 20 and 100 * n_repeat_words <= 30 * n_words").withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)))
    own = [r[0] for r in rows.groupBy("stratum").count().orderBy(F.desc("count"), "stratum").limit(max_strata).collect()]
    if not own:
        return {}, set()
    step = lambda e: F.expr(f"least(1001, {GRID[-1]} + 15 * cast(ceil(greatest({e} - {GRID[-1]}, 0) / 15.0) as int))")
    rows = rows.withColumn("stratum", F.when(F.col("stratum").isin(own), F.col("stratum")).otherwise(POOL)).select("stratum", "quality", "half", *[step(e).alias(r) for r, e in RULES.items()])
    tall = rows.where("half = 0").select("stratum", "quality", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("v")) for r in RULES])).alias("x"))
    counts: dict = {}
    for s, r, v, g, b in tall.groupBy("stratum", "x.rule", "x.v").agg(F.sum(F.col("quality")), F.sum(1 - F.col("quality"))).collect():
        counts.setdefault((s, r), []).append((v, int(g), int(b)))
    aims = targets(counts, max_false_rejection, least_precision)
    if not aims:
        return {}, set(own)
    never, first = F.lit(STEPS + 1), []
    for rule in RULES:
        if mine := {s: i for (s, r), i in aims.items() if r == rule}:
            aim = F.create_map(*[F.lit(x) for s, i in sorted(mine.items()) for x in (s, i)])[F.col("stratum")]
            place = F.greatest(F.floor((GRID[0] - F.col(rule)) / 15) + 1, F.lit(0)).cast("int")  # the first place in GRID that the measure exceeds
            first.append(F.when(aim.isNull() | (place > aim), never).when(place == 0, 0).otherwise(F.ceil(place * STEPS / aim).cast("int")))
    rejected: dict = {s: {} for s, _ in aims}
    for s, at, g in rows.where("half = 1 and quality = 1").groupBy("stratum", F.least(*first, never).alias("first")).count().collect():
        if s in rejected:
            rejected[s][at] = g
    held = certified(rejected, max_false_rejection, delta)
    return {(s, r): GRID[on_path(i, held[s])] for (s, r), i in aims.items() if s in held}, set(own)


def judged(found: DataFrame, cutoffs: dict, own: set[str]) -> DataFrame:
    """Adds base_failed and kept; the cutoffs are a bounded literal expression."""
    base = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    bad = F.lit(False)
    at = F.when(F.col("stratum").isin(sorted(own)), F.col("stratum")).otherwise(POOL) if own else F.lit(POOL)
    for rule, e in RULES.items():
        mine = {s: c for (s, r), c in cutoffs.items() if r == rule}
        if mine:
            table = F.create_map(*[F.lit(x) for s, c in sorted(mine.items()) for x in (s, c)])
            bad = bad | F.coalesce(F.expr(e) > table[at], F.lit(False))
    return found.withColumn("base_failed", base).withColumn("kept", ~base & ~bad)


def quality_rules(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """Measures, base_failed and kept of each document."""
    found = written(measures(docs), "measures")
    return judged(found, *thresholds(found, labels, **limits))


def _passing(cutoffs: dict, own: set[str]):
    def run(batches):
        for batch, data, off in trimmed(slices(batches)):
            m = text_measures(data, off)
            n = np.maximum(m["n_words"], 1)
            value = {
                "symbols": 1000 * m["n_symbols"] / n, "dup_lines": 1000 * m["n_dup_lines"] / np.maximum(m["n_lines"], 1), "repeat_words": 1000 * m["n_repeat_words"] / n,
                "upper": 1000 * m["n_upper"] / np.maximum(m["n_letters"], 1), "few_kinds": 1000 - 1000 * m["n_distinct"] / n, "long_words": 50 * m["word_chars"] / n,
            }
            keep = (m["n_words"] >= 20) & (100 * m["n_repeat_words"] <= 30 * m["n_words"])
            langs = [(x if x in own else POOL) for x in ((UNKNOWN if v is None else v) for v in batch.column(batch.schema.get_field_index("lang")).to_pylist())]
            for rule, v in value.items():
                keep &= v <= np.array([cutoffs.get((s, rule), np.inf) for s in langs])
            yield batch.filter(pa.array(keep))

    return run


def passing(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """The documents, all columns, that neither the base rule nor a certified cutoff rejects."""
    found = written(measures(docs), "measures")
    return docs.mapInArrow(_passing(*thresholds(found, labels, **limits)), docs.schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = quality_rules(documents(spark, sf_dir), labels)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
