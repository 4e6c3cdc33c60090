"""Scores of certification evidence: tiers, regimes, mean and consistency rules, the validity score of a card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .replay import null_parameters

#: Evidence tiers, the weakest first. Fixed values.
TIERS = ("T1", "T2", "T3")
#: Verdicts that a card may have. Fixed values.
VERDICTS = ("USE", "ADVISORY", "REFUSE", "NOT_EXECUTABLE", "EXPIRED")
#: What the verdicts of evidence files mean. Fixed values.
MEANINGS = {"CLEARED": "CLEARED", "not-refuted": "CLEARED", "REFUTED": "REFUTED", "FAIL": "REFUTED"}
#: Most that the mean of a terminal e-value may be. Fixed value.
MEAN_BOUND = 1.0
#: Mean increment that cannot be without a crossing. Fixed value.
IMPOSSIBLE_MEAN = 1e6


def registered(verdict: Column) -> Column:
    """The verdict; one that is not registered is an error."""
    return F.when(verdict.isin(*VERDICTS), verdict).otherwise(F.raise_error(F.concat(F.lit("unregistered verdict "), F.coalesce(verdict, F.lit("null")))).cast("string"))


def study_tier(study: Column, declared: Column | None = None) -> Column:
    """A declared tier, which must be registered; else T3 if the study's name has the word real, T2 if it has clustersynth, else T1."""
    name = F.coalesce(study, F.lit(""))
    by_name = F.when(name.rlike(r"(?i)(^|[-_.\s])real([-_.\s]|$)"), "T3").when(name.rlike("(?i)clustersynth"), "T2").otherwise("T1")
    if declared is None:
        return by_name
    return F.when(declared.isNull(), by_name).when(declared.isin(*TIERS), declared).otherwise(F.raise_error(F.concat(F.lit("unregistered tier "), declared)).cast("string"))


def least_tier(tier: Column) -> Column:
    """Aggregate: the weakest tier of a group, null if it has none."""
    return F.min(F.when(tier.isin(*TIERS), tier))


def effective_phi(phi: Column, null_id: Column) -> Column:
    """The recorded autocorrelation, else what the null's id says, else null."""
    return F.coalesce(phi, null_parameters(null_id)["phi"])


def phi_is_estimated(phi_source: Column, params: Column, null_id: Column) -> Column:
    """Whether a cell's autocorrelation was fitted on a finite window: by its recorded source, its parameters, or its null's id."""
    by_id = F.coalesce(null_parameters(null_id)["phi_source"] == "estimated", F.lit(False))
    return F.when(phi_source.isNotNull(), phi_source == "estimated").when(params == "estimated-phi", True).otherwise(by_id)


def regime(phi: Column, estimated: Column, m: Column, phi_max: Column, phi_known: Column, m_min: Column) -> Column:
    """STRUCT<status, reason>: `refused` if the regime bounds phi and it is not known, `out` beyond the regime, else `in`."""
    told = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason") if reason else F.lit(None).cast("string").alias("reason"))
    return (
        F.when(phi_max.isNotNull() & phi.isNull(), told("refused", "phi unmeasured")).when(F.coalesce(phi_known, F.lit(False)) & estimated, told("out", "estimated phi"))
        .when(phi > phi_max, told("out", "phi above the regime")).when(m < m_min, told("out", "m below the regime")).otherwise(told("in", None))
    )


def mean_refutes(cls: Column, mean: Column, lower: Column) -> Column:
    """Whether a terminal e-value's mean refutes it: the mean's recorded lower bound, or the mean itself, is above the bound. Nothing here clears."""
    above = lambda c: F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) & (c > MEAN_BOUND), F.lit(False))
    return (cls == "terminal_e_value") & (above(lower) | above(mean))


def inconsistent(cls: Column, increment_mean: Column, crossing_rate: Column) -> Column:
    """A test martingale whose mean increment is huge although it never crossed."""
    return F.coalesce((cls == "test_martingale") & (increment_mean > IMPOSSIBLE_MEAN) & (increment_mean < float("inf")) & (crossing_rate == 0), F.lit(False))


def validity(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outcome of each cell, and the status of each card.

    cells: card, run, cls, guard (see certify.guard), raw (the verdict of its
    class's own instrument), foreign (whether only another class's verdict is
    there), mean, lower, increment_mean, crossing_rate, regime (in, out or
    refused). A run with a void or an inconsistent cell is voided as a whole.
    outcome is CLEARED, REFUTED, excluded or missing, with the reason. A card is
    VOID if all its cells inside the regime are voided, REFUTED if one of them
    is, MISSING if none counts, else PASS.
    """
    bad = inconsistent(F.col("cls"), F.col("increment_mean"), F.col("crossing_rate"))
    run = Window.partitionBy("card", "run")
    c = cells.withColumn("voided", F.max((F.col("guard") == "VOID") | bad).over(run))
    meaning = F.coalesce(*[F.when(F.col("raw") == k, v) for k, v in MEANINGS.items()])
    mean = (meaning == "CLEARED") & mean_refutes(F.col("cls"), F.col("mean"), F.col("lower"))
    cases = [
        (F.col("voided"), "excluded", "run voided"), (F.col("guard") == "NON_FINITE", "excluded", "not finite"), (F.col("guard") == "VACUOUS", "missing", "wealth never moved"), (F.col("regime") == "refused", "missing", "phi unmeasured"),
        (F.col("raw").isNull() & (F.col("cls") != "test_martingale") & F.col("foreign"), "missing", "only a foreign verdict"), (meaning.isNull(), "missing", "unmapped verdict"), (mean, "REFUTED", "mean rule"),
    ]
    outcome, reason = (F.coalesce(*[F.when(case, value[i]) for case, *value in cases]) for i in (0, 1))
    c = c.withColumns({"outcome": F.coalesce(outcome, meaning), "reason": reason})
    inside = F.col("regime") == "in"
    n = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("int"))
    g = c.groupBy("card").agg(n(inside).alias("n_in"), n(inside & F.col("voided")).alias("n_void"), n(inside & (F.col("outcome") == "REFUTED")).alias("n_refuted"), n(inside & F.col("outcome").isin("CLEARED", "REFUTED")).alias("n_counted"))
    status = F.when((F.col("n_in") > 0) & (F.col("n_in") == F.col("n_void")), "VOID").when(F.col("n_refuted") > 0, "REFUTED").when(F.col("n_counted") == 0, "MISSING").otherwise("PASS")
    return c, g.withColumn("status", status)


def cells_of(cells: DataFrame, cards: DataFrame) -> DataFrame:
    """Cells of each card: those of its detector or of one of its aliases. cards: card, detector_id, aliases array."""
    names = cards.select("card", F.explode(F.array_distinct(F.concat(F.array("detector_id"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("detector"))
    return cells.join(names, "detector")


def untold_exclusions(cells: DataFrame) -> DataFrame:
    """How many cells of a detector were left out for a reason without having had a verdict."""
    return cells.where("outcome in ('excluded', 'missing') and raw is null").groupBy("detector", "reason").agg(F.count("*").alias("n"))


def expired(cards: DataFrame, files: DataFrame) -> DataFrame:
    """Cards whose pinned SHA-256 of a file is not that of the file any more, or whose file is gone. cards: card, path, sha256; files: path, content binary."""
    now = files.select("path", F.sha2("content", 256).alias("now"))
    j = cards.join(now, "path", "left")
    return j.where("now is null or now <> sha256").select("card", "path", F.when(F.col("now").isNull(), "file is gone").otherwise("file has changed").alias("reason"))
