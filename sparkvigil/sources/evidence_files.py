"""Evidence of validation studies, read from their result folders into one table of cells.

A folder <study>/results/live/<run>/ holds a manifest.json and cells in one of
these forms: summary.json or, without it, endpoints.json (an array of cells, or
an object with `cells`), with the cells of cells/*.json that the aggregate does not
have; or cells/*.json alone, one cell a file. Cells are objects of any fields, so
they are read as variants; one without `detector` but with fields sui_* and ui_* is
a wide cell and becomes one for each prefix.

Rows of a run that a later one corrects are left out by (study, run, detector): by
the array `supersedes` of a manifest, or by a study's SUPERSESSIONS.json, which has
the last word. A declaration that names a run or a detector that is not there, the
run itself, another study, or leaves a detector without a run is an error; the old
form {priorRun, defect} is told, not applied. A run without cells in any form, and a
cell without a detector, are told as skipped. JSON that cannot be read is an error.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.certify import INSTRUMENTS, guard
from ..operators.replay import null_parameters
from ..operators.scoring import cells_of, effective_phi, phi_is_estimated, regime, study_tier

#: Prefixes of wide cells, the detector each stands for, and the fields that are not only stripped. Fixed values.
WIDE = {"sui_": ("sequential_ui_e_process", {"sui_crossing": "crossing_rate"}), "ui_": ("universal_inference_e_value", {})}
#: What tells cells of a run apart. Fixed values.
IDENTITY = ("detector", "null_id", "control", "shift_sigma", "alpha")
_PATH = r"([^/]+)/results/live/(?:([^/]+)/(manifest|summary|endpoints|cells/[^/]+)|(SUPERSESSIONS))\.json$"


class Evidence(NamedTuple):
    """cells (study, run, git_sha, tier, detector, fields, null_id, phi, phi_source, params, phi_derived); runs; superseded cells by detector; declarations that were not applied; what was skipped."""

    cells: DataFrame
    runs: DataFrame
    superseded: DataFrame
    unhonoured: DataFrame
    skipped: DataFrame


def _text(v: Column, path: str) -> Column:
    """A string of a document; null where there is none or something else."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def files(spark: SparkSession, root: str) -> DataFrame:
    """study_dir, run_dir, kind (manifest, summary, endpoints, cells/<name>, or null for a registry), path and v."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(root)
    part = lambda i: F.nullif(F.regexp_extract("path", _PATH, i), F.lit(""))
    named = raw.select("path", part(1).alias("study_dir"), part(2).alias("run_dir"), part(3).alias("kind"), F.try_parse_json(F.decode("content", "UTF-8")).alias("v")).where("study_dir is not null")
    return named.withColumn("kind", F.when(F.col("v").isNull(), F.raise_error(F.concat(F.col("path"), F.lit(" is no JSON")))).otherwise(F.col("kind")))


def _manifests(f: DataFrame) -> DataFrame:
    """study_dir, run_dir, study, git_sha, tier, supersedes of every run that has files."""
    told = f.where("kind = 'manifest'").select("study_dir", "run_dir", _text(F.col("v"), "$.study").alias("_study"), _text(F.col("v"), "$.git_sha").alias("git_sha"), _text(F.col("v"), "$.tier").alias("_tier"), F.try_variant_get("v", "$.supersedes", "variant").alias("supersedes"))
    m = f.where("run_dir is not null").select("study_dir", "run_dir").distinct().join(told, ["study_dir", "run_dir"], "left").withColumn("study", F.coalesce("_study", "study_dir"))
    return m.withColumn("tier", study_tier(F.col("study"), F.col("_tier"))).drop("_study", "_tier")


def _identity(v: Column) -> Column:
    """What two cells share if they are the same; numbers by value, absent as null."""
    one = [F.coalesce(F.try_variant_get(v, f"$.{c}", "double").cast("string"), F.to_json(F.try_variant_get(v, f"$.{c}", "variant")), F.lit("null")) for c in IDENTITY]
    return F.to_json(F.array(*one))


def _cells(f: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(run's cells as variants, runs without any form of cells)."""
    key = ["study_dir", "run_dir"]
    whole = f.where("kind in ('summary', 'endpoints')").withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("kind")))).where("_n = 1").drop("_n")  # summary before endpoints
    inner = F.when(_is(F.col("v"), "ARRAY"), F.col("v")).otherwise(F.try_variant_get("v", "$.cells", "variant"))
    aggregate = whole.select(*key, F.explode(F.try_variant_get(inner, "$", "array<variant>")).alias("v"))
    single = f.where("kind like 'cells/%'")
    have = whole.select(*key)
    alone = single.join(have, key, "left_anti").select(*key, "v")
    entries = F.when(_is(F.col("v"), "ARRAY"), F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
    more = single.join(have, key, "left_semi").select(*key, "kind", F.posexplode(entries).alias("pos", "v")).where(F.try_variant_get("v", "$.detector", "variant").isNotNull()).withColumn("_id", _identity(F.col("v")))
    more = more.join(aggregate.select(*key, _identity(F.col("v")).alias("_id")).distinct(), [*key, "_id"], "left_anti")
    more = more.withColumn("_n", F.row_number().over(Window.partitionBy(*key, "_id").orderBy("kind", "pos"))).where("_n = 1")
    cells = aggregate.unionByName(alone).unionByName(more.select(*key, "v"))
    empty = f.where("run_dir is not null").select(*key).distinct().join(have.unionByName(single.select(*key)).distinct(), key, "left_anti")
    return cells, empty


def _told(cells: DataFrame) -> DataFrame:
    """Cells with detector and fields (a map of variants); a wide cell is one for each of its prefixes, an unknown one has a null detector."""
    m = F.try_variant_get("v", "$", "map<string,variant>")
    c = cells.withColumn("m", m)
    shared = lambda k, _: ~(k.startswith("sui_") | k.startswith("ui_"))
    parts = []
    for prefix, (detector, renames) in WIDE.items():
        own = F.map_filter("m", _starting(prefix))
        fields = F.transform_keys(own, _stripped(prefix, renames))
        parts.append(F.when(F.size(own) > 0, F.struct(F.lit(detector).alias("detector"), F.map_concat(F.map_filter("m", shared), fields).alias("fields"))))
    plain = F.struct(F.try_variant_get("v", "$.detector", "string").alias("detector"), F.col("m").alias("fields"))
    wide = F.array_compact(F.array(*parts))
    each = F.when(F.map_contains_key("m", "detector"), F.array(plain)).when(F.size(wide) > 0, wide).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("detector"), F.col("m").alias("fields"))))
    return c.select("study_dir", "run_dir", F.explode(each).alias("c")).select("study_dir", "run_dir", "c.detector", "c.fields")


def _starting(prefix: str):
    return lambda k, _: k.startswith(prefix)


def _stripped(prefix: str, renames: dict[str, str]):
    def new(k: Column, _: Column) -> Column:
        out = F.substring(k, len(prefix) + 1, 1 << 20)
        for old, name in renames.items():
            out = F.when(k == old, name).otherwise(out)
        return out

    return new


_ENTRY = "array<struct<study:string,run:string,detectors:array<string>,reason:string,declared_by:string>>"


def _declared(f: DataFrame, manifests: DataFrame, carried: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(drops: study, run, detector, superseded_by, reason, source; problems; old declarations)."""
    kind = F.schema_of_variant("supersedes")
    there = manifests.where(F.col("supersedes").isNotNull() & (kind != "VOID"))
    old = there.where(~_is(F.col("supersedes"), "ARRAY") & _text(F.col("supersedes"), "$.priorRun").isNotNull())
    unhonoured = old.select(F.concat_ws("/", "study", "run_dir").alias("declared_by"), "study", _text(F.col("supersedes"), "$.priorRun").alias("run"), F.coalesce(_text(F.col("supersedes"), "$.defect"), F.lit("(no defect stated)")).alias("defect"))
    odd = there.where(~_is(F.col("supersedes"), "ARRAY") & _text(F.col("supersedes"), "$.priorRun").isNull()).select(F.concat_ws("/", "study", "run_dir").alias("where"), F.lit("supersedes must be an array, {priorRun, defect} or null").alias("problem"))
    items = lambda v: F.posexplode(F.from_json(F.to_json(v), _ENTRY)).alias("pos", "e")
    by_run = there.where(_is(F.col("supersedes"), "ARRAY")).select(F.concat_ws("/", "study", "run_dir").alias("where"), F.lit("manifest").alias("source"), F.col("study_dir"), items(F.col("supersedes")))
    registry = f.where("run_dir is null")
    by_registry = registry.where(_is(F.col("v"), "ARRAY")).select(F.col("path").alias("where"), F.lit("registry").alias("source"), "study_dir", items(F.col("v")))
    odd = odd.unionByName(registry.where(~_is(F.col("v"), "ARRAY")).select(F.col("path").alias("where"), F.lit("a registry must be an array").alias("problem")))
    d = by_run.unionByName(by_registry).select("where", "source", "study_dir", "pos", "e.*")
    runs = manifests.select("study", F.col("run_dir").alias("run"), F.lit(True).alias("_seen")).distinct()
    studies = manifests.select("study_dir", "study", F.lit(True).alias("_own")).distinct()
    one = d.withColumn("detector", F.explode_outer("detectors")).join(runs, ["study", "run"], "left").join(studies, ["study_dir", "study"], "left").join(carried.withColumn("_carried", F.lit(True)), ["study", "run", "detector"], "left")
    gone = lambda c: F.col(c).isNull() | (F.col(c) == "")
    target = F.concat_ws("/", "study", "run")
    problem = (
        F.when(gone("study") | gone("run") | gone("reason") | F.col("detector").isNull(), "an entry needs study, run, detectors and reason").when((F.col("source") == "registry") & gone("declared_by"), "a registry's entry needs declared_by")
        .when((F.col("source") == "manifest") & (target == F.col("where")), "a run cannot supersede itself").when((F.col("source") == "registry") & F.col("_own").isNull(), F.concat(F.lit("names another study, "), "study"))
        .when(F.col("_seen").isNull(), F.concat(F.lit("names a run that is not there, "), target)).when(F.col("_carried").isNull(), F.concat(F.lit("names a detector that the run does not have, "), "detector"))
    )
    one = one.withColumn("problem", problem)
    bad = odd.unionByName(one.where("problem is not null").select("where", "problem"))
    fine = one.where("problem is null").withColumn("superseded_by", F.when(F.col("source") == "registry", F.col("declared_by")).otherwise(F.col("where")))
    last = Window.partitionBy("study", "run", "detector").orderBy(F.desc("source"), F.desc("where"), F.desc("pos"))  # a registry's word comes after a manifest's
    drops = fine.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("study", "run", "detector", "superseded_by", "reason", "source")
    # a registry must leave a run of the study that has cells of the detector
    left = carried.join(drops.select("study", "run", "detector"), ["study", "run", "detector"], "left_anti").select("study", "detector").distinct()
    bare = fine.where("source = 'registry'").join(left, ["study", "detector"], "left_anti").select("where", F.concat(F.lit("leaves no run with cells of "), "detector").alias("problem"))
    covered = drops.where("source = 'registry'").select("study", "run", F.lit(True).alias("covered_by_registry")).distinct()
    return drops, bad.unionByName(bare), unhonoured.join(covered, ["study", "run"], "left").fillna(False, ["covered_by_registry"])


def load(spark: SparkSession, root: str) -> Evidence:
    """All evidence under a folder of studies; the first wrong declaration is a ValueError."""
    f = files(spark, root)
    manifests = _manifests(f)
    raw, empty = _cells(f)
    ids = manifests.select("study_dir", "run_dir", "study", "git_sha", "tier")
    told = _told(raw).join(ids, ["study_dir", "run_dir"]).withColumnRenamed("run_dir", "run")
    known = told.where("detector is not null")
    carried = known.select("study", "run", "detector").distinct()
    drops, problems, unhonoured = _declared(f, manifests, carried)
    if wrong := problems.orderBy("where", "problem").limit(1).collect():
        raise ValueError(f"{wrong[0]['where']}: {wrong[0]['problem']}")
    key = ["study", "run", "detector"]
    null_id = F.try_variant_get(F.element_at("fields", F.lit("null_id")), "$", "string")
    cells = known.join(drops.select(*key), key, "left_anti").drop("study_dir").withColumn("null_id", null_id).withColumn("_p", null_parameters(F.col("null_id")))
    own = lambda c, t: F.try_variant_get(F.element_at("fields", F.lit(c)), "$", t)
    phi = own("phi", "double")
    cells = cells.withColumns({"phi": F.coalesce(phi, F.col("_p.phi")), "phi_derived": phi.isNull() & F.col("_p.phi").isNotNull(), "phi_source": F.coalesce(F.col("_p.phi_source"), own("phi_source", "string")), "params": F.coalesce(own("params", "string"), F.col("_p.params"))}).drop("_p")
    gone = known.join(drops, key).groupBy(*key, "superseded_by", "reason", "source").agg(F.count("*").alias("cells"))
    skipped = empty.join(ids, ["study_dir", "run_dir"]).select("study", F.col("run_dir").alias("run"), F.lit("no cells in a known form").alias("reason")).unionByName(told.where("detector is null").select("study", "run", F.lit("a cell without a detector").alias("reason")))
    runs = ids.join(empty, ["study_dir", "run_dir"], "left_anti").select("study", F.col("run_dir").alias("run"), "git_sha", "tier")
    return Evidence(cells, runs, gone, unhonoured, skipped)


def judged(cells: DataFrame, cards: DataFrame) -> DataFrame:
    """The cells of each card as operators.scoring.validity takes them. cards: card, detector_id, aliases, cls, phi_max, phi_known, m_min."""
    field = lambda path, t, c="fields": F.try_variant_get(F.element_at(c, F.lit(path.split(".")[0])), "$" + "".join(f".{p}" for p in path.split(".")[1:]), t)
    c = cells_of(cells, cards).join(cards.select("card", "cls", "phi_max", "phi_known", "m_min"), "card")
    names = [n for group in INSTRUMENTS.values() for n in group]
    present = F.array_intersect(F.map_keys("fields"), F.array(*map(F.lit, names)))
    checked = guard(F.col("cls"), present, F.coalesce(field("non_finite_wealth", "double"), F.lit(0.0)), field("increment_estimator.sd", "double"))
    where = regime(effective_phi(F.col("phi"), F.col("null_id")), phi_is_estimated(F.col("phi_source"), F.col("params"), F.col("null_id")), field("m", "double"), F.col("phi_max"), F.col("phi_known"), F.col("m_min"))
    raw = F.coalesce(field("verdict", "string"), F.when(F.col("cls") == "test_martingale", field("supermartingale_verdict", "string")))
    return c.select(
        "card", F.concat_ws("/", "study", "run").alias("run"), "study", "detector", "null_id", "tier", "cls", checked.alias("guard"), raw.alias("raw"), field("increment_verdict", "string").isNotNull().alias("foreign"), field("mean_e", "double").alias("mean"), field("mean_e_lower_95", "double").alias("lower"),
        field("increment_estimator.mean", "double").alias("increment_mean"), field("crossing_rate", "double").alias("crossing_rate"), where["status"].alias("regime"),
    )
