"""Topology documents of accelerators: chip meshes (TPU) and device lists (Neuron), one JSON document a row.

Input rows are (source, value). A document gives one row of `snapshots`, its
nodes and its undirected edges, each once whatever order or number they are told
in; links to oneself are dropped, and a peer that is not listed is a node too. A
document that is malformed has a problem, the code of the first rule it breaks;
`strict` makes the first problem an error instead. A null value is no JSON. Types
are those of the document: a number where a name is asked for is a problem.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Generations of chips that are known. Fixed values.
GENERATIONS = ("v4", "v5p", "v5e")
#: A slice with a dimension below this is a mesh without wrap-around links.
FULL_SIDE = 4


def _kind(v: Column, path: str) -> Column:
    """Type of a part of a document, in SQL's words; null where it is absent."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _text(v: Column, path: str) -> Column:
    return F.when(_kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def tpu_problem(v: Column) -> Column:
    """Code of the first rule that a parsed document breaks, or null."""
    version, side = _text(v, "$.tpu_version"), F.try_variant_get(v, "$.slice_shape", "array<double>")
    whole = _kind(v, "$.slice_shape").rlike(r"^ARRAY<(BIGINT|DOUBLE|DECIMAL\(.*\))>$") & (F.size(side) == 3) & F.forall(side, lambda x: F.coalesce((x >= 1) & (x == F.floor(x)), F.lit(False)))
    return (
        F.when(v.isNull(), "TPU_PARSE_INVALID_JSON").when(version.isNull() | (version == ""), "TPU_PARSE_MISSING_TPU_VERSION").when(~version.isin(*GENERATIONS), F.concat(F.lit("TPU_PARSE_UNKNOWN_TPU_VERSION: "), version))
        .when(~F.coalesce(whole, F.lit(False)), "TPU_PARSE_INVALID_SLICE_SHAPE").when(~F.coalesce(_kind(v, "$.chips").startswith("ARRAY"), F.lit(False)), "TPU_PARSE_MISSING_CHIPS")
        .when(_kind(v, "$.chips[0]").isNull(), "TPU_PARSE_NO_CHIPS")
    )


def neuron_problem(v: Column) -> Column:
    kind = _text(v, "$.instance_type")
    return (
        F.when(v.isNull(), "NEURON_PARSE_INVALID_JSON").when(kind.isNull(), "NEURON_PARSE_MISSING_INSTANCE_TYPE").when(~kind.rlike("^(trn|inf)"), F.concat(F.lit("NEURON_PARSE_UNKNOWN_INSTANCE_TYPE: "), kind))
        .when(~F.coalesce(_kind(v, "$.neuron_devices").startswith("ARRAY"), F.lit(False)), "NEURON_PARSE_MISSING_NEURON_DEVICES").when(_kind(v, "$.neuron_devices[0]").isNull(), "NEURON_PARSE_NO_DEVICES")
    )


def _checked(body: DataFrame, problem, strict: bool) -> DataFrame:
    d = body.select("source", F.try_parse_json("value").alias("v")).withColumn("problem", problem(F.col("v")))
    if strict:
        d = d.withColumn("problem", F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.col("problem"), F.lit(" in "), F.coalesce("source", F.lit("a document without a source"))))).otherwise(F.col("problem")))
    return d


def _graph(links: DataFrame, relationship: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of rows (source, a, b, kind): an element and one of its peers, or null."""
    ids = links.select("source", "kind", F.explode(F.array("a", F.when(F.col("a") != F.col("b"), F.col("b")))).alias("id")).where("id is not null").distinct()
    edges = links.where("a <> b").select("source", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
    return ids.select("source", "id", F.col("id").alias("service_name"), "kind"), edges.withColumn("relationship", F.lit(relationship))


def tpu_topology(body: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(snapshots, nodes, edges): snapshots have source_id, source_version, tpu_version, partial (no full torus) and problem."""
    d = _checked(body, tpu_problem, strict)
    good, version = d.where("problem is null"), _text(F.col("v"), "$.tpu_version")
    side = F.try_variant_get(F.col("v"), "$.slice_shape", "array<double>")
    fine = F.col("problem").isNull()
    shots = d.select("source", F.lit("tpu_topology_source").alias("source_id"), F.when(fine, F.concat(F.lit("tpu-"), version, F.lit("-1"))).alias("source_version"), F.when(fine, version).alias("tpu_version"), F.when(fine, F.exists(side, lambda x: x < FULL_SIDE)).alias("partial"), "problem")
    chips = good.select("source", F.explode(F.from_json(F.to_json(F.try_variant_get("v", "$.chips", "variant")), "array<struct<chip:string,ici_peers:array<string>>>")).alias("c"))
    links = chips.select("source", F.col("c.chip").alias("a"), F.explode_outer("c.ici_peers").alias("b"), F.lit("tpu_shard").alias("kind")).where("a is not null")
    return shots, *_graph(links, "tpu_ici_peer")


def neuron_topology(body: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(snapshots, nodes, edges): snapshots have source_id, source_version, chip_family, partial (no link told) and problem."""
    d = _checked(body, neuron_problem, strict)
    family = F.when(_text(F.col("v"), "$.instance_type").startswith("trn"), "trainium").otherwise("inferentia")
    devices = d.where("problem is null").select("source", F.concat(family, F.lit("_chip")).alias("kind"), F.explode(F.from_json(F.to_json(F.try_variant_get("v", "$.neuron_devices", "variant")), "array<struct<neuron_device:long,connected_to:array<long>>>")).alias("d"))
    name = lambda c: F.concat(F.lit("neuron-"), c)
    links = devices.select("source", name(F.col("d.neuron_device")).alias("a"), F.explode_outer("d.connected_to").alias("_b"), "kind").withColumn("b", name(F.col("_b"))).drop("_b").where("a is not null")
    nodes, edges = _graph(links, "neuron_link_peer")
    linked = edges.select("source").distinct().withColumn("_linked", F.lit(True))
    same = F.col("d.source").eqNullSafe(F.col("e.source"))
    fine = F.col("d.problem").isNull()
    shots = d.alias("d").join(linked.alias("e"), same, "left").select("d.source", F.lit("neuron_topology_source").alias("source_id"), F.when(fine, "neuron-1").alias("source_version"), F.when(fine, family).alias("chip_family"), F.when(fine, F.col("_linked").isNull()).alias("partial"), "d.problem")
    return shots, nodes, edges
