"""Readers of topology descriptions, configs, labels and event payloads, as DataFrame plans over text and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Classes of deploy events, and keys that a compiled config must have. Fixed values.
EVENT_CLASSES = ("firmware_push", "model_redeploy", "env_change", "config_change", "capacity_change", "chaos_experiment")
CONFIG_KEYS = ("version", "alpha_budget", "family_a_signals", "bake_profiles", "baseline_cells")


def split_top_level(text: Column) -> Column:
    """Parts between the commas outside brackets."""
    return F.split(text, r",(?![^\[]*\])")


def expand_hostlist(spec: Column) -> Column:
    """Hosts of a list such as n[01-03,7],m1: ranges keep the width of their start; a reversed or malformed range is an error."""

    def one(part: Column) -> Column:
        head, body, tail = (F.regexp_extract(part, r"^([^\[]*)\[([^\]]*)\](.*)$", i) for i in (1, 2, 3))

        def numbers(r: Column) -> Column:
            lo, hi = F.regexp_extract(r, r"^(\d+)", 1), F.regexp_extract(r, r"(\d+)$", 1)
            fine = r.rlike(r"^\d+(-\d+)?$") & (lo.cast("bigint") <= hi.cast("bigint"))
            lo = F.when(fine, lo).otherwise(F.raise_error(F.concat(F.lit("bad host range: "), r)).cast("string"))
            return F.transform(F.sequence(lo.cast("bigint"), hi.cast("bigint")), lambda i: F.concat(head, F.when(F.length(i.cast("string")) < F.length(lo), F.lpad(i.cast("string"), F.length(lo), F.lit("0"))).otherwise(i.cast("string")), tail))

        return F.when(part.contains("["), F.flatten(F.transform(F.split(body, ","), numbers))).otherwise(F.array(part))

    return F.flatten(F.transform(split_top_level(spec), one))


def switch_topology(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of lines `SwitchName=s Switches=.. Nodes=..`: switches are racks, leaves shards. An unknown clause, a line without a name or members, or a repeated switch is an error."""
    t = lines.where(r"trim(value) <> '' and trim(value) not like '#%'").select(F.trim("value").alias("value"))
    part = lambda k: F.regexp_extract("value", rf"(?i)(?:^|\s){k}=(\S+)", 1)
    r = t.select(part("SwitchName").alias("name"), part("Switches").alias("switches"), part("Nodes").alias("members"), "value")
    n = F.count("*").over(Window.partitionBy("name"))
    # a clause is Key=value of a known key
    unknown = F.exists(F.split("value", r"\s+"), lambda c: ~c.rlike(r"(?i)^(SwitchName|Switches|Nodes|LinkSpeed)=\S+$"))
    bad = unknown | (F.col("name") == "") | ((F.col("switches") == "") & (F.col("members") == "")) | (n > 1)
    r = r.withColumn("name", F.when(bad, F.raise_error(F.concat(F.lit("bad topology line: "), "value"))).otherwise(F.col("name")))
    expand = lambda c: F.when(F.col(c) != "", expand_hostlist(F.col(c))).otherwise(F.array().cast("array<string>"))
    down = r.select(F.col("name").alias("src"), F.explode(F.concat(F.transform(expand("switches"), lambda x: F.struct(x.alias("dst"), F.lit("rack").alias("kind"))), F.transform(expand("members"), lambda x: F.struct(x.alias("dst"), F.lit("gpu_shard").alias("kind"))))).alias("m")).select("src", "m.*")
    nodes = r.select(F.col("name").alias("id"), F.lit("rack").alias("kind")).unionByName(down.select(F.col("dst").alias("id"), "kind")).distinct()
    return nodes, down.select("src", "dst", F.lit("contains").alias("relationship"))


_NODE_LIST = "items array<struct<metadata:struct<name:string,labels:map<string,string>>>>"


def cluster_nodes(body: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hosts (racks), zones and accelerators of a node list in JSON: gpu.count shards a host; of repeated hosts the first counts."""
    n = body.select(F.from_json("value", _NODE_LIST).alias("j")).select(F.posexplode("j.items").alias("pos", "i")).select("pos", "i.metadata.*")
    first = n.groupBy("name").agg(F.min_by("labels", "pos").alias("labels"))
    h = first.select("name", F.element_at("labels", "topology.kubernetes.io/zone").alias("zone"), F.coalesce(F.element_at("labels", "gpu.count").cast("int"), F.lit(0)).alias("gpus"))
    shards = h.where("gpus > 0").select("name", F.explode(F.sequence(F.lit(0), F.col("gpus") - 1)).alias("k")).select("name", F.concat("name", F.lit("-gpu-"), "k").alias("id"))
    zones = h.where("zone is not null")
    nodes = h.select(F.col("name").alias("id"), F.lit("rack").alias("kind")).unionByName(shards.select("id", F.lit("gpu_shard").alias("kind"))).unionByName(zones.select(F.col("zone").alias("id"), F.lit("cooling_zone").alias("kind")).distinct())
    edges = shards.select(F.col("name").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("relationship")).unionByName(zones.select(F.col("zone").alias("src"), F.col("name").alias("dst"), F.lit("contains").alias("relationship")))
    return nodes, edges


def peer_links(lines: DataFrame) -> DataFrame:
    """Undirected peer pairs of a link status text: `GPU n:` headers, then lines that name a remote GPU. lines: line_no, value and, for several hosts, host."""
    w = Window.partitionBy(*(["host"] if "host" in lines.columns else [F.lit(0)])).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)  # a host's status text is bounded
    gpu = F.when(F.col("value").rlike(r"^GPU \d+:"), F.regexp_extract("value", r"^GPU (\d+):", 1).cast("int"))
    peer = F.when(~F.col("value").rlike(r"^GPU \d+:") & F.col("value").rlike(r"GPU \d+"), F.regexp_extract("value", r"GPU (\d+)", 1).cast("int"))
    r = lines.withColumn("a", F.last(gpu, True).over(w)).withColumn("b", peer).where("a is not null and b is not null and a <> b")
    return r.select(*(["host"] if "host" in lines.columns else []), F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def torus_links(spark: SparkSession, shape: tuple[int, int, int]) -> DataFrame:
    """Links of a three-dimensional chip mesh; a dimension wraps round from four chips on."""
    x, y, z = shape
    if min(shape) < 1:
        raise ValueError(f"shape must be positive: {shape}")
    n = spark.range(x * y * z).select((F.col("id") % x).alias("x"), (F.floor(F.col("id") / x) % y).alias("y"), F.floor(F.col("id") / (x * y)).alias("z"))
    name = lambda a, b, c: F.concat_ws("-", F.lit("chip"), a, b, c)
    out = None
    for axis, size in (("x", x), ("y", y), ("z", z)):
        nxt = {c: F.col(c) for c in "xyz"} | {axis: (F.col(axis) + 1) % size}
        step = n if size >= 4 else n.where(F.col(axis) < size - 1)
        links = step.select(name("x", "y", "z").alias("src"), name(nxt["x"], nxt["y"], nxt["z"]).alias("dst")).where("src <> dst")
        out = links if out is None else out.unionByName(links)
    return out.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


_EVENT = "contract_version string, event struct<event_id:string,event_class:string,event_ts:double,event_window_end_ts:double>, emitted_at_ts double"


def event_problem(body: Column) -> Column:
    """First field of a deploy event's envelope that is missing or wrong, or null for a valid one."""
    j = F.from_json(body, _EVENT)
    e = j["event"]
    finite = lambda c: c.isNotNull() & ~F.isnan(c)
    return (
        F.when(j.isNull(), "json").when(~(j["contract_version"].eqNullSafe(F.lit("v1"))), "contract_version").when(e.isNull(), "event").when(F.coalesce(e["event_id"], F.lit("")) == "", "event_id")
        .when(~F.coalesce(e["event_class"].isin(*EVENT_CLASSES), F.lit(False)), "event_class").when(~finite(e["event_ts"]), "event_ts").when(~finite(j["emitted_at_ts"]), "emitted_at_ts")
    )


def config_problem(body: Column) -> Column:
    """First required key that a compiled config lacks, an empty version, or an alpha total that is no number; null if it is fine."""
    out = F.when(F.get_json_object(body, "$").isNull(), "json")
    for k in CONFIG_KEYS:
        out = out.when(F.get_json_object(body, f"$.{k}").isNull(), k)
    return out.when(F.get_json_object(body, "$.version") == "", "version").when(F.get_json_object(body, "$.alpha_budget.total").try_cast("double").isNull(), "alpha_budget.total")


def labelled_windows(body: DataFrame) -> DataFrame:
    """(dataset, start_ts, end_ts) of a JSON map from path to windows."""
    m = body.select(F.explode(F.from_json("value", "map<string,array<array<string>>>")).alias("dataset", "windows"))
    return m.select("dataset", F.explode_outer("windows").alias("w")).select("dataset", F.col("w")[0].alias("start_ts"), F.col("w")[1].alias("end_ts")).where("start_ts is not null")


def benchmark_files(spark: SparkSession, root: str) -> DataFrame:
    """(benchmark, dataset, path) of the CSV files below root, one folder a benchmark; a root that is not there is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).load(root).select("path")
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("benchmark"), F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1)).alias("dataset"), "path")


def series_ends(df: DataFrame) -> DataFrame:
    """First and last timestamp and number of rows of each dataset of csv_series."""
    return df.groupBy("dataset").agg(F.min_by("timestamp", "row").alias("first_timestamp"), F.max_by("timestamp", "row").alias("last_timestamp"), F.count("*").alias("n"))


def csv_series(spark: SparkSession, glob: str) -> DataFrame:
    """dataset (file path), row, timestamp, value of CSV files with a header; a value that is no finite number is an error that names its row."""
    raw = spark.read.option("header", True).csv(glob).select(F.col("_metadata.file_path").alias("dataset"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"), "timestamp", "value")
    r = raw.withColumn("row", F.row_number().over(Window.partitionBy("dataset").orderBy("_b", "_i")) - 1)
    v = F.col("value").try_cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return r.select("dataset", "row", "timestamp", F.when(ok, v).otherwise(F.raise_error(F.concat(F.lit("row "), F.col("row"), F.lit(": not a finite value")))).alias("value"))
