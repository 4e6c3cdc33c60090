"""Engine inputs as views over the driver tables, with the same views as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CAL = 20  # ticks of a series that calibrate it


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def epoch(c: str) -> F.Column:
    """Whole seconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")


def series(spark: SparkSession, sf: str) -> DataFrame:
    """Long form: a series for each user, ticks in order of (ts, event_id)."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("series"), "ts", "event_id", "event_type", "value")
    w = Window.partitionBy("series").orderBy("ts", "event_id")  # under its final name, so later steps by series need no exchange
    return e.select("series", (F.row_number().over(w) - 1).cast("bigint").alias("tick"), "event_id", "event_type", "value", F.log(F.greatest("value", F.lit(1e-9))).alias("x"), epoch("ts").alias("sec"))


SERIES = """s AS (SELECT user_id AS series, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS tick, event_id, event_type, value,
  ln(greatest(value, 1e-9)) AS x, date_diff('second', TIMESTAMP '1970-01-01', ts) AS sec FROM events)"""


def calibrated(spark: SparkSession, sf: str) -> DataFrame:
    """The series with mean, variance (sample), phi of its first CAL ticks; the rows after them."""
    from ..operators.baselines import ar1_of_prefix

    return ar1_of_prefix(series(spark, sf), ["series"], CAL, "x")


CALIBRATED = f"""{SERIES},
c0 AS (SELECT *, x - avg(x) OVER (PARTITION BY series) AS d FROM s WHERE tick < {CAL}),
c1 AS (SELECT series, d, avg(x) OVER (PARTITION BY series) AS mean, lag(d) OVER (PARTITION BY series ORDER BY tick) AS p FROM c0),
c2 AS (SELECT series, count(*) AS n, first(mean) AS mean, coalesce(sum(d * p), 0) AS a, sum(d * d) AS b FROM c1 GROUP BY series),
cal AS (SELECT series, n, mean, greatest(b / greatest(n - 1, 1), 1e-12) AS variance,
  CASE WHEN n < 3 OR b < 1e-12 THEN 0 ELSE greatest(-0.95, least(0.95, a / b + (1 + 3 * a / b) / n)) END AS phi FROM c2),
r AS (SELECT s.*, cal.mean, cal.variance, cal.phi FROM s JOIN cal USING (series) WHERE tick >= {CAL})"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.col("label").alias("cell"), *[F.col("embedding")[i].cast("double").alias(f"v{i + 1}") for i in range(3)])


VECTORS = "v AS (SELECT vec_id, label AS cell, CAST(embedding[1] AS DOUBLE) AS v1, CAST(embedding[2] AS DOUBLE) AS v2, CAST(embedding[3] AS DOUBLE) AS v3 FROM embeddings)"


def graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as shards in racks (nations) in cooling zones (regions)."""
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    sid, nid, rid = F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "r_regionkey")
    nodes = s.select(sid.alias("id"), F.lit("gpu_shard").alias("kind")).unionByName(n.select(nid.alias("id"), F.lit("rack").alias("kind"))).unionByName(r.select(rid.alias("id"), F.lit("cooling_zone").alias("kind")))
    edges = s.select(F.concat(F.lit("n"), "s_nationkey").alias("src"), sid.alias("dst"), F.lit("contains").alias("relationship")).unionByName(n.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), nid.alias("dst"), F.lit("contains").alias("relationship")))
    return nodes, edges


GRAPH = """nodes AS (SELECT 's' || s_suppkey AS id, 'gpu_shard' AS kind FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'rack' FROM nation UNION ALL SELECT 'r' || r_regionkey, 'cooling_zone' FROM region),
edges AS (SELECT 'n' || s_nationkey AS src, 's' || s_suppkey AS dst FROM supplier UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation),
und AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"""


def fired(spark: SparkSession, sf: str) -> DataFrame:
    """Errors as fired shards: user u fires shard u modulo the suppliers."""
    e = table(spark, sf, "events").where("event_type = 'error'")
    return e.select(F.concat(F.lit("s"), F.col("user_id") % 97 + 1).alias("shard_node_id"), epoch("ts").alias("event_ts"), "event_id")


FIRED = "fired AS (SELECT 's' || (user_id % 97 + 1) AS shard_node_id, date_diff('second', TIMESTAMP '1970-01-01', ts) AS event_ts, event_id FROM events WHERE event_type = 'error')"
