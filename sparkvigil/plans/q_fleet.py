"""Queries of fleet evidence, per-shard state, topology, grouping and replay."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import fleet as fl
from ..operators import grouping as gr
from ..operators import replay as rp
from ..operators import topology as tp
from ..sources import parsers as ps
from .registry import registry, rounded
from .views import FIRED, GRAPH, SERIES, epoch, fired, graph, series, table

QUERIES, SQL, query = registry()

_LOGE = f"{SERIES}, le AS (SELECT series % 16 AS shard, sec // 86400 AS tick, avg(x) - 4 AS log_e FROM s GROUP BY 1, 2)"


def _log_e(spark, sf):
    s = series(spark, sf)
    return s.groupBy((F.col("series") % 16).alias("shard"), F.floor(F.col("sec") / 86400).alias("tick")).agg((F.avg("x") - 4).alias("log_e"))


@query(f"WITH {_LOGE}, a AS (SELECT tick, sum(log_e) AS p, max(log_e) AS m, count(*) AS n FROM le GROUP BY tick) SELECT a.tick, round(p, 6) AS log_product, round(first(m) + ln(sum(exp(log_e - m))) - ln(first(n)), 6) AS log_average FROM a JOIN le USING (tick) GROUP BY a.tick, p")
def fleet_combine(spark, sf):
    e = _log_e(spark, sf)
    p = fl.combine_product(e, ["tick"]).select("tick", F.round("log_fleet_e", 6).alias("log_product"))
    return p.join(fl.combine_average(e, ["tick"]).select("tick", F.round("log_fleet_e", 6).alias("log_average")), "tick")


@query(f"""WITH {_LOGE}, p AS (SELECT 1 AS g, tick, sum(log_e) AS l FROM le GROUP BY tick), w AS (SELECT *, greatest(0, max(l) OVER (ORDER BY tick)) AS m, row_number() OVER (ORDER BY tick) - 1 AS i FROM p)
SELECT tick, round(m, 6) AS log_max, m >= 2 AS fired, min(CASE WHEN m >= 2 THEN i END) OVER (ORDER BY tick) AS first_fire FROM w""")
def fleet_tracker(spark, sf):
    p = fl.combine_product(_log_e(spark, sf), ["tick"]).withColumn("g", F.lit(1))
    return rounded(fl.track(p, ["g"], 2.0), "log_max").select("tick", "log_max", "fired", "first_fire")


_EV = "ev AS (SELECT user_id % 10 AS fleet, event_id AS idx, exp(value / 40 - 5) AS e FROM events)"


def _ev(spark, sf):
    return table(spark, sf, "events").select((F.col("user_id") % 10).alias("fleet"), F.col("event_id").alias("idx"), F.exp(F.col("value") / 40 - 5).alias("e"))


@query(f"""WITH {_EV}, k AS (SELECT *, row_number() OVER (PARTITION BY fleet ORDER BY e DESC, idx) AS rank, count(*) OVER (PARTITION BY fleet) AS n FROM ev),
z AS (SELECT *, coalesce(max(CASE WHEN rank * e >= n / 0.3::DOUBLE THEN rank END) OVER (PARTITION BY fleet), 0) AS k FROM k) SELECT fleet, idx, rank, k, rank <= k AS selected FROM z""")
def e_bh(spark, sf):
    return fl.e_bh(_ev(spark, sf), ["fleet"], 0.3).select("fleet", "idx", "rank", "k", "selected")


@query(f"""WITH {_EV}, k AS (SELECT fleet, idx, e * e * e AS e, row_number() OVER (PARTITION BY fleet ORDER BY e DESC, idx) AS rank, count(*) OVER (PARTITION BY fleet) AS n FROM ev),
z AS (SELECT *, coalesce(max(CASE WHEN rank * e >= n / 0.3::DOUBLE THEN rank END) OVER (PARTITION BY fleet), 0) AS k FROM k) SELECT fleet, idx, rank FROM z WHERE rank <= k""")
def e_bh_selected(spark, sf):
    e = _ev(spark, sf).withColumn("e", F.col("e") * F.col("e") * F.col("e"))
    return fl.e_bh_selected(e, ["fleet"], 0.3).select("fleet", "idx", "rank")


@query(f"""WITH {_EV}, k AS (SELECT *, row_number() OVER (PARTITION BY fleet ORDER BY ln(e) DESC, idx) AS rank, count(*) OVER (PARTITION BY fleet) AS n FROM ev),
z AS (SELECT *, coalesce(max(CASE WHEN ln(rank) + ln(e) >= ln(n / 0.2::DOUBLE) THEN rank END) OVER (PARTITION BY fleet), 0) AS k FROM k) SELECT fleet, idx, rank, k, rank <= k AS selected FROM z""")
def e_bh_log(spark, sf):
    e = _ev(spark, sf).withColumn("log_e", F.log("e"))
    return fl.e_bh(e, ["fleet"], 0.2, "log_e", log=True).select("fleet", "idx", "rank", "k", "selected")


@query(f"""WITH {_EV}, k AS (SELECT *, row_number() OVER (PARTITION BY fleet ORDER BY e DESC, idx) AS rank, count(*) OVER (PARTITION BY fleet) AS n FROM ev),
z AS (SELECT *, coalesce(max(CASE WHEN rank * e >= n / 0.3::DOUBLE THEN rank END) OVER (PARTITION BY fleet), 0) AS r FROM k),
b AS (SELECT *, n / (0.3::DOUBLE * (r + CASE WHEN rank <= r THEN 0 ELSE 1 END)) AS thr FROM z), c AS (SELECT fleet, idx, n, CASE WHEN thr * least(1, 1 / (e * e)) <= 1 THEN thr * (1 + 1e-9) ELSE 0 END AS bo FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY fleet ORDER BY bo DESC, idx) AS rank FROM c) SELECT fleet, idx, rank <= coalesce(max(CASE WHEN rank * bo >= n / 0.3::DOUBLE THEN rank END) OVER (PARTITION BY fleet), 0) AS selected FROM d""")
def e_bh_boosted(spark, sf):
    tail = F.least(F.lit(1.0), 1 / (F.col("e") * F.col("e")))
    return fl.e_bh_boosted(_ev(spark, sf), ["fleet"], 0.3, tail).select("fleet", "idx", "selected")


@query(f"""WITH {_EV}, g AS (SELECT * FROM ev WHERE idx % 3 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY fleet ORDER BY e DESC, idx) AS rank, count(*) OVER (PARTITION BY fleet) AS n FROM g),
z AS (SELECT *, coalesce(max(CASE WHEN rank * e >= n / 0.5::DOUBLE THEN rank END) OVER (PARTITION BY fleet), 0) AS k FROM k) SELECT fleet, idx, rank <= k AS selected FROM z""")
def e_bh_guarded(spark, sf):
    """Only evidence with an admissible envelope enters the selection."""
    from ..operators.evidence import admissible

    k = F.col("idx")
    e = _ev(spark, sf).select("*", F.when(k % 3 == 0, "safe_t_e_value").when(k % 3 == 1, "betting_e_process").otherwise("unlisted").alias("detector_id"), F.lit(0.1).alias("phi"), F.lit(200).alias("cal_len"))
    return fl.e_bh(admissible(e).where("admissible").select("fleet", "idx", "e"), ["fleet"], 0.5).select("fleet", "idx", "selected")


@query(f"""WITH {SERIES}, a AS (SELECT *, (value > 200)::INT AS seed FROM s), b AS (SELECT *, coalesce((lag(seed) OVER w <> seed)::INT, 0) AS ch FROM a WINDOW w AS (PARTITION BY series ORDER BY tick)), c AS (SELECT *, CAST(sum(ch) OVER (PARTITION BY series ORDER BY tick) AS BIGINT) AS epoch FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY series, epoch ORDER BY tick) AS n FROM c) SELECT series, tick, epoch, n AS n_samples, CASE WHEN n >= 9 THEN 'strict' WHEN n >= 4 THEN 'warm_start' ELSE 'none' END AS confidence FROM d""")
def ps_confidence(spark, sf):
    s = series(spark, sf).withColumn("seed", (F.col("value") > 200).cast("int"))
    return fl.confidence_tiers(s, ["series"], warm=4, strict=9).select("series", "tick", "epoch", "n_samples", "confidence")


_FIRES = f"""{SERIES}, fi AS (SELECT series, tick, row_number() OVER (PARTITION BY series ORDER BY tick) AS i FROM s WHERE value > 120)"""


def _fires(spark, sf):
    return series(spark, sf).where("value > 120").select("series", "tick")


@query(f"""WITH RECURSIVE {_FIRES}, f(series, i, last, kept) AS (SELECT series, 0::BIGINT, -1000::BIGINT, []::BIGINT[] FROM (SELECT DISTINCT series FROM fi)
UNION ALL SELECT f.series, fi.i, CASE WHEN fi.tick <= f.last + 5 THEN f.last ELSE fi.tick END, CASE WHEN fi.tick <= f.last + 5 THEN f.kept ELSE list_append(f.kept, fi.tick) END FROM f JOIN fi ON fi.series = f.series AND fi.i = f.i + 1)
SELECT series, unnest(kept) AS tick FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY i DESC) AS rn FROM f) WHERE rn = 1""")
def nb_fire_cooldown(spark, sf):
    return fl.cooled(_fires(spark, sf), ["series"], 5)


@query(f"""WITH RECURSIVE {_FIRES}, f(series, i, alarms, till, rec) AS (SELECT series, 0::BIGINT, []::BIGINT[], 0::BIGINT, []::BIGINT[] FROM (SELECT DISTINCT series FROM fi)
UNION ALL SELECT series, i, CASE WHEN go THEN []::BIGINT[] ELSE al END, CASE WHEN go THEN tick + 12 ELSE till END, CASE WHEN go THEN list_append(rec, tick) ELSE rec END FROM (
 SELECT *, tick >= till AND len(al) >= 3 AS go FROM (SELECT f.series, fi.i, fi.tick, f.till, f.rec, list_filter(list_append(f.alarms, fi.tick), lambda a: a > fi.tick - 10) AS al FROM f JOIN fi ON fi.series = f.series AND fi.i = f.i + 1)))
SELECT series, unnest(rec) AS tick FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY i DESC) AS rn FROM f) WHERE rn = 1""")
def ps_baseline_lifecycle(spark, sf):
    return fl.lifecycle(_fires(spark, sf), ["series"], 10, 3, 12).where("record").select("series", "tick")


@query(f"WITH {SERIES} SELECT series, round(median(x), 6) AS level FROM s WHERE tick < 20 GROUP BY series")
def fleet_shard_level(spark, sf):
    return rounded(fl.shard_levels(series(spark, sf), ["series"], 20, "x"), "level")


@query()
def fleet_common_mode_residuals(spark, sf):
    s = _log_e(spark, sf).withColumn("fleet", F.lit("all"))
    first = s.agg(F.min("tick")).first()[0] or 0
    out = fl.common_mode_residuals(s.withColumn("tick", F.col("tick") - first), ["fleet"], 10, "shard", "log_e")
    return rounded(out, "residual").select("shard", "tick", "residual")


_REACH = f"""{GRAPH}, h0 AS (SELECT id AS start, id AS node, 0 AS hop FROM nodes), h1 AS (SELECT start, dst AS node, 1 AS hop FROM h0 JOIN und ON src = node), h2 AS (SELECT start, dst AS node, 2 AS hop FROM h1 JOIN und ON src = node), h3 AS (SELECT start, dst AS node, 3 AS hop FROM h2 JOIN und ON src = node),
reach AS (SELECT start, node, min(hop) AS hop FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY 1, 2), reach3 AS (SELECT start, node, min(hop) AS hop FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) GROUP BY 1, 2)"""


@query(f"WITH {_REACH} SELECT start, node, hop FROM reach")
def topology_reach(spark, sf):
    nodes, edges = graph(spark, sf)
    return tp.reach(nodes.select("id"), edges, 2)


@query(f"""WITH {_REACH}, {FIRED}, t AS (SELECT r.node, n.kind, r.start, r.hop, f.event_ts FROM fired f JOIN reach r ON r.start = f.shard_node_id AND r.hop > 0 JOIN nodes n ON n.id = r.node AND n.kind IN ('rack', 'cooling_zone')),
c AS (SELECT node, kind, start, min(hop) AS hop, min(event_ts) AS lo, max(event_ts) AS hi FROM t GROUP BY 1, 2, 3), o AS (SELECT node, kind, count(*) AS member_count, max(hop) AS distance, min(lo) AS earliest_ts, max(hi) AS latest_ts FROM c GROUP BY 1, 2 HAVING count(*) >= 2),
ee AS (SELECT 's' || s_suppkey AS id, s_acctbal + 1000 AS e FROM supplier), g AS (SELECT DISTINCT r.node, r.start AS member FROM reach r JOIN nodes n ON n.id = r.start AND n.kind = 'gpu_shard' WHERE r.hop > 0),
gs AS (SELECT node, count(*) AS group_size, avg(e) AS ge FROM g JOIN ee ON ee.id = g.member GROUP BY node)
SELECT o.*, group_size, round(ge, 6) AS group_e_value, round(least(1, list_sum(list_transform(range(member_count, group_size + 1), lambda i: exp(lgamma(group_size + 1) - lgamma(i + 1) - lgamma(group_size - i + 1) + i * ln(0.3::DOUBLE) + (group_size - i) * ln(0.7::DOUBLE))))), 6) AS binom_tail FROM o JOIN gs USING (node)""")
def common_mode_attribution(spark, sf):
    nodes, edges = graph(spark, sf)
    e = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("shard_node_id"), (F.col("s_acctbal") + 1000).alias("e"))
    out = tp.common_mode(fired(spark, sf), nodes, edges, 2, fire_rate=0.3, e_values=e)
    return rounded(out, "group_e_value", "binom_tail").drop("members")


@query(f"""WITH {_REACH}, {FIRED}, t AS (SELECT r.node, n.kind, r.start, r.hop, f.event_ts FROM fired f JOIN reach r ON r.start = f.shard_node_id AND r.hop > 0 JOIN nodes n ON n.id = r.node AND n.kind IN ('rack', 'cooling_zone')),
w AS (SELECT a.node, a.event_ts AS e, count(DISTINCT b.start) AS c FROM (SELECT DISTINCT node, event_ts FROM t) a JOIN t b ON b.node = a.node AND b.event_ts BETWEEN a.event_ts - 7200 AND a.event_ts GROUP BY 1, 2),
b AS (SELECT node, arg_max(e, (c, -e)) AS e FROM w GROUP BY node), u AS (SELECT t.* FROM t JOIN b USING (node) WHERE event_ts BETWEEN e - 7200 AND e)
SELECT node, kind, count(DISTINCT start) AS member_count, min(event_ts) AS earliest_ts, max(event_ts) AS latest_ts FROM u GROUP BY 1, 2 HAVING count(DISTINCT start) >= 2""")
def common_mode_coincidence(spark, sf):
    nodes, edges = graph(spark, sf)
    out = tp.common_mode(fired(spark, sf), nodes, edges, 2, window_s=7200)
    return out.select("node", "kind", "member_count", "earliest_ts", "latest_ts")


@query(f"""WITH {FIRED}, ce AS (SELECT event_id, event_type AS kind, date_diff('second', TIMESTAMP '1970-01-01', ts) AS event_ts FROM events WHERE event_type = 'purchase'),
j AS (SELECT ce.*, shard_node_id AS sh, f.event_ts - ce.event_ts AS d FROM ce JOIN fired f ON f.event_ts > ce.event_ts - 3600 AND f.event_ts < ce.event_ts + 3600)
SELECT event_id, kind, event_ts, count(DISTINCT CASE WHEN d < 0 THEN sh END) AS pre_count, count(DISTINCT CASE WHEN d BETWEEN 0 AND 1800 THEN sh END) AS member_count FROM j GROUP BY 1, 2, 3
HAVING count(DISTINCT CASE WHEN d BETWEEN 0 AND 1800 THEN sh END) >= 2 AND count(DISTINCT CASE WHEN d BETWEEN 0 AND 1800 THEN sh END) - count(DISTINCT CASE WHEN d < 0 THEN sh END) >= 1""")
def event_conditional_attribution(spark, sf):
    ce = table(spark, sf, "events").where("event_type = 'purchase'").select("event_id", F.col("event_type").alias("kind"), epoch("ts").alias("event_ts"))
    return tp.event_conditional(fired(spark, sf), ce, 3600, 3600, 1800, members=False)


_ENRICH = f"""WITH {_REACH}, gr AS (SELECT o_orderkey AS group_id, 's' || (o_custkey % 100 + 1) AS start, date_diff('second', TIMESTAMP '1970-01-01', o_orderdate) AS a FROM orders),
ev AS (SELECT o_orderkey AS event_id, 'n' || (o_orderkey % 25) AS node, date_diff('second', TIMESTAMP '1970-01-01', o_orderdate) AS t FROM orders),
c AS (SELECT g.group_id, e.event_id, r.node, r.hop, greatest(0, 1 - greatest(a - t, t - (a + 86400), 0) / 864000.0::DOUBLE) AS ov FROM gr g JOIN reach3 r ON r.start = g.start JOIN ev e ON e.node = r.node AND e.t BETWEEN a - 864000 AND a + 86400 + 864000),
k AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY ov DESC, hop, event_id) AS rank FROM c WHERE ov > 0)"""


def _enriched(spark, sf):
    nodes, edges = graph(spark, sf)
    o = table(spark, sf, "orders").withColumn("t", epoch("o_orderdate"))
    groups = o.select(F.col("o_orderkey").alias("group_id"), F.concat(F.lit("s"), F.col("o_custkey") % 100 + 1).alias("deploy_id"), F.col("t").alias("window_start_ts"), (F.col("t") + 86400).alias("window_end_ts"))
    ev = o.select(F.concat(F.lit("n"), F.col("o_orderkey") % 25).alias("node_id"), F.col("o_orderkey").alias("event_id"), F.col("t").alias("event_ts"), F.lit(None).cast("bigint").alias("event_end_ts"))
    return groups, tp.enriched(groups, nodes.withColumn("service_name", F.lit(None).cast("string")), edges, ev, decay_s=864000.0)


@query(f"{_ENRICH} SELECT group_id, event_id, node, hop, round(ov, 6) AS overlap FROM k WHERE rank = 1")
def topology_enrichment(spark, sf):
    return rounded(_enriched(spark, sf)[1], "overlap").drop("rank", "n_candidates")


@query(f"""{_ENRICH}, n AS (SELECT group_id, count(*) AS n FROM k GROUP BY 1) SELECT gr.group_id, coalesce(n.n, 0) AS n_candidates, t.event_id AS top_event, round(t.ov, 6) AS top_overlap
FROM gr LEFT JOIN n USING (group_id) LEFT JOIN (SELECT * FROM k WHERE rank = 1) t USING (group_id)""")
def topology_audit_events(spark, sf):
    a = tp.audit_events(*_enriched(spark, sf))
    return a.select("group_id", "n_candidates", F.col("top_candidate.event_id").alias("top_event"), F.round("top_candidate.overlap", 6).alias("top_overlap"))


_VERDICT = f"""{SERIES}, ve AS (SELECT event_id AS seq, series AS dep, CASE WHEN series % 3 = 0 THEN 'e' || (series % 5) ELSE '' END AS ek, sec AS ts, tick, value > 300 AS terminal, value > 60 AS f1, value > 150 AS f2, value / 1000 AS alpha FROM s),
vo AS (SELECT *, row_number() OVER (PARTITION BY ek, dep ORDER BY ts, seq) AS i FROM ve)"""
_FOLD = """f(ek, dep, i, op, ca, cg, g, late) AS (SELECT ek, dep, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, false FROM (SELECT DISTINCT ek, dep FROM vo)
UNION ALL SELECT ek, dep, i, CASE WHEN lt OR en THEN NULL ELSE gg END, CASE WHEN en OR rot THEN ts ELSE ca END, CASE WHEN en THEN gg WHEN rot THEN op ELSE cg END, gg, lt FROM (SELECT *, terminal AND NOT lt AS en FROM (SELECT *, CASE WHEN lt THEN cg WHEN op IS NULL OR rot THEN ts ELSE op END AS gg FROM (
 SELECT f.ek, f.dep, vo.i, vo.ts, vo.terminal, f.op, f.ca, f.cg, coalesce(vo.ts - f.op > 400000, false) AS rot, coalesce(f.op IS NULL AND vo.ts - f.ca <= 40000, false) AS lt FROM f JOIN vo ON vo.ek = f.ek AND vo.dep = f.dep AND vo.i = f.i + 1))))"""


def _assigned(spark, sf):
    s = series(spark, sf)
    fam = F.when(F.col("value") > 150, F.array(F.lit("A"), F.lit("C"))).when(F.col("value") > 60, F.array(F.lit("A"))).otherwise(F.array().cast("array<string>"))
    v = s.select(F.col("event_id").alias("seq"), F.col("series").cast("string").alias("deploy_ref"), F.when(F.col("series") % 3 == 0, F.concat(F.lit("e"), F.col("series") % 5)).alias("cluster_event_id"), F.col("sec").alias("ts"), "tick", (F.col("value") > 300).alias("terminal"), fam.alias("families"), (F.col("value") / 1000).alias("alpha"))
    return gr.assigned(v, 400000, 40000)


@query(f"WITH RECURSIVE {_VERDICT}, {_FOLD} SELECT vo.seq, 'group-' || CASE WHEN f.ek <> '' THEN f.ek || '-' ELSE '' END || f.dep || '-' || f.g AS group_id, f.late AS late_arrival FROM f JOIN vo USING (ek, dep, i)")
def verdict_groups(spark, sf):
    return _assigned(spark, sf).select("seq", "group_id", "late_arrival")


@query(f"""WITH RECURSIVE {_VERDICT}, {_FOLD}, a AS (SELECT vo.*, f.g, f.late FROM f JOIN vo USING (ek, dep, i))
SELECT 'group-' || CASE WHEN ek <> '' THEN ek || '-' ELSE '' END || dep || '-' || g AS group_id, count(*) AS n_verdicts, CAST(sum(f1::INT) AS BIGINT) AS n_firing, CAST(sum(late::INT) AS BIGINT) AS n_late, arg_min(seq, (tick, -alpha, ts, seq)) FILTER (f1) AS root_seq,
  round(least(1, (bool_or(f1)::INT + bool_or(f2)::INT) / 3.0::DOUBLE), 6) AS confidence FROM a GROUP BY ek, dep, g""")
def verdict_group_summary(spark, sf):
    return rounded(gr.summarised(_assigned(spark, sf)), "confidence").select("group_id", "n_verdicts", "n_firing", "n_late", "root_seq", "confidence")


@query(f"WITH RECURSIVE {_VERDICT}, {_FOLD} SELECT f.ek AS cluster_event_id, count(DISTINCT f.ek || f.dep || '-' || f.g) AS n_groups, count(DISTINCT f.dep) AS n_deploys, min(ts) AS first_seen FROM f JOIN vo USING (ek, dep, i) WHERE f.ek <> '' GROUP BY 1")
def cluster_event_rollup(spark, sf):
    a = _assigned(spark, sf).select(F.col("event_key").alias("cluster_event_id"), "group_id", F.col("deploy_ref").alias("deploy_id"), "ts")
    return fl.rollup_by_event(a)


@query(f"""WITH {SERIES}, ev AS (SELECT series, sec FROM s WHERE value > 250), o AS (SELECT *, max(sec + 100000) OVER (PARTITION BY series ORDER BY sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ev),
g AS (SELECT *, sum(CASE WHEN sec > coalesce(m, -1) THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY sec) AS k FROM o), i AS (SELECT series, min(sec) AS a, max(sec) + 100000 AS b FROM g GROUP BY series, k)
SELECT s.event_id FROM s WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.series = s.series AND s.sec BETWEEN a AND b)""")
def ps_freeze_aware_samples(spark, sf):
    s = series(spark, sf).select(F.col("series").alias("shard"), F.col("sec").alias("ts"), "event_id", "value")
    frozen = gr.frozen_intervals(s.where("value > 250").select("shard", F.col("ts").alias("event_ts")), 100000)
    return gr.unfrozen(s, frozen).select("event_id")


_NB = f"""{SERIES}, fr AS (SELECT series AS dataset, tick, value > 150 AS fire FROM s), wi AS (SELECT series AS dataset, (series % 7) * 4 + k * 30 AS lo, (series % 7) * 4 + k * 30 + 9 AS hi FROM (SELECT DISTINCT series FROM s) z, range(2) r(k) WHERE series % 6 <> 0),
h AS (SELECT wi.dataset, lo, hi, min(tick) AS f FROM wi LEFT JOIN fr ON fr.dataset = wi.dataset AND fire AND tick BETWEEN lo AND hi GROUP BY ALL),
g AS (SELECT dataset, count(*) AS nw, sum(CASE WHEN f IS NULL THEN -1 ELSE 1 / (1 + exp(-5 * (hi - f)::DOUBLE / 9)) END) AS gain FROM h GROUP BY dataset),
ou AS (SELECT dataset, count(*) AS n FROM fr WHERE fire AND NOT EXISTS (SELECT 1 FROM wi WHERE wi.dataset = fr.dataset AND fr.tick BETWEEN lo AND hi) GROUP BY dataset)"""


@query(f"WITH {_NB} SELECT d.dataset, coalesce(nw, 0) AS n_windows, coalesce(n, 0) AS n_outside, round(greatest(0, CASE WHEN nw IS NULL THEN 100 - coalesce(n, 0) * 0.22::DOUBLE ELSE 100 * (gain - coalesce(n, 0) * 0.22::DOUBLE) / (nw / (1 + exp(-5))) END), 6) AS score FROM (SELECT DISTINCT dataset FROM fr) d LEFT JOIN g USING (dataset) LEFT JOIN ou USING (dataset)")
def nb_replay_score(spark, sf):
    s = series(spark, sf)
    f = s.select(F.col("series").alias("dataset"), "tick", (F.col("value") > 150).alias("fire"))
    d = f.select("dataset").distinct()
    k = F.explode(F.array(F.lit(0), F.lit(1)))
    w = d.where("dataset % 6 <> 0").select("dataset", k.alias("k")).select("dataset", ((F.col("dataset") % 7) * 4 + F.col("k") * 30).alias("start")).withColumn("end", F.col("start") + 9)
    return rounded(rp.replay_score(f, w, d), "score")


@query("""WITH o AS (SELECT o_orderkey, date_diff('second', TIMESTAMP '1970-01-01', o_orderdate)::DOUBLE AS a FROM orders), b AS (SELECT *, a + (o_orderkey % 9 - 4) * 100 AS c, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN a + (o_orderkey % 9 - 4) * 100 - 1 ELSE a + (o_orderkey % 9 - 4) * 100 + (o_orderkey % 3) * 150 END AS d, a + (o_orderkey % 2) * 300 AS e FROM o)
SELECT o_orderkey, round(CASE WHEN d IS NULL OR d < c THEN greatest(0, 1 - greatest(a - c, c - e, 0) / 300) WHEN greatest(e, d) - least(a, c) > 0 THEN greatest(0, least(e, d) - greatest(a, c)) / (greatest(e, d) - least(a, c)) ELSE 0 END, 6) AS overlap FROM b""")
def topology_overlap(spark, sf):
    """Overlap of each order's window with an event: points, intervals, and windows and intervals that are points."""
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select("o_orderkey", epoch("o_orderdate").cast("double").alias("a"))
    o = o.withColumns({"c": F.col("a") + (k % 9 - 4) * 100, "e": F.col("a") + (k % 2) * 300})
    end = F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, F.col("c") - 1).otherwise(F.col("c") + (k % 3) * 150)
    return rounded(o.withColumn("overlap", tp.overlap(F.col("a"), F.col("e"), F.col("c"), end)), "overlap").select("o_orderkey", "overlap")


@query(f"WITH {_NB} SELECT dataset, tick, CAST(sum(fire::INT) OVER (PARTITION BY dataset ORDER BY tick ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS BIGINT) >= 3 AS smooth FROM fr")
def nb_smoothing(spark, sf):
    f = series(spark, sf).select(F.col("series").alias("dataset"), "tick", (F.col("value") > 150).alias("fire"))
    return rp.smoothed(f, ["dataset"], 5, 3).select("dataset", "tick", "smooth")


@query(f"""WITH RECURSIVE {_NB}, sm AS (SELECT dataset, tick, sum(fire::INT) OVER (PARTITION BY dataset ORDER BY tick ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 2 AS smooth FROM fr),
si AS (SELECT dataset, tick, row_number() OVER (PARTITION BY dataset ORDER BY tick) AS i FROM sm WHERE smooth),
f(dataset, i, last, tick, kept) AS (SELECT DISTINCT dataset, 0::BIGINT, -1000000::BIGINT, NULL::BIGINT, false FROM si UNION ALL SELECT f.dataset, si.i, CASE WHEN si.tick > f.last + 7 THEN si.tick ELSE f.last END, si.tick, si.tick > f.last + 7 FROM f JOIN si ON si.dataset = f.dataset AND si.i = f.i + 1)
SELECT sm.dataset, sm.tick, coalesce(kept, false) AS fire FROM sm LEFT JOIN f ON f.dataset = sm.dataset AND f.tick = sm.tick""")
def nb_likelihood_smoothing(spark, sf):
    """Smoothed firings with a cooldown after each emission."""
    f = series(spark, sf).select(F.col("series").alias("dataset"), "tick", (F.col("value") > 150).alias("fire"))
    return rp.likelihood_smoothed(f, ["dataset"], 5, 2, 7).select("dataset", "tick", "fire")


@query("""WITH c AS (SELECT event_type AS family, 'm' || (user_id % 3) AS mode, count(*) AS n FROM events WHERE NOT (event_type = 'error' AND user_id % 3 = 1) GROUP BY 1, 2)
SELECT f.family, m.mode, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT family FROM c) f CROSS JOIN (SELECT DISTINCT mode FROM c) m LEFT JOIN c ON c.family = f.family AND c.mode = m.mode""")
def resampler_cube(spark, sf):
    e = table(spark, sf, "events").where("not (event_type = 'error' and user_id % 3 = 1)")
    return rp.resampler_cube(e.select(F.col("event_type").alias("family"), F.concat(F.lit("m"), F.col("user_id") % 3).alias("mode"), F.lit(1).alias("n")))


@query("""WITH c AS (SELECT event_type AS family, user_id % 8 AS seed, sum((value > 150)::INT) AS n FROM events GROUP BY 1, 2) SELECT family, round(avg(n), 6) AS mean, count(*) AS seeds, round(1.2::DOUBLE * 0.05::DOUBLE * 250, 6) AS "limit", avg(n) <= 1.2::DOUBLE * 0.05::DOUBLE * 250 AS accepted FROM c GROUP BY family""")
def resampler_acceptance(spark, sf):
    c = table(spark, sf, "events").groupBy(F.col("event_type").alias("family"), (F.col("user_id") % 8).alias("seed")).agg(F.sum((F.col("value") > 150).cast("int")).alias("n"))
    return rounded(rp.resampler_acceptance(c, F.lit(0.05), 250), "mean", "limit")


@query("""WITH i AS (SELECT o_orderkey, 'N' || (o_orderkey % 9) || CASE o_orderkey % 4 WHEN 1 THEN '-p06' WHEN 2 THEN '-p095-m100' WHEN 3 THEN '-m40' ELSE '' END AS id, o_orderkey % 9 AS n, o_orderkey % 4 AS f FROM orders)
SELECT o_orderkey, CASE WHEN n IN (3, 4) AND f = 1 THEN 0.6::DOUBLE WHEN n IN (3, 4) AND f = 2 THEN 0.95::DOUBLE WHEN (n IN (1, 5, 6, 7) AND f = 0) OR (n = 2 AND f = 3) THEN 0.0::DOUBLE END AS phi,
CASE WHEN (n IN (1, 7) AND f = 0) OR (n = 3 AND f IN (1, 2)) THEN 'oracle' WHEN n = 4 AND f IN (1, 2) THEN 'estimated' WHEN (n IN (5, 6) AND f = 0) OR (n = 2 AND f = 3) THEN 'iid-by-construction' END AS phi_source FROM i""")
def certification_null_phi(spark, sf):
    k = F.col("o_orderkey")
    tail = F.when(k % 4 == 1, "-p06").when(k % 4 == 2, "-p095-m100").when(k % 4 == 3, "-m40").otherwise("")
    got = rp.null_parameters(F.concat(F.lit("N"), k % 9, tail))
    return table(spark, sf, "orders").select("o_orderkey", F.round(got["phi"], 6).alias("phi"), got["phi_source"].alias("phi_source"))


@query("SELECT DISTINCT user_id, event_type FROM events a WHERE value > 100 AND NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = a.event_type AND b.value < 5)")
def certification_unpaired(spark, sf):
    e = table(spark, sf, "events")
    return rp.unpaired(e.where("value > 100").select("user_id", "event_type").distinct(), e.where("value < 5"), ["user_id", "event_type"])


@query(f"""WITH {SERIES} SELECT series, tick, round(value + CASE WHEN tick >= 30 THEN 6 ELSE 0 END, 6) AS step, round(value + CASE WHEN tick >= 30 THEN 6 * (tick - 30) / 100.0::DOUBLE ELSE 0 END, 6) AS drift,
  round(value + CASE WHEN tick >= 30 THEN 6 * sin(2 * pi() * (tick - 30) / 10) ELSE 0 END, 6) AS oscillation, round(value + CASE WHEN tick = 30 THEN 6 ELSE 0 END, 6) AS point FROM s""")
def fault_injection(spark, sf):
    s = series(spark, sf)
    return s.select("series", "tick", *[F.round(rp.injected(s, k, F.lit(2.0), 30), 6).alias(k) for k in ("step", "drift", "oscillation", "point")])


@query("""WITH l AS (SELECT s_suppkey AS k, 'n' || (s_suppkey % 10) AS p FROM supplier) SELECT k, p || lpad(CAST(i AS VARCHAR), 2, '0') AS host FROM l, range(1, 5) r(i) UNION ALL SELECT k, p || '7' FROM l""")
def source_hostlist(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("n"), F.col("s_suppkey") % 10, F.lit("[01-04,7]")).alias("spec"))
    return s.select("k", F.explode(ps.expand_hostlist(F.col("spec"))).alias("host"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.k') IS NOT NULL AS valid FROM events")
def source_json_props(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.from_json("props", "k bigint").alias("p")).select("event_id", "p.k", F.col("p.k").isNotNull().alias("valid"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'contract_version' WHEN event_id % 7 = 0 THEN 'event_class' WHEN event_id % 11 = 0 THEN 'event_ts' END AS reason FROM events""")
def source_event_validation(spark, sf):
    k = F.col("event_id")
    body = F.to_json(F.struct(F.when(k % 5 == 0, "v0").otherwise("v1").alias("contract_version"), F.struct(F.concat(F.lit("e"), k).alias("event_id"), F.when(k % 7 == 0, "party").otherwise("config_change").alias("event_class"), F.when(k % 11 != 0, F.lit(5.0)).alias("event_ts")).alias("event"), F.lit(6.0).alias("emitted_at_ts")))
    return table(spark, sf, "events").select("event_id", ps.event_problem(body).alias("reason"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS normal FROM orders""")
def source_timestamp_text(spark, sf):
    t = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T"), F.date_format("o_orderdate", "HH:mm:ss"), F.lit(".250Z"))
    return table(spark, sf, "orders").select("o_orderkey", rp.normal_timestamp(F.regexp_replace(t, r"\.250Z$", ".250")).alias("normal"))


@query(f"""WITH ts AS (SELECT user_id AS dataset, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS tick, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t FROM events), la AS (SELECT dataset, max(CASE WHEN tick = 5 THEN t END) AS a, max(CASE WHEN tick = 9 THEN t END) AS b FROM ts GROUP BY dataset),
att AS (SELECT dataset, t, max(tick) AS tick FROM ts GROUP BY 1, 2) SELECT la.dataset, x.tick AS start, y.tick AS "end" FROM la JOIN att x ON x.dataset = la.dataset AND x.t = a JOIN att y ON y.dataset = la.dataset AND y.t = b""")
def nb_annotation_windows(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = table(spark, sf, "events").select(F.col("user_id").alias("dataset"), (F.row_number().over(w) - 1).cast("bigint").alias("tick"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"))
    lab = t.groupBy("dataset").agg(F.max(F.when(F.col("tick") == 5, F.col("timestamp"))).alias("start_ts"), F.max(F.when(F.col("tick") == 9, F.col("timestamp"))).alias("end_ts"))
    return rp.annotation_windows(lab, t)
