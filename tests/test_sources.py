"""Readers of topology, configs and series."""

import json

import pytest
from pyspark.sql import functions as F

from sparkvigil.operators import topology
from sparkvigil.sources import accelerators as ac
from sparkvigil.sources import parsers as ps


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def text(spark, lines):
    return spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_no int, value string")


def test_hostlist(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("n[08-11,3]x,m1,q[1-2]",)], "s string").select(ps.expand_hostlist(F.col("s")).alias("h"))
    assert df.first().h == ["n08x", "n09x", "n10x", "n11x", "n3x", "m1", "q1", "q2"]


def test_switch_topology(spark):
    nodes, edges = ps.switch_topology(text(spark, ["# top", "SwitchName=s0 Switches=s[1-2]", "SwitchName=s1 Nodes=n[1-2]", "SwitchName=s2 Nodes=n3"]))
    assert rows(nodes) == [("n1", "gpu_shard"), ("n2", "gpu_shard"), ("n3", "gpu_shard"), ("s0", "rack"), ("s1", "rack"), ("s2", "rack")]
    assert rows(edges.select("src", "dst")) == [("s0", "s1"), ("s0", "s2"), ("s1", "n1"), ("s1", "n2"), ("s2", "n3")]
    with pytest.raises(Exception, match="bad topology line"):
        ps.switch_topology(text(spark, ["SwitchName=a Nodes=x", "SwitchName=a Nodes=y"]))[0].collect()


def test_cluster_nodes(spark):
    item = lambda n, **k: {"metadata": {"name": n, "labels": k}}
    body = json.dumps({"items": [item("h1", **{"gpu.count": "2", "topology.kubernetes.io/zone": "z"}), item("h1", **{"gpu.count": "9"}), item("h2")]})
    nodes, edges = ps.cluster_nodes(spark.createDataFrame([(body,)], "value string"))
    assert rows(nodes) == [("h1", "rack"), ("h1-gpu-0", "gpu_shard"), ("h1-gpu-1", "gpu_shard"), ("h2", "rack"), ("z", "cooling_zone")]
    assert ("z", "h1", "contains") in rows(edges) and edges.count() == 3


def test_links(spark):
    assert rows(ps.peer_links(text(spark, ["GPU 0: X", " Link 0: GPU 1", " Link 1: GPU 0", "GPU 1: X", " Link 0: GPU 0", " Link 1: GPU 2"]))) == [(0, 1), (1, 2)]
    assert ps.torus_links(spark, (4, 1, 1)).count() == 4 and ps.torus_links(spark, (2, 2, 1)).count() == 4
    with pytest.raises(ValueError):
        ps.torus_links(spark, (0, 1, 1))


def test_config_and_labels(spark):
    from pyspark.sql import functions as F

    good = {"version": "1", "alpha_budget": {"total": 0.1}, "family_a_signals": [], "bake_profiles": {}, "baseline_cells": {}}
    bad = [good, good | {"version": ""}, good | {"alpha_budget": {"total": "x"}}, {k: v for k, v in good.items() if k != "bake_profiles"}]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bad)] + [(9, "{")], "i int, b string").select("i", ps.config_problem(F.col("b")).alias("p"))
    assert {r.i: r.p for r in df.collect()} == {0: None, 1: "version", 2: "alpha_budget.total", 3: "bake_profiles", 9: "json"}
    lab = ps.labelled_windows(spark.createDataFrame([(json.dumps({"a.csv": [["t1", "t2"]], "b.csv": []}),)], "value string"))
    assert rows(lab) == [("a.csv", "t1", "t2")]


def test_csv_series(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,value\nt0,1.5\nt1,2\n")
    assert [(r.row, r.value) for r in ps.csv_series(spark, str(tmp_path / "a.csv")).orderBy("row").collect()] == [(0, 1.5), (1, 2.0)]
    (tmp_path / "b.csv").write_text("timestamp,value\nt0,1.5\nt1,oops\n")
    with pytest.raises(Exception, match="row 1"):
        ps.csv_series(spark, str(tmp_path / "b.csv")).collect()


def test_snapshot_hash(spark):
    n = spark.createDataFrame([("a", "rack"), ("b", "gpu_shard")], "id string, kind string")
    e = spark.createDataFrame([("a", "b", "contains")], "src string, dst string, relationship string")
    assert topology.snapshot_hash(n, e).first()[0] == topology.snapshot_hash(n.orderBy("kind"), e).first()[0]


def test_parsers_refuse_what_is_malformed(spark, tmp_path):
    from sparkvigil.operators import evaluators as ea

    line = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    for bad in ("n[3-1]", "n[a-b]", "n[1-2-3]"):
        with pytest.raises(Exception, match="bad host range"):
            line(bad).select(ps.expand_hostlist(F.col("value"))).collect()
    with pytest.raises(Exception, match="bad topology line"):
        ps.switch_topology(line("SwitchName=s Nodes=a Colour=red"))[0].collect()
    (tmp_path / "bench").mkdir()
    (tmp_path / "bench" / "a.csv").write_text("timestamp,value\n2020-01-01,1\n2020-01-02,2\n")
    assert ps.benchmark_files(spark, str(tmp_path)).first().dataset == "bench/a.csv"
    ends = ps.series_ends(ps.csv_series(spark, str(tmp_path / "bench"))).first()
    assert (ends.first_timestamp, ends.last_timestamp, ends.n) == ("2020-01-01", "2020-01-02", 2)
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        ps.benchmark_files(spark, str(tmp_path / "none")).collect()
    good = '{"version": "phase-e-slice10-v1", "source": "s", "generated_at": "t", "baseline": {"mean": 2.0, "sigma_squared": 4.0}, "ar1": {"phi": 0.5, "sigma_squared_innovation": 1.0}, "seasonal": {"period": 2, "seasonal_means": [1, 2], "ar1_phi_deseasoned": 0.25, "sigma_squared_innovation_deseasoned": 0.0}}'
    (tmp_path / "s.json").write_text(good)
    p = ea.substrate_parameters(ea.substrate(spark, str(tmp_path / "s.json"))).first()
    assert (p.mean, p.variance, p.tau_squared, p.delta_min, p.phi, p.min_peak_lag, p.null_quantile) == (2.0, 1.0, 0.5, 1.5, 0.25, 3, 0.9)
    (tmp_path / "t.json").write_text(good.replace("slice10", "slice9"))
    with pytest.raises(Exception, match="not a substrate"):
        ea.substrate(spark, str(tmp_path / "t.json")).collect()


TPU = {"tpu_version": "v4", "slice_shape": [4, 4, 4], "chips": [{"chip": "a", "ici_peers": ["b", "a", "z"]}, {"chip": "b", "ici_peers": ["a"]}, {"chip": "c"}]}


def documents(spark, **docs):
    return spark.createDataFrame([(k, v if v is None or isinstance(v, str) else json.dumps(v)) for k, v in docs.items()], "source string, value string")


def test_chip_meshes(spark):
    shots, nodes, edges = ac.tpu_topology(documents(spark, one=TPU, two=TPU | {"tpu_version": "v5e", "slice_shape": [2, 4, 4.0], "topology_type": "mesh"}))
    assert rows(shots) == [("one", "tpu_topology_source", "tpu-v4-1", "v4", False, None), ("two", "tpu_topology_source", "tpu-v5e-1", "v5e", True, None)]
    assert rows(nodes.where("source = 'one'")) == [("one", x, x, "tpu_shard") for x in "abcz"]
    assert rows(edges.where("source = 'two'")) == [("two", "a", "b", "tpu_ici_peer"), ("two", "a", "z", "tpu_ici_peer")]


def test_malformed_chip_meshes(spark):
    bad = {
        "TPU_PARSE_INVALID_JSON": ["{", None, ""], "TPU_PARSE_MISSING_TPU_VERSION": [[], 3, {}, TPU | {"tpu_version": ""}, TPU | {"tpu_version": 4}], "TPU_PARSE_UNKNOWN_TPU_VERSION: v9": [TPU | {"tpu_version": "v9"}],
        "TPU_PARSE_INVALID_SLICE_SHAPE": [TPU | {"slice_shape": x} for x in (None, "4x4x4", [4, 4], [4, 4, 0], [4, 4, 1.5], [4, 4, "4"], ["4", "4", "4"])], "TPU_PARSE_MISSING_CHIPS": [TPU | {"chips": x} for x in (None, {}, "a")], "TPU_PARSE_NO_CHIPS": [TPU | {"chips": []}],
    }
    docs = {f"{code}#{i}": x for code, many in bad.items() for i, x in enumerate(many)}
    shots, nodes, edges = ac.tpu_topology(documents(spark, **docs), strict=False)
    assert {r.source: r.problem for r in shots.collect()} == {k: k.split("#")[0] for k in docs} and not nodes.collect() and not edges.collect()
    with pytest.raises(Exception, match="TPU_PARSE_NO_CHIPS in x"):
        ac.tpu_topology(documents(spark, x=TPU | {"chips": []}))[0].collect()


def test_device_lists(spark):
    docs = {"t": {"instance_type": "trn1.32xlarge", "neuron_devices": [{"neuron_device": 0, "connected_to": [1, 0]}, {"neuron_device": 1, "connected_to": [0, 2]}]}, "i": {"instance_type": "inf2", "neuron_devices": [{"neuron_device": 0}]}}
    shots, nodes, edges = ac.neuron_topology(documents(spark, **docs))
    assert rows(shots) == [("i", "neuron_topology_source", "neuron-1", "inferentia", True, None), ("t", "neuron_topology_source", "neuron-1", "trainium", False, None)]
    assert rows(nodes) == [("i", "neuron-0", "neuron-0", "inferentia_chip"), *(("t", f"neuron-{i}", f"neuron-{i}", "trainium_chip") for i in range(3))]
    assert rows(edges) == [("t", "neuron-0", "neuron-1", "neuron_link_peer"), ("t", "neuron-1", "neuron-2", "neuron_link_peer")]
    bad = {"NEURON_PARSE_INVALID_JSON": "{", "NEURON_PARSE_MISSING_INSTANCE_TYPE": {"instance_type": 3}, "NEURON_PARSE_UNKNOWN_INSTANCE_TYPE: p4": {"instance_type": "p4"}, "NEURON_PARSE_MISSING_NEURON_DEVICES": {"instance_type": "trn1"}, "NEURON_PARSE_NO_DEVICES": {"instance_type": "trn1", "neuron_devices": []}}
    assert {r.source: r.problem for r in ac.neuron_topology(documents(spark, **bad), strict=False)[0].collect()} == {k: k for k in bad}
