"""Feeds over a local endpoint."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from sparkvigil.sources import feeds


@pytest.fixture(scope="module")
def server():
    hits = []

    class H(BaseHTTPRequestHandler):
        def do_GET(self):
            hits.append(self.path)
            body = {"nodes": [{"id": "a", "service_name": "s", "kind": "rack"}], "edges": [{"from": "a", "to": "b", "relationship": "calls"}]} if self.path == "/graph" else {"x": 1}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_POST(self):
            n = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["n"]
            self.send_response(n)
            self.end_headers()

        def log_message(self, *a):
            pass

    s = HTTPServer(("127.0.0.1", 0), H)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", hits
    s.shutdown()


def test_service_graph(spark, server):
    url, hits = server
    for now in (0.0, 30.0, 61.0):
        nodes, edges = feeds.service_graph(spark, f"{url}/graph", now=lambda now=now: now)
    assert hits.count("/graph") == 2 and nodes.first().id == "a" and edges.first().dst == "b"
    with pytest.raises(ValueError):
        feeds.service_graph(spark, f"{url}/other")


def test_post(spark, server):
    url, _ = server
    df = spark.createDataFrame([("a", '{"n": 202}'), ("b", '{"n": 404}'), ("c", '{"n": 503}'), ("d", "{")], "group_id string, request string")
    got = {r.group_id: (r.outcome, r.status) for r in feeds.post(df, url).collect()}
    assert got == {"a": ("accepted", 202), "b": ("client_error", 404), "c": ("server_error", 503), "d": ("invalid", None)}
    assert feeds.post(df.limit(1), "http://127.0.0.1:9").first().outcome == "network"


def test_post_new_sends_what_is_not_settled(spark, server, tmp_path):
    url, _ = server
    df = spark.createDataFrame([("a", '{"n": 202}'), ("a", '{"n": 202}'), ("b", '{"n": 404}'), ("c", '{"n": 503}'), ("d", "{"), (None, '{"n": 200}'), ("e", None)], "group_id string, request string")
    calls = [{(r.group_id, r.outcome, r.status) for r in feeds.post_new(df, url, str(tmp_path / "ledger")).collect()} for _ in range(2)]
    assert calls[0] == {("a", "accepted", 202), ("b", "client_error", 404), ("c", "server_error", 503), ("d", "invalid", None), (None, "accepted", 200), ("e", "invalid", None)}
    assert calls[1] - {(None, "accepted", 200)} == {("c", "server_error", 503)}


def test_deploy_events(spark):
    ok = {"contract_version": "v1", "event": {"event_id": "e", "event_class": "env_change", "event_ts": 5.0}, "emitted_at_ts": 6.0}
    lines = [json.dumps(ok), json.dumps(ok | {"contract_version": "v2"}), "nonsense"]
    good, bad = feeds.deploy_events(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert good.first().event_id == "e" and good.count() == 1 and {r.reason for r in bad.collect()} <= {"contract_version", "json"} and bad.count() == 2


def test_isolated_sinks(spark):
    seen = []

    def broken(batch, epoch):
        raise RuntimeError("no")

    feeds.isolated(broken, lambda b, e: seen.append((b.count(), e)))(spark.range(3), 7)
    assert seen == [(3, 7)]


def test_report(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "dataset string, score double")
    feeds.write_report(df.withColumn("event", feeds.lifecycle_event("scored", F.struct("score"), F.lit(1))), str(tmp_path / "r"))
    rows = [json.loads(x) for p in (tmp_path / "r").glob("part-*") for x in p.read_text().splitlines()]
    assert len(rows) == 2 and any("score" not in r for r in rows)
