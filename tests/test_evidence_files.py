"""Evidence folders of all layouts, their supersessions, and the table that scoring takes."""

import json

import pytest

from sparkvigil.operators import scoring
from sparkvigil.sources import evidence_files as ef


def put(root, **docs):
    for name, doc in docs.items():
        path = root / f"{name.replace('__', '/')}.json"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(doc if isinstance(doc, str) else json.dumps(doc))


def corpus(root, supersedes=None, registry=None):
    a, b, c, d, e = "alpha__results__live__run-1__", "alpha__results__live__run-2__", "beta__results__live__run-1__", "gamma__results__live__run-1__", "gamma__results__live__run-9__"
    cell = lambda det, null, **more: {"detector": det, "null_id": null, "verdict": "CLEARED"} | more
    put(root, **{
        f"{a}manifest": {"study": "2026-alpha", "git_sha": "s1"},
        f"{a}summary": {"cells": [cell("bet", "N1", alpha=0.05, crossing_rate=0.01), cell("mix", "N3-p06", verdict="REFUTED")]},
        f"{a}endpoints": [cell("ignored", "N1")],
        f"{a}cells__x": cell("bet", "N1", alpha=0.050), f"{a}cells__y": [cell("bet", "N2-m100"), cell("bet", "N2-m100"), {"no": "detector"}],
        f"{b}manifest": {"study": "2026-alpha", "tier": "T2", "supersedes": supersedes}, f"{b}endpoints": {"cells": [cell("mix", "N3-p06", phi=0.5)]},
        f"{c}cells__one": {"arm": "x", "null_id": "N1", "sui_crossing": 0.1, "sui_verdict": "REFUTED", "ui_mean_e": 1.5, "ui_verdict": "CLEARED"}, f"{c}cells__two": {"what": "is this"},
        f"{d}summary": [cell("spectral", None, increment_estimator={"mean": 2e6, "sd": 1.0}, crossing_rate=0)], f"{d}manifest": {"supersedes": {"priorRun": "run-0", "defect": "phi"}}, f"{e}manifest": {"study": "gamma"},
    })
    if registry is not None:
        put(root, alpha__results__live__SUPERSESSIONS=registry)
    return str(root)


def test_layouts(spark, tmp_path):
    e = ef.load(spark, corpus(tmp_path))
    want = [("2026-alpha", "run-1", "bet", "N1", 0.0, True), ("2026-alpha", "run-1", "mix", "N3-p06", 0.6, True), ("2026-alpha", "run-1", "bet", "N2-m100", 0.0, True), ("2026-alpha", "run-2", "mix", "N3-p06", 0.5, False)]
    want += [("beta", "run-1", d, "N1", 0.0, True) for d in ("sequential_ui_e_process", "universal_inference_e_value")] + [("gamma", "run-1", "spectral", None, None, False)]
    assert sorted(((r.study, r.run, r.detector, r.null_id, r.phi, r.phi_derived) for r in e.cells.collect()), key=str) == sorted(want, key=str)
    assert {(r.study, r.run, r.tier, r.git_sha) for r in e.runs.collect()} == {("2026-alpha", "run-1", "T1", "s1"), ("2026-alpha", "run-2", "T2", None), ("beta", "run-1", "T1", None), ("gamma", "run-1", "T1", None)}
    assert {(r.study, r.run) for r in e.skipped.collect()} == {("beta", "run-1"), ("gamma", "run-9")}
    assert [(r.declared_by, r.run, r.defect, r.covered_by_registry) for r in e.unhonoured.collect()] == [("gamma/run-1", "run-0", "phi", False)] and not e.superseded.collect()
    wide = {r.detector: r.fields for r in e.cells.where("study = 'beta'").collect()}
    assert set(wide["sequential_ui_e_process"]) == {"arm", "null_id", "crossing_rate", "verdict"} and set(wide["universal_inference_e_value"]) == {"arm", "null_id", "mean_e", "verdict"}


ENTRY = {"study": "2026-alpha", "run": "run-1", "detectors": ["mix"], "reason": "defect"}


def test_supersession(spark, tmp_path):
    e = ef.load(spark, corpus(tmp_path, [ENTRY], [ENTRY | {"declared_by": "A1", "reason": "amended"}]))
    assert ("2026-alpha", "run-1", "mix") not in {(r.study, r.run, r.detector) for r in e.cells.collect()}
    assert [(r.run, r.detector, r.superseded_by, r.reason, r.source, r.cells) for r in e.superseded.collect()] == [("run-1", "mix", "A1", "amended", "registry", 1)]


@pytest.mark.parametrize(
    "supersedes, registry, problem",
    [
        ("yes", None, "must be an array"), ([ENTRY | {"reason": ""}], None, "needs study"), ([ENTRY | {"detectors": []}], None, "needs study"), ([ENTRY | {"run": "run-2"}], None, "supersede itself"), ([ENTRY | {"run": "run-7"}], None, "not there"),
        ([ENTRY | {"detectors": ["mix", "typo"]}], None, "does not have, typo"), (None, {"study": "x"}, "must be an array"), (None, [ENTRY], "declared_by"), (None, [ENTRY | {"study": "beta", "declared_by": "A"}], "another study"), (None, [ENTRY | {"detectors": ["bet"], "declared_by": "A"}], "leaves no run with cells of bet"),
    ],
)
def test_wrong_declarations(spark, tmp_path, supersedes, registry, problem):
    with pytest.raises(ValueError, match=problem):
        ef.load(spark, corpus(tmp_path, supersedes, registry))


def test_broken_json(spark, tmp_path):
    put(tmp_path, alpha__results__live__run__summary="{")
    with pytest.raises(Exception, match="is no JSON"):
        ef.load(spark, str(tmp_path)).cells.collect()


def test_scored(spark, tmp_path):
    e = ef.load(spark, corpus(tmp_path))
    cards = spark.createDataFrame(
        [("BET", "bet", None, "e_process", 0.5, False, None), ("MIX", "mixture", ["mix"], "test_martingale", None, False, None), ("UI", "universal_inference_e_value", None, "terminal_e_value", None, False, None), ("SPEC", "spectral", None, "test_martingale", None, False, None), ("NONE", "nothing", None, "e_process", None, False, None)],
        "card string, detector_id string, aliases array<string>, cls string, phi_max double, phi_known boolean, m_min double",
    )
    each, status = scoring.validity(ef.judged(e.cells, cards))
    got = {(r.card, r.run.split("/")[0], r.null_id): (r.guard, r.raw, r.outcome) for r in each.collect()}
    assert got["UI", "beta", "N1"] == ("OK", "CLEARED", "REFUTED")  # its mean is above 1
    assert got["SPEC", "gamma", None][2] == "excluded" and got["BET", "2026-alpha", "N1"] == ("OK", "CLEARED", "CLEARED")
    assert {r.card: r.status for r in status.collect()} == {"BET": "PASS", "MIX": "REFUTED", "UI": "REFUTED", "SPEC": "VOID"}
