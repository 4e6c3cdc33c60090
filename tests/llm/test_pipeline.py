"""The pipeline's stages against brute-force versions, one after the other."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as pipeline  # noqa: E402
from sparkvigil.llm import pieces  # noqa: E402
from sparkvigil.llm.store import documents, written  # noqa: E402

from .test_operators import WORD, components_brute, lower, quality_brute, removed_brute  # noqa: E402


def test_stages(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = {r.doc_id: r for r in docs.collect()}
    texts = {d: r.text for d, r in rows.items()}
    items = [(r.item_id, WORD.findall(lower(r.text))) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in pipeline.STAGES:
        out = written(stage(spark, docs, sf_dir))
        got = {r.doc_id: r for r in out.collect()}
        if name == "quality rules":  # too few labels at this size for any certified cutoff
            want = {d for d, t in texts.items() if (q := quality_brute(t))[0] >= 20 and 100 * q[4] <= 30 * q[0]}
            assert set(got) == want
        elif name == "near-duplicates":
            assert set(got) == {d for d, c in components_brute(texts.items(), 80).items() if c == d}
        elif name == "suffix dedup":
            want = {d: n - gone for d, n, gone, _, _ in removed_brute(sorted(texts.items()), 100)}
            assert set(got) == set(texts) and all(abs(len(r.text.encode()) - want[d]) <= 6 for d, r in got.items())
        elif name == "benchmark decontamination":
            whole = {d for d, t in texts.items() if any(f" {' '.join(w)} " in f" {' '.join(WORD.findall(lower(t)))} " for _, w in items)}
            assert not whole & set(got) and len(got) >= len(texts) - len(whole) - 5
        else:
            assert {r.doc_id: r.text for r in pieces.decoded(out, pieces.model_path()).collect()} == texts
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs, texts = out, {d: r.text for d, r in got.items()}
    assert pipeline.run(spark, sf_dir).count() == len(texts)
