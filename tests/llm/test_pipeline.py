"""Every stage of the pipeline on its own input, against a plain version where there is one."""

import collections

import corpus_pipeline
import pytest
from test_operators_llm import plain_components, plain_lines


@pytest.fixture(scope="module")
def results(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, sf).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = (before.collect(), docs.collect())
        if name != "pack":
            assert docs.columns == before.columns
    return out


def test_quality_keeps_good_documents(spark, sf, results):
    before, after = results["quality"]
    kept = {r.doc_id for r in after}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert kept < {r.doc_id for r in before}
    good = [r.doc_id in kept for r in labels if r.quality == 1]
    bad = [r.doc_id in kept for r in labels if r.quality == 0]
    assert sum(good) > 0.95 * len(good) and sum(bad) < 0.2 * len(bad)


def test_lines(results):
    before, after = results["lines"]
    want = plain_lines([(r.doc_id, r.text) for r in before], 10, 1, False)
    assert sorted((r.doc_id, r.text) for r in after) == [(r[0], r[1]) for r in want]
    assert all(r.n_chars == len(r.text) for r in after)


def test_near_copies(results):
    before, after = results["near_copies"]
    want = plain_components([(r.doc_id, r.text) for r in before], 5, 80, 100)
    assert sorted(r.doc_id for r in after) == sorted({c for _, _, c in want})
    texts = {r.doc_id: r.text for r in before}
    assert all(texts[r.doc_id] == r.text for r in after)


def test_mix_and_pack(results):
    before, after = results["mix"]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before}
    assert 0.7 * len(before) < len(after) < 1.4 * len(before)
    copies = collections.Counter(r.doc_id for r in after)
    _, pieces = results["pack"]
    assert collections.Counter(r.doc_id for r in pieces if r.piece == 0) == copies
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces)


def test_run_gives_the_last_stage(spark, sf, results):
    assert corpus_pipeline.run(spark, sf).count() == len(results["pack"][1])
