"""The pipeline against its parts, and its registered queries against SQL."""

import pytest

import corpus_pipeline
from __spark_entry__ import queries
from checks.compare import compare
from siftguard.llm import language_id, mixing, secret_scan
from siftguard.llm.oracles import ORACLES
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.saved(stage(spark, before, SF), name)
        ids = sorted(r.doc_id for r in after.select("doc_id").collect())
        rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
        if name == "language_id":
            told = language_id.identified(before, language_id.fit(before)).where("lang_pred <> 'und' and lang_score >= 0.2")
            assert ids == sorted(r.doc_id for r in told.select("doc_id").collect()) and len(ids) > 0.95 * len(rows)
        elif name == "near_dedup":
            assert ids == sorted(d for d, (_, _, kept) in brute.near_duplicates(rows).items() if kept)
        elif name == "decontamination":
            assert ids == sorted(d for d, x in brute.decontamination(rows, items).items() if not x[4])
        elif name == "secret_scan":
            assert ids == sorted(d for d, _ in rows)
            found = secret_scan.secret_report(after).where("n_assign + n_access + n_hex > 0").count()
            assert found == 0
        else:
            want = mixing.mixture(before)
            assert sorted(map(str, want.select("doc_id", "epoch", "take_tokens").collect())) == sorted(map(str, after.select("doc_id", "epoch", "take_tokens").collect()))
        if name != "mixing":
            assert after.columns == docs.columns
        before = after
    assert corpus_pipeline.run(spark, SF).count() == before.count()


@pytest.mark.parametrize("name", sorted(k for k in queries() if k.startswith("op")))
def test_query(spark, name):
    assert compare(spark, name, queries()[name], ORACLES.get(name), SF) == ""
