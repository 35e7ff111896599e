"""Language identification, toxicity and mixing."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from siftguard.llm import language_id, mixing, toxicity
from siftguard.llm.oracles import ORACLES
from tests.llm.conftest import DOCS, ODD

SF = "/root/testdata/sf0.01"


def _fold(doc, parts):
    return zlib.crc32(str(doc).encode()) % parts


def test_languages_on_the_held_out_fold(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = language_id.op4_language_id(spark, SF).collect()
    assert len(rows) == len(truth) and all(r.held_out == (_fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_language_of_odd_texts(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    model = language_id.fit(docs)
    odd = documents(ODD + [(9, "12 !? —"), (10, "…"), (11, "中文")])
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in language_id.identified(odd, model).collect()}
    assert [d for d, (lang, _) in got.items() if lang == "und"] == [1, 2, 3, 9, 10] and got[9][1] == 0
    assert got[11][0] in ("de", "en", "es", "fr")
    assert language_id.fit(documents([])) is None
    assert {r.lang_pred for r in language_id.identified(odd, None).collect()} == {"und"}
    kept = language_id.keep_identified(docs.limit(300))
    assert kept.columns == docs.columns and kept.count() == 300


def test_families_come_first():
    rng = np.random.default_rng(0)
    x, langs = [], []
    for k, lang in enumerate(["en", "de", "fr", "es", "ru", "xx"]):
        centre = np.zeros(12)
        centre[[k, 6 + k // 2]] = 1
        x += [centre + rng.normal(0, 0.05, 12) for _ in range(30)]
        langs += [lang] * 30
    model = language_id.LanguageModel(np.array(x, np.float32), langs)
    assert model.families == ["germanic", "romance", "slavic", "xx"] and len(model.pairs) == 2
    assert model.predict(np.array(x, np.float32))[0] == langs


def test_toxicity_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = toxicity.op9_toxicity(spark, sf).collect()
    assert all(r.held_out == (_fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(r.score, r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    hits = sum(p and t for _, p, t in held)
    assert hits > 0.7 * sum(t for *_, t in held) and hits > 0.9 * sum(p for _, p, _ in held)


def test_toxicity_of_odd_tables(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit(documents(ODD), none) is None
    assert {r.toxic_score for r in toxicity.scored(documents(ODD), None).collect()} == {0.0}
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    random.seed(0)
    rows = [(i, " ".join(random.choices(words, k=20)) + (" vile scum" if i % 5 == 0 else "")) for i in range(400)] + ODD
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(10, 400)] + [(None, 1, 1), (99_999, 0, 1), (11, 0, None)], "doc_id long, quality int, toxic int")
    docs = documents(rows)
    got = {r.doc_id: r.toxic_score for r in toxicity.scored(docs, toxicity.fit(docs, labels)).collect()}
    assert min(got[i] for i in range(10, 400, 5)) > max(got[i] for i in range(11, 400, 5)) and len(got) == 401


def test_selection_and_risk_find_the_signal():
    rng = np.random.default_rng(1)

    def rows(n, toxic):
        out = []
        for _ in range(n):
            index = set(rng.integers(0, 500, 20).tolist()) | ({600} if toxic else set())
            out.append((np.array(sorted(index), np.uint16).tobytes(), np.ones(len(index), np.float32).tobytes()))
        return out

    positive, unlabelled = toxicity.Sparse(rows(60, True)), toxicity.Sparse(rows(400, False) + rows(40, True))
    use = toxicity.telling(positive, unlabelled)
    w, b = toxicity.nn_pu(positive.only(use), unlabelled.only(use), 0.09)
    w = w * use
    fresh = toxicity.Sparse(rows(100, True) + rows(100, False)).dot(w) + b
    assert np.median(fresh[:100]) > np.quantile(fresh[100:], 0.95) and w.argmax() == 600


def _mix_docs(spark):
    random.seed(2)
    rows = [(i, " ".join("t" for _ in range(random.randint(0, 30))), random.choice(["en", "de", None]), f"s{0 if i % 3 else random.randint(0, 12)}", 1) for i in range(900)]
    return spark.createDataFrame(rows + [(None, "a b", "en", "s1", 1), (5000, None, "de", None, None), (5001, "x y", "en", "s1", 1), (5001, "x y", "en", "s1", 1)], DOCS).withColumn("budget", F.lit(7))


def test_budgets_follow_the_tree(spark):
    leaves = spark.createDataFrame([("web", "en", "a", 100), ("web", "en", "b", 1000), ("web", "de", "c", 50), ("ref", "en", "d", 10_000)],
                                   "domain string, lang_leaf string, source_leaf string, limit long")
    got = {r.source_leaf: r.budget for r in mixing.budgets(leaves, 2000.0, {"web": 1.0, "ref": 1.0}).collect()}
    # Half goes to the web; German is full at 50, so English takes 950, of which source a can take 100.
    assert got == {"a": 100, "b": 850, "c": 50, "d": 1000}
    got = {r.source_leaf: r.budget for r in mixing.budgets(leaves, 4000.0, {}).collect()}
    assert got == {"a": 100, "b": 1000, "c": 50, "d": 2850}
    got = {r.source_leaf: r.budget for r in mixing.budgets(leaves, 99_999.0, {"web/de": 0.0}).collect()}
    assert got == {"a": 100, "b": 1000, "c": 0, "d": 10_000}


def test_mixture_fills_the_budgets(spark):
    docs = _mix_docs(spark)
    for share, epochs in ((0.3, 2), (0.9, 3), (5.0, 2)):
        rows = mixing.mixture(docs, share=share, epochs=epochs).collect()
        total = docs.select(mixing.count_tokens(F.col("text"))).groupBy().sum().first()[0]
        taken = sum(r.take_tokens for r in rows)
        assert abs(taken - min(total * share, total * epochs)) <= 40  # a unit per leaf, and rows that share an id
        assert all(0 <= r.take_tokens <= r.n_tokens and r.epoch < epochs for r in rows)
    assert mixing.mixture(docs.limit(0)).count() == 0


def test_mixture_is_seeded(spark):
    docs = _mix_docs(spark)
    pick = lambda seed: {(r.doc_id, r.epoch) for r in mixing.mixture(docs, share=0.2, seed=seed).collect()}
    assert pick(1) == pick(1) != pick(2)


def test_mixed_documents(spark):
    docs = _mix_docs(spark)
    picked, rows = mixing.mixture(docs, share=0.3), mixing.mixed_documents(docs, share=0.3)
    assert rows.columns == [*docs.columns, "epoch", "take_tokens"]
    key = lambda frame: sorted(map(str, frame.select("doc_id", "epoch", "take_tokens").collect()))
    assert key(picked) == key(rows)
    assert rows.where(mixing.count_tokens(F.col("text")) != F.col("take_tokens")).count() == 0


def test_oracles_name_queries():
    from siftguard.llm.queries import QUERIES
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) == 13
