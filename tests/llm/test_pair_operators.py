"""Near duplicates, repeated substrings, decontamination and vector search against brute force."""

import random

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftguard.llm import near_duplicates as near
from siftguard.llm import vector_search
from siftguard.llm.decontamination import contamination, remove_contaminated
from siftguard.llm.substrings import substring_report
from tests.llm import brute
from tests.llm.conftest import ODD

random.seed(4)
VOCABULARY = [f"w{i}" for i in range(3000)]


def _text(n):
    return " ".join(random.choice(VOCABULARY) for _ in range(n))


def _edited(text, rate):
    return " ".join(random.choice(VOCABULARY) if random.random() < rate else w for w in text.split())


def _near_rows():
    """A hot group with edits on both sides of the threshold, chains, exact copies, short texts."""
    base = _text(120)
    rows = [(100 + i, _edited(base, random.choice([0, 0.01, 0.03, 0.06, 0.1]))) for i in range(150)]
    chain = _text(80).split()
    rows += [(500 + i, " ".join(chain[5 * i:] + _text(5 * i).split()[:5 * i])) for i in range(6)]
    rows += [(600 + i, " ".join(base.split()[:120 - 4 * i])) for i in range(8)]
    rows += [(700, "one two"), (701, "ONE two"), (702, "one two three"), (703, "A  b\tc d e"), (704, "a b c d e")]
    rows += [(800 + i, _text(60)) for i in range(60)]
    return rows + ODD


def test_near_duplicates(documents):
    rows = _near_rows()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.near_duplicates(documents(rows)).collect()}
    want = brute.near_duplicates([r for r in rows if r[0] is not None])
    assert got.pop(None) == (3, None, True)
    assert got == want
    assert len({c for _, c, _ in want.values()}) < len(want)


def test_near_duplicates_of_nothing_and_of_repeated_rows(documents):
    assert near.near_duplicates(documents([])).count() == 0
    text = _text(30)
    docs = documents([(1, text), (1, text), (2, text), (3, None)])
    assert sorted((r.doc_id, r.component_id, r.kept) for r in near.near_duplicates(docs).collect()) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    kept = near.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 1, 3]


def test_estimates_and_merging():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.6, 0.75, 0.9):
        n = 2000
        common = rng.integers(0, 2**63, int(2 * n * share / (1 + share)), dtype=np.uint64)
        sets = [np.unique(np.concatenate([common, rng.integers(0, 2**63, n - len(common), dtype=np.uint64)])) for _ in range(2)]
        a, b = (near.registers(s, np.array([0, len(s)])) for s in sets)
        size = [np.array([len(s)]) for s in sets]
        exact = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        assert abs(near.estimated_similarity(a, b, *size)[0] - exact) < 0.12
        union = np.union1d(*sets)
        assert (near.merged(a, b) == near.registers(union, np.array([0, len(union)]))).all()


def test_connected(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)] + [(1000, 1000 + i) for i in range(1, 200)]
    got = {r.node: r.low for r in near.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 95: 90, 100: 90, **{1000 + i: 1000 for i in range(1, 200)}}


def test_steps_of_connected_stay_small_plans(spark, monkeypatch):
    """The driver plans and compiles every step, so a step may not hold its input many times over."""
    scans = []

    def noted(frame, name, inner=near.saved):
        scans.append(frame._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return inner(frame, name)

    monkeypatch.setattr(near, "saved", noted)
    rows = near.connected(spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 60), (70, 60)], "a long, b long")).collect()
    assert {(r.node, r.low) for r in rows} == {(i, 1) for i in range(2, 41)} | {(60, 50), (70, 50)}
    assert len(scans) > 2 and max(scans) <= 4


def _passages():
    shared, hot = _text(60), _text(50)
    rows = [(i, f"{_text(random.randint(0, 40))} {hot} {_text(random.randint(0, 40))}") for i in range(100, 220)]
    rows += [(300, f"{_text(20)} {shared} {_text(10)}"), (301, shared), (302, " ".join(shared.split()[3:38]) + " tail"), (303, " ".join(shared.split()[3:37]) + " tail")]
    rows += [(400, "same " * 80), (401, f"{shared} x {shared}"), (402, hot), (402, hot), (403, "\n".join([_text(36)] * 3))]
    return rows + ODD


def test_repeated_substrings(documents):
    rows = _passages()
    got = substring_report(documents(rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute.substrings(rows), key=str)
    assert sum(r.n_removed for r in got) > 1000


def test_kept_text_and_spans(documents):
    shared = _text(40)
    got = {r.doc_id: r for r in substring_report(documents([(1, f"a {shared} b"), (2, f"c  {shared}"), (3, "d")]), with_text=True).collect()}
    assert (got[1].kept_text, got[1].spans, got[2].kept_text, got[2].spans, got[3].spans) == ("a b", "1:41", "c", "1:41", "")
    assert substring_report(documents([])).count() == 0


ITEMS = [(1, "Alpha beta GAMMA, delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short one"), (3, None), (4, "..."), (None, "no id here at all"),
         (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "short one"), (10, "é ü")]


@pytest.mark.parametrize("most", [1000, 2])
def test_decontamination(spark, documents, most):
    rows = [(100, "x alpha-beta gamma delta epsilon zeta eta theta iota kappa lambda y"), (101, "alpha beta gamma delta"), (102, "a SHORT one, short ONE"), (103, "é ü É ü"), (104, "shorts one")] + ODD
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = contamination(documents(rows), items, max_windows=most, with_text=True).collect()
    want = brute.decontamination(rows, [i for i in ITEMS if i[0] is not None])
    assert {r.doc_id: tuple(r)[1:6] for r in got} == want
    clean = {r.doc_id: r.clean_text for r in got}
    assert clean[102] == "a  ,  " and clean[101] == "alpha beta gamma delta" and clean[1] is None
    kept = remove_contaminated(documents(rows), items, max_windows=most)
    assert kept.columns == documents(rows).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(d or 0 for d, v in want.items() if not v[4])


def test_decontamination_of_nothing(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(documents([]), none).count() == 0
    assert [tuple(r)[1:4] for r in contamination(documents([(1, "a b")]), none).collect()] == [(2, 0, 0)]


@pytest.mark.parametrize("scale", [1, 1 << 18, 1 << 40])
@pytest.mark.parametrize("shard_rows", [1000, 40])
def test_vector_search(spark, shard_rows, scale):
    """Against every pair of rows; a third of them share one id, and products need more bits from one scale to the next."""
    rng = np.random.default_rng(2)
    vectors = np.concatenate([rng.integers(-20, 20, (100, 6)), np.tile([3, 1, 4, 1, 5, 9], (30, 1))]) * scale
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(40, v.tolist()) for v in rng.integers(-9, 9, (60, 6)) * scale]
    rows += [(0, vectors[0].tolist()), (900, [1, 2]), (920, []), (901, [5, -1])]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = Counter(tuple(r) for r in vector_search.nearest(frame, frame.where("vec_id % 20 = 0"), top=7, shard_rows=shard_rows, block=3).collect())
    want = Counter()
    for k, (q, v) in enumerate(rows):
        if q % 20 == 0:
            score = lambda w: max(-2**63 + 1, min(2**63 - 1, sum(a * b for a, b in zip(v, w))))
            best = sorted((-score(w), i) for n, (i, w) in enumerate(rows) if n != k and len(w) == len(v))[:7]
            want.update((q, n + 1, i, -s) for n, (s, i) in enumerate(best))
    assert got == want


def test_vectors_that_take_no_part(spark, tmp_path):
    rows = [(0, [1.0, 2.0]), (20, [1e9, -3.0]), (1, [float("nan"), 1.0]), (2, None), (3, [1.0, None]), (4, [5.0, -5.01]), (5, [1e300, 1.0]), (6, [float("inf"), 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r.query_id, r.vec_id) for r in vector_search.op7_exact_top_k(spark, str(tmp_path)).collect())
    assert got == [(0, 4), (0, 5), (0, 20), (20, 0), (20, 4), (20, 5)]


def test_repeated_ids_equal_sql(spark, tmp_path):
    import duckdb

    from siftguard.llm.oracles import TOP_K
    rows = [(20, [1.0, 2.0]), (20, [0.5, 4.0]), (1, [64.0, 1.0]), (1, [32.0, 1.0]), (1, [64.0, 1.0]), (40, [0.0, -1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = vector_search.op7_exact_top_k(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(TOP_K).fetchall()) and sum(r.vec_id == 1 for r in got) == 9


def test_box_bounds_hold():
    rng = np.random.default_rng(3)
    vectors, queries = rng.integers(-50, 50, (700, 5)), rng.integers(-50, 50, (30, 5))
    tree = vector_search.KdTree(vectors, leaf_rows=16)
    for node, (a, b) in enumerate(tree.range):
        assert (tree.bounds(node, queries) >= (queries @ vectors[tree.order[a:b]].T).max(1)).all()
    assert sorted(tree.order) == list(range(700))


def test_no_documents_column_is_touched(documents):
    docs = documents(ODD).withColumn("doc", F.lit(1)).withColumn("lead", F.lit(2))
    assert near.keep_one_of_each(docs).columns == docs.columns


def test_removal_of_null_and_repeated_ids_does_not_depend_on_the_benchmark_size(spark, documents):
    item = " ".join(f"q{i}" for i in range(12))
    items = spark.createDataFrame([("i1", item)], "item_id string, text string")
    rows = [(None, f"x {item} y"), (None, "clean without id"), (None, None), (7, item), (7, "clean with the same id"), (7, item), (8, "clean"), (8, "clean")]
    kept = [sorted(map(str, remove_contaminated(documents(rows), items, max_windows=most).collect())) for most in (1, 1000)]
    assert kept[0] == kept[1] and len(kept[0]) == 5
