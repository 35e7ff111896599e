"""One id that owns a third of all rows, very long texts with very many matches, and clashing names."""

import random
import time

import pytest
from pyspark.sql import functions as F

from siftguard.llm import language_id, licenses, mixing, personal_data, secret_scan, substrings, toxicity
from siftguard.llm import spans as S
from tests.llm import brute


@pytest.mark.parametrize("name, report, unit, seconds", [
    ("numbers", personal_data.personal_data_report, "12, ", 60), ("hexadecimal runs", secret_scan.secret_report, "deadbeef" * 5 + " ", 60),
    ("assignments", secret_scan.secret_report, "token=abcdefgh12 ", 60), ("mentions", licenses.license_report, "isc license, ", 90)])
def test_a_megabyte_of_matches_takes_seconds(documents, name, report, unit, seconds):
    text = unit * (1_000_000 // len(unit))
    report(documents([(1, unit * 3)])).collect()
    started = time.perf_counter()
    row = report(documents([(1, text)])).first()
    assert time.perf_counter() - started < seconds
    if name == "hexadecimal runs":
        assert row.n_hex == len(text) // len(unit) and tuple(row)[1:5] == brute.secrets(text)
    elif name == "assignments":
        assert tuple(row)[1:5] == brute.secrets(text)


def test_many_spans_are_blanked_in_order(spark):
    rng = random.Random(4)
    for n in (0, 1, 300, 3000):
        text = "".join(rng.choice("abcé😀") for _ in range(5 * n + 7))
        spans = [(a := rng.randint(0, len(text) - 1), min(len(text), a + rng.randint(1, 9))) for _ in range(n)]
        at, want = 0, []
        for a, b in sorted(spans):
            if a >= at:
                want += [text[at:a], "#"]
            at = max(at, b)
        frame = spark.createDataFrame([(text, spans)], "t string, s array<struct<start:int,end:int>>")
        assert frame.select(S.blanked(F.col("t"), F.col("s"), "#")).first()[0] == "".join(want) + text[at:]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running_results(spark, n):
    values = [random.Random(n + i).randint(-50, 50) for i in range(n)]
    frame = spark.createDataFrame([(values,)], "v array<int>")
    got = frame.select(S.running(F.col("v"), "int", lambda a, b: a + b).alias("s"), S.running(F.col("v"), "int", lambda a, b: F.greatest(a, b)).alias("m")).first()
    assert got.s == [sum(values[:i + 1]) for i in range(n)] and got.m == [max(values[:i + 1]) for i in range(n)]


def test_spans_within_and_clear_of_others(spark):
    rng = random.Random(9)
    make = lambda n: [("k", a := rng.randint(0, 60), a + rng.randint(1, 12), "x") for _ in range(n)]
    cases = [(make(rng.randint(0, 9)), make(rng.randint(0, 9))) for _ in range(150)]
    rows = spark.createDataFrame([(i, b, s) for i, (b, s) in enumerate(cases)], f"i int, b {S.SPAN}, s {S.SPAN}")
    got = {r.i: (sorted((x.start, x.end) for x in r.w), sorted((x.start, x.end) for x in r.c)) for r in rows.select(
        "i", S.not_within(F.col("s"), F.col("b")).alias("w"), S.clear_of(F.col("s"), F.col("b")).alias("c")).collect()}
    for i, (base, spans) in enumerate(cases):
        within = sorted((a, b) for _, a, b, _ in spans if not any(x <= a and y >= b for _, x, y, _ in base))
        clear = sorted((a, b) for _, a, b, _ in spans if not any(x < b and y > a for _, x, y, _ in base))
        assert got[i] == (within, clear)


def test_the_allow_list_hides_what_it_matches_only(documents):
    key = "q9ZkQ2mN5pL7xV3cB9wE4rT6yU1i"
    private = "b3BlbnNzaC1rZXktdjEAAAAABG5vbmU" + "AAAAAAAA" + key
    rows = [(1, f"srv/example/{key}/x"), (2, private), (3, f"EXAMPLE{key}"), (4, "xxxx1111" * 5), (5, f"{key}-123e4567-e89b-12d3-a456-426614174000")]
    got = {r.doc_id: r.spans for r in secret_scan.secret_report(documents(rows)).collect()}
    assert got[1].startswith("entropy:") and got[2].startswith("entropy:") and got[5].startswith("entropy:0:") and got[3] == got[4] == ""
    assert key not in secret_scan.redact_secrets(documents(rows)).where("doc_id = 2").first().text


def test_weight_zero_counts_for_no_limit_above(spark):
    leaves = spark.createDataFrame([("web", "en", "a", 100), ("web", "de", "c", 5000), ("ref", "en", "d", 10_000)],
                                   "domain string, lang_leaf string, source_leaf string, limit long")
    got = {r.source_leaf: r.budget for r in mixing.budgets(leaves, 2000.0, {"web/de": 0.0}).collect()}
    assert got == {"a": 100, "c": 0, "d": 1900}


def _hot(spark, rows):
    """The rows, and half as many again under one id, and some without an id."""
    more = [(7, t) for _, t in rows[:len(rows) // 2]] + [(None, t) for _, t in rows[:20]]
    return spark.createDataFrame([(i, t, "en" if k % 2 else "de", "s1", 1) for k, (i, t) in enumerate(rows + more)], "doc_id long, text string, lang string, source string, n_chars long")


def test_a_hot_id_counts_once_in_the_samples(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rng = random.Random(3)
    docs = _hot(spark, [(100 + i, " ".join(rng.choices(words, k=20)) + (" vile scum" if i % 5 == 0 else "")) for i in range(300)])
    labels = spark.createDataFrame([(100 + i, 1, int(i % 5 == 0)) for i in range(300)] + [(7, 1, 0)], "doc_id long, quality int, toxic int")
    sent = []
    vectors = toxicity._vectors
    toxicity._vectors = lambda texts: sent.append(texts.groupBy("doc_id", "role").count().where("count > 1").count()) or vectors(texts)
    try:
        model = toxicity.fit(docs, labels)
    finally:
        toxicity._vectors = vectors
    assert sent == [0] and model is not None
    assert toxicity.scored(docs, model).count() == 470
    first, second = language_id.fit(docs), language_id.fit(docs.repartition(7))
    assert (first.first == second.first).all() and (first.second == second.second).all()


def test_repeated_texts_under_one_id(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=60))
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(10, 120))) + (f" {passage}" if i % 9 == 0 else "")) for i in range(60)]
    hot = [(7, rows[3][1])] * 40 + [(None, rows[5][1])] * 10 + [(7, f"{passage} a b {passage}")]
    docs = spark.createDataFrame(rows + hot, "doc_id long, text string")
    got = sorted(tuple(map(str, r)) for r in substrings.substring_report(docs).collect())
    assert got == sorted(tuple(map(str, r)) for r in brute.substrings(rows + hot))


def test_inner_names_do_not_clash(spark, documents):
    docs = documents([(1, "token = abcdefgh12 and some words"), (2, "12345")]).withColumns(
        {n: F.lit(n) for n in ("__base", "__secrets", "lang_pred", "lang_score", "__hits", "__doc", "__text")})
    out = secret_scan.redact_secrets(docs)
    assert out.columns == docs.columns and {r.doc_id: (r["__base"], r["__secrets"]) for r in out.collect()} == {1: ("__base", "__secrets"), 2: ("__base", "__secrets")}
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and [(r.doc_id, r.lang_pred, r.lang_score) for r in kept.collect()] == [(1, "lang_pred", "lang_score")]
    from siftguard.llm.decontamination import remove_contaminated
    items = spark.createDataFrame([("x", "abcdefgh12 and some words"), ("y", "more of it")], "item_id string, text string")
    for most in (100, 1):
        clean = remove_contaminated(docs, items, max_windows=most)
        assert clean.columns == docs.columns and [(r.doc_id, r["__doc"], r["__hits"]) for r in clean.collect()] == [(2, "__doc", "__hits")]
