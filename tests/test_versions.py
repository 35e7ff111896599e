"""Ordered versions, affected intervals and the binned interval join, against plain rules."""

import random

import pytest
from pyspark.sql import functions as F

from siftguard.functions.osv import osv_intervals
from siftguard.functions.versions import ordered_version
from siftguard.operators import dependencies as deps
from siftguard.operators.intervals import interval_join, stored, with_bins

SEMANTIC = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.1-0", "1.0.1", "1.2.0", "1.10.0", "2.0.0"]
GENERAL = ["0.9", "1.0.dev1", "1.0a1.dev2", "1.0a1", "1.0a2", "1.0b1", "1.0rc1", "1.0", "1.0.post1", "1.0.post2", "1.0.1", "1.1.dev0", "1.1", "1.10", "v2.0", "1!0.1"]


@pytest.mark.parametrize("versions, semantic", [(SEMANTIC, True), (GENERAL, False)])
def test_versions_sort_by_their_keys(spark, versions, semantic):
    shuffled = random.Random(1).sample(versions, len(versions))
    rows = spark.createDataFrame([(v,) for v in shuffled], "v string").orderBy(ordered_version(F.col("v"), F.lit(semantic))).collect()
    assert [r.v for r in rows] == versions


def test_equal_versions_have_equal_keys(spark):
    pairs = [("1.0", "1.0.0"), ("v1.2", "1.2"), ("1.2+local", "1.2"), ("1.0-alpha", "1.0.0alpha"), ("2.0RC", "2.0rc"), (" 1", "1.0")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert all(r[0] for r in df.select(ordered_version(F.col("a"), F.lit(False)) == ordered_version(F.col("b"), F.lit(False))).collect())


def affected(version, events):
    """The rule of the format: sweep the events in version order up to the version."""
    state = False
    order = sorted(range(len(events)), key=lambda i: (events[i][1], events[i][0] == "last_affected", i))
    for kind, at in (events[i] for i in order if events[i][0] != "limit"):
        if kind == "introduced" and version >= at:
            state = True
        elif (kind == "fixed" and version >= at) or (kind == "last_affected" and version > at):
            state = False
    limits = [at for kind, at in events if kind == "limit"]
    return state and (not limits or any(version < at for at in limits))


def test_intervals_equal_the_sweep(spark):
    rng = random.Random(2)
    cases = [[(rng.choice(["introduced", "introduced", "fixed", "last_affected", "limit"] if rng.random() < 0.3 else ["introduced", "fixed", "last_affected"]),
               rng.randint(0, 9)) for _ in range(rng.randint(0, 6))] for _ in range(300)]
    kinds = ["introduced", "fixed", "last_affected", "limit"]
    # Version 0 is written "0", which is before everything; all others have two parts.
    rows = [(i, [tuple((f"{at}.1" if at else "0.0") if k == kind else None for k in kinds) for kind, at in events]) for i, events in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, e array<struct<introduced string, fixed string, last_affected string, `limit` string>>")
    found = df.select("i", F.inline(osv_intervals(F.col("e"), F.lit(False))))
    points = spark.range(10).select(F.concat(F.col("id"), F.lit(".1")).alias("v"), F.col("id").alias("version")).withColumn("key", ordered_version(F.col("v"), F.lit(False)))
    points = points.withColumn("key", F.when(F.col("version") == 0, ordered_version(F.lit("0.0"), F.lit(False))).otherwise(F.col("key")))
    inside = (F.col("key") >= F.col("low")) & (F.col("high").isNull() | (F.col("key") < F.col("high")) | (F.col("high_included") & (F.col("key") == F.col("high"))))
    got = {(r.i, r.version) for r in found.crossJoin(points).where(inside).collect()}
    assert got == {(i, v) for i, events in enumerate(cases) for v in range(10) if affected(v, events)}


def test_introduced_at_zero_is_before_everything(spark):
    df = spark.createDataFrame([([("0", None, None, None), (None, "1.0", None, None)],)], "e array<struct<introduced string, fixed string, last_affected string, `limit` string>>")
    row = df.select(F.inline(osv_intervals(F.col("e"), F.lit(True)))).first()
    assert row.low == [] and not row.high_included


def test_ranges_over_commits_and_unordered_events_hit_nothing_wrong(spark):
    affected_by = [{"package": {"name": "flask", "ecosystem": "PyPI"}, "ranges": [
        {"type": "GIT", "events": [{"introduced": "0"}]}, {"type": "ECOSYSTEM", "events": [{"fixed": "1.2"}, {"introduced": "0"}]}]}]
    import json

    from siftguard.sources.feeds import parse_osv
    ranges = deps.osv_ranges(parse_osv(spark.createDataFrame([(json.dumps({"id": "X", "affected": affected_by}),)], "record string")))
    pins = spark.createDataFrame([("PyPI", "flask", "3.0.0"), ("PyPI", "flask", "1.1"), ("PyPI", "flask", "1.2rc1"), ("npm", "flask", "1.1")], "ecosystem string, pkg string, ver string")
    assert sorted(r.ver for r in deps._in_ranges(pins, ranges).collect()) == ["1.1", "1.2rc1"]


@pytest.mark.parametrize("bin_points", [1, 3, 1000])
def test_interval_join_equals_trying_every_pair(spark, bin_points):
    rng = random.Random(3)
    key = lambda: [rng.randint(0, 3) for _ in range(rng.randint(1, 4))]
    points = [(rng.choice("ab"), key()) for _ in range(120)]
    spans = [(rng.choice("abc"), n, rng.choice([None, key()]), rng.choice([None, key(), key()]), rng.random() < 0.5) for n in range(80)]
    got = interval_join(spark.createDataFrame(points, "g string, key array<int>"),
                        spark.createDataFrame(spans, "g string, n int, low array<int>, high array<int>, high_included boolean"), ["g"], bin_points)
    want = sorted((g, k, n) for g, k in {(g, tuple(k)) for g, k in points} for h, n, low, high, included in spans
                  if g == h and (low is None or list(k) >= low) and (high is None or list(k) < high or (included and list(k) == high)))
    assert sorted((r.g, tuple(r.key), r.n) for r in got.collect()) == want and len(want) > 500


def test_a_popular_package_is_dealt_out_evenly(spark):
    """A million advisories, a tenth of the pins on one package: no task holds three times the median of pins."""
    n, tasks = 400_000, 32
    name = F.when(F.col("id") % 10 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 20011))
    number = lambda shift, most: F.pmod(F.xxhash64(F.col("id") + shift), F.lit(most))
    pins = stored(spark.range(n).select(name.alias("pkg_key"), F.array(number(0, 60), number(7, 60), number(9, 60), F.lit(0).cast("long")).alias("key")).distinct(), "pins")
    placed = with_bins(pins, ["pkg_key"], 1000)
    sizes = sorted(r["count"] for r in placed.repartition(tasks, "pkg_key", "_bin").groupBy(F.spark_partition_id()).count().collect())
    assert sizes[-1] < 3 * sizes[len(sizes) // 2]
    bounds = spark.range(1_000_000).select(name.alias("pkg_key"), F.col("id").alias("n"), F.array(F.lit(0), number(1, 60), F.lit(0), F.lit(0)).cast("array<long>").alias("high"),
                                           F.array(F.lit(0), number(1, 60) - 1, F.lit(30), F.lit(0)).cast("array<long>").alias("low"), F.lit(True).alias("high_included"))
    found = interval_join(pins, bounds, ["pkg_key"], 1000)
    busy = sorted(r["count"] for r in found.where("pkg_key = 'hot'").groupBy(F.spark_partition_id()).count().collect())
    assert sum(busy) > 100_000


def test_counting_a_feed_needs_no_pairs(spark):
    """Counts equal those of the pairs, however the rows are dealt, and 400 million pairs are counted without being made."""
    rng = random.Random(8)
    pins = [(f"f{i}", i, rng.choice(["hot", "hot", "a", "b", None]), rng.choice(["1", "1.0", "0.3", "2.1-4", "x", None, f"{rng.randint(0, 3)}.{rng.randint(0, 9)}"])) for i in range(400)]
    feed = [(rng.choice(["hot", "a", "c", None]), f"A{i}", "HIGH", rng.choice([None, [0, 0, 0, 0], [rng.randint(0, 3), rng.randint(0, 9), 0, 0]])) for i in range(90)]
    feed += [("a", "A1", "HIGH", [3, 0, 0, 0]), ("hot", "A2", "HIGH", [1, 0, 0, 0]), ("hot", "A2", "HIGH", [1, 0, 0, 0])]
    deps_ = spark.createDataFrame(pins, "file string, line int, pkg_key string, ver string")
    table = spark.createDataFrame(feed, "pkg_key string, advisory_id string, severity string, max_key array<bigint>")
    row = ["advisory_id", "pkg_key", "max_key"]
    paired = deps.match_advisories(deps_, table).groupBy(*row).agg(F.count(F.lit(1)).alias("pins"), F.countDistinct("ver_key").alias("versions"))
    counted = deps.count_advisory_feed(deps_, table).groupBy(*row).agg(F.sum("pins").alias("pins"), F.max("versions").alias("versions"))
    want = sorted(map(str, paired.collect()))
    assert sorted(map(str, counted.collect())) == want and len(want) > 20
    many = spark.range(20_000)
    pinned = many.select(F.lit("f").alias("file"), F.col("id").cast("int").alias("line"), F.lit("hot").alias("pkg_key"), F.concat(F.lit("0."), F.col("id") % 500).alias("ver"))
    noted = many.select(F.lit("hot").alias("pkg_key"), F.col("id").cast("string").alias("advisory_id"), F.lit("HIGH").alias("severity"), F.array(F.lit(9), *[F.lit(0)] * 3).cast("array<bigint>").alias("max_key"))
    found = deps.count_advisory_feed(pinned, noted)
    assert found.where("pins = 20000 and versions = 500").count() == 20_000
