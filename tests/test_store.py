"""Scan history by attempts, and its rollups."""

import random

import pytest
from pyspark.sql import functions as F

from siftguard.operators import history
from siftguard.sinks import HistoryStore

DAY = "2024-01-{:02d} 10:00:00"


def _findings(spark, n, title="T"):
    return spark.range(n).select(
        F.concat(F.lit("f"), F.col("id").cast("string")).alias("file"), F.lit(1).alias("line"), F.when(F.col("id") % 2 == 0, "CRITICAL").otherwise("LOW").alias("severity"),
        F.lit(5).alias("sev_weight"), F.lit(title).alias("title"), F.lit("d").alias("description"), F.lit("s").alias("code_snippet"),
        F.lit(None).cast("string").alias("cwe_id"), F.lit("").alias("fix"), F.lit("S").alias("scanner"), F.lit(1).cast("bigint").alias("rule_ord"))


def _counts(store):
    return {r.scan_id: r["count"] for r in store.findings().groupBy("scan_id").count().collect()}


def test_a_retry_leaves_one_copy(spark, tmp_path):
    class Broken(HistoryStore):
        def _open(self, days):
            raise OSError("header not written")

    store = HistoryStore(spark, str(tmp_path))
    with pytest.raises(OSError):
        Broken(spark, str(tmp_path)).append(_findings(spark, 6), "p", DAY.format(1), 1, 0, 1.0, scan_id="a")
    assert store.scans().count() == 0 and _counts(store) == {} and store.titles().count() == 0
    store.append(_findings(spark, 6), "p", DAY.format(1), 1, 0, 1.0, scan_id="a")
    store.append(_findings(spark, 4), "p", DAY.format(1), 1, 0, 1.0, scan_id="a")
    assert _counts(store) == {"a": 4} and store.scans().first().total == 4 and [r.n for r in store.titles().collect()] == [4]


def test_a_deleted_scan_can_be_added_again(spark, tmp_path):
    store = HistoryStore(spark, str(tmp_path))
    store.append(_findings(spark, 3), "p", DAY.format(1), 1, 0, 1.0, scan_id="a")
    store.append(_findings(spark, 3), "p", DAY.format(2), 1, 0, 1.0, scan_id="a")
    assert store.delete_scan("a") and not store.delete_scan("a") and _counts(store) == {}
    store.append(_findings(spark, 5), "p", DAY.format(3), 1, 0, 1.0, scan_id="a")
    assert _counts(store) == {"a": 5} and [str(r.scan_date) for r in store.scans().collect()] == ["2024-01-03"]


def test_compaction_keeps_what_readers_see(spark, tmp_path):
    store = HistoryStore(spark, str(tmp_path))
    for n in (3, 4):
        store.append(_findings(spark, n), "p", DAY.format(1), 1, 0, 1.0, scan_id="a")
    store.append(_findings(spark, 2), "q", DAY.format(1), 1, 0, 1.0, scan_id="b")
    store.append(_findings(spark, 2), "q", DAY.format(2), 1, 0, 1.0, scan_id="c")
    store.compact()
    assert _counts(store) == {"a": 4, "b": 2, "c": 2}
    assert spark.read.parquet(f"{tmp_path}/findings").count() == 8 and spark.read.parquet(f"{tmp_path}/titles").count() == 3


def test_rollups_equal_the_raw_tables(spark, tmp_path):
    store = HistoryStore(spark, str(tmp_path))
    for day in range(1, 8):
        for k in range(3):
            store.append(_findings(spark, day + k, f"T{day % 3}"), f"p{(day * k) % 5}", DAY.format(day), 1, 0, 1.0, scan_id=f"{day}-{k}")

    def check():
        scans, findings = store.scans(), store.findings()
        raw, rolled = history.history_stats(scans).first(), store.history_stats().first()
        assert raw == rolled
        now = DAY.format(7)
        assert history.daily_trend(scans, now, 4).collect() == store.daily_trend(now, 4).collect()
        assert history.top_titles(scans, findings, scans_back=9).collect() == store.top_titles(scans_back=9).collect()

    check()
    store.seal("2024-01-05")
    assert store._sealed().count() == 4
    check()
    store.delete_scan("2-1")
    store.append(_findings(spark, 9, "new"), "late", DAY.format(3), 1, 0, 1.0)
    assert store._sealed().count() == 2
    check()
    store.seal("2024-01-07")
    assert store._sealed().count() == 6
    check()


def test_sealed_days_are_read_from_the_rollup(spark, tmp_path):
    store = HistoryStore(spark, str(tmp_path))
    store.append(_findings(spark, 3), "p", DAY.format(1), 1, 0, 1.0)
    store.seal("2024-02-01")
    rest = store._live().join(store._sealed().select("scan_date"), "scan_date", "left_anti")
    assert rest.count() == 0 and store.days().first().total == 3


def test_estimated_projects_lie_within_the_bound(spark, tmp_path):
    store = HistoryStore(spark, str(tmp_path))
    scans = spark.range(20_000).select(
        F.col("id").cast("string").alias("scan_id"), F.concat(F.lit("p"), F.col("id") % 7000).alias("target_path"),
        F.timestamp_seconds(F.lit(1_704_100_000) + F.col("id") * 60).alias("scanned_at"), F.lit(1).cast("bigint").alias("files_scanned"), F.lit(0).cast("bigint").alias("files_skipped"),
        F.lit(1.0).alias("scan_duration"))
    store.append_many(scans, _findings(spark, 0).withColumn("scan_id", F.lit("x")))
    store.seal("2024-01-08")
    got = store.history_stats().first()
    assert got.total_scans == 20_000 and abs(got.total_projects - 7000) <= 0.03 * 7000 and got.total_findings == 0


def test_scans_are_worked_out_once_and_headers_not_repeated(spark, tmp_path):
    """Scans whose plan gives another day each time keep their findings; readers join each header once."""
    day = F.udf(lambda n: random.randint(0, 27), "int").asNondeterministic()
    scans = spark.range(40).select(
        F.col("id").cast("string").alias("scan_id"), F.lit("p").alias("target_path"), F.timestamp_seconds(F.lit(1_704_100_000) + day("id") * 86_400).alias("scanned_at"),
        F.lit(1).cast("bigint").alias("files_scanned"), F.lit(0).cast("bigint").alias("files_skipped"), F.lit(1.0).alias("scan_duration"))
    store = HistoryStore(spark, str(tmp_path))
    store.append_many(scans, _findings(spark, 200).withColumn("scan_id", (F.regexp_extract("file", "f([0-9]+)", 1).cast("int") % 39).cast("string")))
    assert store.findings().count() == 200 and store.titles().agg(F.sum("n")).first()[0] == 200
    assert sorted(r.total for r in store.scans().collect()) == [0, *[5] * 34, *[6] * 5]
    assert "Generate" not in store.findings()._jdf.queryExecution().optimizedPlan().toString()


def test_an_append_leaves_few_files_per_date(spark, tmp_path):
    """Every task would else write a file for every date, and readers list and open them all."""
    scans = spark.range(4000).select(
        F.col("id").cast("string").alias("scan_id"), F.lit("p").alias("target_path"), F.timestamp_seconds(F.lit(1_704_100_000) + F.col("id") % 3 * 86_400).alias("scanned_at"),
        F.lit(1).cast("bigint").alias("files_scanned"), F.lit(0).cast("bigint").alias("files_skipped"), F.lit(1.0).alias("scan_duration"))
    store = HistoryStore(spark, str(tmp_path))
    store.append_many(scans, _findings(spark, 4000).withColumn("scan_id", F.regexp_extract("file", "f([0-9]+)", 1)))
    assert {name: len(list(tmp_path.glob(f"{name}/scan_date=*/*.parquet"))) for name in ("findings", "titles", "scans")} == {"findings": 3, "titles": 3, "scans": 3}
    assert store.findings().count() == 4000 and store.titles().agg(F.sum("n")).first()[0] == 4000 and store.history_stats().first().total_findings == 4000
