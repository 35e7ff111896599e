"""Scan history, SARIF, JSON documents, diagnostics, streams."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from siftguard.operators import export, history, summary
from siftguard.schemas import FINDINGS
from siftguard.sinks import HistoryStore, write_baseline, write_documents, write_findings
from siftguard.sources.feeds import read_baseline
from siftguard.streaming import operators as stream

UTC = datetime.timezone.utc


def _findings(spark, rows):
    weight = {"CRITICAL": 5, "HIGH": 4, "MEDIUM": 3, "LOW": 2, "INFO": 1}
    full = [(f, n, s, weight[s], t, "desc", "snip" if n % 2 else "", "CWE-1" if n % 2 else None, "fix" if n % 2 else "", "S", 1) for f, n, s, t in rows]
    return spark.createDataFrame(full, FINDINGS)


def _scans(spark, rows):
    cols = "scan_id string, target_path string, scanned_at timestamp, files_scanned bigint, files_skipped bigint, scan_duration double, critical bigint, high bigint, medium bigint, low bigint, info bigint, total bigint"
    return spark.createDataFrame([(i, t, datetime.datetime.fromisoformat(at), 1, 0, 1.0, c, h, 0, 0, 0, c + h) for i, t, at, c, h in rows], cols)


def test_trend_and_stats(spark):
    scans = _scans(spark, [("a", "p", "2024-01-01T00:00:00", 1, 0), ("b", "p", "2024-01-02T12:00:00", 0, 2), ("c", "Q", "2024-01-02T13:00:00", 3, 1), ("d", "p", "2024-01-04T00:00:00", 1, 1)])
    rows = history.daily_trend(scans, "2024-01-09 12:00:00", 7).collect()
    assert [(str(r.date), r.critical, r.total, r.scan_count) for r in rows] == [("2024-01-02", 3, 6, 2), ("2024-01-04", 1, 2, 1)]
    assert [str(r.date) for r in history.daily_trend(scans, "2024-01-09 12:00:00", 7, "Q").collect()] == ["2024-01-02"]
    stats = history.history_stats(scans).first()
    assert (stats.total_scans, stats.total_projects, stats.total_findings, stats.total_critical) == (4, 2, 9, 5)
    none = history.history_stats(scans.limit(0)).first()
    assert (none.total_scans, none.total_findings, none.last_scan) == (0, None, None)
    assert [r.scan_id for r in history.recent_scans(scans, limit=2).collect()] == ["d", "c"]
    assert [r.scan_id for r in history.recent_scans(scans, "Q").collect()] == ["c"]
    assert {r.scan_id for r in history.filter_history(scans, contains="q", severity="CRITICAL").collect()} == {"c"}
    assert [r.target_path for r in history.targets(scans).collect()] == ["Q", "p"]


def test_top_titles_only_of_recent_scans(spark):
    scans = _scans(spark, [("a", "p", "2024-01-01T00:00:00", 0, 0), ("b", "p", "2024-01-02T00:00:00", 0, 0)])
    child = spark.createDataFrame([("a", "old")] * 5 + [("b", "x"), ("b", "y"), ("b", "y"), ("b", None)], "scan_id string, title string")
    assert [(r["title"], r["count"]) for r in history.top_titles(scans, child, scans_back=1).collect()] == [("y", 2), ("Unknown", 1), ("x", 1)]
    assert history.top_titles(scans, child, limit=1).first()["title"] == "old"


def test_store(spark, tmp_path):
    store = HistoryStore(spark, str(tmp_path / "h"))
    assert store.scans().count() == 0 and store.delete_scan("none") is False
    found = _findings(spark, [("a", 1, "HIGH", "T"), ("a", 2, "CRITICAL", "U")])
    one = store.append(found, "p", "2024-01-01 10:00:00", 3, 1, 1.23456)
    two = store.append(found.limit(0), "q", "2024-01-02 10:00:00", 0, 0, 0.1)
    row = store.scans().filter(F.col("scan_id") == one).first()
    assert (row.critical, row.high, row.total, row.scan_duration, row.files_skipped) == (1, 1, 2, 1.235, 1)
    shown = history.scan_with_findings(store.scans(), store.findings(), one).collect()
    assert [r.title for r in shown] == ["U", "T"]
    assert history.scan_with_findings(store.scans(), store.findings(), two).count() == 1
    assert store.delete_scan(one) is True and store.delete_scan(one) is False
    assert [r.scan_id for r in store.scans().collect()] == [two] and store.findings().count() == 0
    new = spark.createDataFrame([("h", "b", "", "late", datetime.datetime(2024, 1, 2)), ("h", "a", "", "early", datetime.datetime(2024, 1, 1)),
                                 ("g", "c", "", "", datetime.datetime(2024, 1, 3))], "finding_hash string, title string, file_pattern string, reason string, created_at timestamp")
    store.suppress(new)
    store.suppress(new)
    rows = history.suppressions_newest_first(store.suppressions()).collect()
    assert [(r.finding_hash, r.reason) for r in rows] == [("g", ""), ("h", "early")]
    assert store.delete_suppression(rows[0].id) and store.suppressions().count() == 1
    plan = history.daily_trend(store.scans(), "2024-01-03 00:00:00", 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(scan_date" in plan


def _scan(spark, n):
    levels = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
    found = _findings(spark, [(f"/w/f{i % 3}.py", i + 1, levels[i % 5], f"Title — {i % 4}/x") for i in range(n)]).withColumn("scan_id", F.lit("s"))
    counts = summary.severity_counts(found, ["scan_id"]).withColumns({
        "target_path": F.lit("/w"), "scanned_at": F.lit("2024-01-01T00:00:00"), "files_scanned": F.lit(1), "files_skipped": F.lit(0), "scan_duration": F.lit(0.12345)})
    return found, counts


def test_sarif_document(spark, tmp_path):
    found, counts = _scan(spark, 20)
    rows = export.sarif_documents(found, counts).collect()
    assert len(rows) >= 1
    results = [r for row in rows for r in json.loads(row.document)["runs"][0]["results"]]
    assert len(results) == 20
    run = json.loads(rows[0].document)["runs"][0]
    assert json.loads(rows[0].document)["version"] == "2.1.0" and run["originalUriBaseIds"]["%SRCROOT%"]["uri"] == "/w/"
    assert run["properties"]["metrics"] == {"critical": 4, "high": 4, "medium": 4, "low": 4, "total": 20}
    assert {d["id"] for d in run["tool"]["driver"]["rules"]} <= {f"Title__{i}_x" for i in range(4)}
    first = run["results"][0]
    assert first["level"] == "error" and first["locations"][0]["physicalLocation"]["artifactLocation"]["uriBaseId"] == "%SRCROOT%"
    assert len(run["artifacts"]) == len(run["results"]) and first["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "f0.py"
    write_documents(export.sarif_documents(found, counts), str(tmp_path / "d"))
    assert spark.read.text(str(tmp_path / "d")).count() == len(rows)


def test_documents_are_cut_at_the_chunk_size_and_lose_nothing(spark):
    found, counts = _scan(spark, 300)
    rows = export.findings_documents(found, counts, chunk=16).collect()
    documents = [json.loads(r.document) for r in sorted(rows, key=lambda r: r.chunk)]
    listed = [f for d in documents for f in d["findings"]]
    assert max(len(d["findings"]) for d in documents) <= 16 and len(listed) == 300
    order = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
    ranks = [order.index(f["severity"]) for f in listed]
    assert ranks == sorted(ranks)
    assert all(d["summary"]["total"] == 300 and d["scan_duration"] == 0.123 for d in documents)
    assert sum(len(json.loads(r.document)["runs"][0]["results"]) for r in export.sarif_documents(found, counts, chunk=16).collect()) == 300
    empty = export.findings_documents(found.limit(0), counts).collect()
    assert len(empty) == 1 and json.loads(empty[0].document)["findings"] == []


@pytest.mark.parametrize("adaptive, partitions", [("true", 1), ("true", 32), ("false", 1), ("false", 4), ("false", 32)])
def test_chunks_do_not_depend_on_partitions(spark, adaptive, partitions):
    one, counts = _scan(spark, 300)
    found = one.union(one.limit(25).withColumn("scan_id", F.lit("other"))).union(one.limit(0)).repartition(partitions)
    counts = counts.union(counts.withColumn("scan_id", F.lit("other")))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        for make in (export.findings_documents, export.sarif_documents):
            got = {(r.scan_id, r.chunk) for r in make(found, counts, chunk=16).collect()}
            assert got == {(one.first().scan_id, k) for k in range(19)} | {("other", 0), ("other", 1)}
        rows = export.numbered(found, ["scan_id"], [F.desc("sev_weight"), F.col("file"), F.col("line"), F.col("title")]).collect()
        for scan_id in {r.scan_id for r in rows}:
            own = sorted((r for r in rows if r.scan_id == scan_id), key=lambda r: r._number)
            assert [r._number for r in own] == list(range(len(own))) and {r._total for r in own} == {len(own)}
            keys = [(-r.sev_weight, r.file, r.line, r.title) for r in own]
            assert keys == sorted(keys)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_baseline_documents_are_read_back(spark, tmp_path):
    from siftguard.operators.baseline import baseline_entries
    found, _ = _scan(spark, 300)
    write_baseline(found, str(tmp_path / "b.json"), "proj")
    back = read_baseline(spark, str(tmp_path / "b.json"))
    entries = baseline_entries(found, "proj")
    assert back.columns == entries.columns and sorted(map(tuple, back.collect())) == sorted(map(tuple, entries.collect()))
    texts = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "b.json")).collect()]
    assert {t["total_findings"] for t in texts} == {300} and {t["target_path"] for t in texts} == {"proj"}
    (tmp_path / "one.json").write_text(json.dumps(texts[0], indent=2))
    assert read_baseline(spark, str(tmp_path / "one.json")).count() == len(texts[0]["findings"])
    write_baseline(found.limit(0), str(tmp_path / "none.json"))
    assert read_baseline(spark, str(tmp_path / "none.json")).count() == 0


def test_rule_descriptors_take_the_most_severe_finding(spark):
    found = _findings(spark, [("a", 2, "LOW", "A b/c"), ("b", 1, "HIGH", "A b/c"), ("a", 1, "INFO", "x" * 80)])
    rows = {r.rule_id: r for r in export.sarif_rules(found).collect()}
    assert set(rows) == {"A_b_c", "x" * 64} and (rows["A_b_c"].level, rows["A_b_c"].score) == ("error", "7.0")


def test_diagnostics(spark):
    found = _findings(spark, [("a", 0, "HIGH", "T"), ("a", 3, "LOW", "U"), ("a", 5000, "INFO", "V"), ("b", 2, "MEDIUM", "W")])
    rows = {(r.file, r.line0): r for r in export.diagnostics(found).collect()}
    assert (rows["a", 0].level, rows["a", 0].code, rows["a", 0].message) == ("Error", "S", "T\ndesc")
    assert (rows["a", 2].level, rows["a", 2].code, rows["a", 4999].level) == ("Information", "CWE-1", "Hint")
    grouped = {(r.file, r.block, r.total): [d.line0 for d in r.diagnostics] for r in export.diagnostics_by_file(found).collect()}
    assert grouped == {("a", 0, 3): [0, 2, 4999], ("b", 0, 1): [1]}
    grouped = {(r.file, r.block, r.total): [d.line0 for d in r.diagnostics] for r in export.diagnostics_by_file(found, block=2).collect()}
    assert grouped == {("a", 0, 3): [0, 2], ("a", 1, 3): [4999], ("b", 0, 1): [1]}


@pytest.mark.parametrize("form", ["parquet", "json", "orc"])
def test_findings_tables(spark, tmp_path, form):
    found = _findings(spark, [("a", 1, "LOW", "T"), ("b", 2, "HIGH", "U")])
    write_findings(found, str(tmp_path / form), form, ordered=True)
    assert spark.read.format(form).load(str(tmp_path / form)).count() == 2


def test_stream_equals_batch_and_closes_old_days(spark, tmp_path):
    rows = [(datetime.datetime(2024, 1, day), day % 2, 1 - day % 2, 0, 0, 0, 1) for day in range(1, 13)]
    schema = "scanned_at timestamp, critical bigint, high bigint, medium bigint, low bigint, info bigint, total bigint"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    trend = stream.stream_trend(source, "1 day")
    query = (trend.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
             .option("checkpointLocation", str(tmp_path / "state")).start(str(tmp_path / "out")))
    query.awaitTermination()
    closed = spark.read.parquet(str(tmp_path / "out"))
    assert 0 < closed.count() < 12 and closed.agg(F.max("total")).first()[0] == 1
