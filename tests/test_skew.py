"""One file, title, pin or copy group that owns most rows changes neither results nor shape."""

import random

import pytest
from pyspark.sql import functions as F

from siftguard import ScanConfig
from siftguard.operators import baseline as base
from siftguard.operators import dependencies as deps
from siftguard.operators import export, joins, summary
from siftguard.plans.scan import scan

HOT = 30_000


def _hot_findings(spark):
    """One file with HOT findings of one title, plus a few small files."""
    hot = spark.range(HOT).select(F.lit("hot.py").alias("file"), (F.col("id") + 1).cast("int").alias("line"))
    cold = spark.range(300).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("file"), F.lit(1).alias("line"))
    return hot.unionByName(cold).select(
        "file", "line", F.lit("HIGH").alias("severity"), F.lit(4).alias("sev_weight"), F.lit("T").alias("title"), F.lit("d").alias("description"),
        F.lit("s").alias("code_snippet"), F.lit(None).cast("string").alias("cwe_id"), F.lit("").alias("fix"), F.lit("S").alias("scanner"),
        F.lit(1).cast("bigint").alias("rule_ord"))


def test_hot_file_through_the_scan(files):
    corpus = files({"hot.py": "\n".join(["eval(x)"] * HOT), **{f"c{i}.py": "eval(x)" for i in range(20)}})
    plan = scan(corpus, ScanConfig(enabled_scanners=["command_injection", "ast_scanner"]))
    got = {r.scanner: r.n for r in plan.findings.groupBy("scanner").agg(F.count("*").alias("n")).collect()}
    assert got == {"CommandInjectionScanner": HOT + 20, "ASTScanner": HOT + 20}


def test_hot_title_against_the_baseline(spark):
    found = _hot_findings(spark)
    entries = found.filter(F.col("line") % 20 == 1).select("file", (F.col("line") + 2).alias("line"), "title", "severity", "scanner")
    many = entries.unionByName(entries).unionByName(entries)
    known = base.known_findings(found, many)
    hot_known = known.filter("file = 'hot.py'").count()
    brute = {n for at in range(3, HOT + 3, 20) for n in range(max(1, at - 3), at + 4) if n <= HOT}
    assert hot_known == len(brute) and known.filter("file <> 'hot.py'").count() == 300
    assert base.new_findings(found, many).count() + known.count() == found.count()
    assert base.classify(found, many).filter("known").count() == known.count()


def test_hot_pin(spark):
    pins = spark.range(HOT).select(
        F.concat(F.lit("p"), F.col("id").cast("string"), F.lit("/requirements.txt")).alias("file"), F.lit("requirements.txt").alias("manifest"),
        F.lit("lodash").alias("pkg"), F.lit("lodash").alias("pkg_key"), F.lit("4.17.20").alias("ver"), F.lit(1).alias("line"),
        F.lit("lodash==4.17.20").alias("code_snippet"), F.lit("lodash==4.17.20").alias("source_line"), F.lit(1).cast("bigint").alias("dep_seq"))
    empty = spark.createDataFrame([], "ecosystem string, pkg string, ver string, advisory_id string, summary string, details string, adv_severity string, fix_version string")
    assert deps.osv_findings(pins, empty, deps.advisories(spark)).count() == HOT
    assert deps.dependency_findings(pins, deps.advisories(spark)).count() == HOT


def test_hot_scan_in_documents(spark):
    found = _hot_findings(spark).withColumn("scan_id", F.lit("s"))
    counts = summary.severity_counts(found, ["scan_id"]).withColumns({
        "target_path": F.lit(""), "scanned_at": F.lit(""), "files_scanned": F.lit(1), "files_skipped": F.lit(0), "scan_duration": F.lit(0.0)})
    read = F.from_json("document", "runs array<struct<results array<struct<ruleId string>>>>")["runs"][0]["results"]
    sizes = [r[0] for r in export.sarif_documents(found, counts).select(F.size(read)).collect()]
    assert sum(sizes) == HOT + 300 and max(sizes) <= 4096
    rows = export.diagnostics_by_file(found).filter("file = 'hot.py'").select("n").collect()
    assert sum(r.n for r in rows) == HOT and max(r.n for r in rows) <= export.FILE_BLOCK


def test_records_of_pins_are_not_repeated(spark):
    pins = spark.range(50).select(
        F.concat(F.lit("p"), F.col("id").cast("string"), F.lit("/requirements.txt")).alias("file"), F.lit("requirements.txt").alias("manifest"),
        F.lit("lodash").alias("pkg"), F.lit("lodash").alias("pkg_key"), F.lit("4.17.20").alias("ver"), F.lit(1).alias("line"),
        F.lit("lodash==4.17.20").alias("code_snippet"), F.lit("lodash==4.17.20").alias("source_line"), F.lit(1).cast("bigint").alias("dep_seq"))
    records = spark.range(30).selectExpr(
        "'PyPI' AS ecosystem", "'lodash' AS pkg", "'4.17.20' AS ver", "concat('A', id) AS advisory_id", "'s' AS summary", "'d' AS details", "'HIGH' AS adv_severity", "'5' AS fix_version")
    found = deps.osv_findings(pins, records, deps.advisories(spark))
    assert "_salt" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == 1500


def _pins(spark, keys: int, each: int):
    """``each`` pins of every version 1.0.0, 1.1.0, ...; neighbouring files hold different versions."""
    version = F.concat(F.lit("1."), (F.col("id") % keys).cast("string"), F.lit(".0"))
    return spark.range(keys * each).select(
        F.concat(F.lit("p"), F.col("id").cast("string"), F.lit("/requirements.txt")).alias("file"), F.lit("requirements.txt").alias("manifest"),
        F.lit("lodash").alias("pkg"), F.lit("lodash").alias("pkg_key"), version.alias("ver"), (F.col("id") % 7 + 1).cast("int").alias("line"),
        F.lit("c").alias("code_snippet"), F.lit("s").alias("source_line"), F.lit(1).cast("bigint").alias("dep_seq"))


def test_findings_of_pins_times_records_take_little_disk(spark, tmp_path):
    keys, each = 30, 200
    records = spark.range(keys * each).selectExpr(
        "'PyPI' AS ecosystem", "'lodash' AS pkg", f"concat('1.', id % {keys}, '.0') AS ver", "concat('A', id) AS advisory_id", "'s' AS summary", "'d' AS details",
        "'HIGH' AS adv_severity", "concat(id, '.1') AS fix_version")
    found = deps.osv_findings(_pins(spark, keys, each), records, deps.advisories(spark)).select("file", "line", "severity", "title", "fix", "scanner")
    found.write.parquet(str(tmp_path / "found"))
    assert spark.read.parquet(str(tmp_path / "found")).distinct().count() == keys * each * each
    assert sum(f.stat().st_size for f in (tmp_path / "found").glob("*.parquet")) < keys * each * each


def test_intervals_are_worked_out_once(spark):
    from siftguard.sources.feeds import parse_osv
    text = '{"id":"A","affected":[{"package":{"name":"lodash","ecosystem":"PyPI"},"ranges":[{"events":[{"introduced":"1.2.0"},{"fixed":"1.4.0"}]}]}]}'
    ranges = deps.osv_ranges(parse_osv(spark.createDataFrame([(text,)], "record string")))
    wanted = _pins(spark, 6, 1).select(F.lit("PyPI").alias("ecosystem"), "pkg", "ver")
    found = deps._in_ranges(wanted, ranges)
    assert sorted(r.ver for r in found.collect()) == ["1.2.0", "1.3.0"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate inline(") == 1


def test_records_that_differ_beyond_the_shown_text_stay_apart(spark):
    records = spark.createDataFrame([("PyPI", "lodash", "1.0.0", "A", None, "x" * 300 + end, "HIGH", "5") for end in ("", "y", "z", "z")],
                                    "ecosystem string, pkg string, ver string, advisory_id string, summary string, details string, adv_severity string, fix_version string")
    found = deps.osv_findings(_pins(spark, 1, 2), records.distinct(), deps.advisories(spark)).collect()
    assert len(found) == 6 and {r.description for r in found} == {"x" * 300}


@pytest.mark.parametrize("block,most_cut", [(2, 2), (2, 1000), (7, 2), (1000, 1000)])
def test_blocked_join_equals_a_join(spark, monkeypatch, block, most_cut):
    monkeypatch.setattr(joins, "MOST_CUT", most_cut)
    rng = random.Random(block)
    left = [(k, i) for i, k in enumerate(rng.choices(["hot", "a", "b", "c", None], [30, 2, 3, 1, 2], k=60))] + [("hot", 0)] * 3
    right = [(k, i) for i, k in enumerate(rng.choices(["hot", "a", "b", "d", None], [40, 9, 1, 1, 2], k=80))] + [("a", 1)] * 5
    lefts, rights = spark.createDataFrame(left, "k string, x int"), spark.createDataFrame(right, "k string, y int")
    sizes = lefts.groupBy("k").agg(F.count("*").alias("lefts")).join(rights.groupBy("k").agg(F.count("*").alias("rights")), "k", "full").fillna(0, ["lefts", "rights"])
    got = joins.blocked_join(lefts, rights, ["k"], sizes, F.col("x"), F.col("y"), block, block)
    assert got.columns == ["k", "x", "y"]
    assert sorted(map(tuple, got.collect())) == sorted((k, x, y) for k, x in left for other, y in right if k is not None and k == other)
    assert joins.blocked_join(lefts.limit(0), rights, ["k"], sizes.limit(0), F.col("x"), F.col("y"), block, block).count() == 0
