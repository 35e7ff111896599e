"""Hostile input neither ends a job nor passes unseen."""

import time
import warnings

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from siftguard import ScanConfig
from siftguard.functions.patterns import java_pattern, portable
from siftguard.functions.text import rstrip, strip
from siftguard.operators import dependencies as deps
from siftguard.operators.semantic import _file_facts, semantic_errors
from siftguard.plans.scan import scan
from siftguard.rules import select_rules
from siftguard.sinks.store import HistoryStore
from siftguard.sources.rule_files import user_rules


def _pins(files, name, text):
    rows = deps.extract_dependencies(files({name: text})).orderBy("dep_seq").collect()
    return [(r.pkg, r.ver) for r in rows]


def test_repeated_keys_keep_the_last_value(files):
    assert _pins(files, "package.json", '{"dependencies":{"lodash":"1.0.0","a":"3","lodash":"2.0.0"},"devDependencies":{"a":"4","a":"5"}}') == [("lodash", "2.0.0"), ("a", "5")]
    assert _pins(files, "Pipfile.lock", '{"default":{"x":{"version":"==1.0"},"y":{"version":"==3"},"x":{"version":"==2.0"}}}') == [("x", "2.0"), ("y", "3")]
    assert _pins(files, "package-lock.json", '{"packages":{"node_modules/z":{"version":"1"},"node_modules/z":{"version":"2"}}}') == [("z", "2")]


def test_many_repeated_keys_take_no_long_time(files):
    body = ",".join(f'"k{i % 7}":"{i}"' for i in range(20_000))
    start = time.perf_counter()
    assert len(_pins(files, "package.json", '{"dependencies":{' + body + "}}")) == 7
    assert time.perf_counter() - start < 20


def test_single_quotes_are_no_json(files):
    assert _pins(files, "package.json", "{'dependencies':{'a':'1'}}") == []


@pytest.mark.parametrize("pattern, text, found", [
    ("{{.*}}", "a {{b}} c", True), ("[[]", "a[0]", True), ("[[]", "a", False), ("ba{,2}d", "bd", True), ("ba{,2}d", "baaad", False),
    ("(?P<a_b>x)(?P<ab>y)(?P=a_b)", "xyx", True), ("[]x]", "]", True), ("[a&&b]", "&", True), (r"end\Z", "the end", True)])
def test_python_patterns_run_in_java(spark, pattern, text, found):
    import re
    java = java_pattern(pattern)
    assert bool(re.search(pattern, text)) == found
    assert spark.range(1).select(F.lit(text).rlike(java)).first()[0] == found


def test_patterns_that_cannot_run_are_left_out(spark, files):
    assert java_pattern("(x)?(?(1)y|z)") is None and java_pattern("(") is None and java_pattern(None) is None
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        rules = user_rules([{"id": "a", "pattern": "(x)?(?(1)y|z)"}, {"id": "b", "pattern": "tok_{{[a-z]+"}])
        assert [r.rule_id for r in rules] == ["b"]
        config = ScanConfig(enabled_scanners=["secrets"], extra_secret_patterns=["(x)?(?(1)y|z)", "tok_{{[a-z]+"])
        assert [r.pattern for r in select_rules(config) if r.rule_id.startswith("SECX")] == [portable("tok_{{[a-z]+")]
        assert scan(files({"a.txt": "tok_{{abc"}), config, user_rules=rules).findings.count() == 2


def test_trimming_is_linear(spark):
    text = "x" + " " * 1_000_000 + "y \t\x1f \xa0"
    frame = spark.createDataFrame([(text,), (None,), (" \x1c\n",)], "t string").coalesce(1)
    start = time.perf_counter()
    got = [(r.a, r.b) for r in frame.select(rstrip(F.col("t")).alias("a"), strip(F.col("t")).alias("b")).collect()]
    assert time.perf_counter() - start < 5
    assert got == [(text.rstrip(), text.strip()), (None, None), ("", "")]


def test_faults_of_the_syntax_scanner_are_rows(files):
    deep = "import pickle\nx = " + "-" * 200_000 + "1"
    facts = _file_facts(deep)
    assert [f[2] for f in facts] == ["error"] or facts == []
    assert _file_facts("import pickle\ndef (") == []
    assert semantic_errors(files({"a.py": "import pickle", "b.py": "def ("})).count() == 0


def test_only_a_missing_path_is_an_empty_store(spark, tmp_path):
    assert HistoryStore(spark, str(tmp_path / "none")).scans().count() == 0
    (tmp_path / "broken").mkdir()
    with pytest.raises(AnalysisException):
        HistoryStore(spark, str(tmp_path / "broken"))._read("scans", "a no_such_type")


RECORDS = [
    '{"id":"A","affected":[{"package":{"name":"p","ecosystem":"npm"},"ranges":[{"events":[{"introduced":"0"},{"fixed":"1.2.0"}]}]}]}',
    '{"id":"B","affected":[{"package":{"name":"p","ecosystem":"npm"},"ranges":[{"events":[{"introduced":"2.0.0"},{"last_affected":"2.5.0"},{"introduced":"3.0.0"}]}]}]}',
    '{"id":"C","affected":[{"package":{"name":"q","ecosystem":"npm"},"versions":["1.0.0"],"ranges":[{"events":[{"introduced":"1.0.0"},{"fixed":"1.1.0"}]}]}]}']


def test_version_ranges_of_advisories(spark):
    from siftguard.sources.feeds import parse_osv
    records = parse_osv(spark.createDataFrame([(r,) for r in RECORDS], "record string"))
    pins = [("p", v) for v in ("1.1.9", "1.2.0", "2.0.0", "2.5.0", "2.5.1", "3.0.0", "9")] + [("q", "1.0.0"), ("q", "1.0.5"), ("q", "1.1.0")]
    wanted = spark.createDataFrame([("npm", p, v) for p, v in pins], "ecosystem string, pkg string, ver string")
    table = deps.advisories(spark).limit(0)
    got = {(r.pkg, r.ver, r.advisory_id) for r in deps.resolve(wanted, deps.osv_index(records), table, deps.osv_ranges(records)).collect()}
    assert got == {("p", "1.1.9", "A"), ("p", "2.0.0", "B"), ("p", "2.5.0", "B"), ("p", "3.0.0", "B"), ("p", "9", "B"), ("q", "1.0.0", "C"), ("q", "1.0.5", "C")}


def test_a_clean_scan_has_a_sarif_log(spark, files):
    import json
    from siftguard.operators import export, summary
    found = scan(files({"a.py": "eval(x)"}), ScanConfig()).findings.withColumn("scan_id", F.lit("s1"))
    counts = summary.severity_counts(found, ["scan_id"]).withColumns({"target_path": F.lit("/t"), "scanned_at": F.lit("2024")})
    both = counts.unionByName(counts.withColumns({"scan_id": F.lit("s2"), **{c: F.lit(0).cast("bigint") for c in ("critical", "high", "medium", "low", "info", "total")}}))
    logs = {r.scan_id: json.loads(r.document)["runs"][0] for r in export.sarif_documents(found, both).collect()}
    assert set(logs) == {"s1", "s2"} and logs["s1"]["results"]
    assert logs["s2"]["results"] == [] and logs["s2"]["tool"]["driver"]["rules"] == []


def test_history_reads_are_pruned_by_date(spark, tmp_path, files):
    from siftguard.operators import history
    store = HistoryStore(spark, str(tmp_path / "h"))
    found = scan(files({"a.py": "eval(x)"}), ScanConfig()).findings
    ids = [store.append(found, "/t", f"2024-01-0{d} 10:00:00", 1, 0, 1.0) for d in (1, 2, 3)]
    one = history.scan_with_findings(store.scans(), store.findings(), ids[1])
    ranked = history.top_titles(store.scans(), store.findings(), scans_back=1)
    assert {r.scan_id for r in one.collect()} == {ids[1]} and "scan_date" not in one.columns
    assert ranked.first()["count"] == found.count() / found.select("title").distinct().count()
    assert "dynamicpruning" in one._jdf.queryExecution().optimizedPlan().toString()
    scans_of = ranked._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1:]
    assert any("scan_date" in part.split("]")[0] for part in scans_of)
