"""Suppression, de-duplication, remediation, search, baseline, summaries."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siftguard import ScanConfig
from siftguard.operators import baseline as base
from siftguard.operators import postprocess as post
from siftguard.operators import summary
from siftguard.operators.joins import salted_join
from siftguard.plans.scan import scan
from siftguard.rules.remediation import REMEDIES
from siftguard.schemas import RAW_COLUMNS, RAW_FINDINGS

WEIGHTS = {"CRITICAL": 5, "HIGH": 4, "MEDIUM": 3, "LOW": 2, "INFO": 1}


@pytest.fixture
def raw(spark):
    def make(*rows):
        base_row = dict(file="a.py", line=1, severity="HIGH", title="T", description="d", code_snippet="s", cwe_id=None,
                        fix="f", scanner="S", rule_ord=0, emit_seq=0, source_line="s")
        full = [{**base_row, **row} for row in rows]
        for row in full:
            row["sev_weight"] = WEIGHTS[row["severity"]]
        return spark.createDataFrame([tuple(r[c] for c in RAW_COLUMNS) for r in full], RAW_FINDINGS)
    return make


SUPPRESSION = [  # (line, title, dropped)
    ("x  # nosec", "SQL Injection", True),
    ("x  #nosec", "SQL Injection", True),
    ("x  # NOSEC:  ", "SQL Injection", True),
    ("x  # nosec: ,", "SQL Injection", True),
    ("x  # nosec: sql inj", "SQL Injection — x", True),
    ("x  # nosec: xss , SQL", "SQL Injection", True),
    ("x  # noqa: E501", "SQL Injection", False),
    ("x  # noqa", "anything", True),
    ("x  // nosec", "anything", True),
    ("x  # siftguard: ignore", "anything", True),
    ("x  # siftguard : ignore Logging", "Logging Sensitive", True),
    ("x  # other: ignore", "anything", False),
    ("x  # nosecurity", "SQL Injection", False),
    ("x  # nosecurity", "urity", True),
    ("u = 'http://noqa'", "anything", False),
    ("u = 'http://noqa'", "x '", True),
    ("x  # nosec [CWE-89]", "SQL Injection", False),
    ("x", "anything", False),
    (None, "anything", False),
]


def test_suppression_comments(spark):
    df = spark.createDataFrame([(i, line, title) for i, (line, title, _) in enumerate(SUPPRESSION)], "i int, line string, title string")
    got = df.select("i", post.is_suppressed(F.col("line"), F.col("title")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [want for _, _, want in SUPPRESSION]


def test_suppression_agrees_with_python(spark):
    pattern = re.compile(post.suppression_pattern("siftguard"))
    rng = random.Random(5)
    bits = ["#", "//", " ", "nosec", "noqa", "siftguard", ":", "ignore", ",", "sql", "T", "\t", "x", " "]
    lines = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(3000)]

    def covered(line, title):
        found = pattern.search(line)
        if not found:
            return False
        items = [i.strip().lower() for i in (found.group(1) or "").split(",") if i.strip()]
        return not items or any(i in title.lower() for i in items)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string")
    got = {r.i for r in df.filter(post.is_suppressed(F.col("t"), F.lit("SQL Tx"))).collect()}
    assert got == {i for i, t in enumerate(lines) if covered(t, "SQL Tx")}


def test_first_scanner_wins(raw):
    found = post.deduplicate(raw(
        dict(scanner="late", rule_ord=9000, emit_seq=0), dict(scanner="early", rule_ord=2000, emit_seq=7),
        dict(scanner="early2", rule_ord=2000, emit_seq=9), dict(scanner="other", title="U"))).collect()
    assert {(r.title, r.scanner) for r in found} == {("T", "early"), ("U", "other")}


def test_many_copies_of_one_finding_shrink_before_the_shuffle(spark, raw):
    copies = raw(dict()).crossJoin(spark.range(20000)).drop("id")
    found = post.deduplicate(copies)
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan


def test_remediation_order(raw):
    lines = [("SQL Injection — x", 'cur.execute(f"S")'), ("SQL Injection — x", 'cur.execute("a %s" % x)'),
             ("Command Injection", "os.system(x)"), ("Command Injection", "subprocess.run(x, shell=True)"), ("eval()", "eval(x)"),
             ("Deserialization", "pickle.load(f)"), ("Deserialization", "pickle.loads(f)"), ("Deserialization", "yaml.load(f)"),
             ("Deserialization", "yaml.load(f, Loader=yaml.SafeLoader)"), ("MD5", "hashlib.md5(x)"), ("SHA1", "hashlib.sha1(x)"),
             ("DEBUG = True", "DEBUG = True"), ("XSS", "mark_safe(x)"), ("XSS", "<p dangerouslySetInnerHTML>"), ("XSS", ""),
             ("SQL Injection", "os.system(x)"), ("exec via os.system", "os.system(eval(x))")]
    rows = [dict(title=t, code_snippet=s, line=i + 1) for i, (t, s) in enumerate(lines)]

    def want(title, snippet):
        for remedy in REMEDIES:
            if re.search(remedy.title, title) and snippet and re.search(remedy.snippet, snippet):
                return remedy.text()
        return "f"
    got = post.remediate(raw(*rows)).orderBy("line").collect()
    assert [r.fix for r in got] == [want(t, s) for t, s in lines]
    shown = post.with_multiline_fix(post.remediate(raw(dict(title="eval", code_snippet="eval(x)")))).first()
    advice = next(r for r in REMEDIES if re.search(r.snippet, "eval(x)"))
    assert (shown.before, shown.after) == (advice.before, advice.after) and "eval(" in shown.before


def test_search_and_order(raw):
    df = raw(dict(title="Alpha", cwe_id="CWE-89"), dict(title="Beta", severity="LOW", line=2), dict(title="Gamma", severity="CRITICAL", line=3, scanner="Zz"))
    assert {r.title for r in post.search(df, "ALPHA").collect()} == {"Alpha"}
    assert {r.title for r in post.search(df, "cwe-8").collect()} == {"Alpha"}
    assert {r.title for r in post.search(df, "", "LOW").collect()} == {"Beta"}
    assert post.search(df).count() == 3
    assert [r.title for r in post.by_severity(df).collect()] == ["Gamma", "Alpha", "Beta"]
    assert [r.title for r in post.sorted_by(df, "file").collect()] == ["Alpha", "Beta", "Gamma"]
    assert [r.title for r in post.sorted_by(df, "scanner").collect()] == ["Alpha", "Beta", "Gamma"]
    assert {r.title for r in post.at_least(df, "HIGH").collect()} == {"Alpha", "Gamma"}
    assert post.at_least(df, "odd").count() == 3


def test_persisted_suppression(spark, raw):
    df = raw(dict(), dict(line=2), dict(title="U"))
    listed = spark.createDataFrame([("T::a.py",), ("T::a.py",)], "finding_hash string")
    assert [r.title for r in post.drop_persisted(df, listed).collect()] == ["U"]


@pytest.mark.parametrize("how", ["inner", "left_anti", "left_semi", "left"])
def test_salted_join_equals_join(spark, how):
    big = spark.range(3000).select((F.col("id") % 3 % 2).alias("k"), "id")
    lookup = spark.createDataFrame([(0, "x"), (5, "y")], "k bigint, v string")
    plain = big.join(lookup, ["k"], how)
    salted = salted_join(big, lookup, ["k"], how, F.col("id"))
    assert sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, salted.collect()), key=repr)


def _brute(findings, entries, t=3):
    keys = {(f.replace("\\", "/").lower(), n, title.lower()) for f, line, title in entries
            for n in range(max(1, line - t), line + t + 1)}
    return {(f, line, title) for f, line, title in findings if (f.replace("\\", "/").lower(), line, title.lower()) in keys}


def test_baseline_against_brute_force(spark, raw):
    rng = random.Random(1)
    found = {(rng.choice(["a/b.py", "A\\b.py", "c.py"]), rng.randint(0, 60), rng.choice(["T", "t", "U"])) for _ in range(300)}
    entries = [(rng.choice(["A/B.py", "a\\B.py", "d.py"]), rng.randint(-5, 60), rng.choice(["T", "u"])) for _ in range(40)]
    findings = raw(*[dict(file=f, line=line, title=t) for f, line, t in found])
    baseline = spark.createDataFrame([(f, line, t, "HIGH", "S") for f, line, t in entries], "file string, line int, title string, severity string, scanner string")
    baseline = baseline.union(baseline)

    def keys(df):
        return [(r.file, r.line, r.title) for r in df.collect()]
    known, new = keys(base.known_findings(findings, baseline)), keys(base.new_findings(findings, baseline))
    want = _brute(found, entries)
    assert want and set(known) == want and set(new) == found - want
    assert len(known) + len(new) == len(found)
    flagged = base.classify(findings, baseline).collect()
    assert len(flagged) == len(found) and {(r.file, r.line, r.title) for r in flagged if r.known} == want
    empty = baseline.limit(0)
    assert base.new_findings(findings, empty).count() == len(found) and base.known_findings(findings, empty).count() == 0


def test_baseline_join_keys_hold_the_line_bucket(raw):
    df = raw(dict())
    plan = base.new_findings(df, df.select("file", "line", "title", "severity", "scanner"))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "_bucket" in plan


def test_relative_targets(raw, spark, tmp_path):
    from siftguard.sinks import write_baseline
    from siftguard.sources.feeds import read_baseline
    df = raw(dict(file="/w/p/a.py"))
    path = str(tmp_path / "b")
    write_baseline(df, path, "/w/p")
    assert read_baseline(spark, path).first().file == "a.py"
    assert base.known_findings(df, read_baseline(spark, path), target_path="/w/p").count() == 1
    assert read_baseline(spark, str(tmp_path / "none")).count() == 0
    document = tmp_path / "b.json"
    document.write_text('{"target_path": "/w/p", "findings": [{"file": "a.py", "line": 3, "title": "T", "severity": "LOW", "scanner": "S"}]}')
    assert [(r.file, r.line) for r in read_baseline(spark, str(document)).collect()] == [("a.py", 3)]
    document.write_text("{broken")
    assert read_baseline(spark, str(document)).count() == 0


def test_counts_and_verdicts(spark, raw):
    df = raw(dict(file="a", severity="CRITICAL"), dict(file="a"), dict(file="b"), dict(file="c", severity="LOW"))
    scans = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "file string")
    rows = {r.file: r for r in summary.judge(summary.severity_counts(df, ["file"], scans)).collect()}
    assert (rows["a"].critical, rows["a"].high, rows["a"].total) == (1, 1, 2) and rows["d"].total == 0
    assert [rows[k].verdict for k in "abcd"] == ["REQUEST_CHANGES", "COMMENT", "COMMENT", "APPROVE"]
    assert [rows[k].report_verdict for k in "abcd"] == ["REQUEST CHANGES", "NEEDS REVIEW", "MINOR ISSUES", "APPROVED"]
    assert [rows[k].gate for k in "abcd"] == [1, 0, 0, 0]
    assert [rows[k].security_issues_found for k in "abcd"] == [True, True, False, False]


# A small project written for this test: each flaw line is named with what must be found.
PROJECT = {
    "shop/web.py": "\n".join([
        "import pickle, os, yaml",                                     # 1 pickle import
        "SECRET_KEY = 'development'",                                  # 2 weak key
        "DEBUG = True",                                                # 3 debug
        "def find(cur, k):",
        "    return cur.execute(f'SELECT * FROM t WHERE k = {k}')",    # 5 SQL1 + syntax rule
        "def run(c):",
        "    os.system(c)",                                            # 7 CMD1 + syntax rule
        "    subprocess.run(c, shell=True)",                           # 8 CMD2, merged with syntax rule
        "    return eval(c)",                                          # 9 CMD3 + syntax rule
        "def load(f):",
        "    return pickle.loads(f), yaml.load(f)",                    # 11 DES1, DES4
        "x = yaml.load(f, Loader=yaml.SafeLoader)",
        "y = hashlib.md5(b)  # nosec",
        "try:",
        "    pass",
        "except:",                                                     # 16 silent except
        "    pass",
        "app.run(debug=True)",                                         # 18 SEN3 + syntax rule
    ]),
    "shop/requirements.txt": "flask>=2.0\ndjango==2.2.14\nlodash==4.17.20\nPillow==8.0.0  # nosec\n",
    "shop/Dockerfile": "FROM x:latest\nUSER root",
    "shop/bad.py": "def (:\neval(x)",
}
EXPECTED = {
    ("shop/web.py", 1, "ASTScanner"): 1, ("shop/web.py", 2, "SensitiveDataScanner"): 1, ("shop/web.py", 3, "SensitiveDataScanner"): 1,
    ("shop/web.py", 5, "SQLInjectionScanner"): 1, ("shop/web.py", 5, "ASTScanner"): 1, ("shop/web.py", 7, "CommandInjectionScanner"): 1,
    ("shop/web.py", 7, "ASTScanner"): 1, ("shop/web.py", 8, "CommandInjectionScanner"): 1, ("shop/web.py", 9, "CommandInjectionScanner"): 1,
    ("shop/web.py", 9, "ASTScanner"): 1, ("shop/web.py", 11, "DeserializationScanner"): 2, ("shop/web.py", 16, "ASTScanner"): 1,
    ("shop/web.py", 18, "SensitiveDataScanner"): 1, ("shop/web.py", 18, "ASTScanner"): 1,
    ("shop/requirements.txt", 2, "DependencyScanner"): 1, ("shop/requirements.txt", 3, "DependencyScanner"): 1,
    ("shop/Dockerfile", 1, "IaCScanner"): 1, ("shop/Dockerfile", 2, "IaCScanner"): 1, ("shop/bad.py", 2, "CommandInjectionScanner"): 1,
}


def test_whole_scan_of_a_small_project(files):
    plan = scan(files(PROJECT))
    got = {(r.file, r.line, r.scanner): r["count"] for r in plan.findings.groupBy("file", "line", "scanner").count().collect()}
    assert got == EXPECTED
    dropped = {(r.file, r.line) for r in plan.raw.filter("suppressed").collect()}
    assert dropped == {("shop/web.py", 13), ("shop/requirements.txt", 4)}
    limited = scan(files(PROJECT), ScanConfig(min_severity="CRITICAL", enabled_scanners=["dependencies", "ast_scanner"])).findings
    assert {(r.line, r.severity) for r in limited.collect()} == {(5, "CRITICAL"), (8, "CRITICAL"), (9, "CRITICAL"), (2, "CRITICAL")}


def test_prose_is_attached_after_the_exchange(files):
    corpus = files(PROJECT)
    plan = scan(corpus).findings._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.splitlines() if "min(" in line and "Aggregate" in line]
    assert exchanged and not any(word in line for line in exchanged for word in ("description", "source_line", "cwe_id", "fix#", "severity"))
    # The same findings as with their prose carried along.
    from siftguard.plans.scan import finish, raw_findings
    slim, whole = scan(corpus).findings, finish(raw_findings(corpus)[0])
    assert slim.columns == whole.columns and sorted(map(str, slim.drop("rule_ord").collect())) == sorted(map(str, whole.drop("rule_ord").collect()))


def test_findings_outside_the_rule_table_keep_their_prose(spark, files):
    from siftguard.operators.plugins import Scanner

    def mine(path, content, lines):
        for n, text in enumerate(lines, 1):
            if "eval" in text:
                yield {"line": n, "severity": "low", "title": "has eval", "description": "own words"}

    scanner = Scanner("Mine", (".py",), mine)
    config = ScanConfig(enabled_scanners=["command_injection", "dependencies"])
    found = scan(files(PROJECT), config, scanners=[scanner]).findings.collect()
    own = [r for r in found if r.scanner == "Mine"]
    assert {(r.title, r.description, r.severity, r.sev_weight) for r in own} == {("has eval", "own words", "LOW", 2)}
    assert all(r.description and r.severity for r in found)


def test_scan_with_baseline_and_suppressions(spark, files):
    corpus = files(PROJECT)
    every = scan(corpus).findings.collect()
    gone, listed = every[0], every[-1]
    baseline = spark.createDataFrame([(gone.file, gone.line + 2, gone.title.upper(), gone.severity, gone.scanner)], "file string, line int, title string, severity string, scanner string")
    hashes = spark.createDataFrame([(f"{listed.title}::{listed.file}",), ("other::x",)], "finding_hash string")
    for store in (False, True):
        plan = scan(corpus, baseline=baseline, suppressions=hashes, store=store)
        counts = plan.counts().first()
        known = [r for r in every if r.title == gone.title and r.file == gone.file and abs(r.line - gone.line - 2) <= 3]
        out = [r for r in every if r.title == listed.title and r.file == listed.file]
        assert (counts.suppressed_inline, counts.suppressed_persisted, counts.suppressed_by_baseline) == (plan.raw.filter("suppressed").count(), len(out), len(set(known) - set(out)))
        assert counts.reported == plan.findings.count() == len(every) - counts.suppressed_persisted - counts.suppressed_by_baseline
        assert plan.errors.count() == 0 and plan.findings.columns == scan(corpus).findings.columns


def test_stored_corpus_gives_the_same_findings(files, tmp_path):
    from siftguard.sinks import write_corpus
    direct = scan(files(PROJECT)).findings
    stored = scan(write_corpus(files(PROJECT), str(tmp_path / "corpus"))).findings
    assert direct.exceptAll(stored).count() == 0 and stored.exceptAll(direct).count() == 0


def test_summary_and_history_of_a_scan(spark, files, tmp_path):
    import json

    from siftguard.operators.export import findings_documents, sarif_documents
    from siftguard.plans.scan import record, summarise
    from siftguard.sinks import HistoryStore
    plan = scan(files(PROJECT))
    row = summarise(plan, "s", "shop", "2024-01-01T00:00:00", 1.23456)
    one = row.first()
    assert (one.files_scanned, one.files_skipped, one.total, one.verdict, one.gate) == (4, 0, 20, "REQUEST_CHANGES", 1)
    keyed = plan.findings.withColumn("scan_id", F.lit("s"))
    document = json.loads(findings_documents(keyed, row).first().document)
    assert document["summary"]["total"] == sum(EXPECTED.values()) and document["findings"][0]["severity"] == "CRITICAL"
    results = [r for d in sarif_documents(keyed, row).collect() for r in json.loads(d.document)["runs"][0]["results"]]
    assert len(results) == 20 and {"web.py", "requirements.txt"} <= {
        r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for r in results}
    store = HistoryStore(spark, str(tmp_path / "h"))
    scan_id = record(plan, store, "shop", "2024-01-01 00:00:00", 1.0)
    assert store.scans().filter(F.col("scan_id") == scan_id).first().total == 20
