"""Manifest formats, version keys, advisories and OSV records."""

import json
import random
import re

from pyspark.sql import functions as F

from siftguard.functions.osv import osv_fix_version, osv_severity
from siftguard.functions.versions import version_key
from siftguard.operators import dependencies as deps
from siftguard.operators.postprocess import deduplicate
from siftguard.rules.advisories import ADVISORIES
from siftguard.sources.feeds import parse_osv, read_osv


def _pins(df):
    return sorted((r.file, r.pkg, r.ver, r.line, r.code_snippet, r.source_line) for r in df.collect())


def test_requirements(files):
    text = "Django==2.2 ; x\n  a_b >= 1.0 # c\npkg[x]==1\nplain\n# c==1\nq~=3.1,<4\nr!=1\ns===2"
    got = _pins(deps.extract_dependencies(files({"r/Requirements.txt": text})))
    assert [(p[1], p[2], p[3]) for p in sorted(got, key=lambda p: p[3])] == [
        ("django", "2.2", 1), ("a_b", "1.0", 2), ("q", "3.1,<4", 6), ("r", "1", 7), ("s", "=2", 8)]


def test_package_json(files):
    good = json.dumps({"dependencies": {"Lodash": "^4.17.20", "x": ">= 1.0"}, "devDependencies": {"x": "~2.0"}})
    contents = {"a/package.json": good, "b/package.json": "{broken", "c/package.json": "[1]", "d/package.json": "{}",
                "e/package.json": '{"dependencies": {"n": "1"}} '}
    got = _pins(deps.extract_dependencies(files(contents)))
    assert got == [("a/package.json", "Lodash", "4.17.20", 1, '"Lodash": "^4.17.20"', good),
                   ("a/package.json", "x", "2.0", 1, '"x": "~2.0"', good),
                   ("e/package.json", "n", "1", 1, '"n": "1"', '{"dependencies": {"n": "1"}} ')]


def _poetry_model(text):
    current, out = None, []
    for n, line in enumerate(text.splitlines(), 1):
        name, version = re.search(deps.POETRY_NAME, line), re.search(deps.POETRY_VERSION, line)
        if name:
            current = (name.group(1).lower(), n)
        if version and current:
            out.append((*current, version.group(1)))
            current = None
    return out


def test_lock_files_follow_the_state_machine(files):
    rng = random.Random(2)
    bits = ['name = "P%d"', 'version = "%d"', "[[package]]", 'name = "Q%d" version = "%d"', 'file-name = "z%d"', ""]
    contents = {}
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 12)):
            bit = rng.choice(bits)
            lines.append(bit % tuple(rng.randint(0, 99) for _ in range(bit.count("%d"))))
        contents[f"p{i}/poetry.lock"] = "\n".join(lines)
    got = sorted((r.file, r.pkg, r.line, r.ver) for r in deps.extract_dependencies(files(contents)).collect())
    assert got == sorted((p, name, line, ver) for p, text in contents.items() for name, line, ver in _poetry_model(text))
    assert len(got) > 50


def test_yarn_lock(files):
    text = 'lodash@^4.0, lodash@^4.1:\n  version "4.17.20"\n  resolved "https://r/l@x"\n\n"@org/pkg@^1":\n  version "1.0"\n"Axios@1":\n  dep "2"\n  version "0.21.1"\n'
    got = _pins(deps.extract_dependencies(files({"y/yarn.lock": text})))
    assert [(p[1], p[2], p[3], p[4]) for p in got] == [("Axios", "0.21.1", 7, "Axios@0.21.1"), ("lodash", "4.17.20", 1, "lodash@4.17.20")]


def test_pipfile_and_package_lock(files):
    pipfile = json.dumps({"default": {"Flask": {"version": "==0.12"}, "g": {"git": "u"}}, "develop": {"Flask": {"version": "==0.12"}, "e": {"version": ""}}})
    v2 = json.dumps({"packages": {"": {"version": "1"}, "node_modules/a/node_modules/@o/lodash": {"version": "4"}, "node_modules/b": {}}, "dependencies": {"z": {"version": "9"}}})
    v1 = json.dumps({"dependencies": {"axios": {"version": "0.1"}}})
    empty = json.dumps({"packages": {}, "dependencies": {"z": {"version": "9"}}})
    got = _pins(deps.extract_dependencies(files({"a/Pipfile.lock": pipfile, "b/package-lock.json": v2, "c/package-lock.json": v1, "d/package-lock.json": empty})))
    assert [(p[0], p[1], p[2], p[4]) for p in got] == [
        ("a/Pipfile.lock", "Flask", "0.12", "Flask==0.12"), ("a/Pipfile.lock", "Flask", "0.12", "Flask==0.12"),
        ("b/package-lock.json", "@o/lodash", "4", "@o/lodash@4"), ("c/package-lock.json", "axios", "0.1", "axios@0.1")]


def _key(version):
    parts = []
    for part in re.split(r"[.\-]", version)[:4]:
        parts.append(int(part) if part.isdigit() else 0)
    return (parts + [0] * 4)[:4]


def test_version_keys(spark):
    versions = ["1.2", "1.2.3.4.5", "1.0-rc1", "v1", "", "1.0,<2.0", "10.0", "9.9", "2.2-rc1.7.9"]
    rows = spark.createDataFrame([(v,) for v in versions], "v string").select("v", version_key(F.col("v")).alias("k")).collect()
    assert [list(r.k) for r in rows] == [_key(v) for v in versions]
    order = spark.createDataFrame([("9.9", "10.0"), ("10.0", "9.9"), ("1.0", "1.0.0")], "a string, b string")
    assert [r[0] for r in order.select(version_key(F.col("a")) <= version_key(F.col("b"))).collect()] == [True, False, True]


def test_advisories_against_brute_force(spark, files):
    rng = random.Random(4)
    names = [a[0] for a in ADVISORIES] + ["numpy"]
    pins = {(rng.choice(names), f"{rng.randint(0, 9)}.{rng.randint(0, 40)}.{rng.randint(0, 30)}") for _ in range(400)}
    text = "\n".join(f"{n}=={v}" for n, v in sorted(pins))
    found = deps.dependency_findings(deps.extract_dependencies(files({"requirements.txt": text})), deps.advisories(spark))
    got = sorted(r.title for r in found.collect())
    want = sorted(f"Vulnerable Dependency — {n} {v} ({a[2]})" for n, v in pins for a in ADVISORIES if a[0] == n and _key(v) <= _key(a[1]))
    assert got == want and len(got) > 50
    assert deduplicate(found).count() == len(set(got)) < len(got)


def test_osv_readings(spark):
    cases = [([], "HIGH"), (None, "HIGH"), (["9.0"], "CRITICAL"), (["6.9", "9.9"], "MEDIUM"), (["7"], "HIGH"), (["0.1"], "LOW"),
             (["cvss critical"], "CRITICAL"), (["high"], "HIGH"), (["Medium"], "MEDIUM"), (["CVSS:3.1/AV:N"], "LOW"), ([""], "LOW"), (["nan"], "LOW")]
    df = spark.createDataFrame([(None if s is None else [(x,) for x in s],) for s, _ in cases], "s array<struct<score string>>")
    assert [r[0] for r in df.select(osv_severity(F.col("s"))).collect()] == [w for _, w in cases]
    shape = "a array<struct<ranges array<struct<events array<struct<introduced string, fixed string>>>>>>"
    ranges = [([], "latest"), ([[["0", None], [None, "1"], [None, "2"]]], "1"), ([[[None, "1"]], [[None, "3"], [None, "4"]], [["5", None]]], "3")]
    rows = [([([([tuple(e) for e in events],) for events in rs],)],) for rs, _ in ranges]
    df = spark.createDataFrame(rows, shape)
    assert [r[0] for r in df.select(osv_fix_version(F.col("a"))).collect()] == [w for _, w in ranges]
    assert spark.sql("SELECT CAST(NULL AS " + shape[2:] + ") AS a").select(osv_fix_version(F.col("a"))).first()[0] == "latest"


def test_exact_records_come_before_ranges(spark, files, tmp_path):
    record = {"id": "OSV-1", "summary": "bad", "details": "x" * 400, "severity": [{"score": "9.8"}],
              "affected": [{"package": {"name": "flask", "ecosystem": "PyPI"}, "versions": ["0.12"], "ranges": [{"events": [{"fixed": "0.13"}]}]}]}
    (tmp_path / "feed.json").write_text(json.dumps(record) + "\n")
    osv = deps.osv_index(read_osv(spark, str(tmp_path / "feed.json")))
    assert osv.collect() == deps.osv_index(parse_osv(spark.createDataFrame([(json.dumps(record),)], "record string"))).collect()
    text = "flask==0.12\nflask==0.11\nnumpy==1"
    found = deps.osv_findings(deps.extract_dependencies(files({"requirements.txt": text})), osv, deps.advisories(spark)).collect()
    got = {r.line: r for r in found}
    assert set(got) == {1, 2}
    assert (got[1].scanner, got[1].severity, got[1].fix) == ("OSVScanner", "CRITICAL", "Upgrade flask to >= 0.13. See: https://osv.dev/vulnerability/OSV-1")
    assert len(got[1].description) == 300 and got[2].scanner == "DependencyScanner(bundled)"
