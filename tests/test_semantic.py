"""Syntax rules and user scanners."""

from siftguard.operators.plugins import Scanner, run_scanner, scanner_table
from siftguard.operators.semantic import semantic_findings, semantic_outcomes, syntax_facts

# source → (line, title fragment) that must be found
CASES = {
    "import pickle.x as p, os\n": [(1, "pickle")],
    "from cgi import y\nfrom . import pickle\n": [(1, "cgi")],
    "import ftplib, telnetlib, marshal": [(1, "ftplib"), (1, "marshal"), (1, "telnetlib")],
    "x = 1\neval(a)\nexec('1')\nast.eval(b)\neval()\n": [(2, "eval()")],
    "exec(f'{a}')": [(1, "exec()")],
    "os.system(c)\nos.system('ls')\nmy.os.system(c)\nos.popen(f'{x}')\nos.startfile(p)\n": [(1, "os.system()"), (4, "os.popen()"), (5, "os.startfile()")],
    "subprocess.run(c, shell=True)\nsubprocess.run(c, shell=1)\nsubprocess.call(shell=False)\nsp.run(c, shell=True)\n": [(1, "shell=True")],
    "a.b.execute('x' + y)\nc.execute('x')\nc.executemany(f'{x}', r)\nc.execute(a % b)\nexecute('x' + y)\n": [(1, "execute()"), (3, "execute()")],
    "app.run(debug=True)\nrun(debug=True)\nx.y.run(1, debug=False)\n": [(1, "Flask debug")],
    "s.bind(('0.0.0.0', 1))\ns.bind('0.0.0.0')\ns.bind(('127.0.0.1', 1))": [(1, "0.0.0.0")],
    "assert user.IS_ADMIN\nassert x == 1\nassert (1 and\n  verify_it(x))": [(1, "assert"), (3, "assert")],
    "try:\n  pass\nexcept:\n  pass\n": [(3, "Bare except")],
    "try:\n  pass\nexcept ValueError:\n  pass\ntry:\n  pass\nexcept:\n  x = 1\n": [],
    "def (:\neval(x)": [],
    "eval(x)\n\x00": [],
    "ｅｖａｌ(x)": [(1, "eval()")],
    "x = [eval(y) for y in z]\nfoo(a, eval(b))\n": [(1, "eval()"), (2, "eval()")],
    "eval(\n  x\n)  # tail": [(1, "eval()")],
}


def test_semantic_rules(files):
    names = {f"f{i}.py": (src, want) for i, (src, want) in enumerate(CASES.items())}
    corpus = files({**{n: src for n, (src, _) in names.items()}, "x.js": "eval(a)"})
    got = {}
    for row in semantic_findings(corpus).collect():
        got.setdefault(row.file, []).append((row.line, row.title))
    assert set(got) <= set(names)
    for name, (src, want) in names.items():
        found = sorted(got.get(name, []))
        assert len(found) == len(want) and all(n == m and part in title for (n, title), (m, part) in zip(found, sorted(want))), (src, found)


def test_snippet_is_the_source_line(files):
    row = semantic_findings(files({"a.py": "x\n  \neval( y )   \t"})).first()
    assert (row.line, row.code_snippet, row.source_line) == (3, "eval( y )", "eval( y )   \t")


def test_severity_threshold(files):
    corpus = files({"a.py": "import ftplib\neval(x)"})
    assert {r.severity for r in semantic_findings(corpus, "HIGH").collect()} == {"CRITICAL"}


def test_files_without_trigger_words_are_not_parsed(files):
    corpus = files({"a.py": "x = 1", "b.py": "run(debug=True)"})
    plan = syntax_facts(corpus)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("BatchEvalPythonUDTF"):]
    assert "Contains(content" in below and "Exchange" not in plan


def test_a_file_is_parsed_once_for_findings_and_faults(files):
    plan = semantic_outcomes(files({"a.py": "eval(x)"}), keep=["length"])
    assert plan._jdf.queryExecution().executedPlan().toString().count("BatchEvalPythonUDTF") == 1
    row = plan.first()
    assert (row.file, row.line, row.error, row.length) == ("a.py", 1, None, 7)


def test_a_fault_is_a_row_of_the_same_table(files, monkeypatch):
    deep = "x = " + "(" * 150 + "1" + ")" * 150 + "\nimport pickle"
    rows = semantic_outcomes(files({"deep.py": "a" + ".b" * 30_000 + "\nimport pickle", "a.py": "import pickle", "bad.py": "import pickle (", "b.py": deep})).collect()
    assert {r.file for r in rows if r.error is None} >= {"a.py"} and all(r.file in ("deep.py", "b.py") for r in rows if r.error)


def test_user_scanner_fails_per_file(spark, files):
    def _scan(path, content, lines):
        if "boom" in content:
            raise RuntimeError("boom")
        for n, text in enumerate(lines, 1):
            if "x" in text:
                yield {"line": n, "severity": "low", "title": "has x"}

    scanner = Scanner("Mine", (".txt",), _scan)
    found, errors = run_scanner(files({"a.txt": "x\ny\nx", "b.txt": "x boom", "c.py": "x"}), scanner)
    assert sorted((r.file, r.line, r.severity, r.scanner) for r in found.collect()) == [("a.txt", 1, "LOW", "Mine"), ("a.txt", 3, "LOW", "Mine")]
    assert [(r.file, "boom" in r.error) for r in errors.collect()] == [("b.txt", True)]
    assert scanner_table(spark, [scanner]).first().function == "_scan"
