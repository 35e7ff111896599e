"""Sources: splitting, decoding, binary and size tests, folder trees, file kinds."""

import random

from pyspark.sql import functions as F

from siftguard import ScanConfig, load_config
from siftguard.functions.text import decode_utf8, is_binary, rstrip
from siftguard.operators.lines import explode_lines, snippets_with_context, with_file_facts
from siftguard.sinks import write_corpus
from siftguard.sources.corpus import corpus_from_table, limit_size, read_corpus


def test_split_equals_python(spark, files):
    rng = random.Random(3)
    alphabet = "ab \t\n\r\x0b\f\x1c\x1d\x1e\x1f\x85  é"
    texts = ["", "\n", "a", "a\n\n", "a\r\nb", "\r\n\r\n", "a\x85", "a b\n"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(600)]
    got = {}
    for row in explode_lines(files({f"f{i}": t for i, t in enumerate(texts)})).collect():
        got.setdefault(row.path, {})[row.line] = row.text
    for i, text in enumerate(texts):
        assert [v for _, v in sorted(got.get(f"f{i}", {}).items())] == text.splitlines(), repr(text)


def test_rstrip_equals_python(spark):
    texts = ["a \t", "a 　", "a\x1f", " a ", "", "   ", "a​"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", rstrip(F.col("t")).alias("r")).collect()
    assert [r.r for r in rows] == [t.rstrip() for t in texts]


def test_decode_and_binary(spark):
    raw = [b"", b"plain", b"\xff\xfe\xc3(", b"\x01" * 3 + b"a" * 7, b"\x01" * 4 + b"a" * 6, b"a" * 8192 + b"\x00" * 9000,
           b"\x7f" * 31 + b"a" * 69, b"\t\n\r" * 50]
    df = spark.createDataFrame([(bytearray(b),) for b in raw], "b binary")
    rows = df.select(decode_utf8(F.col("b")).alias("t"), is_binary(F.col("b")).alias("x")).collect()
    assert [r.t for r in rows] == [b.decode("utf-8", errors="replace") for b in raw]

    def share(b):
        head = b[:8192]
        return bool(head) and sum(c < 9 or 14 <= c < 32 or c == 127 for c in head) / len(head) > 0.30
    assert [r.x for r in rows] == [share(b) for b in raw]


def _tree(root):
    layout = {
        "a.py": b"x", "__init__.py": b"y", ".env": b"K=1", "notes.md": b"no", "Dockerfile": b"FROM x",
        "sub/_private.py": b"z", "sub/deep/b.js": b"q", ".git/c.py": b"no", "node_modules/d.js": b"no",
        ".hidden/e.py": b"no", "venv/f.py": b"no", "big.py": b"a" * 101, "edge.py": b"a" * 100, "bin.py": b"\x00\x01" * 10,
        "UPPER.PY": b"no",
    }
    for name, data in layout.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)


def test_tree(spark, tmp_path):
    _tree(tmp_path)
    rows = read_corpus(spark, str(tmp_path), ScanConfig(max_file_size=100)).collect()
    got = {r.path[len(str(tmp_path)) + 1:]: r.skip_reason for r in rows}
    assert got == {"a.py": None, "__init__.py": None, ".env": None, "sub/_private.py": None, "sub/deep/b.js": None,
                   "big.py": "oversize", "edge.py": None, "bin.py": "binary"}
    assert all((r.content is None) == (r.skip_reason is not None) for r in rows)
    everything = read_corpus(spark, str(tmp_path), ScanConfig(include_extensions=[], scan_binary=True)).collect()
    names = {r.path[len(str(tmp_path)) + 1:] for r in everything}
    assert {"Dockerfile", "notes.md", "bin.py", "UPPER.PY"} <= names and not any(n.startswith(".git") for n in names)


def test_subset(spark, tmp_path):
    _tree(tmp_path)
    wanted = spark.createDataFrame([(str(tmp_path / ".git/c.py"),), (str(tmp_path / "notes.md"),), (str(tmp_path / "gone.py"),)], "path string")
    assert {r.path[len(str(tmp_path)) + 1:] for r in read_corpus(spark, str(tmp_path), only=wanted).collect()} == {".git/c.py", "notes.md"}
    none = spark.createDataFrame([], "path string")
    assert read_corpus(spark, str(tmp_path), only=none).count() == 8


def test_stored_corpus_is_split_by_class(spark, files, tmp_path):
    stored = write_corpus(files({"a.py": "x", "p/package.json": "{}", "b.js": "y"}), str(tmp_path / "c"))
    assert {r.path: r.file_class for r in stored.collect()} == {"a.py": "python", "p/package.json": "manifest", "b.js": "other"}
    plan = stored.filter(F.col("file_class") == "python")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(file_class" in plan


def test_table_corpus_and_size_limit(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "é" * 3)], "id int, t string")
    made = limit_size(corpus_from_table(df, F.concat(F.lit("t/"), F.col("id").cast("string")), F.col("t")), ScanConfig(max_file_size=5))
    assert {r.path: r.skip_reason for r in made.collect()} == {"t/1": None, "t/2": "unreadable", "t/3": "oversize"}


def test_file_kinds(spark, files):
    cases = {
        "Dockerfile": "dockerfile", "a/dockerfile.dev": "dockerfile", "Docker-Compose.yml": "compose",
        "docker-compose.YML": None, "m.tf": "terraform", "m.hcl": "terraform", ".tf": None, "m.TF": None,
        "a/.x.tf": "terraform", "k.yaml": "k8s", "s.yml": "compose", "p.yml": None, "x.json": None,
    }
    bodies = {"k.yaml": "apiVersion: 1\nkind: x\nservices:", "s.yml": "services:", "p.yml": "kind: x"}
    rows = with_file_facts(files({p: bodies.get(p, "x") for p in cases})).collect()
    assert {r.path: r.kind for r in rows} == cases


def test_snippets_with_context(spark, files):
    lines = explode_lines(files({"f": "\n".join("abcdef")}))
    spots = spark.createDataFrame([("f", 1), ("f", 3), ("f", 6), ("f", 3)], "file string, line int")
    got = {r.line: r.context_snippet for r in snippets_with_context(spots, lines, 1).collect()}
    assert got == {1: "a\nb", 3: "b\nc\nd", 6: "e\nf"}


def test_config_files(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"min_severity": "high", "max_file_size": "5", "scan_binary": true}')
    config = load_config(str(path))
    assert (config.min_severity, config.max_file_size, config.scan_binary) == ("HIGH", 5, False)
    path.write_text("{broken")
    assert load_config(str(path)) == ScanConfig() == load_config(str(tmp_path / "none"))
