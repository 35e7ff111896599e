"""Folder trees: listing in rounds, the data source, and files that arrive."""

import os
import time

import pytest
from pyspark.sql import functions as F

from siftguard import ScanConfig
from siftguard.sources.corpus import stream_corpus
from siftguard.sources.file_tree import FileTreeSource, FilteringFileTreeReader, Share, _Tree, read_tree
from siftguard.sources.listing import list_tree, sized_tree


def _fill(root, layout):
    for name, data in layout.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)


def _walked(root, excluded=()):
    out = {}
    for here, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if d not in excluded and not d.startswith(".")]
        out |= {os.path.join(here, n): os.path.relpath(os.path.join(here, n), root).count("/") + 1 for n in names}
    return out


@pytest.mark.parametrize("entries", [1, 7, 1000])
def test_rounds_find_the_same_files(spark, tmp_path, entries):
    layout = {f"d{i % 5}/e{i % 3}/f{i % 2}/n{i}.py": b"x" for i in range(60)} | {"top.py": b"", ".git/x.py": b"", "a/.env": b"", "skip/x.py": b"", "a/__init__.py": b"",
                                                                             "deep/" + "/".join("abcdefghijklmnop") + "/z.py": b""}
    _fill(tmp_path, layout)
    (tmp_path / "loop").symlink_to(tmp_path)
    (tmp_path / "link.py").symlink_to(tmp_path / "top.py")
    got = {r.path: r.depth for r in list_tree(spark, str(tmp_path), {"skip"}, entries).collect()}
    want = _walked(tmp_path, {"skip"})
    assert got == want and len(got) == 65


def test_missing_and_empty_folders(spark, tmp_path):
    assert list_tree(spark, str(tmp_path / "gone")).collect() == [] and list_tree(spark, str(tmp_path)).collect() == []


def test_many_siblings_and_one_flat_folder(spark, tmp_path):
    for i in range(20_000):
        os.mkdir(tmp_path / f"s{i}")
    (tmp_path / "s77" / "x.py").write_bytes(b"12")
    flat = tmp_path / "flat"
    flat.mkdir()
    for i in range(50_000):
        os.close(os.open(flat / f"n{i}.py", os.O_CREAT))
    found = sized_tree(spark, str(tmp_path), keep=F.col("path").endswith(".py"))
    assert found.count() == 50_001 and found.where("length = 2").count() == 1


def test_names_that_are_no_text(spark, tmp_path):
    os.close(os.open(os.path.join(os.fsencode(tmp_path), b"bad\xff.py"), os.O_CREAT))
    assert [(r.path.rpartition("/")[2], r.length) for r in sized_tree(spark, str(tmp_path)).collect()] == [("bad?.py", None)]


def test_source_reads_the_tree(spark, tmp_path):
    layout = {f"d{i % 3}/n{i}.{'py' if i % 2 else 'md'}": b"x" * i for i in range(40)} | {".git/c.py": b"no", "node_modules/d.py": b"no", ".env": b"K"}
    _fill(tmp_path, layout)
    spark.dataSource.register(FileTreeSource)
    rows = spark.read.format("file_tree").option("exclude", "node_modules").load(str(tmp_path)).collect()
    assert {r.path[len(str(tmp_path)) + 1:]: bytes(r.bytes) for r in rows} == {k: v for k, v in layout.items() if not k.startswith((".git", "node_modules"))}
    assert all(r.length == len(r.bytes) for r in rows) and len(rows) == 41


def test_filters_reach_the_source(spark, tmp_path):
    _fill(tmp_path, {f"n{i}.{'py' if i % 2 else 'md'}": b"x" * i for i in range(40)})
    found = read_tree(spark, str(tmp_path)).where("path like '%.py' and length <= 11 and length > 3 and cast(bytes as string) like 'xx%'")
    assert sorted(r.length for r in found.select("length").collect()) == [5, 7, 9, 11]
    # Spark has nothing left to test of what was pushed.
    assert "EndsWith" not in found._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]


def test_unread_files_are_not_opened(tmp_path, monkeypatch):
    from pyspark.sql.datasource import IsNotNull, LessThanOrEqual, StringEndsWith
    _fill(tmp_path, {"a.py": b"1", "b.py": b"22", "c.md": b"1"})
    reader = FilteringFileTreeReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([StringEndsWith(("path",), ".py"), LessThanOrEqual(("length",), 1), IsNotNull(("path",))]))
    assert left == [IsNotNull(("path",))]
    opened = []
    monkeypatch.setattr("builtins.open", lambda path, mode: opened.append(path) or __import__("io").BytesIO(b"1"))
    rows = [r for share in reader.partitions() for batch in reader.read(share) for r in batch.to_pylist()]
    assert [r["path"] for r in rows] == opened == [str(tmp_path / "a.py")]


def test_every_file_is_in_one_share(tmp_path):
    _fill(tmp_path, {f"d{i}/x{j}.py": b"" for i in range(400) for j in range(2)} | {f"flat{i}.py": b"" for i in range(100)})
    for shards in (1, 8, 500):
        tree = _Tree({"path": str(tmp_path), "shards": str(shards)})
        found = [path for share in tree.shares() for path, _ in tree.files(share)]
        assert len(found) == len(set(found)) == 900
    assert len([s for s in _Tree({"path": str(tmp_path / "d1"), "shards": "8"}).shares() if s == Share(str(tmp_path / "d1"), False, s.part, 8)]) == 8


def _drain(spark, frame, place):
    query = frame.writeStream.format("parquet").trigger(availableNow=True).option("checkpointLocation", f"{place}-state").start(str(place))
    query.awaitTermination(120)
    return spark.read.parquet(str(place))


def test_files_arrive_once(spark, tmp_path):
    inbox, out = tmp_path / "inbox", tmp_path / "out"
    _fill(inbox, {"a.py": b"one", "sub/b.py": b"two", "c.md": b"no", "big.py": b"x" * 50})
    cfg = ScanConfig(include_extensions=[".py"], max_file_size=40)
    frame = stream_corpus(spark, str(inbox), cfg, settle_ms=0)
    assert frame.isStreaming and frame.columns == ["path", "length", "content", "skip_reason", "arrived"]
    time.sleep(0.05)
    got = _drain(spark, frame, out)
    assert {(os.path.relpath(r.path, inbox), r.content, r.skip_reason) for r in got.collect()} == {("a.py", "one", None), ("sub/b.py", "two", None), ("big.py", None, "oversize")}
    # Moved in with an old time of writing, written anew, and untouched.
    _fill(tmp_path, {"stage/old.py": b"old"})
    os.utime(tmp_path / "stage/old.py", (1, 1))
    os.rename(tmp_path / "stage/old.py", inbox / "old.py")
    _fill(inbox, {"a.py": b"again"})
    time.sleep(0.05)
    got = _drain(spark, stream_corpus(spark, str(inbox), cfg, settle_ms=0), out)
    assert sorted(r.content or "" for r in got.collect()) == ["", "again", "old", "one", "two"]
    assert _drain(spark, stream_corpus(spark, str(inbox), cfg, settle_ms=0), out).count() == 5
