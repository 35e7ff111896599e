"""A folder tree as a Spark data source, for batches and for streams.

```python
spark.dataSource.register(FileTreeSource)
spark.read.format("file_tree").load("/shared/code").where("path like '%.py' and length <= 1000000")
spark.readStream.format("file_tree").load("/shared/inbox")
```

Rows are (path, length, arrived, bytes). Options: ``path``, ``pushdown``, ``exclude`` (folder names, comma-separated), ``shards`` (least number of
partitions), ``settle_ms`` (streams only look at files older than this).

*Partitions.* The planner opens folders breadth first, names only, until it has ``FRONTIER`` of them. A partition
is one folder with everything below, or a share of the names of a folder already opened, picked by hash, so neither one deep folder nor one flat folder is
read by a single task. Files are opened by the tasks.

*Pushdown.* Suffixes, prefixes and parts of ``path`` and bounds of ``length`` are tested on names and sizes; a file that fails is never opened. Other conditions
stay with Spark. Spark accepts a source that does this only where ``spark.sql.python.filterPushdown.enabled`` is set, so the option ``pushdown`` asks for it
(:func:`read_tree` sets both).

*Streams.* A file arrives when its entry changes (``ctime``: written, or moved into the tree). Offsets are times, so a batch holds the files whose entry
changed after the last offset, up to the new one, and a file belongs to exactly one batch. A file written again arrives
again. Files younger than ``settle_ms`` wait, since several may share a tick of the clock or still be written. A restart goes on at the stored offset; replaying a batch gives the same
files unless they have changed since. A file that vanished in between is left out.
"""

from __future__ import annotations

import os
import time
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

from .listing import scan_folder

SCHEMA = "path string, length bigint, arrived timestamp, bytes binary"
#: Folders the planner opens at most, each of whose names it forgets except for sub-folders.
FRONTIER, SHARDS = 256, 8
#: Bytes of content handed to Spark at a time.
BATCH_BYTES = 16_000_000
SETTLE_MS = 200

_NAME_TESTS = {
    StringEndsWith: lambda path, value: path.endswith(value), StringStartsWith: lambda path, value: path.startswith(value),
    StringContains: lambda path, value: value in path, EqualTo: lambda path, value: path == value}
_SIZE_TESTS = {
    LessThanOrEqual: lambda n, value: n <= value, LessThan: lambda n, value: n < value, EqualTo: lambda n, value: n == value,
    GreaterThanOrEqual: lambda n, value: n >= value, GreaterThan: lambda n, value: n > value}


@dataclass
class Share(InputPartition):
    """A folder with all below it, or the share ``part`` of ``parts`` of the files directly in it. Times in nanoseconds."""

    folder: str
    deep: bool
    part: int = 0
    parts: int = 1
    after: int = -1
    until: int | None = None


class _Tree:
    """What both readers share: partitions, and the files of one."""

    def __init__(self, options: dict) -> None:
        if not options.get("path"):
            raise ValueError("the file tree needs a path")
        self.root = options["path"].removeprefix("file://")
        self.excluded = {x for x in options.get("exclude", "").split(",") if x}
        self.shards = int(options.get("shards", SHARDS))
        self.tests: list[tuple[str, type, object]] = []

    def shares(self, after: int = -1, until: int | None = None) -> list[Share]:
        opened, waiting = [], deque([self.root])
        while waiting and len(opened) + len(waiting) < FRONTIER:
            folder = waiting.popleft()
            opened.append(folder)
            below = [path for path, is_folder in scan_folder(folder, self.excluded) if is_folder]
            waiting.extend(below)
        parts = max(1, -(-self.shards // (len(opened) + len(waiting))), self.shards if len(opened) <= 4 else 1)
        return ([Share(f, True, 0, 1, after, until) for f in waiting]
                + [Share(f, False, k, parts, after, until) for f in opened for k in range(parts)])

    def passes(self, name: str, value) -> bool:
        tests = _NAME_TESTS if name == "path" else _SIZE_TESTS
        return all(tests[kind](value, bound) for column, kind, bound in self.tests if column == name)

    def files(self, share: Share) -> Iterator[tuple[str, os.stat_result]]:
        """Files of a share that pass the tests and arrived in time."""
        waiting = deque([share.folder])
        while waiting:
            for path, is_folder in scan_folder(waiting.popleft(), self.excluded):
                if is_folder:
                    if share.deep:
                        waiting.append(path)
                elif self.passes("path", path) and (share.parts == 1 or zlib.crc32(os.fsencode(path)) % share.parts == share.part):
                    try:
                        facts = os.stat(path)
                    except OSError:
                        continue
                    in_time = share.until is None or share.after < facts.st_ctime_ns <= share.until
                    if in_time and self.passes("length", facts.st_size):
                        yield path, facts

    def rows(self, share: Share) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path, facts in self.files(share):
            try:
                with open(path, "rb") as handle:
                    raw = handle.read()
            except FileNotFoundError:
                continue
            except OSError:
                raw = None
            rows.append((path.encode("utf-8", "replace").decode(), facts.st_size, facts.st_ctime_ns // 1000, raw))
            size += len(raw or b"")
            if size >= BATCH_BYTES:
                yield _as_batch(rows)
                rows, size = [], 0
        yield _as_batch(rows)


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    kinds = (pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "length", "arrived", "bytes"])


class FileTreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.tree = _Tree(options)

    def partitions(self) -> list[Share]:
        return self.tree.shares()

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        return self.tree.rows(share)


class FilteringFileTreeReader(FileTreeReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for test in filters:
            column = test.attribute[0] if hasattr(test, "attribute") and len(test.attribute) == 1 else None
            if (column == "path" and type(test) in _NAME_TESTS) or (column == "length" and type(test) in _SIZE_TESTS):
                self.tree.tests.append((column, type(test), test.value))
            else:
                yield test


class FileTreeStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.tree, self.settle = _Tree(options), int(options.get("settle_ms", SETTLE_MS)) * 1_000_000

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() - self.settle}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        return self.tree.shares(start["until"], end["until"]) if start["until"] < end["until"] else []

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        return self.tree.rows(share)


class FileTreeSource(DataSource):
    """``spark.read.format("file_tree")`` and ``spark.readStream.format("file_tree")``."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FileTreeReader:
        return (FilteringFileTreeReader if self.options.get("pushdown") == "true" else FileTreeReader)(self.options)

    def streamReader(self, schema) -> FileTreeStreamReader:
        return FileTreeStreamReader(self.options)


def read_tree(spark: SparkSession, root: str, exclude: list[str] = ()) -> DataFrame:
    """The tree as a table whose conditions on path and length are tested before files are opened."""
    spark.dataSource.register(FileTreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FileTreeSource.name()).options(pushdown="true", exclude=",".join(exclude)).load(root)
