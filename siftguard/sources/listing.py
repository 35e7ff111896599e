"""Listing of folder trees by tasks, in rounds.

The folders still to be opened are a stored table. In each round every task opens the folders it was dealt, goes
on into what it finds below them until it has seen ``ENTRIES`` names, and hands back the folders it has not opened; those are the table of
the next round. So a narrow deep tree takes one round, a wide one is spread over all tasks in the second, and the driver only
ever holds a count. A folder is read by one task, in batches, however many names it has; sizes are taken afterwards by all tasks.

Spark's own file readers leave out names that begin with an underscore or a dot, such as ``__init__.py`` and ``.env``,
which is why the tree is listed here.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir

#: Names a task sees before it hands the remaining folders on, and names per batch.
ENTRIES, BATCH = 20_000, 5_000
#: Folders per task of a round, and names per task when sizes are taken.
FOLDERS_PER_TASK, NAMES_PER_TASK = 64, 50_000

NAMES = "path string, depth int, is_folder boolean"


def enters(name: str, excluded: set[str]) -> bool:
    """Whether a folder of that name is opened."""
    return name not in excluded and not name.startswith(".")


def scan_folder(folder: str, excluded: set[str]) -> Iterator[tuple[str, bool]]:
    """Names directly below a folder: files, and folders to be opened. What cannot be read is empty."""
    try:
        with os.scandir(folder) as entries:
            for entry in entries:
                if not entry.is_dir():
                    yield entry.path, False
                elif not entry.is_symlink() and enters(entry.name, excluded):
                    yield entry.path, True
    except OSError:
        return


def _as_batch(rows: list[tuple[str, int, bool]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([], [], [])
    kinds = (pa.string(), pa.int32(), pa.bool_())
    # Names that are no UTF-8 cannot be a string of Spark; they are handed on with their bytes replaced and found unreadable later.
    clean = lambda x: x.encode("utf-8", "replace").decode() if isinstance(x, str) else x
    return pa.RecordBatch.from_arrays([pa.array([clean(x) for x in column], kind) for column, kind in zip(columns, kinds, strict=True)],
                                      ["path", "depth", "is_folder"])


def expand(folders: DataFrame, excluded: set[str], entries: int = ENTRIES) -> DataFrame:
    """Files below the folders, and the folders that were not opened because the task had seen enough."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The budget holds for the task; every folder it was dealt is opened all the same.
        seen, rows = 0, []
        for batch in batches:
            for given, depth in zip(batch.column("path").to_pylist(), batch.column("depth").to_pylist(), strict=True):
                waiting = deque([(given, depth)])
                while waiting:
                    folder, level = waiting.popleft()
                    if folder != given and seen >= entries:
                        rows.append((folder, level, True))
                    else:
                        for path, is_folder in scan_folder(folder, excluded):
                            seen += 1
                            if is_folder:
                                waiting.append((path, level + 1))
                            else:
                                rows.append((path, level + 1, False))
                            if len(rows) >= BATCH:
                                yield _as_batch(rows)
                                rows = []
                    if len(rows) >= BATCH:
                        yield _as_batch(rows)
                        rows = []
        yield _as_batch(rows)

    return folders.select("path", "depth").mapInArrow(walk, NAMES)


def list_tree(spark: SparkSession, root: str, excluded: set[str] = frozenset(), entries: int = ENTRIES) -> DataFrame:
    """(path, depth) of every file below ``root`` outside excluded folders, as a stored table. A missing root is empty."""
    excluded, rounds = set(excluded), []
    frontier = spark.createDataFrame([(root, 0)], "path string, depth int").coalesce(1)
    while True:
        place = work_dir(spark, "names")
        expand(frontier, excluded, entries).write.parquet(place)
        rounds.append(place)
        frontier = spark.read.schema(NAMES).parquet(place).where("is_folder").select("path", "depth")
        waiting = frontier.count()
        if not waiting:
            return spark.read.schema(NAMES).parquet(*rounds).where("not is_folder").select("path", "depth")
        # The explicit number keeps a short table of names from being coalesced into one task.
        tasks = max(spark.sparkContext.defaultParallelism, -(-waiting // FOLDERS_PER_TASK))
        frontier = frontier.repartition(min(tasks, waiting), "path")


def with_sizes(paths: DataFrame, must_exist: bool = False) -> DataFrame:
    """(path, length) of files; null where the size cannot be taken, or no row if ``must_exist``."""
    def stat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                try:
                    if not must_exist or os.path.isfile(path):
                        found.append((path, os.path.getsize(path)))
                except OSError:
                    found.append((path, None))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["path", "length"])

    return paths.select("path").mapInArrow(stat, "path string, length bigint")


def sized_tree(spark: SparkSession, root: str, excluded: set[str] = frozenset(), keep: Column | None = None) -> DataFrame:
    """(path, length) of the files of a tree; names that fail ``keep`` are dropped before anything is opened."""
    names = list_tree(spark, root, excluded)
    if keep is not None:
        names = names.where(keep)
    tasks = max(spark.sparkContext.defaultParallelism, -(-names.count() // NAMES_PER_TASK))
    return with_sizes(names.repartition(tasks, "path"))
