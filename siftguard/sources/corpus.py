"""Where files come from: a folder tree, a list of paths, or any table with a text column.

Trees are listed by ``listing`` and read by tasks. For one tree that is read as it grows see ``stream_corpus``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ScanConfig
from ..functions.text import decode_utf8, ends_with_any, is_binary
from ..session import work_dir
from .file_tree import FileTreeSource
from .listing import sized_tree, with_sizes

#: Bytes of file content handed from the reader to Spark at a time.
BATCH_BYTES = 16_000_000
#: Bytes of file content one task reads.
BYTES_PER_TASK = 128_000_000


def _read_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Open the files without a skip reason, handing on about ``BATCH_BYTES`` at a time."""
    def packed(rows):
        frame = pd.DataFrame(rows, columns=["path", "length", "skip_reason", "bytes"])
        return frame.astype({"length": "Int64"})

    for batch in batches:
        rows, size = [], 0
        for path, length, skip in zip(batch["path"], batch["length"], batch["skip_reason"]):
            raw = None
            if skip is None:
                try:
                    with open(path, "rb") as handle:
                        raw = handle.read()
                except OSError:
                    skip = "unreadable"
            rows.append((path, length, skip, raw))
            size += len(raw or b"")
            if size >= BATCH_BYTES:
                yield packed(rows)
                rows, size = [], 0
        yield packed(rows)


def decode_files(raw: DataFrame, cfg: ScanConfig, keep: list[str] = ()) -> DataFrame:
    """(path, length, skip_reason, bytes) → files. Skipped files keep their row, without content; ``keep`` names further columns."""
    binary = F.lit(False) if cfg.scan_binary else is_binary(F.col("bytes"))
    reason = F.coalesce("skip_reason", F.when(F.col("bytes").isNull(), "unreadable").when(binary, "binary"))
    marked = raw.select("path", "length", "bytes", reason.alias("skip_reason"), *keep)
    content = F.when(F.col("skip_reason").isNull(), decode_utf8(F.col("bytes")))
    return marked.select("path", "length", content.alias("content"), "skip_reason", *keep)


def read_corpus(spark: SparkSession, root: str, cfg: ScanConfig | None = None,
                only: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Files of a tree that all executors can reach.

    ``only`` is a table with a ``path`` column: exactly those files are read if they exist,
    without folder and suffix tests. An empty table means the whole tree.
    Files over the size limit are never opened.

    The listing is stored first (see ``listing``): the tree is walked once, and its total size sets the number
    of reading tasks. Paths are spread over them by hash, so one crowded folder does not end
    up in one task. The explicit number keeps the tiny list of names from being coalesced.
    """
    cfg = cfg or ScanConfig()
    if only is not None and not only.isEmpty():
        listing = with_sizes(absolute(only.select("path").distinct()), must_exist=True)
    else:
        listing = sized_tree(spark, root, set(cfg.exclude_dirs), ends_with_any(F.col("path"), cfg.include_extensions))
    listed = work_dir(spark, "listing")
    listing.write.parquet(listed)
    listing = spark.read.parquet(listed)
    if not tasks:
        opened = F.when(F.col("length") <= cfg.max_file_size, F.col("length"))
        volume = listing.agg(F.coalesce(F.sum(opened), F.lit(0))).first()[0]
        tasks = max(spark.sparkContext.defaultParallelism, -(-volume // BYTES_PER_TASK))
    spread = listing.repartition(tasks, "path")
    reason = F.when(F.col("length").isNull(), "unreadable").when(F.col("length") > cfg.max_file_size, "oversize")
    raw = spread.withColumn("skip_reason", reason).mapInPandas(
        _read_bytes, "path string, length bigint, skip_reason string, bytes binary")
    return decode_files(raw, cfg)


def absolute(paths: DataFrame) -> DataFrame:
    """Paths as the executors see them from the root."""
    def resolve(batches):
        for batch in batches:
            yield batch.assign(path=[os.path.abspath(p) for p in batch["path"]])
    return paths.mapInPandas(resolve, "path string")


def stream_corpus(spark: SparkSession, root: str, cfg: ScanConfig | None = None, settle_ms: int | None = None) -> DataFrame:
    """Files of a tree as they arrive, with the time of their arrival: a streaming table with the columns of a corpus.

    The suffix test of the configuration is part of the query; a file over the size limit is a row without content.
    """
    cfg = cfg or ScanConfig()
    spark.dataSource.register(FileTreeSource)
    reader = spark.readStream.format(FileTreeSource.name()).option("exclude", ",".join(cfg.exclude_dirs))
    if settle_ms is not None:
        reader = reader.option("settle_ms", settle_ms)
    raw = reader.load(root).where(ends_with_any(F.col("path"), cfg.include_extensions))
    reason = F.when(F.col("length") > cfg.max_file_size, "oversize")
    return decode_files(raw.withColumn("skip_reason", reason), cfg, ["arrived"])


def corpus_from_table(df: DataFrame, path: Column, text: Column) -> DataFrame:
    """Any table with a text column as a corpus of virtual files. Null text counts as unreadable."""
    return df.select(path.alias("path"), F.octet_length(text).cast("bigint").alias("length"), text.alias("content"),
                     F.when(text.isNull(), "unreadable").alias("skip_reason"))


def limit_size(files: DataFrame, cfg: ScanConfig) -> DataFrame:
    """Apply the size limit of the configuration to a table corpus."""
    over = F.col("length") > cfg.max_file_size
    return files.select("path", "length", F.when(~over, F.col("content")).alias("content"),
                        F.when(over, "oversize").otherwise(F.col("skip_reason")).alias("skip_reason"))
