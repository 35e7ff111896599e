"""Comparison with an earlier scan: which findings are new, which are known.

A finding is known if the baseline has the same file and title, without regard to case or
slash direction, at most ``tolerance`` lines away. Distances are measured from the baseline
line, and the accepted lines start at 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import relative_path

# Fixed value: how far a known finding may have moved.
LINE_TOLERANCE = 3


def file_key(file: Column) -> Column:
    return F.lower(F.translate(file, "\\", "/"))


def baseline_entries(findings: DataFrame, target_path: str = "") -> DataFrame:
    """The columns a baseline keeps, with the path relative to the scan target."""
    file = relative_path(F.col("file"), F.lit(target_path))
    return findings.select(file.alias("file"), "line", "title", "severity", "scanner")


def _entry_keys(baseline: DataFrame) -> DataFrame:
    """Distinct entry keys: copies in the baseline collapse before anything is shuffled."""
    return baseline.select(
        file_key(F.coalesce("file", F.lit(""))).alias("_file"),
        F.lower(F.coalesce("title", F.lit(""))).alias("_title"),
        F.coalesce("line", F.lit(0)).alias("_at")).distinct()


def _finding_keys(findings: DataFrame, target_path: str) -> DataFrame:
    file = relative_path(F.col("file"), F.lit(target_path))
    return findings.withColumns({"_file": file_key(file), "_title": F.lower("title")})


def _line_buckets(baseline: DataFrame, tolerance: int) -> DataFrame:
    """Entries as line windows, each listed under the one or two buckets it touches."""
    width = 2 * tolerance + 1
    low, high = F.greatest(F.lit(1), F.col("_at") - tolerance), F.col("_at") + tolerance
    return (
        _entry_keys(baseline).select("_file", "_title", low.alias("_low"), high.alias("_high"))
        .filter(F.col("_low") <= F.col("_high"))
        .select("*", F.explode(F.sequence(F.floor(F.col("_low") / width), F.floor(F.col("_high") / width))).alias("_bucket"))
    )


def _bucket_join(findings, entries, tolerance, target_path, how) -> DataFrame:
    """Range join through line buckets.

    A window of ``2t + 1`` lines touches at most two buckets of that width, so each entry is
    listed twice at most. The join keys then hold a line range of that width, which keeps
    one hot (file, title) pair from meeting in one task.
    """
    width = 2 * tolerance + 1
    keyed = _finding_keys(findings, target_path).withColumn("_bucket", F.floor(F.col("line") / width))
    entries = entries.withColumnsRenamed({"_file": "_bf", "_title": "_bt", "_bucket": "_bb"})
    condition = ((F.col("_file") == F.col("_bf")) & (F.col("_title") == F.col("_bt"))
                 & (F.col("_bucket") == F.col("_bb")) & F.col("line").between(F.col("_low"), F.col("_high")))
    return keyed.join(entries, condition, how).select(findings.columns)


def new_findings(findings: DataFrame, baseline: DataFrame, tolerance: int = LINE_TOLERANCE,
                 target_path: str = "") -> DataFrame:
    return _bucket_join(findings, _line_buckets(baseline, tolerance), tolerance, target_path, "left_anti")


def known_findings(findings: DataFrame, baseline: DataFrame, tolerance: int = LINE_TOLERANCE,
                   target_path: str = "") -> DataFrame:
    return _bucket_join(findings, _line_buckets(baseline, tolerance), tolerance, target_path, "left_semi")


#: Parts of a stored baseline, by hash of the file.
SHARDS = 64


def _shard(file: Column) -> Column:
    return F.pmod(F.xxhash64(file), F.lit(SHARDS)).cast("int")


def write_baseline_index(baseline: DataFrame, path: str) -> None:
    """Store a baseline as the line windows that a comparison joins, in a partition per shard."""
    entries = _line_buckets(baseline, LINE_TOLERANCE)
    entries.withColumn("shard", _shard(F.col("_file"))).repartition(SHARDS, "shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def match_baseline_index(findings: DataFrame, path: str, known: bool, target_path: str = "") -> DataFrame:
    """The findings a stored baseline lists, or the others. Only the shards that the findings fall in are read."""
    spark = findings.sparkSession
    shards = [r.shard for r in _finding_keys(findings, target_path).select(_shard(F.col("_file")).alias("shard")).distinct().collect()]
    index = spark.read.schema("_file string, _title string, _low int, _high int, _bucket bigint, shard int").parquet(path)
    entries = index.filter(F.col("shard").isin(shards)).drop("shard")
    return _bucket_join(findings, entries, LINE_TOLERANCE, target_path, "left_semi" if known else "left_anti")


def expanded_keys(baseline: DataFrame, tolerance: int = LINE_TOLERANCE) -> DataFrame:
    """Every accepted (file, title, line), each once."""
    low, high = F.greatest(F.lit(1), F.col("_at") - tolerance), F.col("_at") + tolerance
    lines = F.when(low <= high, F.sequence(low, high))
    return _entry_keys(baseline).select("_file", "_title", F.explode(lines).alias("_line")).distinct()


def classify(findings: DataFrame, baseline: DataFrame, tolerance: int = LINE_TOLERANCE,
             target_path: str = "") -> DataFrame:
    """All findings with a ``known`` flag, by a pure equi-join on expanded keys.

    Costs more baseline rows than the bucket join but yields both classes in one pass.
    """
    keys = expanded_keys(baseline, tolerance).withColumnsRenamed(
        {"_file": "_bf", "_title": "_bt", "_line": "_bl"}).withColumn("_hit", F.lit(True))
    keyed = _finding_keys(findings, target_path)
    condition = ((F.col("_file") == F.col("_bf")) & (F.col("_title") == F.col("_bt"))
                 & (F.col("line") == F.col("_bl")))
    return keyed.join(keys, condition, "left").select(
        *findings.columns, F.coalesce("_hit", F.lit(False)).alias("known"))
