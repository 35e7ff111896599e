"""Plain table and document writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.baseline import baseline_entries
from ..operators.dependencies import is_manifest
from ..operators.export import CHUNK, numbered
from ..operators.postprocess import by_severity
from ..schemas import FILES


def file_class() -> Column:
    """Which passes beyond the line rules a file takes part in."""
    path = F.col("path")
    return F.when(path.endswith(".py"), "python").when(is_manifest(path), "manifest").otherwise("other")


def write_corpus(files: DataFrame, path: str) -> DataFrame:
    """Store a corpus once and read it back, so that later scans skip listing and decoding.

    The table is partitioned by ``file_class``: the syntax pass and the manifest pass of a scan
    then open only their own partitions, and the corpus as a whole is read a single time.
    """
    files.withColumn("file_class", file_class()).write.mode("overwrite").partitionBy("file_class").parquet(path)
    return files.sparkSession.read.schema(f"{FILES}, file_class string").parquet(path)


def write_findings(findings: DataFrame, path: str, form: str = "parquet", ordered: bool = False) -> None:
    """Findings as a parquet, JSON or ORC table.

    ``ordered`` sorts globally by severity; the sort is a range partitioning, so the part
    files follow each other in order and stay parallel.
    """
    out = by_severity(findings) if ordered else findings
    out.write.mode("overwrite").format(form).save(path)


def write_baseline(findings: DataFrame, path: str, target_path: str = "") -> None:
    """What a later comparison needs, as a table, or as JSON documents if the path ends in ``.json``.

    A document is an envelope of target, number of all findings and a list of at most ``CHUNK`` of them; the path is then a folder with a
    file per document. ``read_baseline`` reads either, and a single such file.
    """
    entries = baseline_entries(findings, target_path)
    if not path.endswith(".json"):
        entries.write.mode("overwrite").parquet(path)
        return
    rows = numbered(entries, [], [F.col(c) for c in entries.columns])
    listed = rows.groupBy(F.floor(F.col("_number") / CHUNK).alias("chunk")).agg(
        F.max("_total").alias("total_findings"), F.sort_array(F.collect_list(F.struct("_number", F.struct(*entries.columns).alias("f")))).alias("e"))
    shown = F.struct(F.lit(target_path).alias("target_path"), "total_findings", F.transform("e", lambda e: e["f"]).alias("findings"))
    listed.select("chunk", F.to_json(shown).alias("value")).write.mode("overwrite").partitionBy("chunk").text(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """Documents of ``export`` as text, one document per line, in a folder per scan."""
    rows = documents.select("scan_id", F.col("document").alias("value"))
    rows.write.mode("overwrite").partitionBy("scan_id").text(path)
