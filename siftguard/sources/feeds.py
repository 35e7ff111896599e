"""Advisory feeds and baselines on disk."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import BASELINE_ENTRY, OSV_RECORD


def read_osv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Vulnerability records in OSV format, one JSON document per line unless told otherwise."""
    return spark.read.schema(OSV_RECORD).json(path, multiLine=multi_line)


def parse_osv(texts: DataFrame, column: str = "record") -> DataFrame:
    """The same from a table with one record per row as text."""
    return texts.select(F.from_json(column, OSV_RECORD).alias("r")).select("r.*")


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Baseline entries from a table folder, or from one JSON document with a ``findings`` list or a folder of such.

    A missing baseline is empty, and so are the malformed parts of a document. A document is read whole by one task; folders are read in parallel.
    """
    empty = spark.createDataFrame([], BASELINE_ENTRY)
    try:
        if path.endswith(".json"):
            schema = f"target_path string, total_findings bigint, findings array<struct<{_nested(BASELINE_ENTRY)}>>"
            document = spark.read.schema(schema).json(path, multiLine=True)
            return document.select(F.explode("findings").alias("f")).select("f.*")
        return spark.read.schema(BASELINE_ENTRY).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty


def _nested(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (part.split() for part in ddl.split(", ")))
