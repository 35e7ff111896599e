"""User scanners: a function per file, run on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import severity as sev
from ..functions.text import ends_with_any
from ..rules import PLUGIN_BASE
from ..schemas import NOTES, RAW_COLUMNS

_OUTPUT = ("seq bigint, line int, severity string, title string, description string, "
           "code_snippet string, cwe_id string, fix string, source_line string, error string")
_FIELDS = [part.split()[0] for part in _OUTPUT.split(", ")]


@dataclass(frozen=True)
class Scanner:
    """``scan(path, content, lines)`` yields dictionaries with the finding fields."""

    name: str
    extensions: tuple[str, ...]
    scan: Callable[[str, str, list[str]], Iterable[dict]]


def _text(value) -> str | None:
    return None if value is None else str(value)


def _rows(scan: Callable, path: str, content: str) -> list[tuple]:
    """Findings of one file, or one row that tells what went wrong."""
    lines = content.splitlines()
    try:
        return [
            (i, int(f["line"]), str(f["severity"]).upper(), _text(f["title"]), _text(f.get("description", "")), _text(f.get("code_snippet", "")),
             _text(f.get("cwe_id")), _text(f.get("fix", "")), lines[f["line"] - 1] if 1 <= f["line"] <= len(lines) else None, None)
            for i, f in enumerate(scan(path, content, lines))]
    except Exception as error:  # user code: isolate it per file
        return [(0, *[None] * (len(_FIELDS) - 2), repr(error))]


def scanner_outcomes(files: DataFrame, scanner: Scanner, order: int = 0, keep: list[str] = ()) -> DataFrame:
    """Raw findings and failures of a scanner in one pass, told apart by ``error``.

    The scanner is a table function, joined laterally to the files. A failure on one file drops that file's rows of
    this scanner and leaves one row with the message.
    """
    scan = scanner.scan

    class Scan:
        def eval(self, path: str, content: str):
            yield from _rows(scan, path, content)

    gated = files.filter(ends_with_any(F.col("path"), scanner.extensions) & F.col("content").isNotNull())
    found = F.udtf(Scan, returnType=_OUTPUT, useArrow=False)(F.col("file").outer(), F.col("content").outer())
    rows = gated.select(F.col("path").alias("file"), "content", *keep).lateralJoin(found)
    return rows.select(
        "*", sev.weight(F.col("severity")).cast("int").alias("sev_weight"), F.lit(scanner.name).alias("scanner"),
        F.lit(PLUGIN_BASE + order).cast("bigint").alias("rule_ord"), (F.col("seq") * NOTES).alias("emit_seq"),
    ).select(*RAW_COLUMNS, "error", *keep)


def run_scanner(files: DataFrame, scanner: Scanner, order: int = 0) -> tuple[DataFrame, DataFrame]:
    """(raw findings, errors) of a scanner."""
    rows = scanner_outcomes(files, scanner, order)
    return rows.filter("error is null").drop("error"), rows.filter("error is not null").select("file", "error")


def scanner_table(spark: SparkSession, scanners: list[Scanner]) -> DataFrame:
    """Name, suffixes and function of the registered scanners."""
    rows = [(s.name, list(s.extensions), s.scan.__name__) for s in scanners]
    return spark.createDataFrame(rows, "name string, extensions array<string>, function string")
