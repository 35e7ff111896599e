"""Scan history and suppressions on shared storage, as append-only parquet tables.

*Attempts.* Everything a scan writes carries the id of the attempt. Its header row goes last and is the commit marker: findings count only
if their attempt has a header. An attempt that replaces earlier ones says so before its header is written, in tombstones that hold
once that header is there; so a retry, after a failed header or after a success nobody heard of, never shows a finding twice, nor none. Deleting appends a
tombstone for the attempt, so a scan that is added again is visible again. One scan id has one writer at a time.

*Rollups.* Each append stores the scan's findings per title. ``seal`` folds the headers of past days into one row per day, with a
mergeable sketch of the targets; reading takes sealed days from there and the others from their headers. A change to a sealed day marks it open again
before it becomes visible.

No table is rewritten while it is read, so a lost executor or a failed job leaves the earlier state intact. ``compact``, run when nobody writes, drops
what no reader sees any more.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.intervals import stored
from ..operators.summary import COUNTERS, severity_counts
from ..schemas import FINDINGS, SUPPRESSIONS

SCANS = ("scan_id string, target_path string, scanned_at timestamp, files_scanned bigint, files_skipped bigint, "
         "scan_duration double, critical bigint, high bigint, medium bigint, low bigint, info bigint, "
         "total bigint, scan_date date")
_MARK = "attempt string, committed_at timestamp"
_STORED_FINDINGS = f"scan_id string, {FINDINGS}, attempt string, scan_date date"
_TOMBSTONES = "scan_id string, attempt string, replaced_by string, replaced_on date"
_TITLES = "scan_id string, attempt string, title string, n bigint, scan_date date"
DAYS = ("scan_count bigint, critical bigint, high bigint, medium bigint, low bigint, info bigint, total bigint, "
        "last_scan timestamp, projects binary, sealed_at timestamp, scan_date date")
_SCAN_COLUMNS = [part.split()[0] for part in SCANS.split(", ")]
_FINDING_COLUMNS = ["scan_id", *(part.split()[0] for part in FINDINGS.split(", ")), "scan_date"]

#: Logarithm of the number of registers of the target sketch: a standard error of 0.8 %.
SKETCH_BITS = 14


def _now() -> Column:
    return F.lit(datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


class HistoryStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -------------------------------------------------------------- reading

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _headers(self) -> DataFrame:
        return self._read("scans", f"{SCANS}, {_MARK}").withColumn("attempt", F.coalesce("attempt", F.lit("")))

    def _live(self) -> DataFrame:
        """Headers without a tombstone that holds. Conditions on the date reach the scan of the headers."""
        gone = self._read("deleted_scans", _TOMBSTONES)
        committed = self._headers().select(F.col("attempt").alias("replaced_by"), F.col("scan_date").alias("replaced_on")).distinct()
        holds = gone.filter("replaced_by is null").unionByName(gone.join(committed, ["replaced_by", "replaced_on"], "left_semi").select(gone.columns))
        return self._headers().join(holds.select("scan_id", F.coalesce("attempt", F.lit("")).alias("attempt")).distinct(), ["scan_id", "attempt"], "left_anti")

    def scans(self) -> DataFrame:
        return self._live().select(*_SCAN_COLUMNS)

    def _of_live(self, rows: DataFrame) -> DataFrame:
        """Rows of attempts that count. The headers are not repeated per salt, as there may be nearly as many as rows; a scan that owns a
        large share of the rows is met by few headers, which are broadcast, or cut by the adaptive skew join. The date prunes partitions."""
        key = ["scan_id", "attempt", "scan_date"]
        return rows.withColumn("attempt", F.coalesce("attempt", F.lit(""))).join(self._live().select(*key), key, "left_semi")

    def findings(self) -> DataFrame:
        return self._of_live(self._read("findings", _STORED_FINDINGS)).select(*_FINDING_COLUMNS)

    def titles(self) -> DataFrame:
        """Findings per scan and title."""
        return self._of_live(self._read("titles", _TITLES)).select("scan_id", "scan_date", "title", "n")

    def suppressions(self) -> DataFrame:
        gone = self._read("deleted_suppressions", "id string").distinct()
        return self._read("suppressions", f"id string, {SUPPRESSIONS}").join(gone, "id", "left_anti")

    # -------------------------------------------------------------- appending

    def append(self, findings: DataFrame, target_path: str, scanned_at: str, files_scanned: int, files_skipped: int,
               scan_duration: float, scan_id: str | None = None) -> str:
        """Store a scan with its findings and counters; returns its id. Calling it again with the same id replaces the scan."""
        scan_id = scan_id or uuid.uuid4().hex
        at = F.lit(scanned_at).cast("timestamp")
        header = self.spark.range(1).select(
            F.lit(scan_id).alias("scan_id"), F.lit(target_path).alias("target_path"), at.alias("scanned_at"),
            F.lit(files_scanned).cast("bigint").alias("files_scanned"), F.lit(files_skipped).cast("bigint").alias("files_skipped"),
            F.round(F.lit(float(scan_duration)), 3).alias("scan_duration"))
        self.append_many(header, findings.withColumn("scan_id", F.lit(scan_id)))
        return scan_id

    def append_many(self, scans: DataFrame, findings: DataFrame) -> str:
        """Store scans (their columns without counters) with their findings, which carry ``scan_id``; returns the attempt.

        The findings are written first, then their counts per title, then the headers, with counters taken from what was
        written. A failure before the last step leaves nothing a reader sees. The scans are worked out once and stored, since every step reads them.
        """
        attempt = uuid.uuid4().hex
        dated = stored(scans.withColumn("scan_date", F.to_date("scanned_at")), "scans")
        kept = [c for c in findings.columns if c in _FINDING_COLUMNS and c != "scan_date"]
        days = dated.select("scan_id", "scan_date")
        rows = findings.select(*kept).join(days, "scan_id")
        _by_date(rows.withColumn("attempt", F.lit(attempt))).write.mode("append").partitionBy("scan_date").parquet(f"{self.root}/findings")
        written = self._read("findings", _STORED_FINDINGS).filter(F.col("attempt") == attempt)
        per_title = written.groupBy("scan_date", "scan_id", F.coalesce("title", F.lit("Unknown")).alias("title")).agg(F.count(F.lit(1)).alias("n"))
        _by_date(per_title.select("scan_id", F.lit(attempt).alias("attempt"), "title", "n", "scan_date")).write.mode("append").partitionBy("scan_date").parquet(f"{self.root}/titles")
        before = stored(self._live().join(days.withColumnRenamed("scan_date", "replaced_on"), "scan_id").select("scan_id", "attempt", "scan_date", "replaced_on"), "replaced")
        self._open(dated.select("scan_date").union(before.select("scan_date")).distinct())
        if not before.isEmpty():
            marks = before.select("scan_id", "attempt", F.lit(attempt).alias("replaced_by"), "replaced_on")
            marks.write.mode("append").parquet(f"{self.root}/deleted_scans")
        counted = severity_counts(written.select("scan_id", "severity"), ["scan_id"])
        header = dated.join(counted, "scan_id", "left").fillna(0, [*COUNTERS, "total"]).withColumns({"attempt": F.lit(attempt), "committed_at": _now()})
        _by_date(header.select(*_SCAN_COLUMNS[:-1], "attempt", "committed_at", "scan_date")).write.mode("append").partitionBy("scan_date").parquet(f"{self.root}/scans")
        return attempt

    # -------------------------------------------------------------- deleting

    def delete_scan(self, scan_id: str) -> bool:
        """Returns whether there was such a scan."""
        found = stored(self._live().filter(F.col("scan_id") == scan_id).select("scan_id", "attempt", "scan_date"), "deleted")
        if found.isEmpty():
            return False
        self._open(found.select("scan_date"))
        found.select("scan_id", "attempt", F.lit(None).cast("string").alias("replaced_by"), F.lit(None).cast("date").alias("replaced_on")).write.mode("append").parquet(f"{self.root}/deleted_scans")
        return True

    def delete_suppression(self, suppression_id: str) -> bool:
        if self.suppressions().filter(F.col("id") == suppression_id).isEmpty():
            return False
        self.spark.createDataFrame([(suppression_id,)], "id string").write.mode("append").parquet(f"{self.root}/deleted_suppressions")
        return True

    def suppress(self, new: DataFrame) -> None:
        """Insert suppressions whose hash is not listed yet; within a batch the first wins."""
        fresh = first_new_suppressions(new, self.suppressions())
        fresh.withColumn("id", F.sha2(F.concat_ws("|", "finding_hash", F.col("created_at").cast("string")), 256)) \
            .write.mode("append").parquet(f"{self.root}/suppressions")

    def compact(self) -> None:
        """Rewrite the days that hold findings or title counts no reader sees. Run it while nobody writes."""
        live = self._live().select("scan_id", "attempt", "scan_date")
        for name, schema in (("findings", _STORED_FINDINGS), ("titles", _TITLES)):
            rows = self._read(name, schema).withColumn("attempt", F.coalesce("attempt", F.lit("")))
            dead = rows.join(live, ["scan_id", "attempt", "scan_date"], "left_anti").select("scan_date").distinct()
            kept = self._of_live(rows.join(dead, "scan_date", "left_semi"))
            # Written beside the table first; then only the days that have rows are replaced.
            stored(kept, "compacted").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_date").parquet(f"{self.root}/{name}")

    # -------------------------------------------------------------- rollups

    def _open(self, days: DataFrame) -> None:
        """Mark sealed days as open, before a change to them becomes visible."""
        sealed = self._read("days", DAYS).select("scan_date").distinct()
        marks = stored(days.distinct().join(sealed, "scan_date", "left_semi").withColumn("opened_at", _now()), "opened")
        if not marks.isEmpty():
            marks.write.mode("append").parquet(f"{self.root}/opened_days")

    def _sealed(self) -> DataFrame:
        """Day rows that still hold: the last seal of a day, unless the day was opened after it."""
        last = Window.partitionBy("scan_date").orderBy(F.desc("sealed_at"))
        rows = self._read("days", DAYS).withColumn("_nth", F.row_number().over(last)).filter("_nth = 1").drop("_nth")
        opened = self._read("opened_days", "scan_date date, opened_at timestamp").groupBy("scan_date").agg(F.max("opened_at").alias("opened_at"))
        return rows.join(opened, "scan_date", "left").filter("opened_at is null or opened_at < sealed_at").drop("opened_at")

    def seal(self, before: str) -> None:
        """Fold every open day before a date into one row."""
        at = _now()
        open_days = self._live().filter(F.col("scan_date") < F.lit(before).cast("date")).join(self._sealed().select("scan_date"), "scan_date", "left_anti")
        rows = _by_day(open_days).withColumn("sealed_at", at)
        rows.select(*[part.split()[0] for part in DAYS.split(", ")]).write.mode("append").partitionBy("scan_date").parquet(f"{self.root}/days")

    def days(self) -> DataFrame:
        """One row per day: sums of the counters, number of scans, last scan and the sketch of the targets."""
        sealed = self._sealed()
        rest = _by_day(self._live().join(sealed.select("scan_date"), "scan_date", "left_anti"))
        return sealed.drop("sealed_at").unionByName(rest)

    def daily_trend(self, now: str, days: int = 30) -> DataFrame:
        """What ``operators.history.daily_trend`` gives for whole days: those after the day of the cutoff come from the rollup, that day from its headers."""
        cutoff = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
        sums = [*COUNTERS, "total", "scan_count"]
        whole = self.days().filter(F.col("scan_date") > F.to_date(cutoff)).select(F.col("scan_date").alias("date"), *sums)
        edge = _by_day(self._live().filter((F.col("scan_date") == F.to_date(cutoff)) & (F.col("scanned_at") >= cutoff))).select(F.col("scan_date").alias("date"), *sums)
        return whole.unionByName(edge).orderBy("date")

    def history_stats(self) -> DataFrame:
        """One row over the whole history; the number of projects is estimated from the merged sketches."""
        projects = F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("projects")), F.lit(0))
        return self.days().agg(
            F.coalesce(F.sum("scan_count"), F.lit(0)).alias("total_scans"), projects.alias("total_projects"), F.sum("total").alias("total_findings"),
            F.sum("critical").alias("total_critical"), F.max("last_scan").alias("last_scan"))

    def top_titles(self, limit: int = 10, scans_back: int = 200) -> DataFrame:
        """Most frequent titles of the most recent scans, from the counts per title."""
        newest = self._live().orderBy(F.desc("scanned_at"), F.desc("scan_id")).limit(scans_back).select("scan_id", "attempt", "scan_date")
        rows = self._read("titles", _TITLES).withColumn("attempt", F.coalesce("attempt", F.lit("")))
        counted = rows.join(newest, ["scan_id", "attempt", "scan_date"], "left_semi").groupBy("title").agg(F.sum("n").alias("count"))
        return counted.orderBy(F.desc("count"), "title").limit(limit)


def _by_date(rows: DataFrame) -> DataFrame:
    """Rows dealt by date before a write that is partitioned by it, so that not every task leaves a file for every date. A large date is cut."""
    return rows.hint("rebalance", "scan_date")


def _by_day(headers: DataFrame) -> DataFrame:
    return headers.groupBy("scan_date").agg(
        F.count(F.lit(1)).alias("scan_count"), *(F.sum(c).alias(c) for c in (*COUNTERS, "total")), F.max("scanned_at").alias("last_scan"),
        F.hll_sketch_agg("target_path", F.lit(SKETCH_BITS)).alias("projects"))


def first_new_suppressions(new: DataFrame, existing: DataFrame) -> DataFrame:
    """One row per hash that is not listed: the earliest of the batch."""
    first = F.min(F.struct("created_at", "title", "file_pattern", "reason"))
    single = new.groupBy("finding_hash").agg(first.alias("f")).select("finding_hash", "f.*")
    fresh = single.join(existing.select("finding_hash").distinct(), "finding_hash", "left_anti")
    return fresh.select("finding_hash", "title", "file_pattern", "reason", "created_at")
