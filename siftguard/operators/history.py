"""Scan history: two tables, one row per scan and one row per finding of a scan.

Findings live in a child table keyed by ``scan_id`` rather than in an array column, so a scan
with any number of findings is stored, pruned and aggregated like ordinary rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .summary import COUNTERS

LIGHT_COLUMNS = ["scan_id", "target_path", "scanned_at", "files_scanned", "files_skipped", "scan_duration",
                 *COUNTERS, "total"]

# Default list length, scans looked at for the title ranking, ranking length.
LIST_LIMIT = 100
RANKED_SCANS = 200
RANKING = 10


def _scan_key(scans: DataFrame, findings: DataFrame) -> list[str]:
    """What joins the two tables: the id, and the date that a stored history is partitioned by."""
    return ["scan_id", "scan_date"] if "scan_date" in scans.columns and "scan_date" in findings.columns else ["scan_id"]


def _newest(scans: DataFrame) -> DataFrame:
    return scans.orderBy(F.desc("scanned_at"), F.desc("scan_id"))


def recent_scans(scans: DataFrame, target: str | None = None, limit: int = LIST_LIMIT) -> DataFrame:
    """Newest scans first, without findings. The limit is a top-k, kept per task."""
    chosen = scans if not target else scans.filter(F.col("target_path") == target)
    return _newest(chosen.select(*LIGHT_COLUMNS)).limit(limit)


def scan_with_findings(scans: DataFrame, findings: DataFrame, scan_id: str) -> DataFrame:
    """Header and findings of one scan, most severe first; a scan without findings is one row."""
    key = _scan_key(scans, findings)
    head = scans.filter(F.col("scan_id") == scan_id).select(*LIGHT_COLUMNS, *key[1:]).limit(1)
    body = findings.filter(F.col("scan_id") == scan_id)
    extra = [c for c in body.columns if c not in (*LIGHT_COLUMNS, "scan_date")]
    # One header row goes to every task; a join on the single id would be one task. Its date
    # leaves one partition of a stored history to read.
    filled = body.select(*key, *extra).join(F.broadcast(head), key).drop(*key[1:])
    head = head.drop(*key[1:])
    empty = head.join(body.select("scan_id").limit(1), "scan_id", "left_anti")
    joined = filled.unionByName(empty, allowMissingColumns=True)
    return joined.orderBy(F.desc("sev_weight"), "file", "line", "title")


def filter_history(scans: DataFrame, target: str | None = None, contains: str = "",
                   severity: str | None = None) -> DataFrame:
    """Exact target, fragment of the target in any case, at least one finding of a severity."""
    out = scans
    if target:
        out = out.filter(F.col("target_path") == target)
    if contains:
        out = out.filter(F.lower("target_path").contains(contains.lower()))
    if severity:
        out = out.filter(F.col(severity.lower()) > 0)
    return out


def targets(scans: DataFrame) -> DataFrame:
    return scans.select("target_path").distinct().orderBy("target_path")


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in (*COUNTERS, "total")]


def daily_trend(scans: DataFrame, now: str, days: int = 30, target: str | None = None) -> DataFrame:
    """Sums per day over the last ``days`` days before ``now``; the cutoff instant counts.

    Days without scans have no row. The filter on ``scanned_at`` reaches the scan, and a
    history written by the sink is also pruned by its date partitions.
    """
    cutoff = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    chosen = scans.filter(F.col("scanned_at") >= cutoff)
    if "scan_date" in scans.columns:
        chosen = chosen.filter(F.col("scan_date") >= F.to_date(cutoff))
    if target:
        chosen = chosen.filter(F.col("target_path") == target)
    return (chosen.groupBy(F.to_date("scanned_at").alias("date"))
            .agg(*_sums(), F.count(F.lit(1)).alias("scan_count")).orderBy("date"))


def history_stats(scans: DataFrame, approximate: bool = False) -> DataFrame:
    """One row over the whole history. Sums are null if there is no scan."""
    projects = F.approx_count_distinct("target_path") if approximate else F.countDistinct("target_path")
    return scans.agg(
        F.count(F.lit(1)).alias("total_scans"), projects.alias("total_projects"),
        F.sum("total").alias("total_findings"), F.sum("critical").alias("total_critical"),
        F.max("scanned_at").alias("last_scan"))


def severity_breakdown(scans: DataFrame) -> DataFrame:
    """Exact number of findings per severity over the whole history."""
    return scans.agg(*_sums())


def top_titles(scans: DataFrame, findings: DataFrame, limit: int = RANKING, scans_back: int = RANKED_SCANS) -> DataFrame:
    """Most frequent finding titles of the most recent scans; ties in title order.

    The scan ids come first, from few columns, with their dates, which prune a stored history; at most ``scans_back`` of them meet the
    findings, which are then counted with a map-side combine.
    """
    key = _scan_key(scans, findings)
    newest = _newest(scans.select("scanned_at", *key)).limit(scans_back).select(*key)
    if len(key) > 1:
        # One small job: the oldest date among them prunes the findings to recent partitions.
        oldest = newest.agg(F.min("scan_date")).first()[0]
        findings = findings.filter(F.col("scan_date") >= F.lit(oldest)) if oldest else findings
    counted = (findings.select(*key, F.coalesce("title", F.lit("Unknown")).alias("title"))
               .join(newest, key, "left_semi")
               .groupBy("title").agg(F.count(F.lit(1)).alias("count")))
    return counted.orderBy(F.desc("count"), "title").limit(limit)


def suppressions_newest_first(suppressions: DataFrame) -> DataFrame:
    return suppressions.orderBy(F.desc("created_at"), "finding_hash")
