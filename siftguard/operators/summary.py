"""Counts and judgements over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..rules import SCANNERS, SEVERITY_WEIGHTS
from ..rules.advisories import ADVISORIES
from ..rules.semantic import SEMANTIC_RULES
from ..session import dimension
from .dependencies import ECOSYSTEMS
from .plugins import Scanner

COUNTERS = [label.lower() for label in SEVERITY_WEIGHTS]


def counters(condition: Column | None = None) -> list[Column]:
    """One count per severity plus the total, as aggregate columns."""
    keep = F.lit(True) if condition is None else condition
    each = [F.count_if((F.col("severity") == label) & keep).alias(label.lower()) for label in SEVERITY_WEIGHTS]
    return [*each, F.count_if(keep).alias("total")]


def severity_counts(findings: DataFrame, keys: list[str] = (), scans: DataFrame | None = None) -> DataFrame:
    """Six counters per key. With ``scans``, keys without findings get a row of zeros.

    Partial counts are combined before the shuffle, so a scan that owns a third of all
    findings costs no more than any other.
    """
    counted = findings.groupBy(*keys).agg(*counters())
    if scans is None:
        return counted
    names = [*COUNTERS, "total"]
    joined = scans.select(*keys).distinct().join(counted, list(keys), "left")
    return joined.fillna(0, names)


def file_counts(files: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Scanned and skipped files. Suppressed findings do not enter either number."""
    return files.groupBy(*keys).agg(
        F.count_if(F.col("skip_reason").isNull()).alias("files_scanned"),
        F.count_if(F.col("skip_reason").isNotNull()).alias("files_skipped"))


# The words of the verdict scales.
def verdict() -> Column:
    return (F.when(F.col("critical") > 0, "REQUEST_CHANGES")
            .when(F.col("total") > 0, "COMMENT").otherwise("APPROVE"))


def report_verdict() -> Column:
    """Four-level variant for reports."""
    return (F.when(F.col("critical") > 0, "REQUEST CHANGES").when(F.col("high") > 0, "NEEDS REVIEW")
            .when(F.col("total") > 0, "MINOR ISSUES").otherwise("APPROVED"))


def judge(counts: DataFrame) -> DataFrame:
    """Verdicts, the security flag and the gate (1 exactly if something is critical)."""
    return counts.withColumns({
        "verdict": verdict(),
        "report_verdict": report_verdict(),
        "security_issues_found": (F.col("critical") > 0) | (F.col("high") > 0),
        "gate": F.when(F.col("critical") > 0, 1).otherwise(0),
    })


def suppression_counts(marked: DataFrame, keys: list[str] = ()) -> DataFrame:
    """How many findings comments removed, from raw findings with a ``suppressed`` flag."""
    return marked.groupBy(*keys).agg(
        F.count_if("suppressed").alias("suppressed_inline"), F.count_if(~F.col("suppressed")).alias("kept"))


def scanner_listing(rule_table: DataFrame, scanners: list[Scanner] = ()) -> DataFrame:
    """Scanner label, number of rules and the suffixes or kinds they look at: line rules, syntax rules, the advisories and registered scanners.

    A registered scanner counts as one rule; manifests are named as such.
    """
    gates = F.when(F.col("kind").isNotNull(), F.array("kind")).otherwise(F.col("exts"))
    lines = (
        rule_table.select("label", F.explode_outer(gates).alias("gate"), "rule_ord")
        .groupBy(F.col("label").alias("scanner"))
        .agg(F.countDistinct("rule_ord").alias("rules"),
             F.array_join(F.sort_array(F.collect_set("gate")), ",").alias("gates"))
    )
    others = [{"scanner": SCANNERS["ast_scanner"], "rules": len(SEMANTIC_RULES), "gates": ".py"},
              {"scanner": SCANNERS["dependencies"], "rules": len(ADVISORIES), "gates": ",".join(sorted(ECOSYSTEMS))}]
    others += [{"scanner": s.name, "rules": 1, "gates": ",".join(sorted(s.extensions))} for s in scanners]
    return lines.unionByName(dimension(rule_table.sparkSession, others, StructType.fromDDL("scanner string, rules bigint, gates string")))
