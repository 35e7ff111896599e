"""The full scan: corpus in, de-duplicated findings out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import ScanConfig
from ..functions import severity as sev
from ..operators import dependencies as deps
from ..operators.baseline import classify
from ..operators.intervals import stored
from ..operators.lines import explode_lines, with_file_facts
from ..operators.plugins import Scanner, scanner_outcomes
from ..operators.postprocess import Prose, at_least, deduplicate, drop_suppressed, mark_persisted, mark_suppressed, remediate
from ..operators.rulescan import rule_label, scan_lines
from ..operators.semantic import semantic_outcomes
from ..operators.summary import file_counts, judge, severity_counts
from ..rules import SEVERITY_WEIGHTS, Rule, min_weight, scanner_base, select_rules
from ..rules.semantic import SEMANTIC_RULES
from ..schemas import RAW_COLUMNS
from ..session import dimension
from ..sinks.store import HistoryStore

FILE_COLUMNS = ["path", "ext", "kind"]


@dataclass
class ScanPlan:
    """Lazy tables of one scan: raw findings marked by suppression comments, all that remain with their verdicts, those to report, and faults."""

    files: DataFrame
    raw: DataFrame
    classified: DataFrame
    findings: DataFrame
    errors: DataFrame

    def counts(self) -> DataFrame:
        """One row: raw findings that comments suppress, then single findings that the suppression table lists, that the baseline knows, and that are reported."""
        inline = self.raw.select(F.col("suppressed").cast("int").alias("suppressed_inline"), *(F.lit(0).alias(c) for c in _CLASSES))
        judged = self.classified.select(F.lit(0).alias("suppressed_inline"), *(F.expr(test).cast("int").alias(c) for c, test in _CLASSES.items()))
        return inline.union(judged).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in inline.columns))


_CLASSES = {"suppressed_persisted": "persisted", "suppressed_by_baseline": "not persisted and known", "reported": "not persisted and not known"}


def lines_of(files: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Lines with the columns that rule gates need."""
    return explode_lines(with_file_facts(files), [*FILE_COLUMNS, *keep])


def _share(files: DataFrame, name: str) -> DataFrame:
    """The partition of a stored corpus a pass needs; any other corpus is filtered by path later."""
    return files.filter(F.col("file_class") == name) if "file_class" in files.columns else files


def raw_outcomes(files: DataFrame, config: ScanConfig | None = None, user_rules: list[Rule] = (),
                 scanners: list[Scanner] = (), advisories: DataFrame | None = None,
                 osv: DataFrame | None = None, osv_ranges: DataFrame | None = None, keep: list[str] = ()) -> DataFrame:
    """Findings of every enabled scanner, before suppression and de-duplication, and faults of scanners as rows with an ``error``.

    ``keep`` names columns of the files to carry along. Files may arrive as a stream unless ``osv`` is given.
    """
    config = config or ScanConfig()
    wanted = set(config.enabled_scanners)
    readable = files.filter(F.col("skip_reason").isNull())
    fine = F.lit(None).cast("string").alias("error")
    columns = [*RAW_COLUMNS, "error", *keep]
    parts = [scan_lines(lines_of(readable, keep), select_rules(config, user_rules), keep).select("*", fine).select(columns)]
    if not wanted or "dependencies" in wanted:
        table = advisories if advisories is not None else deps.advisories(files.sparkSession)
        pins = deps.extract_dependencies(_share(readable, "manifest"), keep=keep)
        found = deps.dependency_findings(pins, table, keep) if osv is None else deps.osv_findings(pins, osv, table, osv_ranges, keep)
        parts.append(at_least(found, config.min_severity).select("*", fine).select(columns))
    if not wanted or "ast_scanner" in wanted:
        parts.append(semantic_outcomes(_share(readable, "python"), config.min_severity, keep).select(columns))
    for order, scanner in enumerate(scanners):
        found = scanner_outcomes(readable, scanner, order, keep)
        parts.append(found.filter(F.col("error").isNotNull() | (sev.weight(F.col("severity")) >= min_weight(config.min_severity))).select(columns))
    return reduce(lambda a, b: a.unionByName(b), parts)


def raw_findings(files: DataFrame, config: ScanConfig | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(raw findings, faults) of ``raw_outcomes``."""
    rows = raw_outcomes(files, config, **options)
    return rows.filter("error is null").drop("error"), rows.filter("error is not null").select("file", "error")


def prose_of(spark: SparkSession, config: ScanConfig, user_rules: list[Rule] = (), scanners: list[Scanner] = (),
             advisories: DataFrame | None = None, osv: DataFrame | None = None, osv_ranges: DataFrame | None = None) -> Prose:
    """The prose of line rules, syntax rules and the bundled advisories, a few hundred rows.

    Findings of other advisories, of records and of registered scanners bring their own.
    """
    rules = [{"rule_ord": r.rule_ord, "note": 0, "severity": r.severity, "sev_weight": r.weight, "description": r.description,
              "cwe_id": r.cwe_id, "fix": r.fix, "scanner": rule_label(r)} for r in select_rules(config, user_rules)]
    base = {name: scanner_base(name) for name in ("ast_scanner", "dependencies")}
    rules += [{"rule_ord": base["ast_scanner"], "note": i, "severity": r.severity, "sev_weight": SEVERITY_WEIGHTS[r.severity], "description": r.description,
               "cwe_id": r.cwe_id, "fix": r.fix, "scanner": "ASTScanner"} for i, r in enumerate(SEMANTIC_RULES)]
    own = osv is not None or advisories is not None
    if not own:
        rules += deps.bundled_prose(base["dependencies"])
    table = dimension(spark, rules, StructType.fromDDL("rule_ord bigint, note int, severity string, sev_weight int, description string, cwe_id string, fix string, scanner string"))
    return Prose(table, sorted({r["rule_ord"] for r in rules}), list(base.values()), not own and not scanners)


def finish(raw: DataFrame, word: str = "siftguard", prose: Prose | None = None) -> DataFrame:
    """Suppression comments, then first-wins de-duplication, then specific advice."""
    return remediate(deduplicate(drop_suppressed(raw, word), prose=prose))


def scan(files: DataFrame, config: ScanConfig | None = None, *, baseline: DataFrame | None = None, suppressions: DataFrame | None = None,
         target_path: str = "", store: bool = False, **options) -> ScanPlan:
    """Plan a scan of a corpus.

    The line rules, the syntax facts and the manifests are three passes over ``files``. On a
    corpus stored by ``sinks.write_corpus`` the last two open only their own partitions.

    Findings listed in ``suppressions`` are taken out first, then those that ``baseline`` knows (paths relative to ``target_path``). With ``store`` the
    scanners run at once and a single time, and all tables of the plan read what they found; otherwise nothing runs until one of the
    tables is used, and each runs the scanners it needs.
    """
    config = config or ScanConfig()
    rows = raw_outcomes(files, config, **options)
    if store:
        rows = stored(rows, "outcomes")
    raw, errors = rows.filter("error is null").drop("error"), rows.filter("error is not null").select("file", "error")
    found = finish(raw, config.suppression_word, prose_of(files.sparkSession, config, **options))
    found = mark_persisted(found, suppressions) if suppressions is not None else found.withColumn("persisted", F.lit(False))
    found = classify(found, baseline, target_path=target_path) if baseline is not None else found.withColumn("known", F.lit(False))
    reported = found.filter(_CLASSES["reported"]).drop("persisted", "known")
    return ScanPlan(files, mark_suppressed(raw, config.suppression_word), found, reported, errors)


def summarise(plan: ScanPlan, scan_id: str, target_path: str, scanned_at: str, duration: float = 0.0,
              findings: DataFrame | None = None) -> DataFrame:
    """One row: counters, file counts, verdicts and gate of a scan.

    ``findings`` replaces those of the plan, for example by the new ones of a baseline diff.
    The row has the columns that the document operators expect of a scan.
    """
    key = F.lit(scan_id)
    found = plan.findings if findings is None else findings
    counted = severity_counts(found.select("severity")).withColumn("scan_id", key)
    read = file_counts(plan.files.select("skip_reason")).withColumn("scan_id", key)
    return judge(read.join(counted, "scan_id")).withColumns({
        "target_path": F.lit(target_path), "scanned_at": F.lit(scanned_at), "scan_duration": F.round(F.lit(float(duration)), 3)})


def record(plan: ScanPlan, store: HistoryStore, target_path: str, scanned_at: str, duration: float,
           scan_id: str | None = None) -> str:
    """Append a scan to the history; only its two file counts come to the driver."""
    counts = file_counts(plan.files.select("skip_reason")).first()
    return store.append(plan.findings, target_path, scanned_at, counts["files_scanned"], counts["files_skipped"],
                        duration, scan_id)
