"""Findings in the shapes other tools read: SARIF parts, editor diagnostics, documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import severity as sev
from ..functions.text import relative_path
from .intervals import stored
from .joins import salted_join

#: Findings in one document, and diagnostics in one row of a file, at most.
CHUNK = 4096
FILE_BLOCK = 10_000

# Fixed value: the schema a SARIF 2.1.0 log names.
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
RULE_ID_LENGTH = 64


def sarif_rule_id(title: Column) -> Column:
    """Spaces and slashes become underscores, long dashes vanish, 64 characters remain."""
    return F.substring(F.translate(title, " /—", "__"), 1, RULE_ID_LENGTH)


def sarif_rules(findings: DataFrame, keys: list[str] = ()) -> DataFrame:
    """One descriptor per rule id, with the metadata of its first finding by severity.

    A minimum over a struct picks that finding with a map-side combine.
    """
    first = F.min(F.struct(
        (-F.col("sev_weight")).alias("order"), "file", "line", "title", "severity", "description", "cwe_id", "fix"))
    picked = (findings.groupBy(*keys, sarif_rule_id(F.col("title")).alias("rule_id"))
              .agg(first.alias("f")).select(*keys, "rule_id", "f.*"))
    return picked.select(
        *keys, "rule_id", F.col("title").alias("name"), "description",
        sev.sarif_level(F.col("severity")).alias("level"), sev.sarif_score(F.col("severity")).alias("score"),
        "cwe_id", F.nullif("fix", F.lit("")).alias("help"))


def sarif_results(findings: DataFrame, target_path: str = "", keys: list[str] = ()) -> DataFrame:
    """One flat result row per finding."""
    uri = relative_path(F.col("file"), F.lit(target_path))
    return findings.select(
        *keys, "sev_weight", sarif_rule_id(F.col("title")).alias("rule_id"), sev.sarif_level(F.col("severity")).alias("level"),
        F.col("description").alias("message"), uri.alias("uri"), F.col("line").alias("start_line"),
        F.nullif("code_snippet", F.lit("")).alias("snippet"), "severity", "scanner",
        F.nullif("fix", F.lit("")).alias("fix"))


def _sarif_result_struct() -> Column:
    def text(column):
        return F.struct(F.col(column).alias("text"))

    region = F.struct(F.col("start_line").alias("startLine"), F.lit(1).alias("startColumn"),
                      F.when(F.col("snippet").isNotNull(), text("snippet")).alias("snippet"))
    place = F.struct(F.struct(F.struct("uri", F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"),
                              region.alias("region")).alias("physicalLocation"))
    return F.struct(
        F.col("rule_id").alias("ruleId"), "level", text("message").alias("message"), F.array(place).alias("locations"),
        F.struct("severity", "scanner").alias("properties"),
        F.when(F.col("fix").isNotNull(), F.array(F.struct(text("fix").alias("description")))).alias("fixes"))


def _sarif_rule_struct() -> Column:
    component = F.struct(F.lit("CWE").alias("name"))
    target = F.struct(F.struct(F.col("cwe_id").alias("id"), component.alias("toolComponent")).alias("target"))
    shown = F.struct(F.col("help").alias("text"), F.concat(F.lit("**Fix:** "), "help").alias("markdown"))
    return F.struct(
        F.col("rule_id").alias("id"), "name", F.struct(F.col("name").alias("text")).alias("shortDescription"),
        F.struct(F.col("description").alias("text")).alias("fullDescription"),
        F.struct("level").alias("defaultConfiguration"),
        F.struct(F.col("score").alias("security-severity"), F.array(F.lit("security")).alias("tags")).alias("properties"),
        F.when(F.col("cwe_id").isNotNull(), F.array(target)).alias("relationships"),
        F.when(F.col("help").isNotNull(), shown).alias("help"))


def numbered(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Add ``_number``, a row's place within its keys in the given order, from 0, and ``_total``, the rows of its keys.

    A range partitioning on keys and order splits even a single hot key; the sorted parts are stored. What lies of a key in each part is
    counted in a small table, whose running sums say where a part's rows go on counting. So numbers depend on the rows
    alone, not on how they were dealt.
    """
    by = [*[F.col(k) for k in keys], *order]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = stored(placed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "numbered")
    parts = placed.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_p"), (before - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("_total"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col("_part") == F.col("_p"))
    return placed.join(parts, same).withColumn("_number", F.col("_at") + F.col("_shift")).select(*rows.columns, "_number", "_total")


def chunked(findings: DataFrame, keys: list[str], order: list, chunk: int = CHUNK) -> DataFrame:
    """Add ``_chunk``: rows of a key in order, ``chunk`` of them at a time."""
    return numbered(findings, keys, order).withColumn("_chunk", F.floor(F.col("_number") / chunk)).drop("_number", "_total")


def _order() -> list[Column]:
    """Severity descending, file, line, title; what else differs settles ties."""
    return [F.desc("sev_weight"), *map(F.col, ("file", "line", "title", "scanner", "severity", "description", "code_snippet", "cwe_id", "fix"))]


def sarif_documents(findings: DataFrame, summary: DataFrame, tool: str = "siftguard", version: str = "1.0.0",
                    uri: str = "", chunk: int = CHUNK) -> DataFrame:
    """SARIF logs per scan as text: (scan_id, chunk, document).

    ``findings`` and ``summary`` carry ``scan_id``; ``summary`` also ``target_path`` and the
    counters. A scan with more findings than ``chunk`` gives several logs, each valid by
    itself with its own rules, in severity order; every log states the counts of the whole scan.
    A scan without findings has one log without results.
    """
    metrics = F.struct("critical", "high", "medium", "low", "total")
    scans = summary.select("scan_id", "target_path", "scanned_at", metrics.alias("metrics"))
    # One scan may own a large share of the findings, so its header is joined with salt.
    known = salted_join(findings, scans, ["scan_id"], "inner", F.struct("file", "line"))
    shaped = chunked(known, ["scan_id"], _order(), chunk).select(
        "scan_id", "_chunk", "target_path", "scanned_at", "metrics", (-F.col("sev_weight")).alias("w"), "file", "line", "title",
        "severity", "scanner", "description", "cwe_id", F.col("title").alias("name"), F.col("description").alias("message"),
        sarif_rule_id(F.col("title")).alias("rule_id"), sev.sarif_level(F.col("severity")).alias("level"),
        sev.sarif_score(F.col("severity")).alias("score"), F.col("line").alias("start_line"),
        relative_path(F.col("file"), F.col("target_path")).alias("uri"), F.nullif("code_snippet", F.lit("")).alias("snippet"),
        F.nullif("fix", F.lit("")).alias("fix"), F.nullif("fix", F.lit("")).alias("help"))
    entry = F.struct("w", "file", "line", "title", "rule_id", _sarif_result_struct().alias("r"), _sarif_rule_struct().alias("d"))
    listed = shaped.groupBy("scan_id", "_chunk").agg(
        F.sort_array(F.collect_list(entry)).alias("entries"),
        *[F.first(c).alias(c) for c in ("target_path", "scanned_at", "metrics")])
    # The descriptor of a rule id is that of its first, most severe finding in the chunk.
    listed = listed.withColumn("_ids", F.transform("entries", lambda e: e["rule_id"])).withColumn(
        "rules", F.transform(F.array_distinct("_ids"), lambda i: F.get(
            F.col("entries"), (F.array_position(F.col("_ids"), i) - 1).cast("int"))["d"]))
    clean = scans.join(findings.select("scan_id").distinct(), "scan_id", "left_anti").withColumn("_chunk", F.lit(0).cast("bigint"))
    listed = listed.unionByName(clean, allowMissingColumns=True)
    entries = F.coalesce("entries", F.array())
    base = F.concat(F.rtrim(F.translate("target_path", "\\", "/"), F.lit("/")), F.lit("/"))
    driver = F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), F.lit(uri).alias("informationUri"),
                      F.lit(version).alias("semanticVersion"), F.coalesce("rules", F.array()).alias("rules"))
    run = F.struct(
        F.struct(driver.alias("driver")).alias("tool"),
        F.array(F.struct(F.lit(True).alias("executionSuccessful"), F.col("scanned_at").alias("endTimeUtc"))).alias("invocations"),
        F.transform(entries, lambda e: e["r"]).alias("results"),
        F.transform(entries, lambda e: F.struct(
            e["r"]["locations"][0]["physicalLocation"]["artifactLocation"].alias("location"))).alias("artifacts"),
        F.struct(F.struct(base.alias("uri")).alias("%SRCROOT%")).alias("originalUriBaseIds"),
        F.struct("metrics").alias("properties"))
    log = F.struct(F.lit(SARIF_SCHEMA).alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))
    return listed.select("scan_id", F.col("_chunk").alias("chunk"), F.to_json(log).alias("document"))


def findings_documents(findings: DataFrame, summary: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """JSON envelopes per scan: (scan_id, chunk, document), findings most severe first.

    Built like :func:`sarif_documents`. A scan without findings has one document.
    """
    flat = chunked(findings, ["scan_id"], _order(), chunk)
    shown = F.struct("file", "line", "severity", "title", "description", "code_snippet", "cwe_id", "fix", "scanner")
    entry = F.struct((-F.col("sev_weight")).alias("w"), "file", "line", "title", shown.alias("f"))
    listed = flat.groupBy("scan_id", "_chunk").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    filled = salted_join(listed, summary, ["scan_id"], "inner", F.col("_chunk"))
    empty = summary.join(findings.select("scan_id").distinct(), "scan_id", "left_anti")
    joined = filled.unionByName(empty, allowMissingColumns=True)
    counts = F.struct("critical", "high", "medium", "low", "info", "total")
    document = F.struct(
        "target_path", "files_scanned", "files_skipped", F.round("scan_duration", 3).alias("scan_duration"),
        counts.alias("summary"),
        F.coalesce(F.transform("entries", lambda e: e["f"]), F.array()).alias("findings"))
    return joined.select("scan_id", F.coalesce("_chunk", F.lit(0).cast("bigint")).alias("chunk"),
                         F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))


def diagnostics(findings: DataFrame) -> DataFrame:
    """One editor diagnostic per finding, with a 0-based line."""
    line = F.greatest(F.lit(0), F.coalesce(F.nullif("line", F.lit(0)), F.lit(1)) - 1)
    return findings.select(
        "file", line.alias("line0"), sev.editor_level(F.col("severity")).alias("level"),
        F.concat("title", F.lit("\n"), "description").alias("message"),
        F.coalesce(F.nullif("cwe_id", F.lit("")), F.col("scanner")).alias("code"))


def diagnostics_by_file(findings: DataFrame, block: int = FILE_BLOCK) -> DataFrame:
    """Diagnostics of a file as one array, in line order, with the file's ``total``.

    A file with more than ``block`` of them is several rows of that many, numbered by ``block``, so no group is unbounded; every row states the whole
    file's total.
    """
    rows = stored(diagnostics(findings), "diagnostics")
    sizes = stored(rows.groupBy("file").agg(F.count(F.lit(1)).alias("total")), "sizes")
    crowded = sizes.filter(F.col("total") > block).select("file")
    entry = F.struct("line0", "level", "message", "code")
    each = [F.sort_array(F.collect_list(entry)).alias("diagnostics"), F.count(F.lit(1)).alias("n")]
    out = rows.join(sizes.filter(F.col("total") <= block), "file").groupBy("file").agg(*each, F.max("total").alias("total"))
    out = out.select("file", F.lit(0).cast("bigint").alias("block"), "diagnostics", "n", "total")
    if crowded.isEmpty():
        return out
    many = numbered(rows.join(crowded, "file", "left_semi"), ["file"], [F.col(c) for c in ("line0", "level", "message", "code")])
    many = many.groupBy("file", F.floor(F.col("_number") / block).alias("block")).agg(*each, F.max("_total").alias("total"))
    return out.unionByName(many.select(out.columns))
