"""Files to numbered lines, infrastructure file kinds, and snippets with context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LINE_BREAK, basename, extension, rstrip


def split_lines(content: Column) -> Column:
    """Array of lines. A final line break ends the last line and opens no new one."""
    return F.split(content, LINE_BREAK, -1)


def drop_last_empty(parts: Column) -> Column:
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def file_kind(path: Column, content: Column) -> Column:
    """Kind of infrastructure file, or null. The first matching test decides.

    The name tests ignore case, but a file only qualifies at all if its suffix is in the
    lower-case list or it is a Dockerfile.
    """
    name = F.lower(basename(path))
    suffix_known = path.endswith(".yml") | path.endswith(".yaml") | path.endswith(".tf") | path.endswith(".hcl")
    # A name that starts with its only dot has no extension.
    stem_free = F.ltrim(basename(path), F.lit("."))
    has_ext = stem_free.contains(".")
    yaml = has_ext & (path.endswith(".yml") | path.endswith(".yaml"))
    return (
        F.when((name == "dockerfile") | name.startswith("dockerfile."), "dockerfile")
        .when(~suffix_known, F.lit(None).cast("string"))
        .when(name.isin("docker-compose.yml", "docker-compose.yaml"), "compose")
        .when(has_ext & ~yaml, "terraform")
        .when(yaml & content.contains("apiVersion:") & content.contains("kind:"), "k8s")
        .when(yaml & content.contains("services:"), "compose")
    )


def with_file_facts(files: DataFrame) -> DataFrame:
    """Add ``ext`` and ``kind``, the two columns that rule gates look at."""
    return files.select("*", extension(F.col("path")).alias("ext"),
                        file_kind(F.col("path"), F.col("content")).alias("kind"))


def explode_lines(files: DataFrame, keep: list[str] = ("path",)) -> DataFrame:
    """One row per line: the kept file columns, ``line`` from 1, ``text``. No shuffle."""
    return (
        files.filter(F.col("content").isNotNull() & (F.col("content") != ""))
        .select(*keep, split_lines(F.col("content")).alias("_parts"))
        .select(*keep, F.posexplode(drop_last_empty(F.col("_parts"))).alias("_pos", "text"))
        .select(*keep, (F.col("_pos") + 1).alias("line"), "text")
    )


def snippets_with_context(findings: DataFrame, lines: DataFrame, context: int) -> DataFrame:
    """Text of lines ``line ± context``, cut at the ends of the file, per finding position.

    Both sides meet on (file, line), so one very long file still spreads over all tasks,
    and each group holds at most ``2 * context + 1`` lines.
    """
    spots = findings.select("file", "line").distinct()
    wanted = spots.select("file", F.col("line").alias("at"),
                          F.explode(F.sequence(F.col("line") - context, F.col("line") + context)).alias("line"))
    found = wanted.join(lines.select(F.col("path").alias("file"), "line", "text"), ["file", "line"])
    parts = F.sort_array(F.collect_list(F.struct("line", "text")))
    return found.groupBy("file", F.col("at").alias("line")).agg(
        rstrip(F.array_join(F.transform(parts, lambda p: p["text"]), "\n")).alias("context_snippet"))
