"""What happens to raw findings: severity threshold, suppression, de-duplication, advice."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import severity as sev
from ..functions.text import matches, sql_text, strip, unicode_pattern
from ..rules import min_weight
from ..rules.remediation import REMEDIES
from ..schemas import FINDING_COLUMNS, NOTES
from .joins import salted_join


def at_least(findings: DataFrame, min_severity: str) -> DataFrame:
    """Severity threshold. An unknown threshold lets everything pass."""
    return findings.filter(sev.weight(F.col("severity")) >= min_weight(min_severity))


# ------------------------------------------------------------------ suppression comments

def suppression_pattern(word: str) -> str:
    """Comment marker with an optional list of title fragments after it.

    Fixed format: ``#`` or ``//``, then ``nosec``, ``noqa`` or ``<word>: ignore``.
    """
    return rf"(?i)(?:#|//)\s*(?:nosec|noqa|{word}\s*:\s*ignore)(?:\s*:?\s*(.+))?$"


def is_suppressed(line_text: Column, title: Column, word: str = "siftguard") -> Column:
    """Does the comment on the line cover a finding with this title?

    A marker without a list covers every finding. A list covers a finding if one of its
    items occurs in the title, whatever the case. No line, no suppression.
    """
    pattern = suppression_pattern(word)
    listed = F.regexp_extract(line_text, unicode_pattern(pattern), 1)
    items = F.filter(F.transform(F.split(listed, ","), lambda item: F.lower(strip(item))),
                     lambda item: item != "")
    covered = (F.size(items) == 0) | F.exists(items, lambda item: F.lower(title).contains(item))
    return F.coalesce(matches(line_text, pattern) & covered, F.lit(False))


def mark_suppressed(raw: DataFrame, word: str = "siftguard") -> DataFrame:
    return raw.withColumn("suppressed", is_suppressed(F.col("source_line"), F.col("title"), word))


def with_source_line(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """Look up the line text for findings that came without it.

    The join runs on (file, line), so the findings of one file spread over many tasks.
    """
    text = lines.select(F.col("path").alias("file"), "line", F.col("text").alias("source_line"))
    return findings.drop("source_line").join(text, ["file", "line"], "left")


def drop_suppressed(raw: DataFrame, word: str = "siftguard") -> DataFrame:
    return mark_suppressed(raw, word).filter(~F.col("suppressed")).drop("suppressed")


def finding_hash() -> Column:
    return F.concat(F.col("title"), F.lit("::"), F.col("file"))


def drop_persisted(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Remove findings listed in the suppression table.

    One title in one file may own a large share of all findings, so the join is salted by
    line. The planner broadcasts the distinct hashes while they are small.
    """
    listed = suppressions.select("finding_hash").distinct()
    hashed = findings.withColumn("finding_hash", finding_hash())
    return salted_join(hashed, listed, ["finding_hash"], "left_anti", F.col("line")).select(findings.columns)


def mark_persisted(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Add ``persisted``: whether the suppression table lists the finding."""
    listed = suppressions.select("finding_hash").distinct().withColumn("_listed", F.lit(True))
    hashed = findings.withColumn("finding_hash", finding_hash())
    marked = salted_join(hashed, listed, ["finding_hash"], "left", F.col("line"))
    return marked.select(*findings.columns, F.coalesce("_listed", F.lit(False)).alias("persisted"))


# ------------------------------------------------------------------ de-duplication

#: What a finding says besides where it is and what the line holds.
PROSE = ["severity", "sev_weight", "description", "cwe_id", "fix", "scanner"]


@dataclass
class Prose:
    """The prose of rules, by ``rule_ord`` and ``note``.

    ``known`` are the rule ordinals in the table, ``noted`` those whose findings have several notes; unless it is
    ``complete``, other findings may occur, which carry their own.
    """

    table: DataFrame
    known: list[int]
    noted: list[int]
    complete: bool


def deduplicate(raw: DataFrame, keys: list[str] = (), prose: Prose | None = None) -> DataFrame:
    """One finding per (file, line, title): that of the earliest scanner and rule.

    A minimum over a struct is combined on the map side, so copies of one finding shrink
    before the shuffle, however many there are. ``keys`` adds columns such as a scan id.

    With ``prose`` only the order and the snippet of a finding are shuffled; what its rule says is joined afterwards from a small
    table. Findings of rules that are not in the table carry their prose along.
    """
    group = [*keys, "file", "line", "title"]
    if prose is None:
        first = F.min(F.struct("rule_ord", "emit_seq", *PROSE, "code_snippet")).alias("first")
        return raw.groupBy(*group).agg(first).select(*group, "first.*").select(*keys, *FINDING_COLUMNS)
    own = [] if prose.complete else [F.when(~F.col("rule_ord").isin(prose.known), F.struct(*PROSE)).alias("own")]
    first = F.min(F.struct("rule_ord", "emit_seq", "code_snippet", *own)).alias("first")
    picked = raw.groupBy(*group).agg(first).select(*group, "first.*")
    note = F.when(F.col("rule_ord").isin(prose.noted), F.col("emit_seq") % NOTES).otherwise(0).cast("int") if prose.noted else F.lit(0)
    joined = picked.withColumn("note", note).join(prose.table, ["rule_ord", "note"], "left")
    if prose.complete:
        return joined.select(*keys, *FINDING_COLUMNS)
    filled = [F.coalesce(F.col(c), F.col(f"own.{c}")).alias(c) if c in PROSE else F.col(c) for c in FINDING_COLUMNS]
    return joined.select(*keys, *filled)


# ------------------------------------------------------------------ advice

def remediation() -> Column:
    """Specific advice where the title and the snippet call for it, else the rule's own."""
    branches = " ".join(
        f"WHEN title RLIKE {sql_text(unicode_pattern(r.title))} "
        f"AND code_snippet RLIKE {sql_text(unicode_pattern(r.snippet))} THEN {sql_text(r.text())}"
        for r in REMEDIES)
    return F.expr(f"CASE {branches} ELSE fix END")


def remediate(findings: DataFrame) -> DataFrame:
    return findings.withColumn("fix", remediation())


def with_multiline_fix(findings: DataFrame) -> DataFrame:
    """Findings whose advice shows code, with its before and after parts, most severe first."""
    def part(label):
        return F.nullif(F.regexp_extract("fix", rf"(?m)^\s*{label}:\s*(.+)$", 1), F.lit(""))

    shown = findings.filter(F.col("fix").contains("\n"))
    return by_severity(shown.select("*", part("Before").alias("before"), part("After").alias("after")))


# ------------------------------------------------------------------ order and search

def by_severity(findings: DataFrame) -> DataFrame:
    """Total order: severity descending, then file, line and title."""
    return findings.orderBy(F.desc("sev_weight"), "file", "line", "title")


def sorted_by(findings: DataFrame, choice: str) -> DataFrame:
    """User's choice of order: severity, file or scanner."""
    tie = ["file", "line", "title"]
    keys = {"severity": [F.desc("sev_weight"), *tie], "file": tie,
            "scanner": ["scanner", *tie]}.get(choice, tie)
    return findings.orderBy(*keys)


def search(findings: DataFrame, text: str = "", severity: str = "ALL") -> DataFrame:
    """Filter by severity and by a fragment of title, file, description, CWE id or scanner."""
    out = findings if severity == "ALL" else findings.filter(F.col("severity") == severity)
    if not text:
        return out
    fragment = text.lower()
    columns = ["title", "file", "description", "cwe_id", "scanner"]
    found = [F.coalesce(F.lower(F.col(c)).contains(fragment), F.lit(False)) for c in columns]
    return out.filter(reduce(lambda a, b: a | b, found))
