"""The line-rule scan: every rule against every line in one narrow pass.

Each rule becomes one bit of a 64-bit mask that is computed inside generated code; a line
without a set bit is dropped at once, and only the few hits are exploded and joined to the
rule table. No shuffle happens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import rstrip, sql_text, unicode_pattern
from ..rules import SCANNERS, USER_RULES_LABEL, Rule
from ..schemas import NOTES, RAW_COLUMNS, RULES
from ..session import dimension

_BITS = 63
#: Characters whose case folding reaches an ASCII letter; the literal gate lets lines
#: with one of them through.
_FOLDING = "ſıİK"


def rule_label(rule: Rule) -> str:
    if rule.scanner == "user":
        return f"{USER_RULES_LABEL}:{rule.rule_id}"
    return SCANNERS[rule.scanner]


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules as a table; the scan joins its metadata columns to the hits."""
    rows = [
        {"rule_ord": r.rule_ord, "rule_id": r.rule_id, "scanner": r.scanner, "label": rule_label(r),
         "exts": list(r.exts), "kind": r.kind, "pattern": r.pattern, "not_pattern": r.not_pattern,
         "severity": r.severity, "sev_weight": r.weight, "title": r.title, "cwe_id": r.cwe_id,
         "description": r.description, "fix": r.fix, "enabled": r.enabled}
        for r in rules
    ]
    from pyspark.sql.types import StructType
    return dimension(spark, rows, StructType.fromDDL(RULES))


def _contains_any(group: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(_lowered, {sql_text(word)})" for word in group) + ")"


def gate_sql(groups) -> str:
    """True for every line the rule can match: at least one literal of each group occurs."""
    return f"(_folding OR ({' AND '.join(_contains_any(g) for g in groups)}))"


def _bit_sql(rule: Rule, bit: int) -> str:
    tests = []
    if rule.exts and not _plain(rule):
        tests.append("(" + " OR ".join(f"endswith(path, {sql_text(e)})" for e in rule.exts) + ")")
    if rule.needs[1:]:
        tests.append(gate_sql(rule.needs[1:]))
    tests.append(f"text RLIKE {sql_text(unicode_pattern(rule.pattern))}")
    if rule.not_pattern:
        tests.append(f"NOT text RLIKE {sql_text(unicode_pattern(rule.not_pattern))}")
    return f"IF({' AND '.join(tests)}, {1 << bit}L, 0L)"


def _mask_sql(rules: list[Rule], bit_of: dict[int, int]) -> str:
    """Sum of the bits of the rules that match. Bits are distinct, so a sum is a union.

    Rules that share their first literal group sit behind one test of it, so a line without
    a parenthesis, say, passes over all call detectors at the price of one search.
    """
    by_anchor: dict[tuple, list[Rule]] = {}
    for rule in rules:
        by_anchor.setdefault(rule.needs[0] if rule.needs else (), []).append(rule)
    terms = []
    for anchor, members in by_anchor.items():
        bits = " + ".join(_bit_sql(r, bit_of[r.rule_ord]) for r in members)
        terms.append(f"IF({gate_sql([anchor])}, {bits}, 0L)" if anchor else f"({bits})")
    return " + ".join(terms)


def _plain(rule: Rule) -> bool:
    """Suffixes like '.py' can be compared with the ``ext`` column."""
    return all(e.startswith(".") and "." not in e[1:] and "/" not in e for e in rule.exts)


def _branches(rules: list[Rule]):
    """Split rules into those for all files, per suffix, and per file kind."""
    everywhere = [r for r in rules if not r.kind and (not r.exts or not _plain(r))]
    by_ext: dict[str, list[Rule]] = {}
    by_kind: dict[str, list[Rule]] = {}
    for rule in rules:
        if rule.kind:
            by_kind.setdefault(rule.kind, []).append(rule)
        elif rule.exts and _plain(rule):
            for ext in dict.fromkeys(rule.exts):
                by_ext.setdefault(ext, []).append(rule)
    return everywhere, by_ext, by_kind


def mask_sql(rules: list[Rule], bit_of: dict[int, int]) -> str:
    """Mask of matching rules for columns ``path``, ``ext``, ``kind``, ``text``."""
    everywhere, by_ext, by_kind = _branches(rules)
    parts = [_mask_sql(everywhere, bit_of)] if everywhere else []
    for column, groups in (("ext", by_ext), ("kind", by_kind)):
        if groups:
            branches = " ".join(f"WHEN {sql_text(value)} THEN {_mask_sql(members, bit_of)}"
                                for value, members in groups.items())
            parts.append(f"CASE {column} {branches} ELSE 0L END")
    return " + ".join(parts)


def match_rules(lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """(path, line, text, rule_ord) for each rule that matches the line.

    ``lines`` has ``path``, ``ext``, ``kind``, ``line``, ``text``. Extra columns pass through.
    The rules arrive as SQL text, which Spark parses in one go.
    """
    if not rules:
        return lines.select("*", F.lit(None).cast("bigint").alias("rule_ord")).filter(F.lit(False))
    folding = " OR ".join(f"contains(text, '{c}')" for c in _FOLDING)
    base = lines.selectExpr("*", "lower(text) AS _lowered", f"({folding}) AS _folding")
    masks, bits = [], []
    for start in range(0, len(rules), _BITS):
        chunk = rules[start:start + _BITS]
        name = f"_mask{len(masks)}"
        masks.append(f"{mask_sql(chunk, {r.rule_ord: i for i, r in enumerate(chunk)})} AS {name}")
        bits += [f"IF({name} & {1 << i}L <> 0, {r.rule_ord}L, NULL)" for i, r in enumerate(chunk)]
    masked = base.selectExpr(*lines.columns, *masks)
    any_hit = " OR ".join(f"_mask{i} <> 0" for i in range(len(masks)))
    # Exploding null yields no row. A filter on the mask would do the same, but the
    # optimizer would move it below the projection and evaluate every rule twice.
    ordinals = f"IF({any_hit}, filter(array({', '.join(bits)}), x -> x IS NOT NULL), NULL)"
    return masked.selectExpr(*lines.columns, f"explode({ordinals}) AS rule_ord")


def attach_metadata(hits: DataFrame, table: DataFrame) -> DataFrame:
    """Raw findings: rule metadata joined to the hits through the small rule table."""
    meta = table.selectExpr("rule_ord", "severity", "sev_weight", "title", "description", "cwe_id", "fix",
                            "label AS scanner")
    return (
        hits.join(meta, "rule_ord")
        .withColumnsRenamed({"path": "file", "text": "source_line"})
        .withColumn("code_snippet", rstrip(F.col("source_line")))
        .withColumn("emit_seq", F.col("line").cast("bigint") * NOTES)
    )


def scan_lines(lines: DataFrame, rules: list[Rule], keep: list[str] = ()) -> DataFrame:
    """Raw findings of all given rules over the lines table."""
    hits = match_rules(lines, rules)
    found = attach_metadata(hits, rule_table(lines.sparkSession, rules))
    return found.select(*keep, *RAW_COLUMNS)
