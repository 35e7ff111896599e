"""Severity as an ordinal and as the levels other tools expect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import SEVERITY_WEIGHTS

# Severity → (SARIF level, SARIF score, editor level).
EXPORT_LEVELS = {
    "CRITICAL": ("error", "9.0", "Error"),
    "HIGH": ("error", "7.0", "Error"),
    "MEDIUM": ("warning", "5.0", "Warning"),
    "LOW": ("note", "3.0", "Information"),
    "INFO": ("none", "1.0", "Hint"),
}


def _choose(severity: Column, values: dict, default) -> Column:
    choice = None
    for label, value in values.items():
        test = severity == label
        choice = F.when(test, value) if choice is None else choice.when(test, value)
    return choice.otherwise(default)


def weight(severity: Column) -> Column:
    return _choose(severity, SEVERITY_WEIGHTS, 0)


def sarif_level(severity: Column) -> Column:
    return _choose(severity, {k: v[0] for k, v in EXPORT_LEVELS.items()}, "warning")


def sarif_score(severity: Column) -> Column:
    return _choose(severity, {k: v[1] for k, v in EXPORT_LEVELS.items()}, "5.0")


def editor_level(severity: Column) -> Column:
    return _choose(severity, {k: v[2] for k, v in EXPORT_LEVELS.items()}, "Warning")


def normalise(severity: Column, default: str = "MEDIUM") -> Column:
    """Upper-case label; an unknown one becomes the default."""
    upper = F.upper(severity)
    return F.when(upper.isin(*SEVERITY_WEIGHTS), upper).otherwise(default)


def cwe_link(cwe_id: Column) -> Column:
    return F.concat(F.lit("https://cwe.mitre.org/data/definitions/"),
                    F.substring_index(cwe_id, "-", -1), F.lit(".html"))
