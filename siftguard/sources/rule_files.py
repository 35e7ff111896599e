"""User-defined rules from a settings file."""

from __future__ import annotations

import warnings

from ..config import read_settings
from ..functions.patterns import java_pattern
from ..rules import SEVERITY_WEIGHTS, USER_RULE_BASE, Rule


def user_rules(items: list[dict]) -> list[Rule]:
    """Rules from plain mappings.

    An item without a pattern is left out, and so is one whose pattern cannot run, with a
    warning. Missing fields get defaults.
    """
    rules = []
    for item in items:
        if not isinstance(item, dict) or "pattern" not in item:
            continue
        name = str(item.get("id", "custom-rule"))
        pattern = java_pattern(item["pattern"])
        if pattern is None:
            warnings.warn(f"rule {name!r} has no pattern that can run", stacklevel=2)
            continue
        severity = str(item.get("severity", "MEDIUM")).upper()
        rules.append(Rule(
            rule_id=name, scanner="user", severity=severity if severity in SEVERITY_WEIGHTS else "MEDIUM",
            cwe_id=item.get("cwe_id"), title=str(item.get("title", name)), pattern=pattern,
            description=str(item.get("description", "")), fix=str(item.get("fix", "")),
            exts=tuple(item.get("file_extensions") or ()), rule_ord=USER_RULE_BASE + len(rules)))
    return rules


def load_rules(path: str) -> list[Rule]:
    """Read the ``rules`` list of a JSON or YAML file; anything unreadable gives no rules."""
    items = read_settings(path).get("rules", [])
    return user_rules(items if isinstance(items, list) else [])
