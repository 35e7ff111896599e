"""The rule catalogue: which detectors exist and in which order they take precedence."""

from __future__ import annotations

import warnings
from dataclasses import replace

from ..functions.patterns import java_pattern
from .infrastructure import INFRASTRUCTURE_RULES
from .language import DISABLED, LANGUAGE_RULES
from .model import (PLUGIN_BASE, SCANNER_STRIDE, SCANNERS, SEVERITY_WEIGHTS, USER_RULE_BASE,
                    USER_RULES_LABEL, Rule, scanner_base)
from .secrets import SECRET_RULES

__all__ = ["Rule", "SCANNERS", "SEVERITY_WEIGHTS", "SCANNER_STRIDE", "USER_RULE_BASE",
           "USER_RULES_LABEL", "PLUGIN_BASE", "scanner_base", "builtin_rules", "select_rules",
           "disabled_rules", "min_weight"]


def _number(rules: list[Rule]) -> list[Rule]:
    """Give each rule its ordinal: scanner precedence first, catalogue order second."""
    seen: dict[str, int] = {}
    out = []
    for rule in rules:
        index = seen.get(rule.scanner, 0)
        seen[rule.scanner] = index + 1
        out.append(replace(rule, rule_ord=scanner_base(rule.scanner) + index))
    return out


def builtin_rules() -> list[Rule]:
    return _number([*SECRET_RULES, *LANGUAGE_RULES, *INFRASTRUCTURE_RULES])


def disabled_rules() -> list[Rule]:
    return list(DISABLED)


def min_weight(min_severity: str) -> int:
    """An unknown threshold means "report everything"."""
    return SEVERITY_WEIGHTS.get(min_severity, 1)


def select_rules(config, user_rules: list[Rule] = ()) -> list[Rule]:
    """The rules a configuration asks for.

    The severity threshold acts here, on the rule table, so that rules below it never
    become part of the scan expression. User rules ignore the scanner switches.
    """
    wanted = set(config.enabled_scanners)
    chosen = [r for r in builtin_rules() if not wanted or r.scanner in wanted]
    if not wanted or "secrets" in wanted:
        start = scanner_base("secrets") + len(SECRET_RULES)
        runnable = [java_pattern(p) for p in config.extra_secret_patterns]
        for pattern in (p for p, java in zip(config.extra_secret_patterns, runnable, strict=True) if java is None):
            warnings.warn(f"secret pattern {pattern!r} cannot run", stacklevel=2)
        chosen += [
            Rule(f"SECX{i + 1}", "secrets", "HIGH", "CWE-798", "Hardcoded Secret — Custom Pattern",
                 pattern, "The line matches a secret pattern from the scan configuration.",
                 "Revoke the credential, then load its successor from a secret store.",
                 rule_ord=start + i)
            for i, pattern in enumerate(runnable) if pattern is not None
        ]
    floor = min_weight(config.min_severity)
    chosen = sorted([*chosen, *user_rules], key=lambda r: r.rule_ord)
    return [r for r in chosen if r.enabled and r.weight >= floor]
