"""The rule row: one line-level detector with its gate and its metadata."""

from __future__ import annotations

from dataclasses import dataclass

# Severity labels with their ordinal weight, highest first.
SEVERITY_WEIGHTS = {"CRITICAL": 5, "HIGH": 4, "MEDIUM": 3, "LOW": 2, "INFO": 1}

# Scanner switches in precedence order, with the label that their
# findings carry. A duplicate finding keeps the row of the earliest scanner.
SCANNERS = {
    "secrets": "SecretsScanner",
    "sql_injection": "SQLInjectionScanner",
    "command_injection": "CommandInjectionScanner",
    "xss": "XSSScanner",
    "path_traversal": "PathTraversalScanner",
    "deserialization": "DeserializationScanner",
    "weak_crypto": "WeakCryptoScanner",
    "sensitive_data": "SensitiveDataScanner",
    "dependencies": "DependencyScanner",
    "ast_scanner": "ASTScanner",
    "iac": "IaCScanner",
}
USER_RULES_LABEL = "YAMLRuleScanner"

#: Rule ordinals leave this many slots per scanner, so an ordinal also sorts by
#: scanner precedence. User rules and registered scanners come after the built-ins.
SCANNER_STRIDE = 1000
USER_RULE_BASE = len(SCANNERS) * SCANNER_STRIDE
PLUGIN_BASE = USER_RULE_BASE * 100


def scanner_base(key: str) -> int:
    return list(SCANNERS).index(key) * SCANNER_STRIDE


@dataclass(frozen=True)
class Rule:
    """One "this pattern occurs in the line" detector.

    ``exts`` and ``kind`` gate the rule by path suffix or by infrastructure file
    kind. ``needs`` lists groups of lower-case literals: a matching line is certain
    to contain at least one literal of every group, which lets the scan skip the
    regular expression on most lines without changing the result.
    """

    rule_id: str
    scanner: str
    severity: str
    cwe_id: str | None
    title: str
    pattern: str
    description: str = ""
    fix: str = ""
    exts: tuple[str, ...] = ()
    kind: str | None = None
    not_pattern: str | None = None
    needs: tuple[tuple[str, ...], ...] = ()
    enabled: bool = True
    rule_ord: int = -1

    @property
    def weight(self) -> int:
        return SEVERITY_WEIGHTS[self.severity]
