"""Detectors for hardcoded credentials, written from publicly documented token formats.

The rule ids start with ``SEC``: this family is a reconstruction, so its titles and
counts carry no promise of parity with any other tool.
"""

from __future__ import annotations

from .model import Rule

_ROTATE = "Revoke the credential, then load its successor from a secret store."


def _rule(rule_id, severity, what, pattern, needs):
    return Rule(rule_id, "secrets", severity, "CWE-798", f"Hardcoded Secret — {what}", pattern,
                f"The line appears to contain a credential ({what}).", _ROTATE, needs=needs)


SECRET_RULES = [
    _rule("SEC01", "CRITICAL", "AWS Access Key", r"\b(AKIA|ASIA)[0-9A-Z]{16}\b", (("akia", "asia"),)),
    _rule("SEC02", "CRITICAL", "AWS Secret Key",
          r"""(?i)aws[a-z_ -]*(secret|key)[a-z_ -]*['"]?\s*[=:]\s*['"]?[0-9a-z/+]{40}\b""", (("=", ":"), ("aws",),)),
    _rule("SEC03", "CRITICAL", "Stripe Key", r"\b[sr]k_(live|test)_[0-9a-zA-Z]{16,}", (("_",), ("k_live_", "k_test_"),)),
    _rule("SEC04", "CRITICAL", "GitHub Token", r"\bgh[pousr]_[0-9A-Za-z]{36}|\bgithub_pat_[0-9A-Za-z_]{22,}",
          (("_",), ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"),)),
    _rule("SEC05", "HIGH", "JSON Web Token",
          r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", (("eyj",),)),
    _rule("SEC06", "CRITICAL", "JWT Signing Secret", r"""(?i)jwt[_-]?secret['"]?\s*[=:]\s*['"]?[^\s'"]{8,}""",
          (("=", ":"), ("jwt",), ("secret",))),
    _rule("SEC07", "CRITICAL", "Private Key", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", (("private key-----",),)),
    _rule("SEC08", "CRITICAL", "Database Connection String",
          r"""(?i)\b(postgres|postgresql|mysql|mongodb|mongodb\+srv|redis|amqp)://[^\s:@/'"]+:[^\s@/'"]+@""",
          (("://",), ("@",))),
    _rule("SEC09", "HIGH", "Slack Webhook",
          r"https://hooks\.slack\.com/services/T[0-9A-Za-z_]+/B[0-9A-Za-z_]+/[0-9A-Za-z_]+", (("://",), ("hooks.slack.com",),)),
    _rule("SEC10", "HIGH", "Slack Token", r"\bxox[abprs]-[0-9A-Za-z-]{10,}", (("xox",),)),
    _rule("SEC11", "HIGH", "Password Assignment", r"""(?i)\b(password|passwd|pwd)['"]?\s*[=:]\s*['"][^'"\s]{6,}['"]""",
          (("=", ":"), ("password", "passwd", "pwd"), ("'", "\""))),
    _rule("SEC12", "HIGH", "Generic Token",
          r"""(?i)\b(api[_-]?key|secret|token)['"]?\s*[=:]\s*['"][0-9a-z_-]{16,}['"]""",
          (("=", ":"), ("key", "secret", "token"), ("'", "\""))),
    _rule("SEC13", "HIGH", "Google API Key", r"\bAIza[0-9A-Za-z_-]{35}", (("aiza",),)),
]
