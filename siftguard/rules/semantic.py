"""Detectors over syntax facts of Python files.

Titles, severities, CWE ids and the name lists are fixed values; the prose is ours.
"""

from __future__ import annotations

from dataclasses import dataclass

# Module → (severity, CWE, title, advice).
RISKY_IMPORTS = {
    "pickle": ("HIGH", "CWE-502", "Insecure Import — pickle", "Exchange data as JSON or msgpack."),
    "marshal": ("HIGH", "CWE-502", "Insecure Import — marshal", "Exchange data as JSON."),
    "telnetlib": ("MEDIUM", "CWE-319", "Insecure Import — telnetlib (plaintext protocol)", "Connect over SSH."),
    "ftplib": ("LOW", "CWE-319", "Insecure Import — ftplib (plaintext FTP)", "Transfer over SFTP or FTPS."),
    "cgi": ("LOW", "CWE-79", "Insecure Import — cgi module (deprecated, XSS risk)", "Move to a maintained web framework."),
}

# Call targets the detectors look at.
EVALUATORS = ["eval", "exec"]
SHELL_CALLS = ["system", "popen", "startfile"]
SUBPROCESS_CALLS = ["call", "run", "Popen", "check_output", "check_call"]
SQL_CALLS = ["execute", "executemany"]
ASSERT_WORDS = ["auth", "permission", "is_admin", "login", "verify", "token"]
ANY_ADDRESS = "0.0.0.0"

#: Names that matter to at least one detector; facts about other names are not kept.
WATCHED = {*RISKY_IMPORTS, *EVALUATORS, *SHELL_CALLS, *SUBPROCESS_CALLS, *SQL_CALLS, "run", "bind"}


@dataclass(frozen=True)
class SemanticRule:
    """``condition`` and ``title`` are SQL expressions over a fact row."""

    severity: str
    cwe_id: str
    title: str
    condition: str
    description: str
    fix: str


def _any(column: str, names: list[str]) -> str:
    return f"{column} IN ({', '.join(repr(n) for n in names)})"


SEMANTIC_RULES = [
    *[SemanticRule(severity, cwe, f"'{title}'", f"kind = 'import' AND name = '{module}'",
                   f"The module {module} brings a known risk into the program.", advice)
      for module, (severity, cwe, title, advice) in RISKY_IMPORTS.items()],
    SemanticRule("CRITICAL", "CWE-95", "concat('Code Injection — ', name, '() with non-literal argument')",
                 f"kind = 'call' AND NOT attribute AND {_any('name', EVALUATORS)} AND first_arg IN ('join', 'other')",
                 "The evaluated text is computed at run time, so it may come from outside.",
                 "Parse literals with ast.literal_eval() instead of evaluating code."),
    SemanticRule("HIGH", "CWE-78", "concat('Command Injection — os.', name, '() with dynamic argument')",
                 f"kind = 'call' AND owner = 'os' AND {_any('name', SHELL_CALLS)} AND first_arg IN ('join', 'other')",
                 "A computed command line goes to the shell.",
                 "Start the program with subprocess.run() and a list of arguments."),
    SemanticRule("CRITICAL", "CWE-78", "'Command Injection — subprocess with shell=True'",
                 f"kind = 'call' AND owner = 'subprocess' AND {_any('name', SUBPROCESS_CALLS)} AND array_contains(true_flags, 'shell')",
                 "The command string is interpreted by a shell.",
                 "Pass a list of arguments and leave shell out."),
    SemanticRule("CRITICAL", "CWE-89", "'SQL Injection — Dynamic Query in execute()'",
                 f"kind = 'call' AND attribute AND {_any('name', SQL_CALLS)} AND first_arg = 'join'",
                 "The statement is put together from parts at the call.",
                 "Keep the statement constant and bind the values."),
    SemanticRule("HIGH", "CWE-215", "'Sensitive Data Exposure — Flask debug=True'",
                 "kind = 'call' AND attribute AND name = 'run' AND array_contains(true_flags, 'debug')",
                 "The debugger of the development server is switched on.",
                 "Take the switch from the environment and keep it off in production."),
    SemanticRule("LOW", "CWE-605", "'Network Binding — Listening on 0.0.0.0'",
                 f"kind = 'call' AND attribute AND name = 'bind' AND array_contains(tuple_texts, '{ANY_ADDRESS}')",
                 "The socket accepts connections on every interface.",
                 "Bind to the interface that is meant to be reachable."),
    SemanticRule("HIGH", "CWE-617", "'Security Logic in assert Statement'",
                 "kind = 'assert' AND (" + " OR ".join(f"contains(lower(name), '{w}')" for w in ASSERT_WORDS) + ")",
                 "Assertions vanish when Python runs optimized, and the check with them.",
                 "Test the condition with if and raise an error."),
    SemanticRule("LOW", "CWE-390", "'Error Handling — Bare except: pass Swallowing All Exceptions'",
                 "kind = 'silent_except'",
                 "Every exception disappears here, even a request to stop the program.",
                 "Name the exceptions you expect and log them."),
]
