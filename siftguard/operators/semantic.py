"""Python files seen through their syntax tree.

The only work done in Python is to flatten a syntax tree into plain fact rows (imports,
calls, asserts, silent handlers): a table function, joined laterally to the files, so any column of a file goes
along. The detectors are SQL conditions over those rows. A file is parsed once; a fault is a row of the same table.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import rstrip, sql_text
from ..rules import SEVERITY_WEIGHTS, min_weight, scanner_base
from ..rules.semantic import RISKY_IMPORTS, SEMANTIC_RULES, WATCHED
from ..schemas import NOTES, RAW_COLUMNS

FACTS = ("seq bigint, line int, kind string, name string, attribute boolean, owner string, "
         "first_arg string, true_flags array<string>, tuple_texts array<string>, source_line string")
_FIELDS = [part.split()[0] for part in FACTS.split(", ")]

#: A file without any of these words yields no finding, so it is never parsed.
TRIGGERS = [*RISKY_IMPORTS, "eval", "exec", "system", "popen", "startfile", "subprocess", "debug", "bind",
            "assert", "except"]


def _argument(node: ast.Call) -> str:
    if not node.args:
        return "none"
    first = node.args[0]
    if isinstance(first, ast.Constant):
        return "constant"
    joined = isinstance(first, ast.JoinedStr) or (isinstance(first, ast.BinOp) and isinstance(first.op, ast.Add))
    return "join" if joined else "other"


def _facts(node: ast.AST):
    """(kind, name, attribute, owner, first_arg, true_flags, tuple_texts) per fact of a node."""
    if isinstance(node, ast.Import):
        for alias in node.names:
            yield "import", alias.name.split(".")[0], False, None, None, [], []
    elif isinstance(node, ast.ImportFrom):
        yield "import", (node.module or "").split(".")[0], False, None, None, [], []
    elif isinstance(node, ast.Assert):
        yield "assert", ast.unparse(node.test), False, None, None, [], []
    elif isinstance(node, ast.ExceptHandler):
        if node.type is None and all(isinstance(s, ast.Pass) for s in node.body):
            yield "silent_except", None, False, None, None, [], []
    elif isinstance(node, ast.Call) and isinstance(node.func, (ast.Name, ast.Attribute)):
        attribute = isinstance(node.func, ast.Attribute)
        name = node.func.attr if attribute else node.func.id
        owner = node.func.value.id if attribute and isinstance(node.func.value, ast.Name) else None
        flags = [k.arg for k in node.keywords
                 if k.arg and isinstance(k.value, ast.Constant) and k.value.value is True]
        texts = [e.value for a in node.args if isinstance(a, ast.Tuple) for e in a.elts
                 if isinstance(e, ast.Constant) and isinstance(e.value, str)]
        yield "call", name, attribute, owner, _argument(node), flags, texts


def _file_facts(content: str) -> list[tuple]:
    """Facts in source order. A file Python cannot parse has none; any other fault is one fact of kind ``error``."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            stack = [ast.parse(content)]
        lines = content.splitlines()
        rows = []
        while stack:
            node = stack.pop()
            for fact in _facts(node):
                if fact[0] in ("assert", "silent_except") or fact[1] in WATCHED:
                    text = lines[node.lineno - 1] if node.lineno <= len(lines) else None
                    rows.append((len(rows), node.lineno, *fact, text))
            stack.extend(reversed(list(ast.iter_child_nodes(node))))
        return rows
    except (SyntaxError, ValueError):  # no Python source
        return []
    except Exception as error:  # one file must not fail the job, nor pass as clean
        return [(0, None, "error", repr(error)[:200], False, None, None, [], [], None)]


class SyntaxFacts:
    """Table function: the facts of a file. (Spark takes no Arrow table function in a lateral join.)"""

    def eval(self, content: str) -> Iterator[tuple]:
        yield from _file_facts(content)


def syntax_facts(files: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Fact rows of all ``.py`` files that contain a trigger word, with their ``file`` and the columns to keep.

    The word test runs in the JVM before any text is sent to Python. A file with non-ASCII
    text passes it unseen, since Python folds some of those characters into identifiers.
    """
    content = F.col("content")
    trigger = reduce(lambda a, b: a | b, [content.contains(w) for w in TRIGGERS])
    odd = F.length(content) != F.octet_length(content)
    python = files.filter(F.col("path").endswith(".py") & content.isNotNull() & (trigger | odd))
    facts = F.udtf(SyntaxFacts, returnType=FACTS, useArrow=False)
    return python.select(F.col("path").alias("file"), "content", *keep).lateralJoin(facts(F.col("content").outer())).select("file", *keep, *_FIELDS)


def semantic_outcomes(files: DataFrame, min_severity: str = "INFO", keep: list[str] = ()) -> DataFrame:
    """Raw findings (every fact that satisfies a detector) and faults, told apart by ``error``. No shuffle.

    The place of a detector in the catalogue is part of ``emit_seq``, so its prose can be attached later.
    """
    floor = min_weight(min_severity)
    rules = [(i, r) for i, r in enumerate(SEMANTIC_RULES) if SEVERITY_WEIGHTS[r.severity] >= floor]
    found = [f"IF({r.condition}, named_struct('severity', '{r.severity}', 'sev_weight', {SEVERITY_WEIGHTS[r.severity]}, "
             f"'title', {r.title}, 'description', {sql_text(r.description)}, 'cwe_id', '{r.cwe_id}', "
             f"'fix', {sql_text(r.fix)}, 'note', {i}, 'error', CAST(NULL AS STRING)), NULL)" for i, r in rules]
    nothing = ", ".join(f"'{n}', CAST(NULL AS {t})" for n, t in (
        ("severity", "STRING"), ("sev_weight", "INT"), ("title", "STRING"), ("description", "STRING"), ("cwe_id", "STRING"), ("fix", "STRING"), ("note", "INT")))
    found.append(f"IF(kind = 'error', named_struct({nothing}, 'error', name), NULL)")
    hits = syntax_facts(files, keep).select("file", "line", "seq", "source_line", *keep, F.expr(f"explode(array({', '.join(found)}))").alias("hit"))
    return hits.filter(F.col("hit").isNotNull()).select(
        "file", "line", "hit.*", *keep, F.coalesce(rstrip(F.col("source_line")), F.lit("")).alias("code_snippet"),
        F.lit("ASTScanner").alias("scanner"), F.lit(scanner_base("ast_scanner")).cast("bigint").alias("rule_ord"),
        (F.col("seq") * NOTES + F.col("note")).alias("emit_seq"), "source_line",
    ).select(*RAW_COLUMNS, "error", *keep)


def semantic_errors(files: DataFrame) -> DataFrame:
    """Files whose syntax tree could not be walked: path and message."""
    return semantic_outcomes(files).filter("error is not null").select("file", "error")


def semantic_findings(files: DataFrame, min_severity: str = "INFO") -> DataFrame:
    """The findings alone."""
    return semantic_outcomes(files, min_severity).filter("error is null").drop("error")
