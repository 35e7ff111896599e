"""Patterns written for Python that Java has to run."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException

from .text import unicode_pattern


def portable(pattern: str) -> str:
    """Spell a Python pattern the way Java does.

    Translated are named groups, the end anchor, an open-ended lower bound, braces that are
    no quantifier, and brackets and double ampersands inside a character class.
    """
    names: dict[str, str] = {}

    def group(name: str) -> str:
        return names.setdefault(name, f"g{len(names) + 1}n")

    out, i, inside, first = [], 0, False, False
    while i < len(pattern):
        rest = pattern[i:]
        quantifier = re.match(r"\{(\d*)(,?)(\d*)\}", rest)
        if rest[0] == "\\":
            out.append("\\z" if rest.startswith("\\Z") and not inside else rest[:2])
            i, first = i + 2, False
        elif inside:
            ends = rest[0] == "]" and not first
            out.append("\\[" if rest[0] == "[" else "\\]" if rest[0] == "]" and first else "&\\&" if rest.startswith("&&") else rest[0])
            i += 2 if rest.startswith("&&") else 1
            first, inside = first and rest[0] == "^" and pattern[i - 2] == "[", not ends
        elif rest[0] == "[":
            out.append("[")
            inside, first, i = True, True, i + 1
        elif named := re.match(r"\(\?P<(\w+)>", rest):
            out.append(f"(?<{group(named[1])}>")
            i += named.end()
        elif named := re.match(r"\(\?P=(\w+)\)", rest):
            out.append(f"\\k<{group(named[1])}>")
            i += named.end()
        elif quantifier and (quantifier[1] or quantifier[3]):
            out.append("{" + (quantifier[1] or "0") + quantifier[2] + quantifier[3] + "}")
            i += quantifier.end()
        else:
            out.append("\\" + rest[0] if rest[0] in "{}" else rest[0])
            i += 1
    return "".join(out)


def java_pattern(pattern: str) -> str | None:
    """The pattern as Java runs it, or None if it cannot; without a session Java is not asked."""
    try:
        re.compile(pattern)
    except (re.error, TypeError, RecursionError, OverflowError):
        return None
    spelled, context = portable(pattern), SparkContext._active_spark_context
    if context is not None:
        try:
            context._jvm.java.util.regex.Pattern.compile(unicode_pattern(spelled))
        except (Py4JJavaError, IllegalArgumentException):
            return None
    return spelled
