"""Text functions: decoding, line splitting, trimming, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that end a line, "\r\n" being one ending.
LINE_BREAK = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85  ]"

#: White space in the Unicode sense, with the four separators U+001C to U+001F.
SPACES = ("\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
          + "\u2028\u2029\u202f\u205f\u3000")

# Share of control bytes above which a file counts as binary, and the
# number of leading bytes looked at.
BINARY_SHARE = 0.30
BINARY_SAMPLE = 8192


def unicode_pattern(pattern: str) -> str:
    """Make Java read ``\\s``, ``\\w``, ``\\b`` and case folding in the Unicode sense."""
    if any(token in pattern for token in (r"\s", r"\S", r"\w", r"\W", r"\b", r"\d", "(?i)")):
        return "(?U)" + pattern
    return pattern


def sql_text(value: str) -> str:
    """A SQL string literal with this value."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{escaped}'"


def matches(text: Column, pattern: str) -> Column:
    """Does the pattern occur anywhere in the text? The pattern is a plan-time literal."""
    return text.rlike(unicode_pattern(pattern))


def rstrip(text: Column) -> Column:
    """Without white space at the end; linear in the text, unlike an anchored pattern."""
    return F.rtrim(text, F.lit(SPACES))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def decode_utf8(content: Column) -> Column:
    """Bytes to text; invalid sequences become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def is_binary(content: Column) -> Column:
    """More than 30 % control bytes in the leading sample. An empty file is text."""
    sample = F.substring(content, 1, BINARY_SAMPLE)
    control = F.length(F.regexp_replace(F.decode(sample, "ISO-8859-1"),
                                        r"[^\x00-\x08\x0e-\x1f\x7f]", ""))
    size = F.length(sample)
    return (size > 0) & (control / size > BINARY_SHARE)


def extension(path: Column) -> Column:
    """The text from the last dot on; a suffix test for '.x' equals a test of this value."""
    return F.when(path.contains("."), F.concat(F.lit("."), F.substring_index(path, ".", -1))).otherwise("")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def ends_with_any(path: Column, suffixes) -> Column:
    """Case-sensitive suffix gate; no suffixes means every path passes."""
    gate = F.lit(not suffixes)
    for suffix in suffixes:
        gate = gate | path.endswith(suffix)
    return gate


def relative_path(path: Column, root: Column) -> Column:
    """Path below ``root`` with forward slashes; a path elsewhere stays as it is."""
    slashed = F.translate(path, "\\", "/")
    base = F.concat(F.rtrim(F.translate(root, "\\", "/"), F.lit("/")), F.lit("/"))
    inside = (root != "") & slashed.startswith(base)
    return F.when(inside, F.substr(slashed, F.length(base) + 1)).otherwise(slashed)
