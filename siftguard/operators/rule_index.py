"""Thousands of user rules: an index of the literals that their matches must contain.

One generated expression per rule does not scale: past some hundred patterns the code of a stage grows too large to be compiled. Here every rule gets a key of up to
``GRAM`` characters, cut from a literal that its matches contain, and a line is searched once for all keys, by one pattern that follows their tree. What a line holds is
joined with the index of rules by their key, a small table, and the pattern of each candidate rule decides.

A key that more than ``CROWD`` rules share is told apart by a second one from the same rule, so a line meets the rules of ``<div`` only where it holds their numbers as well.
A rule whose matches hold one of several literals has a key for each of these ways; a line meets it by the first one only, so no line meets a rule twice.

Keys are in lower case, and so is a line for the search; the few letters whose case folds onto ASCII count as what they fold to. Rules without a literal are
tested in groups of ``GROUP`` patterns, as few as a stage compiles well.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import reduce
from re import _constants as kinds
from re import _parser as parser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import unicode_pattern
from ..rules import Rule
from ..session import MAX_DIMENSION_ROWS, dimension
from .rulescan import _FOLDING, attach_metadata, match_rules, rule_table

#: Characters per key, bits of a table, patterns per generated expression, rules from which the index is used.
GRAM, TABLE_BITS, GROUP, MANY = 4, 16, 60, 500
#: Rules per key beyond which a second key is added, characters of a key at least where there are several ways, ways of a rule and characters of the search pattern at most.
CROWD, SHORTEST, MOST_WAYS, LONGEST_SEARCH = 8, 3, 16, 20_000
#: What the characters of ``_FOLDING`` fold to.
_FOLDED = "siik"

_REPEATS = (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT)


def _inner(op, arg):
    """The items inside an item that every match passes, else none."""
    if op is kinds.SUBPATTERN and not arg[1] and not arg[2]:
        return arg[3]
    if op in _REPEATS and arg[0] >= 1:
        return arg[2]
    return arg if op is kinds.ATOMIC_GROUP else ()


def _sequences(items, fold: bool, repeats: bool = False) -> list[str]:
    """Literal runs that every match of a parsed pattern contains, in ASCII if letters fold. With ``repeats``, a repeated literal goes on with its run."""
    out, run = [], ""
    for op, arg in items:
        if op is kinds.LITERAL and (not fold or arg < 128):
            run += chr(arg)
            continue
        if repeats and op in _REPEATS and arg[0] >= 1 and all(o is kinds.LITERAL and (not fold or a < 128) for o, a in arg[2]):
            run += "".join(chr(a) for _, a in arg[2]) * min(arg[0], GRAM)
            if arg[1] == arg[0] <= GRAM:
                continue
            out.append(run)
            run = ""
            continue
        out.append(run)
        run = ""
        out += _sequences(_inner(op, arg), fold, repeats)
    return [*out, run]


def _parsed(pattern: str):
    """The parsed pattern, or nothing if it is not understood."""
    # Patterns arrive as Java spells them.
    spelled = re.sub(r"\(\?<(?![=!])\w+>", "(", pattern).replace("\\z", "\\Z")
    try:
        parsed = parser.parse(spelled)
    except (re.error, RecursionError, OverflowError):
        return ()
    # A flag in the middle, a conditional or a reference: nothing is certain.
    return () if any(op in (kinds.GROUPREF_EXISTS,) for op, _ in parsed) else parsed


def mandatory_literal(pattern: str) -> str:
    """The longest literal, in lower case, that every matching line contains whatever its case; empty if none is certain."""
    parsed = _parsed(pattern)
    # Runs are looked up in lower case, which keeps one character one only within ASCII.
    literals = (max(re.split(r"[^\x00-\x7f]+", s), key=len) for s in _sequences(parsed, True))
    return max(literals, key=len, default="").lower()


def _alternatives(items):
    """Every list of alternatives that all matches pass."""
    for op, arg in items:
        if op is kinds.BRANCH:
            yield arg[1]
        yield from _alternatives(_inner(op, arg))


def _ways(items) -> list[list[str]]:
    own = [s.lower() for s in _sequences(items, True, True) if s]
    best = [own] if own else []
    if max(map(len, own), default=0) >= GRAM:
        return best
    worth = lambda ways: min((max(map(len, w)) for w in ways), default=0)
    for alternatives in _alternatives(items):
        each = [_ways(a) for a in alternatives]
        ways = [own + w for of_one in each for w in of_one]
        if all(each) and len(ways) <= MOST_WAYS and worth(ways) > worth(best):
            best = ways
    return best


def ways_of(pattern: str) -> list[list[str]]:
    """Lists of literals, in lower case: every matching line contains all literals of one list at least. Empty if none is certain."""
    return _ways(_parsed(pattern))


def _bit(gram: str) -> int:
    return zlib.crc32(gram.encode()) % (1 << TABLE_BITS)


def index_of(rules: list[Rule]) -> tuple[list[tuple[str, Rule]], list[Rule]]:
    """(run, rule) of every indexable rule, and the others. Of the runs of a literal the one that fewest rules use."""
    literals = {r.rule_ord: mandatory_literal(r.pattern) for r in rules}
    grams = {o: sorted({t[i:i + GRAM] for i in range(len(t) - GRAM + 1)}) for o, t in literals.items()}
    uses: dict[str, int] = {}
    for own in grams.values():
        for gram in own:
            uses[gram] = uses.get(gram, 0) + 1
    indexed = [(min(grams[r.rule_ord], key=lambda g: (uses[g], g)), r) for r in rules if grams[r.rule_ord]]
    return indexed, [r for r in rules if not grams[r.rule_ord]]


def _cut(literals: list[str]) -> set[str]:
    return {t[i:i + GRAM] for t in literals for i in range(max(1, len(t) - GRAM + 1))}


def keys_of(rules: list[Rule]) -> tuple[list[tuple[Rule, list[tuple[str, str | None]]]], list[Rule]]:
    """(rule, its ways as first and second key) of every rule that can be looked up, and the others."""
    indexed, rest = index_of(rules)
    found = [(r, [(gram, [s for way in ways_of(r.pattern)[:1] for s in way])]) for gram, r in indexed]
    others = []
    for rule in rest:
        ways = [(max(way, key=len)[:GRAM], way) for way in ways_of(rule.pattern)]
        if ways and min(len(key) for key, _ in ways) >= SHORTEST:
            found.append((rule, ways))
        else:
            others.append(rule)
    shared: dict[str, list[set[str]]] = {}
    for _, ways in found:
        for key, literals in ways:
            shared.setdefault(key, []).append(_cut(literals) - {key})
    uses = {key: Counter(c for cuts in all_cuts for c in cuts) for key, all_cuts in shared.items()}

    def second(key: str, literals: list[str]) -> str | None:
        if len(shared[key]) <= CROWD:
            return None
        return min(_cut(literals) - {key}, key=lambda c: (uses[key][c], -len(c), c), default=None)

    return [(rule, list(dict.fromkeys((key, second(key, literals)) for key, literals in ways))) for rule, ways in found], others


def _tree_pattern(keys: set[str]) -> str:
    """A pattern for the longest of the keys that starts at a place. The classes of a level share no character, so nothing is tried twice."""
    below: dict[str, set[str]] = {}
    for key in keys - {""}:
        below.setdefault(key[0], set()).add(key[1:])
    if not below:
        return ""
    alike: dict[str, list[str]] = {}
    for first, tails in sorted(below.items()):
        alike.setdefault(_tree_pattern(tails), []).append(first)
    parts = [_one_of(firsts) + tail for tail, firsts in alike.items()]
    return f"(?:{'|'.join(parts)})" + ("?" if "" in keys else "")


def _one_of(characters) -> str:
    return "[" + "".join(f"\\x{ord(c):02x}" for c in characters) + "]"


def search_pattern(keys: set[str]) -> str:
    """Finds, at every place where a key starts, text that begins with all keys which start there."""
    for depth in range(GRAM, 0, -1):
        tree = _tree_pattern({k[:depth] for k in keys})
        if len(tree) <= LONGEST_SEARCH:
            break
    tail = "" if depth == GRAM else ".{0,%d}" % (GRAM - 1)
    return f"(?s)(?={_one_of(sorted({k[0] for k in keys}))})(?=({tree}{tail}))"


def _within(values: set[str]):
    """Test by a bit table; a few strings pass that are not among the values."""
    table = bytearray(1 << TABLE_BITS)
    for value in values:
        table[_bit(value)] = 1
    place = lambda g: F.pmod(F.crc32(g.cast("binary")), F.lit(1 << TABLE_BITS)).cast("int")
    return lambda g: F.substring(F.lit(bytes(table)), place(g) + 1, 1) == F.lit(b"\x01")


def _joined(first: str, second: str | None) -> str:
    return first if second is None else f"{first}\0{second}"


def match_indexed(lines: DataFrame, keyed: list[tuple[Rule, list[tuple[str, str | None]]]]) -> DataFrame:
    """(line columns, rule_ord) of the rules with keys that match."""
    shape = "key string, earlier array<string>, rule_ord bigint, exts array<string>, kind_gate string, pattern string, not_pattern string"
    rows, alone, firsts, seconds, pairs = [], set(), set(), set(), set()
    for r, ways in keyed:
        for n, (first, second) in enumerate(ways):
            rows.append({"key": _joined(first, second), "earlier": [_joined(*w) for w in ways[:n]], "rule_ord": r.rule_ord, "exts": list(r.exts), "kind_gate": r.kind,
                         "pattern": unicode_pattern(r.pattern), "not_pattern": unicode_pattern(r.not_pattern) if r.not_pattern else None})
            if second is None:
                alone.add(first)
            else:
                firsts.add(first)
                seconds.add(second)
                pairs.add(_joined(first, second))
    if not rows:
        return lines.select("*", F.lit(None).cast("bigint").alias("rule_ord")).filter(F.lit(False))
    index = dimension(lines.sparkSession, rows, StructType.fromDDL(shape))
    # As many rows as rules have ways: small whatever is scanned, while without it all lines would be shuffled by their keys.
    index = F.broadcast(index) if len(rows) <= MAX_DIMENSION_ROWS else index
    keys = alone | firsts | seconds
    odd = reduce(lambda a, b: a | b, [F.contains("text", F.lit(c)) for c in _FOLDING])
    lowered = F.lower(F.when(odd, F.translate("text", _FOLDING, _FOLDED)).otherwise(F.col("text")))
    held = F.array_distinct(F.regexp_extract_all(lowered, F.lit(search_pattern(keys)), F.lit(1)))
    starts = sorted({len(k) for k in keys})
    held = F.array_distinct(F.flatten(F.transform(held, lambda t: F.array(*[F.substring(t, 1, n) for n in starts]))))
    asked = F.filter("_held", _within(alone))
    if pairs:
        by_second = F.filter("_held", _within(seconds))
        both = F.flatten(F.transform(F.filter("_held", _within(firsts)), lambda a: F.transform(by_second, lambda b: F.concat(a, F.lit("\0"), b))))
        asked = F.concat(asked, F.filter(both, _within(pairs)))
    # The outer form keeps the optimizer from searching every line twice, once to see whether anything is found; the join drops the nulls.
    cut = lines.select("*", held.alias("_held")).select(*lines.columns, asked.alias("_asked")).select("*", F.explode_outer("_asked").alias("key"))
    gates = ((F.size("exts") == 0) | F.exists("exts", lambda e: F.endswith(F.col("path"), e))) & (F.col("kind_gate").isNull() | (F.col("kind_gate") == F.col("kind")))
    first_way = (F.size("earlier") == 0) | ~F.arrays_overlap("earlier", "_asked")
    found = cut.join(index, "key").filter(gates & first_way & F.expr("text RLIKE pattern") & F.expr("not_pattern IS NULL OR NOT text RLIKE not_pattern"))
    return found.select(*lines.columns, "rule_ord")


def match_many(lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """What ``match_rules`` gives, for rule sets of any size."""
    keyed, others = keys_of(rules)
    parts = [match_indexed(lines, keyed)] + [match_rules(lines, others[k:k + GROUP]) for k in range(0, len(others), GROUP)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def scan_many(lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """Raw findings of a rule set of any size, with the columns of ``scan_lines``."""
    from ..schemas import RAW_COLUMNS
    return attach_metadata(match_many(lines, rules), rule_table(lines.sparkSession, rules)).select(*RAW_COLUMNS)
