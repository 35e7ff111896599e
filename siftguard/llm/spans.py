"""Regex matches with positions, as expressions: what SQL's own functions leave out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: start and end count code points, end exclusive.
SPAN = "array<struct<kind:string,start:int,end:int,found:string>>"


#: Elements that a running result is built of at a time: arrays never grow beyond a block, or beyond the number of blocks.
BLOCK = 256
#: Characters per part of a text that is cut at many places.
PART = 512


def no_spans() -> Column:
    return F.array().cast(SPAN)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed a single time: named inside a lambda, it would be computed anew for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, kind: str, merge: Callable[[Column, Column], Column]) -> Column:
    """The running result of an associative merge, one per element.

    An array that grows by one element is copied every time. So results run within blocks, then over the last ones of the blocks, and
    then those are merged into the next block: a few hundred copies per element, however many there are.
    """
    none = F.array().cast(f"array<{kind}>")

    def grown(block: Column) -> Column:
        return F.aggregate(block, none, lambda done, x: F.concat(done, F.array(
            F.when(F.size(done) > 0, merge(F.element_at(done, -1), x)).otherwise(x))))

    def joined(blocks: Column) -> Column:
        ends = grown(F.transform(blocks, lambda block: F.element_at(block, -1)))
        before = F.concat(F.array(F.lit(None).cast(kind)), F.slice(ends, F.lit(1), F.size(blocks) - 1))
        return F.flatten(F.zip_with(blocks, before, lambda block, b: F.when(b.isNull(), block).otherwise(F.transform(block, lambda x: merge(b, x)))))

    def over(values: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))
        several = once(F.transform(starts, lambda k: grown(F.slice(values, k * BLOCK + 1, F.lit(BLOCK)))), joined)
        return F.when(F.size(values) <= 0, none).when(F.size(values) <= BLOCK, grown(values)).otherwise(several)

    return once(values, over)


def _add(a: Column, b: Column) -> Column:
    return a + b


def matches(text: Column, pattern: Column) -> Column:
    """Matches ``m``, the text before each (``gap``, back to the match before), and all of the text between matches."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    return once(F.struct(found.alias("m"), F.split(text, pattern).alias("gaps")), lambda x: F.struct(
        x.m.alias("m"), F.slice(x.gaps, F.lit(1), F.size(x.m)).alias("gap"), F.slice(x.gaps, F.lit(2), F.size(x.m)).alias("next")))


def located(text: Column, pattern: Column, kind: Column) -> Column:
    """Leftmost non-overlapping matches with their places.

    Splitting at the pattern gives the text between the matches, so lengths add up to places.
    """
    def places(x: Column) -> Column:
        ends = running(F.zip_with(x.gap, x.m, lambda gap, m: F.length(gap) + F.length(m)), "int", _add)
        return F.zip_with(x.m, ends, lambda m, end: F.struct(
            kind.alias("kind"), (end - F.length(m)).alias("start"), end.alias("end"), m.alias("found")))

    return once(matches(text, pattern), places)


def in_context(text: Column, pattern: str, kind: str, gate: str, width: int = 40) -> Column:
    """``located`` with the text around: up to ``width`` characters before each match, one after.

    Context ends at the neighbouring match. Everything stays linear in the text.
    """
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,found:string,before:string,after:string>>")

    def places(x: Column) -> Column:
        ends = running(F.zip_with(x.gap, x.m, lambda gap, m: F.length(gap) + F.length(m)), "int", _add)
        around = F.zip_with(x.gap, x.next, lambda gap, after: F.struct(F.right(gap, F.lit(width)).alias("before"), F.left(after, F.lit(1)).alias("after")))
        placed = F.zip_with(x.m, ends, lambda m, end: F.struct(m.alias("m"), end.alias("end")))
        return F.zip_with(placed, around, lambda p, c: F.struct(
            F.lit(kind).alias("kind"), (p.end - F.length(p.m)).alias("start"), p.end.alias("end"), p.m.alias("found"),
            c.before.alias("before"), c.after.alias("after")))

    return F.when(text.rlike(gate), once(matches(text, F.lit(pattern)), places)).otherwise(empty)


def _swept(base: Column, spans: Column, turn: int, at: Callable[[Column], Column], keep: Callable[[Column, Column], Column]) -> Column:
    """Spans that ``keep`` accepts, given the farthest end of the base spans that begin before them, in one sorted pass."""
    plain = lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"), s.found.alias("found"))
    nothing = F.lit(None).cast(SPAN[len("array<"):-1])
    events = F.array_sort(F.concat(
        F.transform(base, lambda b: F.struct(b.start.alias("at"), F.lit(1 - turn).alias("turn"), b.end.alias("reach"), nothing.alias("span"))),
        F.transform(spans, lambda s: F.struct(at(s).alias("at"), F.lit(turn).alias("turn"), F.lit(-1).alias("reach"), plain(s).alias("span")))))

    def chosen(events: Column) -> Column:
        reach = running(F.transform(events, lambda e: e.reach), "int", lambda a, b: F.greatest(a, b))
        kept = F.zip_with(events, reach, lambda e, far: F.when(e.span.isNotNull() & keep(e.span, far), e.span))
        return F.array_compact(kept)

    return F.when((F.size(spans) > 0) & (F.size(base) > 0), once(events, chosen)).otherwise(F.transform(spans, plain))


def not_within(spans: Column, base: Column) -> Column:
    """Spans that lie inside no base span."""
    return _swept(base, spans, 1, lambda s: s.start, lambda s, far: far < s.end)


def clear_of(spans: Column, base: Column) -> Column:
    """Spans that share no character with a base span."""
    return _swept(base, spans, 0, lambda s: s.end, lambda s, far: far <= s.start)


def found(text: Column, pattern: str, kind: str, gate: str | None = None) -> Column:
    """``located`` for a fixed pattern; texts that fail the cheap ``gate`` are not split."""
    return F.when(text.rlike(gate or pattern), located(text, F.lit(pattern), F.lit(kind))).otherwise(no_spans())


def listing(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def by_start(spans: Column, kinds: list[str]) -> Column:
    """Sorted by start, then by the order of ``kinds``."""
    rank = F.array(*map(F.lit, kinds))
    keyed = F.transform(spans, lambda s: F.struct(s.start.alias("start"), F.array_position(rank, s.kind).alias("rank"), s.alias("span")))
    return F.transform(F.array_sort(keyed), lambda s: s.span)


def by_kind(spans: Column, kinds: list[str]) -> Column:
    """Sorted by the order of ``kinds``, then by start."""
    rank = F.array(*map(F.lit, kinds))
    keyed = F.transform(spans, lambda s: F.struct(F.array_position(rank, s.kind).alias("rank"), s.start.alias("start"), s.alias("span")))
    return F.transform(F.array_sort(keyed), lambda s: s.span)


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")


def _cut(parts: Column, start: Column, end: Column) -> Column:
    """Characters [start, end) of a text given as parts of ``PART`` characters; reading from the text itself would begin at its first byte each time."""
    first, last = (F.floor(x / PART).cast("int") for x in (start, end - 1))
    inside = F.substr(F.get(parts, first), start - first * PART + 1, end - start)
    across = F.concat(F.substr(F.get(parts, first), start - first * PART + 1), F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
                      F.substr(F.get(parts, last), F.lit(1), end - last * PART))
    return F.when(end <= start, F.lit("")).when(first == last, inside).otherwise(across)


def blanked(text: Column, spans: Column, mark: str) -> Column:
    """The text with every span replaced by ``mark``; overlapping spans are replaced once."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"))))
    parts = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PART), F.lit(0))

    def replaced(x: Column) -> Column:
        reach = running(F.transform(x.spans, lambda s: s.end), "int", lambda a, b: F.greatest(a, b))

        def joined(reach: Column) -> Column:
            before = F.concat(F.array(F.lit(0)), F.slice(reach, F.lit(1), F.greatest(F.size(reach) - 1, F.lit(0))))
            pieces = F.zip_with(x.spans, before, lambda s, b: F.when(s.start >= b, F.concat(_cut(x.parts, b, s.start), F.lit(mark))).otherwise(""))
            return F.concat(F.array_join(pieces, ""), _cut(x.parts, F.element_at(reach, -1), x.n))

        return once(reach, joined)

    made = once(F.struct(ordered.alias("spans"), parts.alias("parts"), F.length(text).alias("n")), replaced)
    return F.when(F.size(spans) > 0, made).otherwise(text)
