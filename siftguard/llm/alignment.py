"""Cross-tokenizer alignment: groups of tokens between common ends, and links between tokens that share bytes.

Vocabulary A is byte-level, B holds pieces with a blank in front; both read the same bytes, a space and the text. The
ends of the tokens, counted in bytes from the start, go into one dictionary per side (end to index). The
keys that both dictionaries hold are where the two tokenizations agree; sorted, they slice both id lists into groups, and the
links of a group are expanded within its slice: where one side has a single token it meets all of the other side's, otherwise two
pointers walk over the overlapping ranges.

*Units.* Before a single space between two printing characters both tokenizations end a token, and neither looks across. So texts are cut there,
every distinct unit is tokenized and aligned once, and texts are put together from their units in whole arrays. A task keeps its units until
they hold ``MOST_IDS`` ids; then it begins anew. Texts without such a space are a unit.

*Counts.* The count of an id pair is the number of documents that hold it linked. A document lists each pair once, with its
occurrences, so counting is one aggregation that combines before its exchange. For the way back, a histogram of the counts finds the
level above which at most ``HOT_PAIRS`` pairs lie. Those are broadcast (so no frequent pair is ever shuffled), and only the occurrences
of rarer pairs are joined by shuffle. A document's rows meet again as sums per row.

Defined cases: texts that are null or empty, and those whose tokens do not give back the space and the text byte by byte, have no groups and no links;
repeated rows and rows that share an id, or have none, are documents of their own;
extra columns are not read and do not come back; an empty table gives an empty result.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftguard.llm.common import pieces, saved, ship, table
from siftguard.llm.vocabularies import (
    BESIDE_CUT,
    BLANK,
    broadcast_file,
    entry_bytes,
    is_plain_byte_level,
    json_tokenizer,
    neighbours,
    piece_bytes,
    piece_model,
    public_vocabulary,
    word_units,
)

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs that may be broadcast (a key and three numbers each, some 20 MB).
HOT_PAIRS = 400_000
#: Text bytes that are put together at a time, and ids of the units that a task keeps (some 100 bytes each).
PIECE_BYTES, MOST_IDS = 1 << 19, 1_500_000
#: Units that are encoded in a row, where their ends allow it.
ROW_UNITS = 64
#: Steps of the histogram of counts per doubling.
STEPS = 8

GROUPS = "array<struct<a: array<int>, b: array<int>>>"
LINKS = "array<struct<a: int, b: int, n: int>>"
SCHEMA = f"doc_id long, n_a long, n_b long, n_groups long, n_links long, groups {{}}, links {LINKS}"


def common_cuts(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], list[int]]:
    """Numbers of A and of B tokens up to each common end, in order."""
    at_a = {end: k for k, end in enumerate(a_ends, 1)}
    at_b = {end: k for k, end in enumerate(b_ends, 1)}
    common = sorted(at_a.keys() & at_b.keys())
    return [at_a[end] for end in common], [at_b[end] for end in common]


def links_within(a_cuts: np.ndarray, b_cuts: np.ndarray, a_ends: list[int], b_ends: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, A token and B token of every overlapping pair, in the order of groups."""
    a_start, b_start = (np.concatenate([[0], cuts[:-1]]).astype(np.int64)[:len(cuts)] for cuts in (a_cuts, b_cuts))
    n_a, n_b = a_cuts - a_start, b_cuts - b_start
    simple = (n_a == 1) | (n_b == 1)
    # One side's only token covers the whole group and meets all of the other side's.
    sizes = np.where(simple, n_a * n_b, 0)
    group = np.repeat(np.arange(len(sizes)), sizes)
    nth = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    many_a = n_b[group] == 1
    out = [(group, a_start[group] + np.where(many_a, nth, 0), b_start[group] + np.where(many_a, 0, nth))]
    walked = []
    for g in np.flatnonzero(~simple).tolist():
        i, j = int(a_start[g]), int(b_start[g])
        while i < a_cuts[g] and j < b_cuts[g]:
            walked.append((g, i, j))
            # The token that ends first is done; both end together at the last pair only.
            if a_ends[i] <= b_ends[j]:
                i += 1
            else:
                j += 1
    if walked:
        out.append(tuple(np.array(walked, np.int64).T))
    group, i, j = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(group, kind="stable")
    return group[order], i[order], j[order]


class Units:
    """Aligned units of text: ids, cuts and links of each, in flat arrays with bounds. Numbers count up as units are added."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.a_ids, self.b_ids, self.a_cuts, self.b_cuts = (array("i") for _ in range(4))
        self.links, self.lost = array("q"), array("b")
        self.token_a, self.token_b, self.cut, self.link = (array("q", [0]) for _ in range(4))
        self.listing: list[str] = []

    def _append(self, bounds: array, sizes: np.ndarray, *stores: tuple[array, np.ndarray]) -> None:
        bounds.frombytes((bounds[-1] + np.cumsum(sizes)).astype(np.int64).tobytes())
        for store, values in stores:
            store.frombytes(values.astype(np.int64 if store.typecode == "q" else np.int32).tobytes())

    def add(self, lost: list[bool], sizes: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray, a_length: np.ndarray, b_length: np.ndarray) -> None:
        """Append the units that were numbered last, of ``sizes`` bytes each (0: lost), given the ids of all of them in a row.

        They lie one after the other on one axis of bytes; both sides end a token where a unit ends.
        """
        a_ends, b_ends = np.cumsum(a_length[a_ids]), np.cumsum(b_length[b_ids])
        stops = np.cumsum(sizes)
        n_a, n_b = (np.diff(np.searchsorted(ends, stops, "right"), prepend=0) for ends in (a_ends, b_ends))
        a_ends, b_ends = a_ends.tolist(), b_ends.tolist()
        a_cuts, b_cuts = (np.array(cuts, np.int64) for cuts in common_cuts(a_ends, b_ends))
        group, i, j = links_within(a_cuts, b_cuts, a_ends, b_ends)
        unit = np.searchsorted(np.cumsum(n_a), a_cuts)  # the unit that each group lies in
        n_cuts, n_links = np.bincount(unit, minlength=len(sizes)), np.bincount(unit[group], minlength=len(sizes))
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        self.lost.extend(lost)
        self._append(self.token_a, n_a, (self.a_ids, a_ids))
        self._append(self.token_b, n_b, (self.b_ids, b_ids))
        self._append(self.cut, n_cuts, (self.a_cuts, a_cuts - first_a[unit]), (self.b_cuts, b_cuts - first_b[unit]))
        self._append(self.link, n_links, (self.links, a_ids[i] << 32 | b_ids[j]))
        self._list(n_cuts, a_ids, b_ids, a_cuts, b_cuts)

    def _list(self, n_cuts: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray) -> None:
        """The groups of every new unit as text."""
        a, b = list(map(str, a_ids.tolist())), list(map(str, b_ids.tolist()))
        groups, i, j = [], 0, 0
        for stop_a, stop_b in zip(a_cuts.tolist(), b_cuts.tolist(), strict=True):
            groups.append(f"{a[i]}|{b[j]}" if stop_a - i == stop_b - j == 1 else f"{','.join(a[i:stop_a])}|{','.join(b[j:stop_b])}")
            i, j = stop_a, stop_b
        stops = np.cumsum(n_cuts).tolist()
        self.listing += [";".join(groups[x:y]) for x, y in zip([0, *stops], stops)]


class Aligner:
    """Both tokenizers, the bytes of their ids, and the units aligned so far."""

    def __init__(self, byte_level: bytes, piece: bytes, most_ids: int = MOST_IDS) -> None:
        self.a, self.b, self.most_ids, self.units = json_tokenizer(byte_level), piece_model(piece), most_ids, Units()
        if not is_plain_byte_level(self.a):
            raise ValueError("the first vocabulary must be byte-level and leave texts as they are")
        if any(pair[0] != BLANK and pair[1] == BLANK for pair in neighbours(self.b)):
            raise ValueError("a piece of the second vocabulary goes on after a space, so texts cannot be cut there")
        self.a.encode_special_tokens = True
        self.a_bytes, self.b_bytes = entry_bytes(self.a), piece_bytes(self.b)
        self.a_length, self.b_length = (np.array(list(map(len, table)), np.int64) for table in (self.a_bytes, self.b_bytes))

    def _joined(self, units: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of units that may stand next to each other, encoded in rows of ``ROW_UNITS``; None if any bytes were lost."""
        rows = [" ".join(units[k:k + ROW_UNITS]) for k in range(0, len(units), ROW_UNITS)]
        a = list(chain.from_iterable(x.ids for x in self.a.encode_batch_fast([" " + r for r in rows], add_special_tokens=False)))
        b = list(chain.from_iterable(self.b.encode(rows, num_threads=1)))
        raw = b"".join(b" " + r.encode() for r in rows)
        whole = all(b"".join([table[i] for i in ids]) == raw for table, ids in ((self.a_bytes, a), (self.b_bytes, b)))
        return (np.array(a, np.int64), np.array(b, np.int64)) if whole else None

    def _single(self, units: list[str]) -> tuple[list[bool], np.ndarray, np.ndarray]:
        """Which units lose bytes, and the ids of the others, each encoded by itself."""
        a = [x.ids for x in self.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False)] if units else []
        b = self.b.encode(units, num_threads=1) if units else []
        lost = [any(b"".join([table[i] for i in ids]) != b" " + u.encode() for table, ids in ((self.a_bytes, x), (self.b_bytes, y)))
                for u, x, y in zip(units, a, b, strict=True)]
        return lost, *(np.array([i for own, gone in zip(ids, lost, strict=True) if not gone for i in own], np.int64) for ids in (a, b))

    def _add(self, known: int) -> np.ndarray:
        """Align the units from number ``known`` on; returns their numbers in the order they had."""
        fresh = list(islice(self.units.number, known, None))
        beside = np.array([u[0] in BESIDE_CUT and u[-1] in BESIDE_CUT for u in fresh])
        order = np.argsort(~beside, kind="stable")
        units = [fresh[k] for k in order.tolist()]
        n = int(beside.sum())
        joined = self._joined(units[:n])
        if joined is None:
            n, joined = 0, (np.zeros(0, np.int64),) * 2
        lost, *rest = self._single(units[n:])
        lost = [False] * n + lost
        sizes = np.array([0 if gone else len(u.encode()) + 1 for u, gone in zip(units, lost, strict=True)], np.int64)
        self.units.add(lost, sizes, *(np.concatenate(x) for x in zip(joined, rest, strict=True)), self.a_length, self.b_length)
        self.units.number.update(zip(units, range(known, known + len(units)), strict=True))
        place = np.empty(len(order), np.int64)
        place[order] = known + np.arange(len(order))
        return place

    def align(self, texts: list[str]) -> Alignment:
        """All texts at once; one whose bytes were lost, and an empty one, has no tokens."""
        if len(self.units.a_ids) > self.most_ids:
            self.units = Units()
        number, sizes, found = self.units.number, [], []
        known = len(number)
        for text in texts:
            own = word_units(text) if text else []
            sizes.append(len(own))
            found += [number.setdefault(unit, len(number)) for unit in own]
        unit = np.array(found, np.int64)
        if len(number) > known:
            place, new = self._add(known), unit >= known
            unit[new] = place[unit[new] - known]
        return Alignment(self.units, np.array(sizes, np.int64), unit)


def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


class Alignment:
    """Tokens, groups and links of several texts in flat arrays, in order, put together from their units."""

    def __init__(self, units: Units, sizes: np.ndarray, unit: np.ndarray) -> None:
        row = np.repeat(np.arange(len(sizes)), sizes)
        lost = np.bincount(row, np.frombuffer(units.lost, np.int8)[unit] if len(unit) else None, len(sizes)) > 0
        row, unit = row[~lost[row]], unit[~lost[row]]

        def gathered(bounds: array, *stores: array) -> tuple[np.ndarray, ...]:
            """What the units hold, how much each, and where it begins."""
            at = np.frombuffer(bounds, np.int64)
            n = at[unit + 1] - at[unit]
            begins = np.cumsum(n) - n
            index = np.arange(n.sum()) + np.repeat(at[unit] - begins, n)
            return n, begins, *(np.frombuffer(s, np.int64 if s.typecode == "q" else np.int32)[index] if len(s) else np.zeros(0, np.int32) for s in stores)

        n_a, begins_a, self.a_ids = gathered(units.token_a, units.a_ids)
        n_b, begins_b, self.b_ids = gathered(units.token_b, units.b_ids)
        n_cuts, _, a_cuts, b_cuts = gathered(units.cut, units.a_cuts, units.b_cuts)
        n_links, _, self.link = gathered(units.link, units.links)
        self.a_cuts, self.b_cuts = a_cuts + np.repeat(begins_a, n_cuts), b_cuts + np.repeat(begins_b, n_cuts)
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.bincount(row, n, len(sizes)).astype(np.int64) for n in (n_a, n_b, n_cuts, n_links))
        self.link_row = np.repeat(row, n_links)
        self._unit, self._unit_bounds, self._listing = unit, _bounds(np.bincount(row, minlength=len(sizes))), units.listing

    def listing(self) -> list[str]:
        """The groups of each text as ``a1,a2|b1;a3|b2,b3``."""
        bounds, unit = self._unit_bounds.tolist(), self._unit.tolist()
        return [";".join([self._listing[k] for k in unit[x:y]]) for x, y in zip(bounds, bounds[1:])]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, pair code and occurrences of the distinct id pairs of each row."""
        order = np.lexsort((self.link, self.link_row))
        code, row = self.link[order], self.link_row[order]
        first = np.ones(len(code), bool)
        first[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(first)
        return row[at], code[at], np.diff(np.append(at, len(code)))


def _lists(bounds: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)


def _as_batch(ids: pa.Array, found: Alignment, as_text: bool) -> pa.RecordBatch:
    """An alignment as the columns of ``SCHEMA``."""
    number = lambda x: pa.array(x.astype(np.int32))
    if as_text:
        groups = pa.array(found.listing(), pa.string())
    else:
        sides = [_lists(np.concatenate([[0], cuts]), number(tokens)) for tokens, cuts in ((found.a_ids, found.a_cuts), (found.b_ids, found.b_cuts))]
        groups = _lists(_bounds(found.n_groups), pa.StructArray.from_arrays(sides, ["a", "b"]))
    row, code, times = found.pairs()
    linked = pa.StructArray.from_arrays([number(x) for x in (code >> 32, code & 0xFFFFFFFF, times)], ["a", "b", "n"])
    sizes = [pa.array(x) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)]
    return pa.RecordBatch.from_arrays(
        [ids, *sizes, groups, _lists(_bounds(np.bincount(row, minlength=len(ids))), linked)],
        ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])


def aligned(docs: DataFrame, byte_level: str, piece: str, most_ids: int = MOST_IDS, as_text: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, numbers of tokens, groups and links, the groups, and the linked id pairs with their occurrences.

    Groups are arrays of A and B ids, or with ``as_text`` a listing ``a1,a2|b1;a3|b2,b3``, which is cheaper to hand on.
    """
    spark = docs.sparkSession
    ship(spark)
    files = broadcast_file(spark, byte_level), broadcast_file(spark, piece)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(files[0].value, files[1].value, most_ids)
        for batch, data, offsets in pieces(batches, most=PIECE_BYTES):
            texts = [data[offsets[r]:offsets[r + 1]].tobytes().decode() for r in range(len(batch))]
            yield _as_batch(batch.column("doc_id"), aligner.align(texts), as_text)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA.format("string" if as_text else GROUPS))


def group_listing(groups: Column) -> Column:
    """Groups given as arrays, as text."""
    ids = lambda x: F.array_join(x.cast("array<string>"), ",")
    return F.array_join(F.transform(groups, lambda g: F.concat(ids(g["a"]), F.lit("|"), ids(g["b"]))), ";")


def pair_counts(alignments: DataFrame) -> DataFrame:
    """Id pairs with the number of documents that hold them linked, and whether that is the highest of their A id."""
    counts = saved(alignments.select(F.inline("links")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_docs")), "pair-counts")
    # One row per id of the vocabulary at most.
    highest = F.broadcast(counts.groupBy("a").agg(F.max("n_docs").alias("highest")))
    return counts.join(highest, "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("highest")).alias("best"))


def _hot_step(counts: DataFrame, most: int) -> tuple[int, bool]:
    """Lowest step of the histogram above which at most ``most`` pairs lie, and whether any lie below. Some hundred rows reach the driver."""
    steps = sorted(counts.groupBy(_step().alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    taken, lowest = 0, 1 << 20
    for row in steps:
        taken += row.n
        if taken > most:
            return lowest, True
        lowest = row.step
    return lowest, False


def _step() -> Column:
    return F.floor(STEPS * F.log2("n_docs")).cast("int")


def link_scores(alignments: DataFrame, counts: DataFrame, row: str, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Per value of ``row``: occurrences of links that are best for their A id, and the sum of the counts of all links."""
    key = (F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("pair")
    counts = saved(counts.select(key, "n_docs", "best"), "pairs")
    lowest, more = _hot_step(counts, hot_pairs)
    hot = F.broadcast(counts.where(_step() >= lowest))
    links = alignments.select(row, F.inline("links")).select(row, key, "n")
    sums = [F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("n_docs")).alias("count_sum")]
    out = links.join(hot, "pair").groupBy(row).agg(*sums)
    if more:
        rest = links.join(hot.select("pair"), "pair", "left_anti").join(counts.where(_step() < lowest), "pair")
        out = out.union(rest.groupBy(row).agg(*sums)).groupBy(row).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out


def op13_cross_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    found = aligned(table(spark, sf_dir, "documents"), public_vocabulary(BYTE_LEVEL), public_vocabulary(PIECES), as_text=True)
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    sizes = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    # Texts are encoded once; the groups are digested before the table is written.
    stage = saved(found.select(F.monotonically_increasing_id().alias("row"), *sizes, "links", digest.alias("groups_sha256")), "alignments")
    scores = link_scores(stage, pair_counts(stage), "row")
    return stage.join(scores, "row", "left").select(
        *sizes, F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
