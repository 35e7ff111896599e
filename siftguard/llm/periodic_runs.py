"""Periodic run detection with a suffix automaton and link-cut access.

*Automaton.* The words of a text are appended one by one to a suffix automaton. The suffix links form a tree in which the
ancestors of a prefix's state stand for the suffixes of that prefix.

*Access.* A link-cut forest over the links keeps, on each of its paths, the end of the latest occurrence. Accessing
the state of the prefix that ends at i recolours the path to the root with i and meets the segments of older colours on the way. A
segment of colour j whose deepest state has length L says: the longest suffix that ends both at j and at i
has L words. With d = i - j, the words d apart agree over L words, so if d <= L a square of period d ends at i, and the
stretch from i - d - L to i has period d and cannot be extended to the left.

*Runs.* Squares with the same start and period whose ends follow each other are one stretch; its last end is where the run ends.
d is the smallest period of what is reported: a smaller one would have given that suffix a later occurrence than j. And a run of at
least four periods is reported at its end, because there the suffixes of two to three periods have their latest
occurrence one period before. So runs of ``LEAST_PERIODS`` periods are found whole, without comparing words.

*Candidates.* A run of six words and four periods holds every five words of it twice, so stretches of words without a
repeated five-word hash cannot belong to one and are left out beforehand, exactly. Ordinary text never reaches the automaton.

States and paths live in flat integer arrays (about 100 bytes per candidate word).

Defined cases: null, empty and blank texts have no words and no runs; ties for the strongest run go to the smallest start, then the smallest
period; repeated rows repeat; extra columns are not read and do not come back; an empty table gives an empty
result. For the planted copies of ``op11`` an absent doc_id counts as empty text.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftguard.llm.common import pieces, ship, table
from siftguard.llm.words import SPACED, Runs, mix, tokenize

#: A run has at least this many words and this many periods. The proof above needs four periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words of the hashes that pick candidates; a run holds each of these twice.
GRAM = 5

RUNS = "array<struct<start: long, length: long, period: long>>"


class SuffixAutomaton:
    """States with their lengths and links, and the state of every prefix."""

    def __init__(self, words: list[int]) -> None:
        self.length, self.link, self.prefix = array("i", [0]), array("i", [-1]), array("i")
        # Most states have one way out, kept in two arrays; the others are in dictionaries.
        self._word, self._next, self._more = array("i", [-1]), array("i", [-1]), {}
        last = 0
        for word in words:
            last = self._append(last, word)
            self.prefix.append(last)

    def _state(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self._word.append(-1)
        self._next.append(-1)
        return len(self.length) - 1

    def _go(self, state: int, word: int) -> int:
        if self._word[state] == word:
            return self._next[state]
        more = self._more.get(state)
        return more.get(word, -1) if more else -1

    def _set(self, state: int, word: int, to: int) -> None:
        if self._word[state] in (-1, word):
            self._word[state], self._next[state] = word, to
        else:
            self._more.setdefault(state, {})[word] = to

    def _append(self, last: int, word: int) -> int:
        length, link = self.length, self.link
        new = self._state(length[last] + 1, 0)
        at = last
        while at != -1 and (old := self._go(at, word)) == -1:
            self._set(at, word, new)
            at = link[at]
        if at == -1:
            return new
        if length[at] + 1 == length[old]:
            link[new] = old
            return new
        copy = self._state(length[at] + 1, link[old])
        self._word[copy], self._next[copy] = self._word[old], self._next[old]
        if old in self._more:
            self._more[copy] = dict(self._more[old])
        while at != -1 and self._go(at, word) == old:
            self._set(at, word, copy)
            at = link[at]
        link[old] = link[new] = copy
        return new


class LatestEnds:
    """Link-cut forest over the links. Each path is a splay tree by depth; its root holds the path's colour."""

    def __init__(self, link: array) -> None:
        self.up = array("i", link)
        self.left, self.right, self.colour = (array("i", [fill]) * len(link) for fill in (-1, -1, 0))

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            inner = left[p] = right[x]
            right[x] = p
        else:
            inner = right[p] = left[x]
            left[x] = p
        if inner != -1:
            up[inner] = p
        if g != -1:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
        up[p], up[x] = x, g

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        root, p = x, up[x]
        while p != -1 and (left[p] == root or right[p] == root):
            root, p = p, up[p]
        if root == x:
            return
        colour = self.colour[root]
        while root != x:
            p = up[x]
            if p == root:
                self._rotate(x)
                break
            g = up[p]
            done = g == root
            self._rotate(p if (left[g] == p) == (left[p] == x) else x)
            self._rotate(x)
            if done:
                break
        self.colour[x] = colour

    def access(self, state: int, end: int) -> Iterator[tuple[int, int]]:
        """Colours met on the way to the root, each with the deepest state that has it; then all of the way gets ``end``."""
        up, right, colour = self.up, self.right, self.colour
        below, x = -1, state
        while x != -1:
            self._splay(x)
            if colour[x]:
                yield colour[x], x
            if right[x] != -1:
                colour[right[x]] = colour[x]
            right[x] = below
            below, x = x, up[x]
        colour[below] = end


def periodic_stretches(words: list[int], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in a list of word numbers, by start, then period."""
    automaton = SuffixAutomaton(words)
    length, latest, ends = automaton.length, LatestEnds(automaton.link), {}
    for end, state in enumerate(automaton.prefix, 1):
        for before, deepest in latest.access(state, end):
            period = end - before
            if period <= length[deepest]:
                ends[end - period - length[deepest], period] = end
    return sorted((start, end - start, period) for (start, period), end in ends.items()
                  if end - start >= max(least_words, least_periods * period))


def candidate_stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words per text, and the stretches (text, first word, past the last) whose five-word hashes all repeat within their text."""
    words = tokenize(data, offsets, SPACED)
    grams = Runs(words.hashes).all_of(GRAM)
    at = np.flatnonzero(np.arange(len(grams)) + GRAM <= words.text_end()[:len(grams)])
    text = np.searchsorted(words.bounds, at, "right") - 1
    _, which, times = np.unique(mix(grams[at] ^ mix(text.astype(np.uint64))), return_inverse=True, return_counts=True)
    keep = times[which] > 1
    at, text = at[keep], text[keep]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1])
    first = np.flatnonzero(fresh)
    last = np.concatenate([first[1:], [len(at)]])[:len(first)] - 1
    base = words.bounds[text[first]]
    return words.counts, text[first], at[first] - base, at[last] + GRAM - base


def _runs_of(words: list[bytes], stretches: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    out = []
    for first, stop in stretches:
        numbers: dict[bytes, int] = {}
        coded = [numbers.setdefault(w, len(numbers)) for w in words[first:stop]]
        out += [(first + start, size, period) for start, size, period in periodic_stretches(coded)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period."""
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, size, period in runs:
            gone[start + period] += 1
            gone[start + size] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
    return b" ".join(words)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, number of words, runs (by start, then period), and the text with every run cut to one period, words joined by one space."""
    ship(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(batches):
            counts, text, first, stop = candidate_stretches(data, offsets)
            stretches: dict[int, list] = {}
            for row, a, b in zip(text.tolist(), first.tolist(), stop.tolist(), strict=True):
                stretches.setdefault(row, []).append((a, b))
            runs, short = [], []
            for row in range(len(batch)):
                words = data[offsets[row]:offsets[row + 1]].tobytes().split()  # at the same six bytes as SPACED
                runs.append(_runs_of(words, stretches.get(row, [])))
                short.append(_collapsed(words, runs[-1]))
            flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
            listed = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
            bounds = np.concatenate([[0], np.cumsum([len(own) for own in runs])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), listed), pa.array(short, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the most periods, exactly compared; of equals the first in the list. Null without runs."""
    better = lambda r, best: best.isNull() | (r.length * best.period > best.length * r.period)
    nothing = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return F.aggregate(runs, nothing, lambda best, r: F.when(better(r, best), r).otherwise(best))


def run_listing(runs: Column) -> Column:
    """A line ``start,length,period`` per run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which a tenth of the documents, picked by id, repeats a stretch of words up to its end."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", h.alias("h"))
    found = found.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    found = found.withColumns({"n": F.size("words"), "g": F.floor(F.col("h") / 10)}).withColumn("a", F.col("g") % F.col("n"))
    found = found.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    head = F.slice("words", F.lit(1), F.col("a").cast("int"))
    # Fewer than eleven periods fill the rest.
    cycle = F.flatten(F.array_repeat(F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int")), 11))
    planted = F.array_join(F.concat(head, F.slice(cycle, F.lit(1), (F.col("n") - F.col("a")).cast("int"))), " ")
    return found.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_run_detection(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        sha(run_listing(F.col("runs"))).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
