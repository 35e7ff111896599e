"""Benchmark decontamination: windows of test words held in a broadcast hash set, verified hits.

Every test item is cut into windows of ten normalised words (a shorter item is one window).
Training texts are scanned once, window by window, against the broadcast set; a hash hit is
compared with the window's words before it counts. Words of a verified hit can be removed from
the text, or the whole document dropped.

The broadcast is bounded by ``MAX_WINDOWS``. A larger benchmark is joined instead: windows are
shuffled by hash on both sides and verified after the join; results are the same.

Defined cases: null or empty text has no words and hits nothing; items without words or
without an id are ignored; repeated items and repeated documents count row by row (items by
id); a null doc_id is carried through; other columns never matter.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftguard.llm.common import pieces, ship, table, unused
from siftguard.llm.words import ALPHANUMERIC, Runs, signed, tokenize

#: Words per window.
WINDOW = 10
#: Windows that are broadcast at most; at about 120 bytes each this is under 64 MB.
MAX_WINDOWS = 500_000

REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_BITS = np.uint64(44)


def _plain(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join(ALPHANUMERIC.fold[data[a:b]].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per window and item: its hash, length, words and item."""
    schema = "hash long, length int, words binary, item_id string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(batches):
            words = tokenize(data, offsets, ALPHANUMERIC)
            runs, rows = Runs(words.hashes), []
            for item, a, b in zip(batch.column("item_id").to_pylist(), words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
                size = min(window, b - a)
                for i in range(a, b - size + 1 if size else a):
                    code = signed(runs.of(np.array([i]), np.array([i + size])))[0]
                    rows.append((int(code), size, _plain(data, words.starts[i:i + size], words.ends[i:i + size]), item))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.string()))],
                ["hash", "length", "words", "item_id"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null")
    return items.mapInArrow(cut, schema).distinct()


class WindowSet:
    """Windows of test items by length and hash, with a bit table in front."""

    def __init__(self, rows: list[tuple[int, int, bytes, str]]) -> None:
        by_length: dict[int, dict[int, dict[bytes, list[str]]]] = defaultdict(dict)
        for code, length, words, item in rows:
            by_length[length].setdefault(code, {}).setdefault(bytes(words), []).append(item)
        self.entries = dict(by_length)
        self.hashes = {n: np.sort(np.fromiter(x, np.int64, len(x))).view(np.int64) for n, x in by_length.items()}
        self.seen = {}
        for length, codes in self.hashes.items():
            self.seen[length] = np.zeros(1 << 20, bool)
            self.seen[length][codes.view(np.uint64) >> _BITS] = True

    def hits(self, data: np.ndarray, words) -> Iterator[tuple[int, int, list[str]]]:
        """Verified occurrences: (first word, length, items)."""
        runs, ends = Runs(words.hashes), words.text_end()
        for length, codes in self.hashes.items():
            found = runs.all_of(length)
            near = np.flatnonzero(self.seen[length][found >> _BITS])
            near = near[near + length <= ends[near]]
            value = signed(found[near])
            place = np.minimum(np.searchsorted(codes, value), len(codes) - 1)
            for i in near[codes[place] == value].tolist():
                texts = self.entries[length][int(signed(found[i:i + 1])[0])]
                items = texts.get(_plain(data, words.starts[i:i + length], words.ends[i:i + length]))
                if items:
                    yield i, length, items


def _digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _covered(n_words: int, hits: list[tuple[int, int]]) -> np.ndarray:
    """Which words lie in a hit."""
    steps = np.zeros(n_words + 1, np.int64)
    for start, length in hits:
        steps[start] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:-1]) > 0


def _without(data: np.ndarray, words, low: int, gone: np.ndarray, a: int, b: int) -> str:
    """Bytes ``a`` to ``b`` without the words that are ``gone``; word numbers start at ``low``."""
    keep = np.ones(b - a, bool)
    for i in np.flatnonzero(gone).tolist():
        keep[words.starts[low + i] - a:words.ends[low + i] - a] = False
    return data[a:b][keep].tobytes().decode()


def _scan(docs: DataFrame, windows, with_text: bool) -> DataFrame:
    schema = REPORT + (", clean_text string" if with_text else "")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = windows.value
        for batch, data, offsets in pieces(batches):
            words = tokenize(data, offsets, ALPHANUMERIC)
            found, items = defaultdict(list), defaultdict(set)
            for i, length, names in known.hits(data, words):
                row = int(np.searchsorted(words.bounds, i, "right")) - 1
                found[row].append((i - int(words.bounds[row]), length))
                items[row].update(names)
            n_hit, clean = np.zeros(len(batch), np.int64), (batch.column("text").to_pylist() if with_text else [])
            for row, hits in found.items():
                gone = _covered(int(words.counts[row]), hits)
                n_hit[row] = gone.sum()
                if with_text:
                    clean[row] = _without(data, words, int(words.bounds[row]), gone, int(offsets[row]), int(offsets[row + 1]))
            none = _digest(set())
            columns = [batch.column("doc_id"), pa.array(words.counts.astype(np.int64)), pa.array(n_hit),
                       pa.array([len(items[r]) if r in items else 0 for r in range(len(batch))], pa.int64()),
                       pa.array([_digest(items[r]) if r in items else none for r in range(len(batch))], pa.string()), pa.array(n_hit > 0)]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(clean, pa.string())] if with_text else []),
                                             [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, schema)


def _text_key(docs: DataFrame):
    """What tells rows with the same or no id apart."""
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")), F.lit(7))


def _hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Hits with their windows' words and items, of the (doc_id, text_key) that have any, by a shuffle join on window hashes.

    Of a document's windows only hashes travel; the words of the test windows they meet come along for :func:`_verified`.
    """
    lengths = sorted(r.length for r in windows.select("length").distinct().limit(WINDOW + 1).collect())
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_key(docs).alias("text_key"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(batches):
            words = tokenize(data, offsets, ALPHANUMERIC)
            runs, ends, row_of = Runs(words.hashes), words.text_end(), np.repeat(np.arange(len(batch)), words.counts)
            for length in lengths:
                found = runs.all_of(length)
                at = np.flatnonzero(np.arange(len(found)) + length <= ends[:len(found)])
                for part in np.array_split(at, len(at) // 50_000 + 1):
                    rows = pa.array(row_of[part])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(rows), batch.column("text_key").take(rows), pa.array(part - words.bounds[row_of[part]]),
                         pa.array(np.full(len(part), length, np.int32)), pa.array(signed(found[part]))],
                        ["doc_id", "text_key", "start", "length", "hash"])

    cuts = docs.mapInArrow(cut, "doc_id long, text_key long, start long, length int, hash long")
    return cuts.join(windows, ["hash", "length"]).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "length", "words", "item_id")).alias("hits"))


def _verified(data: np.ndarray, words, low: int, hits: list[dict]) -> list[dict]:
    """The hits whose words are indeed those of the test window; word numbers start at ``low``."""
    def same(h):
        at = slice(low + h["start"], low + h["start"] + h["length"])
        return _plain(data, words.starts[at], words.ends[at]) == bytes(h["words"])
    return [h for h in hits or [] if same(h)]


def _with_hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Every document with its text key and hits; without any, null."""
    hits, names = _hits(docs, windows), [unused(n, docs) for n in ("__doc", "__text", "__hits")]
    hits = hits.select(F.col("doc_id").alias(names[0]), F.col("text_key").alias(names[1]), F.col("hits").alias(names[2]))
    same = docs["doc_id"].cast("long").eqNullSafe(hits[names[0]]) & (_text_key(docs) == hits[names[1]])
    return docs.join(hits, same, "left").drop(*names[:2])


def _joined(docs: DataFrame, windows: DataFrame, with_text: bool) -> DataFrame:
    """The same report for benchmarks of any size."""
    rows = _with_hits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), windows)
    schema = REPORT + (", clean_text string" if with_text else "")

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(batches):
            words = tokenize(data, offsets, ALPHANUMERIC)
            rows = []
            for r, (doc, text, hits) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "__hits")), strict=True)):
                hits = _verified(data, words, int(words.bounds[r]), hits)
                items = {h["item_id"] for h in hits}
                gone = _covered(int(words.counts[r]), [(h["start"], h["length"]) for h in hits])
                clean = _without(data, words, int(words.bounds[r]), gone, int(offsets[r]), int(offsets[r + 1])) if hits else text
                rows.append((doc, int(words.counts[r]), int(gone.sum()), len(items), _digest(items), bool(gone.any()), clean))
            names = [x.split()[0] for x in schema.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kinds[k]) for k in range(len(names))], names)

    return rows.mapInArrow(report, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS,
                  with_text: bool = False) -> DataFrame:
    """Per document: words, words hit, items met, and with ``with_text`` the text without hit words."""
    ship(docs.sparkSession)
    windows = benchmark_windows(benchmark, window)
    rows = windows.limit(max_windows + 1).collect()
    if len(rows) > max_windows:
        return _joined(docs, windows, with_text)
    held = docs.sparkSession.sparkContext.broadcast(WindowSet([tuple(r) for r in rows]))
    return _scan(docs, held, with_text)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents no test window occurs in, with all their columns."""
    ship(docs.sparkSession)
    windows = benchmark_windows(benchmark, settings.get("window", WINDOW))
    most = settings.get("max_windows", MAX_WINDOWS)
    rows = windows.limit(most + 1).collect()
    if len(rows) > most:
        hits, names = unused("__hits", docs), docs.columns

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, data, offsets in pieces(batches):
                words = tokenize(data, offsets, ALPHANUMERIC)
                keep = [not _verified(data, words, int(words.bounds[r]), found) for r, found in enumerate(batch.column(hits).to_pylist())]
                yield batch.filter(pa.array(keep, pa.bool_())).select(names)

        return _with_hits(docs, windows).mapInArrow(check, docs.schema)
    held = docs.sparkSession.sparkContext.broadcast(WindowSet([tuple(r) for r in rows]))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch, data, offsets in pieces(batches):
            words = tokenize(data, offsets, ALPHANUMERIC)
            keep = np.ones(len(batch), bool)
            for i, _, _ in known.hits(data, words):
                keep[np.searchsorted(words.bounds, i, "right") - 1] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(clean, docs.schema)


def op6_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
