"""Exact substring dedup by seed and extend.

*Seeds.* Winnowing: in every window of ``length`` words the smallest hash of ``seed`` words (the
rightmost, on ties) is the window's anchor. The choice depends on the window's words only, so
equal windows have equal anchors at equal places. A run of windows with one anchor, and the
words it spans, is the anchor's *reach*. Anchors that occur once cannot lie in a repeat.

*Extension.* Occurrences of a seed are joined through counts, never pair by pair. If a whole
reach (all words to both sides of the seed that its windows span) occurs again, all its windows
are repeats. Only occurrences whose reach ends differently are extended word by word: the
windows of one representative per distinct reach are compared with theirs.

*Result.* Overlapping repeated windows merge into maximal repeats; their words are removed.

Memory of a task is bounded by a piece of text (or one long document); a passage that a third
of all documents hold is counted with map-side aggregation and joins that adaptive execution
may split. Hashes of reach and window are compared together with the seed's (128 bits).

Defined cases: null and empty texts have no words and give a row of zeros; documents shorter
than a window keep everything; repeats within one document count; repeated rows repeat each
other; rows that share a doc_id with different texts are told apart by a text hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftguard.llm.common import dropped, packed, pieces, saved, ship, slices, table, unpacked
from siftguard.llm.words import SPACED, Runs, Words, signed, tokenize

#: Words of a repeat at least, and words of a seed.
LENGTH, SEED = 35, 8

REPORT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of every window of ``width``, by doubling."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:len(out) - step], out[step:])
        done += step
    return out


def reaches(words, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Anchor place, first and last window start, seed hash and reach hash of every anchor."""
    none = tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),) * 2
    if len(words) < length:
        return none
    runs = Runs(words.hashes)
    grams = runs.all_of(seed)
    # A later place wins a tie: its low bits are smaller.
    low_bits = np.uint64((1 << 24) - 1)
    ranked = (grams & ~low_bits) | (low_bits - (np.arange(len(grams), dtype=np.uint64) & low_bits))
    lowest = _lowest(ranked, length - seed + 1)
    start = np.flatnonzero(np.arange(len(lowest)) + length <= words.text_end()[:len(lowest)])
    if not len(start):
        return none
    place = (low_bits - (lowest[start] & low_bits)).astype(np.int64)
    place = start + ((place - start) & int(low_bits))
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1])]))
    last = np.concatenate([new[1:], [len(start)]]) - 1
    anchor, low, high = place[new], start[new], start[last]
    shape = ((anchor - low) * 64 + (high - low)).astype(np.uint64)
    reach = runs.of(low, high + length) ^ (shape * np.uint64(0x9FB21C651E98DF25))
    return anchor, low, high, grams[anchor], reach


def _anchors(docs: DataFrame, length: int, seed: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(batches):
            words = tokenize(data, offsets, SPACED)
            _, low, high, gram, reach = reaches(words, length, seed)
            row = np.searchsorted(words.bounds, low, "right") - 1
            at = words.bounds[row]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), batch.column("text_key").take(pa.array(row)), pa.array((low - at).astype(np.int32)),
                 pa.array((high - low).astype(np.int16)), pa.array(signed(gram)), pa.array(signed(reach))],
                ["doc_id", "text_key", "low", "span", "seed", "reach"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(cut, "doc_id long, text_key int, low int, span short, seed long, reach long")


def _unpacked_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, Words]]:
    """Rows of packed texts in pieces of bounded text size, their bytes and words."""
    for batch in batches:
        for start, stop in slices(np.concatenate([[0], np.cumsum(batch.column("n_bytes").to_numpy())])):
            part = batch.slice(start, stop - start)
            data, offsets = unpacked(part.column("ztext").to_pylist(), part.column("n_bytes").to_pylist())
            yield part, data, tokenize(data, offsets, SPACED)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column in a row, and the number of each row's."""
    return lists.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def _windows(texts: DataFrame, length: int) -> DataFrame:
    """Hash of every window in the reaches that are to be compared."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, words in _unpacked_pieces(batches):
            runs = Runs(words.hashes)
            flat = {k: _flat(part.column(k)) for k in ("lows", "spans", "seeds", "singles")}
            row = np.repeat(np.arange(len(part)), flat["lows"][1])
            size = flat["spans"][0].astype(np.int64) + 1
            at = np.repeat(np.arange(len(size)), size)
            start = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + flat["lows"][0].astype(np.int64)[at]
            place = start + words.bounds[row[at]]
            owner = pa.array(row[at])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(owner), part.column("text_key").take(owner), pa.array(start.astype(np.int32)), pa.array(flat["seeds"][0][at]),
                 pa.array(signed(runs.of(place, place + length))), pa.array(flat["singles"][0][at].astype(bool))],
                ["doc_id", "text_key", "low", "seed", "code", "single"])

    return texts.mapInArrow(cut, "doc_id long, text_key int, low int, seed long, code long, single boolean")


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents by id and text hash; an absent id is carried along."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash(F.coalesce("text", F.lit(""))).alias("text_key"), "text")


def _same(left: DataFrame, right: DataFrame):
    return left.doc_id.eqNullSafe(right.doc_id) & (left.text_key == right.text_key)


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Word ranges [low, high) whose words lie in windows that occur elsewhere as well.

    Ranges of one document may touch or overlap; ``substring_report`` merges them.
    """
    ship(docs.sparkSession)
    docs = _keyed(docs)
    anchors = saved(_anchors(docs, length, seed), "anchors")
    # Counts are stored before they are joined: adaptive execution can then split a hot seed.
    known = saved(anchors.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.min("reach").alias("least"), F.max("reach").alias("most")).where("n > 1"), "seeds")
    shared = saved(anchors.join(known, "seed").select(anchors["*"], (F.col("least") == F.col("most")).alias("alike")), "shared")
    dropped(anchors, known)
    mixed = shared.where("not alike")
    kinds = saved(mixed.groupBy("seed", "reach").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")), "kinds")
    alone = saved(kinds.groupBy("seed").agg(F.min("n").alias("fewest")).where("fewest = 1").select("seed"), "alone")
    sorted_out = saved(mixed.join(kinds, ["seed", "reach"]).select("doc_id", "text_key", "low", "span", "seed", "n", "first"), "mixed")
    compare = sorted_out.where((F.col("n") == 1) | F.col("doc_id").eqNullSafe(F.col("first"))).join(alone, "seed", "left_semi")
    # Sets, not lists: a text that many rows hold under one id has the ranges of one text.
    reach = F.struct("low", "span", "seed", (F.col("n") == 1).cast("int").alias("single"))
    parts = compare.groupBy("doc_id", "text_key").agg(F.collect_set(reach).alias("r")).select(
        "doc_id", "text_key", *(F.col(f"r.{k}").alias(f"{k}s") for k in ("low", "span", "seed", "single")))
    texts = packed(docs, "doc_id", "text_key")
    wanted = texts.join(parts, _same(texts, parts)).select(texts["*"], "lows", "spans", "seeds", "singles")
    windows = saved(_windows(wanted, length), "windows")
    again = saved(windows.groupBy("seed", "code").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seed", "code"), "again")
    grown = windows.where("single").join(again, ["seed", "code"], "left_semi")
    whole = shared.where("alike").select("doc_id", "text_key", "low", "span").union(sorted_out.where("n > 1").select("doc_id", "text_key", "low", "span"))
    ranges = whole.select("doc_id", "text_key", "low", (F.col("low") + F.col("span") + length).alias("high")).union(
        grown.select("doc_id", "text_key", "low", (F.col("low") + length).alias("high")))
    out = saved(ranges, "repeats")
    dropped(shared, kinds, alone, sorted_out, windows, again)
    return out


def substring_report(docs: DataFrame, length: int = LENGTH, seed: int = SEED, with_text: bool = False) -> DataFrame:
    """Per document: words, words removed, hash of the kept words; with ``with_text`` also the
    kept words and the maximal repeats as word ranges."""
    found = repeats(docs, length, seed)
    per_text = found.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("low", "high")).alias("r")).select(
        "doc_id", "text_key", F.col("r.low").alias("lows"), F.col("r.high").alias("highs"))
    texts = packed(_keyed(docs), "doc_id", "text_key")
    joined = texts.join(per_text, _same(texts, per_text), "left").select(texts.doc_id, "ztext", "n_bytes", "lows", "highs")
    schema = REPORT + (", kept_text string, spans string" if with_text else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, words in _unpacked_pieces(batches):
            raw = data.tobytes()
            steps = np.zeros(len(words) + 1, np.int64)
            for side, sign in (("lows", 1), ("highs", -1)):
                value, size = _flat(part.column(side))
                np.add.at(steps, value + np.repeat(words.bounds[:-1], size), sign)
            gone = np.cumsum(steps[:-1]) > 0
            starts, ends = words.starts.tolist(), words.ends.tolist()
            out = []
            for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
                text = b" ".join([raw[starts[i]:ends[i]] for i in (np.flatnonzero(~gone[a:b]) + a).tolist()])
                turn = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].astype(np.int8), [0]]))).tolist()
                out.append((b - a, int(gone[a:b].sum()), hashlib.sha256(text).hexdigest(), *((text.decode(), ",".join(
                    f"{x}:{y}" for x, y in zip(turn[::2], turn[1::2], strict=True))) if with_text else ())))
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([x[k] for x in out], kinds[k]) for k in range(len(names) - 1))], names)

    return joined.mapInArrow(report, schema)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_report(table(spark, sf_dir, "documents"))
