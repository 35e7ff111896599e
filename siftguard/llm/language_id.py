"""Language identification by hierarchical discrimination.

A document is counted as hashed byte trigrams of its letters (other ASCII is blank, A-Z as a-z); the
square roots of their shares are its features, a vector of length one. A linear support vector
machine per family, one against the rest, predicts the family first. Within a family, one machine
per pair of languages votes; most votes win, ties go to the larger sum of margins.

The machines are fitted on the driver from a bounded sample of labelled documents: the first texts of each
language in the order of a hash of the id, one per id, ``PER_LANGUAGE`` each and ``TOTAL`` together.
Every text is predicted whole, in one narrow pass, ``ROWS`` documents at a time.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is everything if nothing was learned;
a language missing in ``FAMILIES`` is a family of its own; null languages are not learned from; a null doc_id counts as empty text for the folds;
repeated rows repeat; other columns never matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftguard.llm.common import held_out, pieces, release, saved, ship, table, unused

#: Labelled documents per language and in all, of which features reach the driver (16 KB each).
PER_LANGUAGE, TOTAL = 400, 4000
FEATURES = 1 << 12
#: Rows of dense features at a time (16 KB each).
ROWS = 512

#: Families of language codes.
FAMILIES = {
    **dict.fromkeys(["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"], "germanic"),
    **dict.fromkeys(["fr", "es", "it", "pt", "ro", "ca", "gl"], "romance"),
    **dict.fromkeys(["ru", "uk", "be", "bg", "pl", "cs", "sk", "sl", "hr", "sr", "mk"], "slavic"),
    **dict.fromkeys(["fi", "et", "hu"], "uralic"), **dict.fromkeys(["ar", "he", "fa"], "semitic and neighbours"),
    **dict.fromkeys(["hi", "bn", "ur", "mr"], "indic"), **dict.fromkeys(["lt", "lv"], "baltic"), **dict.fromkeys(["tr", "az", "kk"], "turkic"),
}
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.where(_LETTER, np.arange(256), 32).astype(np.uint32)
_FOLD[65:91] += 32
_MIX = np.array([2654435761, 2246822519, 3266489917], np.uint32)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features per text."""
    rows = len(offsets) - 1
    if len(data) < 3:
        return np.zeros((rows, FEATURES), np.float32)
    folded = _FOLD[data]
    code = folded[:-2] * _MIX[0] + folded[1:-1] * _MIX[1] + folded[2:] * _MIX[2]
    code = ((code ^ (code >> np.uint32(15))) * np.uint32(2246822519)) >> np.uint32(20)
    blank = (folded[:-2] == 32) & (folded[1:-1] == 32)
    row = np.repeat(np.arange(rows), np.diff(offsets))[:-2]
    inside = ~blank & (np.arange(len(code)) + 3 <= offsets[1:][row])
    counts = np.bincount(row[inside] * FEATURES + code[inside], minlength=rows * FEATURES).reshape(rows, FEATURES)
    share = counts.astype(np.float32)
    share /= np.maximum(counts.sum(1, keepdims=True), 1)
    return np.sqrt(share, out=share)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter; only texts without ASCII letters are decoded."""
    ascii_letter = _LETTER & (np.arange(256) < 128)
    seen = np.concatenate([[0], np.cumsum(ascii_letter[data])])
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for r in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        out[r] = any(map(str.isalpha, data[offsets[r]:offsets[r + 1]].tobytes().decode()))
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Weights and bias of a support vector machine with squared hinge loss, by dual coordinate descent."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    alpha, w, norm = np.zeros(len(x)), np.zeros(x.shape[1]), (x * x).sum(1) + 0.5 / cost
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            gradient = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / cost
            new = max(alpha[i] - gradient / norm[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


class LanguageModel:
    """Family machines, and pairwise machines of each family with several languages."""

    def __init__(self, x: np.ndarray, langs: list[str], families: dict[str, str] = FAMILIES) -> None:
        self.langs = sorted(set(langs))
        kin = {lang: families.get(lang, lang) for lang in self.langs}
        self.families = sorted(set(kin.values()))
        self.members = [[k for k, lang in enumerate(self.langs) if kin[lang] == f] for f in self.families]
        label = np.array([self.langs.index(lang) for lang in langs], int)
        family = np.array([self.families.index(kin[lang]) for lang in langs], int)
        n = x.shape[1] + 1
        if len(self.families) == 2:
            one = linear_svm(x, np.where(family == 0, 1, -1))
            self.first = np.stack([one, -one])
        else:
            self.first = np.stack([linear_svm(x, np.where(family == f, 1, -1)) for f in range(len(self.families))]) if len(self.families) > 1 else np.zeros((len(self.families), n))
        self.pairs = [(f, a, b) for f, own in enumerate(self.members) for i, a in enumerate(own) for b in own[i + 1:]]
        self.second = np.stack([linear_svm(x[(label == a) | (label == b)], np.where(label[(label == a) | (label == b)] == a, 1, -1)) for _, a, b in self.pairs]) if self.pairs else np.zeros((0, n))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        first = x @ self.first.T
        family = first.argmax(1)
        ranked = np.sort(first, axis=1)
        margin = (ranked[:, -1] - ranked[:, -2]) / 2 if first.shape[1] > 1 else np.ones(len(x))
        votes = np.zeros((len(x), len(self.langs)))
        for (f, a, b), score in zip(self.pairs, (x @ self.second.T).T, strict=True):
            # Votes first; the bounded margin settles ties.
            votes[:, a] += np.where(family == f, (score > 0) + 0.01 * np.tanh(score), 0)
            votes[:, b] += np.where(family == f, (score <= 0) - 0.01 * np.tanh(score), 0)
        chosen = np.empty(len(x), int)
        for f, own in enumerate(self.members):
            chosen[family == f] = np.array(own)[votes[family == f][:, own].argmax(1)]
        for (_, a, b), score in zip(self.pairs, (x @ self.second.T).T, strict=True):
            margin = np.where(chosen == a, np.minimum(margin, score), np.where(chosen == b, np.minimum(margin, -score), margin))
        return [self.langs[k] for k in chosen], 1 / (1 + np.exp(-3 * margin))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, total: int = TOTAL) -> LanguageModel | None:
    """Learn from labelled documents outside the held-out fold; None if there are none."""
    spark = docs.sparkSession
    ship(spark)
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), 5, 0))
    sizes = saved(learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    langs = sizes.count()
    if not langs:
        return None
    each = max(20, min(per_language, total // langs))
    # A cut by hash leaves little more than the sample of each language to be ranked.
    rank = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(3)), F.lit(1_000_000_000))
    ids = learn.select(F.col("doc_id").cast("long").alias("doc_id"), "lang").join(F.broadcast(sizes), "lang").withColumn("rank", rank)
    ids = ids.where(F.col("rank") <= F.lit(1.5e9 * each) / F.col("n")).select("doc_id", "lang", "rank").distinct()
    order = Window.partitionBy("lang").orderBy("rank", "doc_id")
    ids = ids.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= each)
    # No more than ``total`` texts: one per id and language, that of the smallest hash, however many rows share the id.
    texts = learn.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").join(F.broadcast(ids.select("doc_id", "lang")), ["doc_id", "lang"])
    texts = texts.groupBy("doc_id", "lang").agg(F.min(F.struct(F.xxhash64("text").alias("key"), "text")).alias("t")).select("lang", "t.text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(batches, rows=ROWS):
            keep = np.flatnonzero(has_letter(data, offsets))
            rows = features(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(keep)), pa.array([rows[r].tobytes() for r in keep], pa.binary())], ["lang", "x"])

    sample = sorted((r.lang, bytes(r.x)) for r in texts.select("lang", "text").mapInArrow(count, "lang string, x binary").collect())
    if not sample:
        return None
    langs, rows = [lang for lang, _ in sample], np.stack([np.frombuffer(x, np.float32) for _, x in sample])
    del sample
    model = LanguageModel(rows, langs)
    del rows
    release()
    return model


def identified(docs: DataFrame, model: LanguageModel | None, into: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """The documents with the language told and its score, in two more columns."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType(list(docs.schema.fields)).add(into[0], "string").add(into[1], "double")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = held.value
        for batch, data, offsets in pieces(batches, rows=ROWS):
            lang, score = ["und"] * len(batch), np.zeros(len(batch))
            known = np.flatnonzero(has_letter(data, offsets))
            if machine and len(known):
                names, scores = machine.predict(features(data, offsets)[known])
                score[known] = scores
                for r, name in zip(known.tolist(), names, strict=True):
                    lang[r] = name
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], [*batch.schema.names, *into])

    return docs.mapInArrow(predict, schema)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language can be told, columns as they are. Only texts without letters are ``und``: a machine always has a best language, and its score says how near the next one was."""
    told, score = unused("lang_pred", docs), unused("lang_score", docs)
    return identified(docs, fit(docs), (told, score)).where(F.col(told) != "und").select(*docs.columns)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
