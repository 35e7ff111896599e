"""Toxicity by non-negative positive-unlabelled learning.

*Features.* Presence of hashed words, and shares of hashed word beginnings (four to seven bytes)
among all words of the document.

*Learning.* Confirmed toxic documents are positives; everything else of the training fold, whatever its label, is unlabelled.
The risk of calling unlabelled text toxic is corrected by the class prior: with prior p it is
p * R(positive, +) + max(0, R(unlabelled, -) - p * R(positive, -)). Where the corrected
negative risk falls below zero, the step goes back up instead (the non-negative estimator). The linear
model is fitted in numpy on the driver from at most ``POSITIVES`` and ``UNLABELLED`` documents, chosen by a hash of the id;
the prior is the share of toxic documents among the labelled ones of the fold.

*Calibration.* A quarter of the fold's labelled documents takes no part in the fit; a logistic fit on
their scores turns margins into probabilities.

Every text is scored whole in one narrow pass.

Defined cases: null and empty texts score as texts without words; without positives everything scores 0; labels of unknown
documents are ignored; a null doc_id counts as empty text for the folds; repeated rows repeat; other columns never matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftguard.llm.common import held_out, pieces, ship, table
from siftguard.llm.words import ALPHANUMERIC, tokenize

#: Documents that the model is fitted and calibrated on at most.
POSITIVES, UNLABELLED, CALIBRATION = 2000, 4000, 2000
#: Features the model may use: those whose mean differs most, in standard errors, between positive and unlabelled text.
SELECTED, LEAST_POSITIVES = 300, 5
#: Hash buckets of words and of beginnings; a share of 1 weighs as much as ``SHARE`` words.
BUCKETS, SHARE = 1 << 15, 20.0
THRESHOLD = 0.7
_BEGINNINGS = (4, 5, 6, 7)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: where each text's entries begin, bucket numbers, values."""
    words = tokenize(data, offsets, ALPHANUMERIC)
    rows, n = len(offsets) - 1, words.counts
    row = np.repeat(np.arange(rows), n)
    present = np.unique(row * BUCKETS + (words.hashes >> np.uint64(49)).astype(np.int64))
    owners, buckets, values = [present // BUCKETS], [present % BUCKETS], [np.ones(len(present))]
    folded = np.append(ALPHANUMERIC.fold[data], np.zeros(8, np.uint8)).astype(np.uint64)
    code = np.zeros(len(words), np.uint64)
    for k in range(_BEGINNINGS[-1]):
        code = code * np.uint64(1099511628211) + folded[words.starts + k] + np.uint64(k + 1)
        if k + 1 in _BEGINNINGS:
            long_enough = np.flatnonzero(words.ends - words.starts > k)
            owners.append(row[long_enough])
            mixed = code[long_enough] * np.uint64(0x9E3779B97F4A7C15)
            buckets.append((mixed >> np.uint64(49)).astype(np.int64) + BUCKETS)
            values.append(SHARE / n[row[long_enough]])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.searchsorted(owner[order], np.arange(rows + 1)), np.concatenate(buckets)[order], np.concatenate(values)[order]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


class Sparse:
    """A sparse matrix of sampled documents."""

    def __init__(self, rows: list[tuple[bytes, bytes]]) -> None:
        index = [np.frombuffer(i, np.uint16) for i, _ in rows]
        self.bounds = np.concatenate([[0], np.cumsum([len(i) for i in index])]).astype(int)
        self.index = np.concatenate([np.zeros(0, np.uint16), *index]).astype(np.int32)
        self.value = np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(v, np.float32) for _, v in rows)]).astype(float)

    def only(self, features: np.ndarray) -> Sparse:
        """Without the entries of other features."""
        out, use = Sparse([]), features[self.index]
        out.bounds = np.concatenate([[0], np.cumsum(use)])[self.bounds]
        out.index, out.value = self.index[use], self.value[use]
        return out

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def dot(self, w: np.ndarray) -> np.ndarray:
        return _sums(w[self.index] * self.value, self.bounds)

    def back(self, per_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, np.repeat(per_row, np.diff(self.bounds)) * self.value, minlength=2 * BUCKETS)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def telling(positive: Sparse, unlabelled: Sparse, most: int = SELECTED) -> np.ndarray:
    """Which features tell positive from unlabelled text; rare ones are left out."""
    mean = lambda rows: rows.back(np.ones(len(rows))) / len(rows)
    square = np.bincount(unlabelled.index, unlabelled.value**2, minlength=2 * BUCKETS) / len(unlabelled)
    gap = (mean(positive) - mean(unlabelled)) / np.sqrt((square + 1e-3) / len(positive))
    gap[np.bincount(positive.index, minlength=2 * BUCKETS) < LEAST_POSITIVES] = 0
    chosen = np.zeros(2 * BUCKETS, bool)
    chosen[np.argsort(-np.abs(gap), kind="stable")[:most]] = True
    return chosen & (gap != 0)


def nn_pu(positive: Sparse, unlabelled: Sparse, prior: float, rounds: int = 300, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk (logistic loss, Adam)."""
    theta, m, v = np.zeros(2 * BUCKETS + 1), np.zeros(2 * BUCKETS + 1), np.zeros(2 * BUCKETS + 1)

    def gradient(rows: Sparse, slope: np.ndarray) -> np.ndarray:
        slope = slope / len(rows)
        return np.append(rows.back(slope), slope.sum())

    for t in range(1, rounds + 1):
        gp, gu = positive.dot(theta[:-1]) + theta[-1], unlabelled.dot(theta[:-1]) + theta[-1]
        negative_risk = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        down = gradient(unlabelled, _sigmoid(gu)) - prior * gradient(positive, _sigmoid(gp))
        step = prior * gradient(positive, _sigmoid(gp) - 1) + down if negative_risk >= 0 else -down
        step = step + decay * np.append(theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * step, 0.999 * v + 0.001 * step * step
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def calibrated(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit, with the usual smoothed targets."""
    hits = y.sum()
    if not 0 < hits < len(y):
        return 1.0, 0.0
    target = np.where(y > 0, (hits + 1) / (hits + 2), 1 / (len(y) - hits + 2))
    scale = score.std() + 1e-9
    z, a, b = score / scale, 1.0, float(np.log(hits / (len(y) - hits)))
    for _ in range(100):
        p = _sigmoid(a * z + b)
        w = p * (1 - p) + 1e-9
        hessian = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-2]])
        delta = np.linalg.solve(hessian, np.array([((target - p) * z).sum(), (target - p).sum()]))
        a, b = a + np.clip(delta[0], -2, 2), b + np.clip(delta[1], -2, 2)
    return float(max(a, 1e-3) / scale), float(b)


def _vectors(texts: DataFrame) -> list[tuple[str, bytes, bytes]]:
    """Role and sparse features of sampled texts, in a fixed order."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(batches):
            bounds, index, value = features(data, offsets)
            key = np.repeat(np.arange(len(batch)), np.diff(bounds)) * (2 * BUCKETS) + index
            key, at = np.unique(key, return_inverse=True)
            value = np.bincount(at, value, minlength=len(key)).astype(np.float32)
            index, bounds = (key % (2 * BUCKETS)).astype(np.uint16), np.searchsorted(key // (2 * BUCKETS), np.arange(len(batch) + 1))
            cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("role"), cut(index), cut(value)], ["doc_id", "role", "i", "v"])

    rows = texts.select("doc_id", "role", "text").mapInArrow(count, "doc_id long, role string, i binary, v binary").collect()
    return [(r.role, bytes(r.i), bytes(r.v)) for r in sorted(rows, key=lambda r: (r.role, r.doc_id, r.i))]


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, calibration: int = CALIBRATION):
    """Weights, bias, slope, offset; None without positives."""
    ship(docs.sparkSession)
    fold = lambda frame: frame.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 3, 1))
    marked = fold(labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))).where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = marked.agg(F.avg("toxic")).first()[0]
    if not share:
        return None
    order, spare = F.xxhash64("doc_id", F.lit(5)), F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(4)) == 0

    def first(frame: DataFrame, role: str, most: int) -> DataFrame:
        return frame.select("doc_id").orderBy(order, "doc_id").limit(most).select("doc_id", F.lit(role).alias("role"))

    texts = fold(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    checked = marked.where(spare)
    chosen = first(marked.where((F.col("toxic") == 1) & ~spare), "p", positives)
    chosen = chosen.union(first(texts.select("doc_id").distinct().where(~spare), "u", unlabelled))
    chosen = chosen.union(first(checked.where("toxic = 1"), "c1", calibration // 2)).union(first(checked.where("toxic = 0"), "c0", calibration))
    # One text per id and role, that of the smallest hash, however many rows share the id: at most the sum of the bounds above.
    taken = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "role").agg(F.min(F.struct(F.xxhash64("text").alias("key"), "text")).alias("t"))
    groups: dict[str, list] = {"p": [], "u": [], "c0": [], "c1": []}
    for role, index, value in _vectors(taken.select("doc_id", "role", "t.text")):
        groups[role].append((index, value))
    if not groups["p"] or not groups["u"]:
        return None
    prior = float(min(max(share, 0.001), 0.5))
    positive, other = Sparse(groups["p"]), Sparse(groups["u"])
    use = telling(positive, other)
    w, b = nn_pu(positive.only(use), other.only(use), prior)
    w = w * use
    check = Sparse(groups["c1"] + groups["c0"])
    y = np.array([1.0] * len(groups["c1"]) + [0.0] * len(groups["c0"]))
    slope, offset = calibrated(check.dot(w) + b, y) if len(check) else (1.0, 0.0)
    return w.astype(np.float32), b, slope, offset


def scored(docs: DataFrame, model) -> DataFrame:
    """The documents with ``toxic_score``."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType(list(docs.schema.fields)).add("toxic_score", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch, data, offsets in pieces(batches):
            out = np.zeros(len(batch))
            if known is not None:
                w, b, slope, offset = known
                bounds, index, value = features(data, offsets)
                out = _sigmoid(slope * (_sums(w[index] * value, bounds) + b) + offset)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "toxic_score"])

    return docs.mapInArrow(score, schema)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), F.col("toxic_score").alias("score"),
                      (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"))
