"""Join helpers for keys that may hold a large share of all rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Into how many parts a hot key of the big side is cut.
SALTS = 16

#: Rows of a key, left and right, that meet in one task; keys of a side that are cut (they are broadcast), tasks; all at most. Beyond the latter two, blocks or tasks grow.
BLOCK_LEFT, BLOCK_RIGHT, MOST_CUT, MOST_TASKS = 4096, 1024, 10_000, 10_000


def salted_join(big: DataFrame, lookup: DataFrame, on: list[str], how: str, spread: Column,
                salts: int = SALTS) -> DataFrame:
    """Equi-join whose big side is cut into ``salts`` parts per key.

    ``spread`` is a value that differs among the rows of one key, such as a line number.
    ``lookup`` is repeated once per part; it must be distinct or small next to ``big``.
    The result equals ``big.join(lookup, on, how)``.
    """
    salt = F.pmod(F.xxhash64(spread), F.lit(salts))
    left = big.withColumn("_salt", salt)
    right = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def blocked_join(left: DataFrame, right: DataFrame, on: list[str], sizes: DataFrame, spread_left: Column, spread_right: Column,
                 block_left: int = BLOCK_LEFT, block_right: int = BLOCK_RIGHT) -> DataFrame:
    """Equi-join of two sides with many rows per key each, whose result outgrows them. It equals ``left.join(right, on)``.

    ``sizes`` is a stored table of the keys with their numbers of rows, ``lefts`` and ``rights``. A key with more rows on a side than its block is cut there by
    ``spread_left`` or ``spread_right``, and the rows of its other side are repeated per part: one more row per block of rows of the result at most.
    A task gets about ``block_left`` rows of ``left`` and gives the matches of each one after the other. So the columns of ``left`` hold few values in
    long runs, and a result that grows with the square takes little room in a columnar file. Rows without a match stay out of the shuffle while few keys have one.
    """
    both = (F.col("lefts") > 0) & (F.col("rights") > 0)
    of = {"keys": both.cast("int"), "lefts": F.col("lefts"), "rights": F.col("rights")}
    most = sizes.agg(*[F.coalesce(F.sum(x.cast("double")), F.lit(0.0)).alias(c) for c, x in of.items()]).first()
    few = most["keys"] <= MOST_CUT
    cuts = {c: max(block, math.ceil(most[c] / MOST_CUT)) for c, block in (("lefts", block_left), ("rights", block_right))}
    parts = {c: F.ceil(F.col(c) / n) for c, n in cuts.items()}
    known = sizes.where(both) if few else sizes
    dealt_out = known.agg(*[F.coalesce(F.sum((F.col(c) * F.greatest(parts[other], F.lit(1))).cast("double")), F.lit(0.0)).alias(c)
                            for c, other in (("lefts", "rights"), ("rights", "lefts"))]).first()
    tasks = min(MOST_TASKS, max(1, math.ceil(max(dealt_out["lefts"] / block_left, dealt_out["rights"] / (16 * block_left)))))
    crowded = (F.col("lefts") > cuts["lefts"]) | (F.col("rights") > cuts["rights"])
    cut = F.broadcast(sizes.where(both if few else both & crowded).select(*on, *[x.alias(f"_{c}") for c, x in parts.items()]))

    def dealt(rows: DataFrame, spread: Column, own: str, other: str) -> DataFrame:
        parts = {c: F.coalesce(f"{c}s", F.lit(1).cast("bigint")) for c in (own, other)}
        placed = rows.join(cut, on, "inner" if few else "left").withColumn(own, F.pmod(F.xxhash64(spread), parts[own]))
        placed = placed.withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), parts[other] - 1))).drop("_lefts", "_rights")
        return placed.repartition(tasks, *on, "_left", "_right")

    return dealt(left, spread_left, "_left", "_right").hint("merge").join(
        dealt(right, spread_right, "_right", "_left"), [*on, "_left", "_right"]).drop("_left", "_right")
