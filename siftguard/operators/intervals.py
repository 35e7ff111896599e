"""Points in intervals of ordered keys, by an equi-join on key prefixes.

Keys are arrays that compare element by element, such as version keys. Joined on the group alone (a package, say), a popular group
would meet all its intervals in one task, row against row. Here a point belongs to a bin: the first element of its key, or more of them where many points
share those, so that a bin holds about ``BIN_POINTS`` points. Intervals are joined to the few bins that exist within their
group, which says of each bin whether it lies inside an interval as a whole or holds one of its ends; then
points and intervals meet by group and bin, and only in the bins with an end are keys compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_dir
from .joins import salted_join

#: Points per bin, number of crowded prefixes at most (they are broadcast, a few kilobytes to a megabyte), longest prefix.
BIN_POINTS, MOST_CROWDED, LONGEST = 20_000, 10_000, 4


def _prefix(key: Column, length) -> Column:
    return F.slice(key, F.lit(1), length if isinstance(length, Column) else F.lit(length))


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back."""
    path = work_dir(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def with_bins(points: DataFrame, on: list[str], bin_points: int = BIN_POINTS, longest: int = LONGEST) -> DataFrame:
    """Add ``_bin``, the prefix of ``key`` a point is dealt by. ``points`` is a stored table of distinct groups and keys."""
    # A prefix is crowded if it holds more than this many points, so no more than MOST_CROWDED of one length are.
    crowd = max(bin_points, -(-points.count() // MOST_CROWDED))
    out, length = points, F.lit(1)
    for n in range(1, longest):
        counts = points.groupBy(*on, _prefix(F.col("key"), n).alias(f"_prefix{n}")).agg(F.count(F.lit(1)).alias("_n"))
        crowded = counts.where(F.col("_n") > crowd).select(*on, f"_prefix{n}", F.lit(1).alias(f"_crowded{n}"))
        out = out.withColumn(f"_prefix{n}", _prefix(F.col("key"), n)).join(F.broadcast(crowded), [*on, f"_prefix{n}"], "left")
        length = length + F.coalesce(f"_crowded{n}", F.lit(0))
    return out.withColumn("_bin", _prefix(F.col("key"), length)).select(*points.columns, "_bin")


def interval_join(points: DataFrame, intervals: DataFrame, on: list[str], bin_points: int = BIN_POINTS) -> DataFrame:
    """Every point with every interval of its group that holds it.

    ``points`` has the columns ``on`` and ``key``; copies of a point are one. ``intervals`` has ``on``, ``low`` (included; null: unbounded),
    ``high`` (null: unbounded) and ``high_included``, and what else it carries along.
    """
    placed = with_bins(stored(points.select(*on, "key").distinct(), "points"), on, bin_points)
    bins = placed.select(*on, "_bin").distinct()
    spread = F.struct(*[c for c in intervals.columns if c not in on])
    length = F.size("_bin")
    low, high = _prefix(F.col("low"), length), _prefix(F.col("high"), length)
    # An end shorter than the bin compares as it is; it lies before or after the bin as a whole.
    after_low, before_high = F.col("low").isNull() | (low < F.col("_bin")), F.col("high").isNull() | (high > F.col("_bin"))
    touched = salted_join(intervals, bins, on, "inner", spread).where(
        (F.col("low").isNull() | (low <= F.col("_bin"))) & (F.col("high").isNull() | (high >= F.col("_bin"))))
    touched = touched.withColumn("_whole", after_low & before_high)
    inside = (F.col("low").isNull() | (F.col("key") >= F.col("low"))) & (
        F.col("high").isNull() | (F.col("key") < F.col("high")) | (F.col("high_included") & (F.col("key") == F.col("high"))))
    return placed.join(touched, [*on, "_bin"]).where(F.col("_whole") | inside).drop("_bin", "_whole")


def running_totals(rows: DataFrame, on: list[str], order: str, sums: list[str]) -> DataFrame:
    """Rows with each of ``sums`` replaced by its total over the rows of the group up to this one. ``on`` and ``order`` are unique together and not null.

    A range partitioning cuts even a single hot group; the parts are stored. The totals of a group's parts are a small table, and what
    precedes a part is added to the totals within it.
    """
    by = [*on, order]
    placed = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()), "totals")
    before = Window.partitionBy(*on).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(*on, "_part").agg(*[F.sum(c).alias(c) for c in sums])
    parts = parts.select(*on, "_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{c}") for c in sums])
    within = Window.partitionBy(*on, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumns({c: F.sum(c).over(within) for c in sums}).join(parts, [*on, "_part"])
    return summed.select(*[(F.col(c) + F.col(f"_before_{c}")).alias(c) if c in sums else F.col(c) for c in rows.columns])
