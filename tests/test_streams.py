"""Streaming precedence and the stored baseline."""

import datetime

from pyspark.sql import functions as F

from siftguard.operators import baseline as base
from siftguard.operators.postprocess import deduplicate
from siftguard.schemas import RAW_COLUMNS, RAW_FINDINGS
from siftguard.streaming.operators import start_baseline_diff, stream_first_findings

START = datetime.datetime(2024, 1, 1)


def _raw(spark, rows):
    """Raw findings from (file, line, title, rule_ord, emit_seq, day)."""
    full = [(f, n, "HIGH", 4, t, f"d{o}", f"s{q}", None, "", f"scanner{o}", o, q, None, START + datetime.timedelta(days=d)) for f, n, t, o, q, d in rows]
    return spark.createDataFrame(full, RAW_FINDINGS + ", at timestamp")


def _drain(spark, frame, out):
    query = frame.writeStream.format("parquet").trigger(availableNow=True).option("checkpointLocation", f"{out}-state").start(str(out))
    query.awaitTermination(120)
    return spark.read.schema(frame.schema).parquet(str(out))


def test_the_earliest_scanner_wins_whenever_it_arrives(spark, tmp_path):
    waves = [
        [("a", 1, "T", 5000, 1, 0), ("a", 1, "T", 3000, 9, 0), ("b", 1, "T", 7000, 1, 0), ("c", 1, "U", 1, 5, 0), ("c", 1, "U", 1, 2, 1)],
        [("a", 1, "T", 100, 4, 1), ("b", 1, "T", 8000, 0, 2)],
        [("z", 1, "late", 1, 1, 40)], [("a", 1, "T", 900, 1, 41), ("z", 2, "late", 1, 1, 80)]]
    inbox, out = str(tmp_path / "in"), tmp_path / "out"
    _raw(spark, waves[0]).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema(_raw(spark, []).schema).parquet(inbox)
    single = stream_first_findings(stream, "at", "7 days")
    assert _drain(spark, single, out).count() == 0
    for wave in waves[1:]:
        _raw(spark, wave).write.mode("append").parquet(inbox)
        got = _drain(spark, single, out)
    rows = sorted((r.file, r.line, r.title, r.rule_ord, r.emit_seq, r.scanner) for r in got.collect())
    # State of the first reports is gone by day 41, so the place is reported anew; the last event is still held.
    assert rows == [("a", 1, "T", 100, 4, "scanner100"), ("a", 1, "T", 900, 1, "scanner900"), ("b", 1, "T", 7000, 1, "scanner7000"), ("c", 1, "U", 1, 2, "scanner1"),
                    ("z", 1, "late", 1, 1, "scanner1")]
    batch = deduplicate(_raw(spark, waves[0] + waves[1]).select(RAW_COLUMNS)).select("file", "line", "title", "rule_ord").collect()
    assert {tuple(r) for r in batch} <= {r[:4] for r in rows}


def test_findings_of_a_block_of_lines_share_a_state(spark, tmp_path):
    """A thousand findings of a file cost a few calls; each of them still has its own time."""
    rows = [("a", n, f"T{n % 7}", 50 + d - n % 3 * d, n, d * 2) for n in range(1000) for d in (0, 1)] + [("a", 5, "later", 1, 1, 3), ("a", 5, None, 1, 1, 0), (None, 5, "T", 2, 1, 0)]
    inbox, out = str(tmp_path / "in"), tmp_path / "out"
    _raw(spark, rows).write.parquet(inbox)
    single = stream_first_findings(spark.readStream.schema(_raw(spark, []).schema).parquet(inbox), "at", "7 days")
    assert _drain(spark, single, out).count() == 0
    _raw(spark, [("z", 1, "end", 1, 1, 16)]).write.mode("append").parquet(inbox)
    # The watermark is at day 9: what arrived on day 3 is held until day 10.
    got = sorted(((r.file, r.line, r.title, r.rule_ord) for r in _drain(spark, single, out).collect()), key=str)
    want = deduplicate(_raw(spark, rows).select(RAW_COLUMNS)).where("title is null or title <> 'later'").select("file", "line", "title", "rule_ord").collect()
    assert got == sorted(map(tuple, want), key=str) and len(got) == 1002
    kept = spark.read.format("statestore").option("path", f"{out}-state").option("stateVarName", "held").load()
    assert kept.count() <= 6
    _raw(spark, [("z", 1, "end", 1, 1, 60)]).write.mode("append").parquet(inbox)
    assert _drain(spark, single, out).where("title = 'later'").count() == 1


def test_a_stored_baseline_is_joined_by_shard(spark, tmp_path):
    found = _raw(spark, [(f"f{i}.py", n, "T", 1, n, 0) for i in range(300) for n in (1, 50)])
    entries = found.filter("line = 50").select(F.upper("file").alias("file"), (F.col("line") + 2).alias("line"), "title", "severity", "scanner")
    index = str(tmp_path / "index")
    base.write_baseline_index(entries, index)
    few = found.filter("file in ('f1.py', 'f2.py')")
    for known in (True, False):
        plain = base.known_findings(found, entries) if known else base.new_findings(found, entries)
        assert sorted(map(str, base.match_baseline_index(found, index, known).collect())) == sorted(map(str, plain.collect()))
    plan = base.match_baseline_index(few, index, True)._jdf.queryExecution().executedPlan().toString()
    static = plan[plan.index("FileScan parquet"):]
    assert "PartitionFilters: [shard" in static and "RLIKE" not in static
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    found.write.parquet(inbox)
    stream = spark.readStream.schema(found.schema).parquet(inbox)
    for _ in range(2):
        start_baseline_diff(stream, index, out, out + "-state", availableNow=True).awaitTermination(120)
    assert spark.read.parquet(out).count() == 300
    few.write.mode("append").parquet(inbox)
    start_baseline_diff(stream, index, out, out + "-state", availableNow=True).awaitTermination(120)
    assert spark.read.parquet(out).groupBy("batch").count().count() == 2 and spark.read.parquet(out).count() == 302
