"""Operators on streaming DataFrames."""

from __future__ import annotations

from operator import itemgetter

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructType

from ..config import ScanConfig
from ..operators.baseline import match_baseline_index
from ..operators.intervals import stored
from ..operators.postprocess import drop_suppressed
from ..operators.rulescan import scan_lines
from ..operators.summary import COUNTERS
from ..plans.scan import FILE_COLUMNS
from ..operators.lines import explode_lines, with_file_facts
from ..rules import Rule, select_rules
from ..schemas import RAW_COLUMNS, RAW_FINDINGS


def stream_scan(files: DataFrame, config: ScanConfig | None = None, keep: list[str] = (),
                user_rules: list[Rule] = ()) -> DataFrame:
    """Line rules over arriving content, suppression comments applied. Stateless.

    ``keep`` names columns to carry along, such as the event time.
    """
    config = config or ScanConfig()
    lines = explode_lines(with_file_facts(files), [*keep, *FILE_COLUMNS])
    found = scan_lines(lines, select_rules(config, user_rules), keep)
    return drop_suppressed(found, config.suppression_word)


def stream_deduplicate(findings: DataFrame, event_time: str, delay: str) -> DataFrame:
    """One finding per (file, line, title) within the watermark delay.

    State is dropped once the watermark has passed it. Which copy survives is not defined,
    so feed it one scanner family, whose copies are equal.
    """
    return findings.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["file", "line", "title"])


#: Lines of a file whose findings are held in one state.
BLOCK_LINES = 256
_KINDS = dict(part.split() for part in RAW_FINDINGS.split(", "))
_LINE, _TITLE, _ORD, _SEQ = (RAW_COLUMNS.index(c) for c in ("line", "title", "rule_ord", "emit_seq"))


class EarliestFinding(StatefulProcessor):
    """Per (file, line, title): the finding of the earliest scanner and rule so far, handed on when its time is over.

    Calls and state accesses cost far more than rows, so the findings of ``BLOCK_LINES`` lines of a file share a state: a row for each, with the time of
    its first arrival plus the delay as its ``due``. A timer at that time hands on what is due and drops it, so a row is held for the delay and no longer.
    """

    def __init__(self, event_time: str) -> None:
        self.columns = [*RAW_COLUMNS, event_time]
        held = ", ".join([*(f"{c}: {_KINDS[c]}" for c in RAW_COLUMNS), f"{event_time}: timestamp", "due: bigint"])
        self.schema = StructType.fromDDL(f"held array<struct<{held}>>")

    def init(self, handle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", self.schema)

    def _best(self) -> dict:
        if not self.held.exists():
            return {}
        return {(row[_LINE], row[_TITLE]): tuple(row) for row in self.held.get()[0]}

    def handleInputRows(self, key, rows, timerValues):
        best, first, pick = self._best(), {}, None
        for row in rows:
            # By position: a field's name would be searched for in every row.
            pick = pick or itemgetter(*(row.__fields__.index(c) for c in (*self.columns, "_due")))
            *mine, due = pick(row)
            place = mine[_LINE], mine[_TITLE]
            old = best.get(place)
            if old is None or place in first:
                first[place] = min(due, first.get(place, due))
            if old is None or (mine[_ORD], mine[_SEQ]) < (old[_ORD], old[_SEQ]):
                best[place] = (*mine, due if old is None else old[-1])
        for place, due in first.items():
            best[place] = (*best[place][:-1], due)
        if best:
            self.held.update((list(best.values()),))
        for due in set(first.values()):
            self.handle.registerTimer(due)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, best = expiredTimerInfo.getExpiryTimeInMs(), self._best()
        over = [row for row in best.values() if row[-1] <= now]
        rest = [row for row in best.values() if row[-1] > now]
        if rest:
            self.held.update((rest,))
        else:
            self.held.clear()
        shape = Row(*self.columns)
        for row in over:
            yield shape(*row[:-1])

    def close(self) -> None:
        pass


def stream_first_findings(findings: DataFrame, event_time: str, delay: str) -> DataFrame:
    """One finding per (file, line, title) of all scanners: that of the earliest scanner and rule within ``delay`` of the first arrival.

    The result is what the batch de-duplication gives if all copies arrive within the delay. A finding is handed on once the watermark has passed that
    time, so the last ones wait for later events.
    """
    spark = findings.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # An interval in days or less; its length is asked of Spark, which knows the units.
    delay_ms = spark.sql(f"SELECT unix_millis(timestamp'1970-01-01 00:00:00 UTC' + INTERVAL {delay}) AS ms").first().ms
    block, due = F.floor(F.col("line") / BLOCK_LINES).alias("_block"), (F.unix_millis(event_time) + delay_ms).alias("_due")
    keyed = findings.withWatermark(event_time, delay).select(*RAW_COLUMNS, event_time, due, block).groupBy("file", "_block")
    schema = ", ".join([*(f"{c} {_KINDS[c]}" for c in RAW_COLUMNS), f"{event_time} timestamp"])
    return keyed.transformWithState(EarliestFinding(event_time), schema, "Append", "EventTime")


def stream_trend(scans: DataFrame, delay: str, window: str = "1 day", slide: str | None = None) -> DataFrame:
    """Severity sums per day, or per sliding window. Use update or complete mode for a live view."""
    period = F.window("scanned_at", window, slide) if slide else F.window("scanned_at", window)
    sums = [F.sum(c).alias(c) for c in (*COUNTERS, "total")]
    return (scans.withWatermark("scanned_at", delay).groupBy(period)
            .agg(*sums, F.count(F.lit(1)).alias("scan_count"))
            .select(F.col("window.start").alias("window_start"), *COUNTERS, "total", "scan_count"))


def start_baseline_diff(findings: DataFrame, index: str, out: str, checkpoint: str, known: bool = False, **trigger) -> StreamingQuery:
    """Write the arriving findings that a stored baseline does not list, or does, to ``out``.

    ``index`` is a folder written by ``write_baseline_index``. A micro-batch is stored, then joined with the shards of the index that its files fall
    in; nothing of the baseline is computed again. A batch that runs twice replaces what it wrote.
    """
    def diff(batch: DataFrame, number: int) -> None:
        found = match_baseline_index(stored(batch, "arrived"), index, known)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return findings.writeStream.foreachBatch(diff).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"})).start()
