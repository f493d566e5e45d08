"""Structured Streaming flow (T1-T5): the batch operators on whole requests, and a live monitor."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestamp.operators.inventory import entries, pattern
from lodestamp.operators.matching import identify
from lodestamp.sources.lineage import materialize
from lodestamp.sources.tables import append_log

log = logging.getLogger(__name__)
FLOOR_SECONDS = 5.0  # fixed value: versions aren't asked for more often
REQUEST = "request_id long, variant_ord int, line_ord int, text string, confidence double, ts timestamp"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Snapshot:
    """Entries and pattern of the inventory under a version pointer.

    ``version`` is asked at most every ``interval`` seconds (5 at least); ``read`` only when it answers something new. What is read is written to tables of the
    session's catalogue, as a whole, before it takes the place of the former one, whose tables go with the next change: a batch that still reads
    them ends undisturbed. If asking, reading or writing fails, the last good version stays and the failure is logged; without a good one it is raised.
    """

    def __init__(self, spark: SparkSession, version: Callable[[], str], read: Callable[[str], DataFrame], interval: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.spark, self.version, self.read, self.interval, self.clock = spark, version, read, max(interval, FLOOR_SECONDS), clock
        self.held, self.asked, self.tables, self.former = None, None, None, None

    def current(self) -> tuple[DataFrame, DataFrame]:
        """(entries, pattern)."""
        if self.asked is None or self.clock() - self.asked >= self.interval:
            self.asked = self.clock()
            try:
                version = self.version()
                if self.tables is None or version != self.held:
                    self.swap(version)
            except Exception:
                if self.tables is None:
                    self.asked = None
                    raise
                log.warning("the inventory couldn't be refreshed; version %s stays", self.held, exc_info=True)
        return self.spark.table(self.tables[0]), self.spark.table(self.tables[1])

    def swap(self, version: str) -> None:
        inventory, name = materialize(self.read(version)), uuid.uuid4().hex
        new = (f"inventory_entries_{name}", f"inventory_pattern_{name}")
        try:
            entries(inventory, ()).write.saveAsTable(new[0])
            pattern(inventory).write.saveAsTable(new[1])
        except Exception:
            self.drop(new)
            raise
        self.drop(self.former)
        self.former, self.tables, self.held = self.tables, new, version

    def drop(self, tables: tuple[str, str] | None) -> None:
        for t in tables or ():
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")


class Gather(StatefulProcessor):
    """Holds a request's rows until none has come for ``wait`` (in milliseconds of event time), then hands them all on. A row that repeats counts once (T4)."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "variant_ord int, line_ord int", "text string, confidence double, ts timestamp")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.due.get()[0] if self.due.exists() else None
        due = last
        for pdf in rows:
            for r in pdf.itertuples():
                place = (int(r.variant_ord), int(r.line_ord))
                if not self.rows.containsKey(place):
                    self.rows.updateValue(place, (None if pd.isna(r.text) else r.text, None if pd.isna(r.confidence) else float(r.confidence), r.ts.to_pydatetime()))
            due = max(due or 0, int(pdf["ts"].max().timestamp() * 1000) + self.wait)
        if due != last:
            if last is not None:
                self.handle.deleteTimer(last)
            self.handle.registerTimer(due)
            self.due.update((due,))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = [(key[0], *place, *value) for place, value in self.rows.iterator()]
        self.rows.clear()
        self.due.clear()
        yield pd.DataFrame(found, columns=["request_id", "variant_ord", "line_ord", "text", "confidence", "ts"])

    def close(self) -> None:
        pass


def whole_requests(readings: DataFrame, wait: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """The rows of each request at once, as soon as the watermark says that none has come for ``wait``, from however many micro-batches.

    Rows behind the watermark are dropped. A request that pauses for longer than ``late`` and ``wait`` is two. The state lies in RocksDB, so it may be larger than memory.
    """
    readings.sparkSession.conf.set(STORE, ROCKS)
    millis = int(pd.Timedelta(wait).total_seconds() * 1000)
    rows = readings.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in REQUEST.split(", ")]).withWatermark("ts", late)
    return rows.groupBy("request_id").transformWithStateInPandas(Gather(millis), REQUEST, "Append", "EventTime")


def once_per_request(readings: DataFrame, late: str = "10 minutes") -> DataFrame:
    """T4: a row that repeats within the watermark is dropped."""
    return readings.withWatermark("ts", late).dropDuplicatesWithinWatermark(["request_id", "variant_ord", "line_ord"])


def identify_stream(readings: DataFrame, snapshot: Snapshot, log_path: str, checkpoint: str, wait: str = "30 seconds", late: str = "10 minutes", **trigger) -> StreamingQuery:
    """Whole requests go through the batch cascade and its answers to the log, by day and batch, so that a repeated batch replaces itself and retention finds its days."""

    def batch(df: DataFrame, n: int) -> None:
        rows = materialize(df.withColumnRenamed("request_id", "image_id"))
        if rows.isEmpty():
            return
        answers = identify(rows, *snapshot.current())
        append_log(answers.join(rows.groupBy("image_id").agg(F.min("ts").alias("ts")), "image_id"), log_path, str(n))

    writer = whole_requests(readings, wait, late).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def monitor(answers: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """T5: answers per status and window, tumbling or sliding; works on streams and tables alike. answers: ts, status."""
    rows = answers.withWatermark("ts", late) if answers.isStreaming else answers
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return rows.groupBy(w.alias("w"), "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "status", "n")


def late_rows(answers: DataFrame, late: str = "10 minutes") -> DataFrame:
    """T5: how many rows of a batch are older than the watermark that its newest row sets, per status. answers: ts, status."""
    newest = answers.agg(F.max("ts").alias("newest"))
    dated = answers.crossJoin(F.broadcast(newest)).withColumn("is_late", F.col("ts") < F.col("newest") - F.expr(f"INTERVAL {late}"))
    return dated.groupBy("status").agg(F.sum(F.col("is_late").cast("long")).alias("n_late"), F.count("*").alias("n"))


LATE_PARTS = 16


def late_on_stream(answers: DataFrame, late: str = "10 minutes") -> DataFrame:
    """T5 on a running stream: (status, part, n, n_late), the rows so far and those that came behind the watermark of their micro-batch, which windows drop. answers: ts, status.

    A status is counted in ``LATE_PARTS`` parts, so that a common one doesn't meet in a task; readers add the newest row of each part. For the update mode.
    """

    def count(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, behind = state.get if state.exists else (0, 0)
        mark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        for pdf in batches:
            n, behind = n + len(pdf), behind + int((pdf["ts"] < mark).sum())
        state.update((n, behind))
        yield pd.DataFrame({"status": [key[0]], "part": [key[1]], "n": [n], "n_late": [behind]})

    rows = answers.select("ts", "status", F.pmod(F.xxhash64("ts"), F.lit(LATE_PARTS)).cast("int").alias("part")).withWatermark("ts", late)
    grouped = rows.groupBy("status", "part")
    return grouped.applyInPandasWithState(count, "status string, part int, n long, n_late long", "n long, n_late long", "update", GroupStateTimeout.NoTimeout)


def read_rows(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)
