"""Structured Streaming: resumable appends, latest states, and runs of failures."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.prefix import shared_folder
from ..sources.io import append_new


def append_stream(stream: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's new keys to a JSON-lines folder. A batch that is run again adds nothing twice."""

    def add(batch: DataFrame, _: int) -> None:
        append_new(batch.dropDuplicates([key]), path, key)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_stream(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The newest value of each key (update or complete mode)."""
    return stream.groupBy(key).agg(F.max_by(value, order).alias(value))


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts per tumbling window and key, with late rows up to a watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))


def failure_streaks(stream: DataFrame, key: str, failed: str, order: str, limit: int) -> DataFrame:
    """key, streak, stopped after each batch: failures in a row, kept as state between batches; a success resets them."""
    kind = stream.schema[key].dataType.simpleString()

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, stopped = state.get if state.exists else (0, False)
        rows = pd.concat(list(batches)).sort_values(order)  # one key's rows of one batch
        for bad in rows[failed]:
            if stopped:
                break
            streak = streak + 1 if bad else 0
            stopped = streak >= limit
        state.update((streak, stopped))
        yield pd.DataFrame({key: [k[0]], "streak": [streak], "stopped": [stopped]})

    return stream.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, streak long, stopped boolean", "streak long, stopped boolean", "update", GroupStateTimeout.NoTimeout)


class _Sessions(StatefulProcessor):
    """Times of one key in runs without a pause longer than `gap` seconds; a timer ends the run that is open."""

    def __init__(self, key: str, gap: int) -> None:
        self.key, self.gap = key, gap * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.run = handle, handle.getValueState("run", "start long, stop long, n long")

    def _rows(self, key: tuple, runs: list[tuple]) -> pd.DataFrame:
        at = lambda i: pd.to_datetime([r[i] for r in runs], unit="ms")
        return pd.DataFrame({self.key: pd.Series([key[0]] * len(runs), dtype=object), "start": at(0), "stop": at(1), "n": [r[2] for r in runs]})

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        times = sorted(t for pdf in rows for t in pdf.iloc[:, -1].tolist())  # the last column: milliseconds, whose name does not arrive
        open_, ended = (self.run.get() if self.run.exists() else None), []
        for t in times:
            if open_ is not None and t - open_[1] > self.gap:
                ended.append(open_)
                open_ = None
            open_ = (t, t, 1) if open_ is None else (min(open_[0], t), max(open_[1], t), open_[2] + 1)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.run.update(open_)
        self.handle.registerTimer(open_[1] + self.gap + 1)
        yield self._rows(key, ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        ended = self.run.get()
        self.run.clear()
        yield self._rows(key, [ended])

    def close(self) -> None:
        pass


def sessions(stream: DataFrame, key: str, time: str, gap: int, late: int) -> DataFrame:
    """key, start, stop, n of runs of rows whose pauses are at most `gap` seconds; a run is given out once it has ended.

    A run ends when a later row of its key comes, or by a timer when the watermark (`late` seconds behind the newest row)
    has passed its last row by more than the gap. State holds one open run a key. Rows without key or time are left out;
    times count to the millisecond. The stream's session must keep state in RocksDB (see table_sessions).
    """
    kind = stream.schema[key].dataType.simpleString()
    known = stream.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn(time, F.col(time).cast("timestamp"))
    timed = known.withWatermark(time, f"{late} seconds").withColumn("_ms", F.unix_millis(time))
    return timed.select(key, time, "_ms").groupBy(key).transformWithStateInPandas(_Sessions(key, gap), f"{key} {kind}, start timestamp, stop timestamp, n long", "append", "eventTime")


def table_sessions(spark: SparkSession, path: str, schema: StructType, key: str, time: str, gap: int, late: int, checkpoint: str | None = None, output: str | None = None) -> DataFrame:
    """sessions() of all files below a Parquet path that are there now, as a batch table.

    `checkpoint` and `output` are folders that a later run goes on from: it reads the files that have come since, and the
    table grows by the runs that these end. Without them both are new ones in the shared folder.
    """
    base = f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}"
    checkpoint, output = checkpoint or f"{base}/checkpoint", output or f"{base}/output"
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    found = sessions(own.readStream.schema(schema).parquet(path), key, time, gap, late)
    found.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(output)
