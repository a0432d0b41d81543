"""Structured Streaming drivers of the write side. State and outputs live under paths that all executors share.

Exactly once: a batch writes its outputs under its own batch_id, then one commit row; readers take only batches
that have one, and a batch that is run again after a failure overwrites its own folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from stratalog.operators.events import WINDOW_EVENTS, upsert_working_facts

FACT_KEY = "project_id string, run_id string, entity string, predicate string"
FACT = FACT_KEY + ", value string, seq long, agent_id string"


def _found(read: Callable[[], DataFrame], otherwise: DataFrame) -> DataFrame:
    """What `read` gives, or `otherwise` where nothing was written yet."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return otherwise


def _batches(spark: SparkSession, path: str) -> DataFrame:
    """The ids of all committed batches."""
    none = spark.createDataFrame([], "batch_id long")
    return _found(lambda: spark.read.schema("batch_id long").json(f"{path}/commits"), none).select("batch_id").distinct()


def _snapshot(spark: SparkSession, path: str, name: str) -> int | None:
    """The last batch that the newest snapshot of an output holds."""
    none = spark.createDataFrame([], "upto long")
    return _found(lambda: spark.read.schema("upto long").json(f"{path}/snapshots/{name}"), none).agg(F.max("upto")).first()[0]


def committed(spark: SparkSession, path: str, name: str, schema: str, last: int | None = None) -> DataFrame:
    """Rows of all committed batches of one output, up to batch `last` where it is given; its newest snapshot stands
    for those that it holds, and their folders are not read."""
    upto = _snapshot(spark, path, name)
    wanted = F.col("batch_id") > (-1 if upto is None else upto)
    if last is not None:
        wanted &= F.col("batch_id") <= last
    batches = _batches(spark, path).where(wanted)
    if upto is not None:
        batches = batches.unionByName(spark.createDataFrame([(-1 - upto,)], "batch_id long"))
        wanted |= F.col("batch_id") == -1 - upto
    none = spark.createDataFrame([], f"{schema}, batch_id long")
    rows = _found(lambda: spark.read.schema(f"{schema}, batch_id long").parquet(f"{path}/{name}"), none)
    return rows.where(wanted).join(batches, "batch_id", "left_semi").drop("batch_id")


def compact(spark: SparkSession, path: str, name: str, schema: str, fold: Callable[[DataFrame], DataFrame]) -> int | None:
    """Writes `fold` of all committed rows of an output as a snapshot, and then the row that makes it count; the last
    batch that the snapshot holds, or null if nothing is committed.

    `fold` of its own result and later rows must be that of all rows. A run that fails leaves the state as it was. The
    folders of batches that a snapshot holds may be deleted once no older reader runs.
    """
    upto = _batches(spark, path).agg(F.max("batch_id")).first()[0]
    if upto is None or upto == _snapshot(spark, path, name):
        return upto
    # A batch that commits meanwhile is no part of the snapshot; it is read beside it.
    fold(committed(spark, path, name, schema, upto)).write.mode("overwrite").parquet(f"{path}/{name}/batch_id={-1 - upto}")
    spark.range(1, numPartitions=1).select(F.lit(upto).cast("long").alias("upto")).write.mode("append").json(f"{path}/snapshots/{name}")
    return upto


def write_batches(stream: DataFrame, path: str, checkpoint: str, make: Callable[[DataFrame], dict[str, DataFrame]]) -> StreamingQuery:
    """Runs `make` on each micro-batch and commits its outputs together."""

    def one(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            rows = batch.count()
            for name, df in make(batch).items():
                df.write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")
            commit = batch.sparkSession.range(1, numPartitions=1).select(F.lit(batch_id).cast("long").alias("batch_id"), F.lit(rows).cast("long").alias("rows"))
            commit.write.mode("append").json(f"{path}/commits")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_working_state(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The newest value of each subject: each batch's best rows are appended, and readers take the best of them."""
    return write_batches(stream, path, checkpoint, lambda batch: {"facts": upsert_working_facts(batch)})


def working_state(spark: SparkSession, path: str) -> DataFrame:
    return upsert_working_facts(committed(spark, path, "facts", FACT))


def compact_working_state(spark: SparkSession, path: str) -> int | None:
    return compact(spark, path, "facts", FACT, upsert_working_facts)


def stream_consolidate(stream: DataFrame, path: str, checkpoint: str, make: Callable[[DataFrame], dict[str, DataFrame]], limit: int = WINDOW_EVENTS) -> StreamingQuery:
    """Outputs of the passes and the marks of their runs (the highest seq read), in one commit.

    `make` gets the events with pass_no: a pass holds at most `limit` events of a run, in order, and what a batch
    brings beyond that is in its later passes.
    """

    def with_marks(batch: DataFrame) -> dict[str, DataFrame]:
        nth = F.row_number().over(Window.partitionBy("run_id").orderBy("seq"))
        return make(batch.withColumn("pass_no", F.ceil(nth / limit).cast("int"))) | {"marks": batch.groupBy("run_id").agg(F.max("seq").alias("covered_seq"))}

    return write_batches(stream, path, checkpoint, with_marks)


MARK = "run_id string, covered_seq long"


def _highest(marks: DataFrame) -> DataFrame:
    return marks.groupBy("run_id").agg(F.max("covered_seq").alias("covered_seq"))


def covered_marks(spark: SparkSession, path: str) -> DataFrame:
    return _highest(committed(spark, path, "marks", MARK))


def compact_marks(spark: SparkSession, path: str) -> int | None:
    return compact(spark, path, "marks", MARK, _highest)


def live_freshness(stream: DataFrame) -> DataFrame:
    """The oldest uncovered event (run_id, seq, created_at) of each run, updated as events arrive."""
    return stream.groupBy("run_id").agg(F.min_by("created_at", "seq").alias("oldest"), F.count("*").alias("pending"))


class Debounce(StatefulProcessor):
    """A run fires when it has `most` pending events, or nothing came for `idle_ms`; a burst is one pass."""

    def __init__(self, most: int, idle_ms: int):
        self.most, self.idle_ms = most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = (self.pending.get()[0] if self.pending.exists() else 0) + sum(len(r) for r in rows)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if n >= self.most:
            self.pending.clear()
            yield pd.DataFrame({"run_id": [key[0]], "events": [n]})
        else:
            self.pending.update((n,))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
            yield pd.DataFrame({"run_id": pd.Series(dtype="object"), "events": pd.Series(dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n = self.pending.get()[0] if self.pending.exists() else 0
        self.pending.clear()
        yield pd.DataFrame({"run_id": [key[0]] if n else pd.Series(dtype="object"), "events": [n] if n else pd.Series(dtype="int64")})

    def close(self) -> None:
        pass


def debounce(stream: DataFrame, most: int = 20, idle_ms: int = 2000) -> DataFrame:
    """run_id and events of each pass that is due. Needs the RocksDB state store."""
    return stream.groupBy("run_id").transformWithStateInPandas(statefulProcessor=Debounce(most, idle_ms), outputStructType="run_id string, events long", outputMode="update", timeMode="ProcessingTime")


def submit_windows(windows: DataFrame, submit: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """First phase of the economy mode: run_id, handle and the seq that the window covers."""
    whole = windows.groupBy("run_id").agg(F.max("seq").alias("covered_seq"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "payload"))), lambda e: e["payload"]), "\n").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["run_id", "covered_seq"]].assign(handle=submit(batch["text"]))

    return whole.mapInPandas(run, "run_id string, covered_seq long, handle string")


def collect_windows(pending: DataFrame, results: DataFrame, events: DataFrame) -> DataFrame:
    """Second phase: results (handle, source_seq, content) of pending windows, up to the seq that was submitted."""
    return results.join(pending, "handle").where("source_seq <= covered_seq").join(events.select("run_id", F.col("seq").alias("source_seq"), "agent_id"), ["run_id", "source_seq"], "left_semi")
