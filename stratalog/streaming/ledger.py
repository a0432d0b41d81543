"""Economy mode: windows are submitted to a slow extractor, and collected when it is done.

The ledger of a path holds what was submitted. A window's key names its run and its first and last seq, so a submit
that is repeated, by a task that is tried again or by a job that is run again, asks under the same key, and a run with
a window in flight has no second one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalog.operators.events import WINDOW_EVENTS

from .commits import commit_pass, guarded_marks

SENT = "key string, run_id string, expected_seq long, covered_seq long, handle string"
CLOSED = "key string, handle string, outcome string"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def in_flight(spark: SparkSession, path: str) -> DataFrame:
    """Windows that were submitted and neither collected nor given up, one row for each key."""
    sent = _table(spark, f"{path}/sent", SENT).groupBy("key", "run_id", "expected_seq", "covered_seq").agg(F.min("handle").alias("handle"))
    return sent.join(_table(spark, f"{path}/closed", CLOSED), ["key", "handle"], "left_anti")


def submit(events: DataFrame, path: str, send: Callable[[pd.Series, pd.Series], pd.Series], *, base: DataFrame | None = None, window: int = WINDOW_EVENTS) -> DataFrame:
    """Submits the first `window` uncovered events (run_id, seq, payload) of each run without a window in flight;
    `send` gets keys and texts, and gives a handle for each, the same one for the same key. The windows in flight."""
    spark = events.sparkSession
    marks = guarded_marks(spark, path, base).withColumnRenamed("covered_seq", "expected_seq")
    open_ = events.join(marks, "run_id", "left").withColumn("expected_seq", F.coalesce("expected_seq", F.lit(0))).where(F.col("seq") > F.col("expected_seq"))
    open_ = open_.join(in_flight(spark, path).select("run_id"), "run_id", "left_anti")
    nth = F.row_number().over(Window.partitionBy("run_id").orderBy("seq"))
    lines = F.array_sort(F.collect_list(F.struct("seq", "payload")))
    whole = open_.withColumn("_nth", nth).where(F.col("_nth") <= window).groupBy("run_id", "expected_seq").agg(F.max("seq").alias("covered_seq"), F.array_join(F.transform(lines, lambda e: e["payload"]), "\n").alias("text"))
    # A window that was given up is sent under a key of its own.
    given_up = _table(spark, f"{path}/closed", CLOSED).where("outcome = 'failed'").groupBy("key").agg(F.count("*").alias("_times"))
    whole = whole.withColumn("_key", F.concat_ws(":", "run_id", "expected_seq", "covered_seq")).join(given_up.withColumnRenamed("key", "_key"), "_key", "left")
    whole = whole.withColumn("key", F.when(F.col("_times").isNull(), F.col("_key")).otherwise(F.concat_ws(":", "_key", "_times")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["key", "run_id", "expected_seq", "covered_seq"]].assign(handle=list(send(batch["key"], batch["text"])))

    # Output of tasks that fail is never committed, so each key that is written has the handle of one whole try.
    sent = whole.select("key", "run_id", F.col("expected_seq").cast("long"), F.col("covered_seq").cast("long"), "text").mapInPandas(run, SENT)
    sent.write.mode("append").parquet(f"{path}/sent")
    return in_flight(spark, path)


def collect(results: DataFrame, states: DataFrame, path: str, *, base: DataFrame | None = None) -> DataFrame:
    """Takes in what is done: states (handle, state: done, failed or running) and results (handle, source_seq, content).

    Results of a done window within its seqs are committed as `candidates` together with its mark, once; a window
    whose run has moved since is discarded. Events that came after the submit stay uncovered, and a failed window is
    open again. The runs that were committed.
    """
    spark = results.sparkSession
    pending = in_flight(spark, path).join(states, "handle").where("state <> 'running'").persist()
    try:
        if pending.isEmpty():
            return spark.createDataFrame([], "run_id string, covered_seq long")
        done = pending.where("state = 'done'")
        rows = results.join(done, "handle").where(F.col("source_seq").between(F.col("expected_seq") + 1, F.col("covered_seq"))).select("run_id", "source_seq", "content", "key")
        name = "collect-" + pending.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("key")), ","), 256)).first()[0][:32]
        found = commit_pass({"candidates": rows}, done.select("run_id", "expected_seq", "covered_seq"), path, name=name, base=base)
        closed = pending.select("key", "handle", F.when(F.col("state") == "done", "collected").otherwise("failed").alias("outcome"))
        closed.write.mode("append").parquet(f"{path}/closed")
        return found
    finally:
        pending.unpersist()
