"""Guarded commits: a pass counts only for runs whose mark is still where the pass found it.

A pass writes its outputs and marks under its own name, then one numbered entry of a log, which is put only if no entry
of that number exists. Before each try the marks of all earlier entries are compared with those that the pass started
from; runs that have moved are left out of the entry, so what the pass made of them is never read. Of two passes over
one window one counts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MARKS = "run_id string, expected_seq long, covered_seq long"
TRIES = 100


class CommitLog:
    """Numbered JSON entries in a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.jvm = spark, spark._jvm
        self.folder = self._path(path)
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.folder.getFileSystem(self.conf)

    def _path(self, *parts):
        return self.jvm.org.apache.hadoop.fs.Path(*parts)

    def numbers(self) -> list[int]:
        if not self.fs.exists(self.folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def put(self, number: int, entry: dict) -> bool:
        """Writes an entry unless there is one of this number; whole or not at all, as it is renamed into place."""
        draft = self._path(self.folder, f".{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.folder.toUri(), self.conf).rename(draft, self._path(self.folder, f"{number:020d}.json"), how)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            self.fs.delete(draft, False)
            return False

    def entries(self, upto: int | None = None) -> DataFrame:
        """number, pass and attempt of each entry, up to one where it is given."""
        schema = "number long, pass string, attempt long"
        if not self.numbers():
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).json(self.folder.toString())
        return rows if upto is None else rows.where(F.col("number") <= upto)


def _accepted(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """pass, run_id and covered_seq of what counts."""
    log = CommitLog(spark, f"{path}/log")
    if not log.numbers():
        return spark.createDataFrame([], "pass string, run_id string, covered_seq long")
    rows = spark.read.schema("run_id string, covered_seq long, pass string, attempt long").parquet(f"{path}/accepted")
    return rows.join(log.entries(upto).drop("number"), ["pass", "attempt"], "left_semi").select("pass", "run_id", "covered_seq")


def guarded_marks(spark: SparkSession, path: str, base: DataFrame | None = None, upto: int | None = None) -> DataFrame:
    """run_id and covered_seq of each run; `base` has the marks from before the log."""
    rows = _accepted(spark, path, upto).select("run_id", "covered_seq")
    rows = rows if base is None else rows.unionByName(base.select("run_id", "covered_seq"))
    return rows.groupBy("run_id").agg(F.max("covered_seq").alias("covered_seq"))


def guarded_rows(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """Rows of one output, of the runs and passes that count."""
    accepted = _accepted(spark, path)
    if accepted.isEmpty():
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, pass string").parquet(f"{path}/{name}")
    return rows.join(accepted, ["pass", "run_id"], "left_semi").drop("pass")


def commit_pass(outputs: dict[str, DataFrame], marks: DataFrame, path: str, *, name: str | None = None, base: DataFrame | None = None) -> DataFrame:
    """Commits outputs (each with run_id) and marks (run_id, expected_seq, covered_seq); the runs that count.

    A run counts if its mark is expected_seq; the others' rows are discarded with what belongs to them. `name` makes a
    repeated commit of one pass harmless: what was committed under it stands.
    """
    spark, name = marks.sparkSession, name or uuid.uuid4().hex
    log = CommitLog(spark, f"{path}/log")
    runs = spark.createDataFrame([], "run_id string, covered_seq long")
    if not log.entries().where(F.col("pass") == name).isEmpty():
        return _accepted(spark, path).where(F.col("pass") == name).select("run_id", "covered_seq")
    for key, df in outputs.items():
        df.write.mode("overwrite").parquet(f"{path}/{key}/pass={name}")
    marks.select("run_id", F.col("expected_seq").cast("long"), F.col("covered_seq").cast("long")).write.mode("overwrite").parquet(f"{path}/marks/{name}")
    marks = spark.read.schema(MARKS).parquet(f"{path}/marks/{name}")
    for _ in range(TRIES):
        last = max(log.numbers(), default=-1)
        now = guarded_marks(spark, path, base, last).withColumnRenamed("covered_seq", "_now")
        fits = marks.join(now, "run_id", "left").where(F.coalesce("_now", F.lit(0)) == F.col("expected_seq")).select("run_id", "covered_seq")
        attempt = f"{path}/accepted/pass={name}/attempt={last + 1}"
        fits.write.mode("overwrite").parquet(attempt)
        found = spark.read.schema("run_id string, covered_seq long").parquet(attempt)
        if found.isEmpty():
            return runs
        if log.put(last + 1, {"number": last + 1, "pass": name, "attempt": last + 1}):
            return found
    raise RuntimeError(f"{TRIES} other passes came first")


def stream_guarded(stream: DataFrame, path: str, checkpoint: str, make: Callable[[DataFrame], dict[str, DataFrame]], *, base: DataFrame | None = None, writer: str = "stream") -> StreamingQuery:
    """Runs `make` on the events (run_id, seq, ...) of each micro-batch that the marks don't cover, and commits its
    outputs guarded. Several streams, and passes beside them, may write one path; each needs a `writer` name."""

    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marks = guarded_marks(spark, path, base)
        fresh = batch.join(marks.withColumnRenamed("covered_seq", "expected_seq"), "run_id", "left").withColumn("expected_seq", F.coalesce("expected_seq", F.lit(0)))
        fresh = fresh.where(F.col("seq") > F.col("expected_seq")).persist()
        try:
            moved = fresh.groupBy("run_id", "expected_seq").agg(F.max("seq").alias("covered_seq"))
            commit_pass(make(fresh.drop("expected_seq")), moved, path, name=f"{writer}-{batch_id}", base=base)
        finally:
            fresh.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
