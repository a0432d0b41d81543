"""Tables by project that are changed by copying only what changes.

The data of a project lie in one folder for each pass that wrote it; a numbered log tells which pass is a project's
current one. An upsert reads and writes the folders of its projects, and readers see a project before or after it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.streaming.commits import TRIES, CommitLog

#: Projects whose folders a scan is told by name, at most.
MOST_NAMED = 10_000
_VERSION = "project_id string, pass string, attempt long"


def _current(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """project_id, pass and attempt of each project's newest write."""
    log = CommitLog(spark, f"{path}/log")
    if not log.numbers():
        return spark.createDataFrame([], _VERSION)
    touched = spark.read.schema("project_id string, pass string").parquet(f"{path}/touched")
    rows = touched.join(F.broadcast(log.entries(upto)), "pass")  # one row for each write
    return rows.groupBy("project_id").agg(F.max_by(F.struct("pass", "attempt"), "number").alias("x")).select("project_id", "x.*")


def read_table(spark: SparkSession, path: str, schema: str, projects: DataFrame | None = None, upto: int | None = None) -> DataFrame:
    """The current rows, of some projects where they are given; `schema` has all columns, project_id among them.

    The folders to read are named to the scan where they are at most MOST_NAMED projects' ones; with more of them old
    folders are read too and drop out in the join."""
    current = _current(spark, path, upto)
    if projects is not None:
        current = current.join(projects.select("project_id").distinct(), "project_id", "left_semi")
    named = current.limit(MOST_NAMED + 1).collect()
    if not named:
        return spark.createDataFrame([], schema)
    others = ", ".join(c for c in map(str.strip, schema.split(", ")) if not c.startswith("project_id "))
    columns = [c.split()[0] for c in map(str.strip, schema.split(", "))]
    rows = spark.read.schema(f"{others}, pass string, attempt long, project_id string").parquet(f"{path}/data")
    if len(named) <= MOST_NAMED:
        rows = rows.where(F.col("project_id").isin([r.project_id for r in named]) & F.col("pass").isin(list({r["pass"] for r in named})))
    return rows.join(current, ["project_id", "pass", "attempt"], "left_semi").select(columns)


def upsert(new: DataFrame, path: str, schema: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
    """Replaces the rows of the projects in `new` by `merge(new, old)`; the number of the write. project_id is never null.

    A write that comes in between is taken into account: if it touched one of the projects, the merge is made anew.
    """
    spark, name = new.sparkSession, uuid.uuid4().hex
    log = CommitLog(spark, f"{path}/log")
    new.select("project_id").distinct().write.parquet(f"{path}/touched/pass={name}")
    projects = spark.read.schema("project_id string").parquet(f"{path}/touched/pass={name}")
    last = max(log.numbers(), default=-1)
    attempt = None
    for _ in range(TRIES):
        if attempt is None:
            attempt = last + 1
            old = read_table(spark, path, schema, projects, last)
            merge(new, old).write.mode("overwrite").partitionBy("project_id").parquet(f"{path}/data/pass={name}/attempt={attempt}")
        if log.put(last + 1, {"number": last + 1, "pass": name, "attempt": attempt}):
            return last + 1
        before, last = last, max(log.numbers())
        others = spark.read.schema("project_id string, pass string").parquet(f"{path}/touched").join(log.entries().where(F.col("number") > before), "pass")
        if not others.join(projects, "project_id", "left_semi").isEmpty():
            attempt = None
    raise RuntimeError(f"{TRIES} other writes came first")
