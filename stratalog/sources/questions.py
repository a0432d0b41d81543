"""Evaluation questions from nested JSON, and turns as events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "question_id string, question_type string, question string, answer string, question_date string, haystack_session_ids array<string>, "
    "haystack_dates array<string>, haystack_sessions array<array<struct<role:string,content:string,has_answer:boolean>>>"
)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path)


def load_questions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions, and their turns (question_id, session_no, session_id, date, turn, role, content).

    Missing session ids are session_0, session_1, ...; missing dates are empty; lists of other lengths are an error.
    """
    n = F.size("haystack_sessions")
    ids = F.coalesce("haystack_session_ids", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("session_"), i.cast("string"))))
    dates = F.coalesce("haystack_dates", F.array_repeat(F.lit(""), n))
    rows = rows.withColumns({"_ids": ids, "_dates": dates}).where(F.assert_true((F.size("_ids") == n) & (F.size("_dates") == n), "session lists of unequal length").isNull())
    sessions = rows.select("question_id", F.posexplode(F.arrays_zip("_ids", "_dates", "haystack_sessions")).alias("session_no", "s"))
    turns = sessions.select("question_id", "session_no", F.col("s._ids").alias("session_id"), F.col("s._dates").alias("date"), F.posexplode("s.haystack_sessions").alias("turn", "t"))
    return rows.drop("_ids", "_dates"), turns.select("question_id", "session_no", "session_id", "date", "turn", "t.role", "t.content", "t.has_answer")


def turns_to_events(turns: DataFrame) -> DataFrame:
    """payload `[date] role: content` (no date: without brackets), the role as agent, in order of session and turn."""
    date = F.when(F.coalesce(F.col("date"), F.lit("")) == "", "").otherwise(F.concat(F.lit("["), "date", F.lit("] ")))
    return turns.withColumns({"payload": F.concat(date, "role", F.lit(": "), "content"), "agent_id": F.col("role")})
