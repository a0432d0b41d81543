"""Views of the given tables as the model's events, runs, memories, embeddings, queries, turns, verdicts and claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalog.functions.text import BETWEEN_WORDS
from stratalog.operators.events import assign_seq


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    k = F.col("k").cast("string")
    payload = (
        F.when(F.col("event_type") == "signup", F.concat(F.lit('{"kind":"state","entity":"user","predicate":"p'), (F.col("k") % 5).cast("string"), F.lit('","value":'), k, F.lit("}")))
        .when(F.col("event_type") == "error", F.concat(F.lit('{"kind":"log","k":'), k, F.lit("}")))
        .when(F.col("event_type") == "view", F.lit('{"kind":"heartbeat"}'))
        .when(F.col("event_type") == "click", F.concat(F.lit('{"note":"Clicked item '), (F.col("k") % 20).cast("string"), F.lit('."}')))
        .otherwise(F.concat(F.lit('{"claim":{"entity":"item'), (F.col("k") % 10).cast("string"), F.lit('","predicate":"price","value":'), k, F.lit("}}")))
    )
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("project_id"), F.col("user_id").cast("string").alias("run_id"),
        F.col("event_type").alias("agent_id"), F.col("ts").alias("created_at"), "k", payload.alias("payload"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_seq(raw_events(spark, sf_dir))


def runs(spark: SparkSession, sf_dir: str, numbered: DataFrame | None = None) -> DataFrame:
    """Runs of the events, or of `numbered`, which are those events where a job holds them already."""
    heads = (events(spark, sf_dir) if numbered is None else numbered).groupBy("project_id", "run_id").agg(F.max("seq").alias("last_seq"))
    return heads.withColumn("covered_seq", F.floor(F.col("last_seq") * 0.25).cast("long"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    kind = F.element_at(F.array(F.lit("semantic"), F.lit("episodic"), F.lit("procedural")), (F.col("doc_id") % 3 + 1).cast("int"))
    created = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).cast("timestamp_ntz")
    return d.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("p"), (F.col("doc_id") % 3).cast("string")).alias("project_id"), kind.alias("kind"), F.col("text").alias("content"),
        F.array(F.concat(F.lit("src:"), "source"), F.concat(F.lit("lang:"), "lang")).alias("scope_keys"),
        F.when(F.col("toxic") == 1, "quarantine").otherwise("normal").alias("trust_tier"), created.alias("created_at"),
        F.when(F.col("doc_id") % 17 == 0, created).alias("valid_to"), F.lit(None).cast("long").alias("superseded_by"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    project = F.concat(F.lit("p"), (F.col("vec_id") % 3).cast("string"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("memory_id"), project.alias("project_id"), F.lit("m1").alias("model_id"), F.col("embedding").alias("vec"))


def search_queries(spark: SparkSession, sf_dir: str, words: int = 3) -> DataFrame:
    """The stated query set: every memory whose id is divisible by 20 asks in its project with its own vector and its
    first long words, every second of them for one scope only. Every fifth of them asks for the first word or all
    others, and every fifth for the first without the second."""
    long_words = F.slice(F.filter(F.split(F.lower("text"), BETWEEN_WORDS), lambda w: F.length(w) > 5), 1, words)
    held = F.col("held")
    others = F.array_join(F.slice(held, 2, words), " ")
    asked_text = F.when(F.col("doc_id") % 100 == 0, F.concat_ws(" or ", F.get(held, 0), F.when(others != "", others)))
    asked_text = asked_text.when(F.col("doc_id") % 100 == 40, F.concat_ws(" -", F.get(held, 0), F.get(held, 1))).otherwise(F.array_join(held, " "))
    asked = embeddings(spark, sf_dir).where("memory_id % 20 = 0").withColumnRenamed("memory_id", "query_id")
    # The words of a text are found once, and not for each place where they are named.
    text = table(spark, sf_dir, "documents").where("doc_id % 20 = 0").select("doc_id", long_words.alias("held")).select(F.col("doc_id").alias("query_id"), asked_text.alias("text"))
    scopes = F.when(F.col("query_id") % 40 == 20, F.array(F.lit("lang:en"))).otherwise(F.array().cast("array<string>"))
    return asked.join(text, "query_id").withColumn("scopes", scopes)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", "role", "text")


def verdicts(spark: SparkSession, sf_dir: str, trials: int = 3) -> DataFrame:
    l = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    l = l.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    flip = (F.col("doc_id") + F.col("trial")) % 7 == 0
    question = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 10 == 0, "_abs").otherwise(""))
    correct = F.when(flip, 1 - F.col("quality")).otherwise(F.col("quality")).cast("int")
    return l.select(F.lit("own").alias("system"), F.lit("answer").alias("protocol"), "trial", question.alias("question_id"), F.col("source").alias("question_type"), correct.alias("correct"))


def twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector, and a twin of length 1 whose first 12 components are 0."""
    e = table(spark, sf_dir, "embeddings")
    cut = F.transform("embedding", lambda x, i: F.when(i < 12, F.lit(0.0)).otherwise(x.cast("double")))
    norm = F.sqrt(F.aggregate(cut, F.lit(0.0), lambda s, x: s + x * x))
    twin = e.select((F.col("vec_id") + 1_000_000).alias("id"), (F.col("vec_id") % 50).alias("bucket"), F.transform(cut, lambda x: x / norm).alias("vec"))
    return e.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 50).alias("bucket"), F.transform("embedding", lambda x: x.cast("double")).alias("vec")).unionByName(twin)
