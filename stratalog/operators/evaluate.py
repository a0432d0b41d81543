"""Question-answering evaluation: accuracy over trials, gates, caches, prompts, subsets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOOR, MARGIN, MOST_STD_POINTS = 0.70, 0.10, 2.0
KEYS = ["system", "protocol"]
#: Fixed value: the answering prompt.
ANSWER_PROMPT = "Today's date is %s.\n\n%s\n\nQuestion: %s"
#: Question types that share the plain grading template; the others have their own.
TEMPLATE_OF = {
    "single-session-user": "default", "single-session-assistant": "default", "multi-session": "default",
    "temporal-reasoning": "temporal", "knowledge-update": "update", "single-session-preference": "preference",
}
SUFFIX = "_abs"


def is_abstention(question_id: Column) -> Column:
    return question_id.endswith(SUFFIX)


def recall_only(rows: DataFrame) -> DataFrame:
    return rows.where(~is_abstention(F.col("question_id")))


def _mean_std(trials: DataFrame, *keys: str) -> DataFrame:
    return trials.groupBy(*keys).agg(
        F.avg("accuracy").alias("mean"), F.coalesce(F.stddev_samp("accuracy"), F.lit(0.0)).alias("std"),
        F.min_by("n", "trial").alias("n"), F.count("*").alias("trials"),
    )


def accuracy(verdicts: DataFrame) -> DataFrame:
    """Mean and sample deviation over trials of the share of correct verdicts; std is 0 for one trial."""
    trials = verdicts.groupBy(*KEYS, "trial").agg(F.avg("correct").alias("accuracy"), F.count("*").alias("n"))
    return _mean_std(trials, *KEYS)


def accuracy_by_type(verdicts: DataFrame) -> DataFrame:
    """The same per question type; a type that a trial lacks counts as 0 there."""
    recall = recall_only(verdicts)
    found = recall.groupBy(*KEYS, "question_type", "trial").agg(F.avg("correct").alias("accuracy"), F.count("*").alias("n"))
    every = recall.select(*KEYS, "trial").distinct().join(recall.select(*KEYS, "question_type").distinct(), KEYS)
    trials = every.join(found, [*KEYS, "question_type", "trial"], "left").withColumns({"accuracy": F.coalesce("accuracy", F.lit(0.0)), "n": F.coalesce("n", F.lit(0))})
    return _mean_std(trials, *KEYS, "question_type")


def eval_report(verdicts: DataFrame) -> DataFrame:
    """Lines overall, abstention and one per type."""
    overall = accuracy(recall_only(verdicts)).withColumn("line", F.lit("overall"))
    abstention = accuracy(verdicts.where(is_abstention(F.col("question_id")))).withColumn("line", F.lit("abstention"))
    by_type = accuracy_by_type(verdicts).withColumn("line", F.concat(F.lit("type:"), "question_type")).drop("question_type")
    return overall.unionByName(abstention).unionByName(by_type).select(*KEYS, "line", "mean", "std", "n", "trials")


def variance_gate(report: DataFrame, most: float = MOST_STD_POINTS) -> DataFrame:
    return report.withColumn("gate", F.col("std") * 100 <= most)


def leaderboard(report: DataFrame) -> DataFrame:
    """One row per system: deviation and mean under each protocol."""
    overall = report.where("line = 'overall'")
    pick = lambda p, c: F.max(F.when(F.col("protocol") == p, F.col(c)))
    return overall.groupBy("system").agg(
        pick("answer", "mean").alias("answer_mean"), pick("answer", "std").alias("answer_std"), (pick("answer", "std") * 100 <= MOST_STD_POINTS).alias("answer_gate"), pick("pipeline", "std").alias("pipeline_std")
    )


def baseline_decision(measured: DataFrame, locked: DataFrame, floor: float = FLOOR, margin: float = MARGIN) -> DataFrame:
    """measured: universe, system, is_reference, accuracy. locked: universe, reference. The reference system locks a
    universe once if its accuracy is sane; others are held against the reference, the one just locked included."""
    rows = measured.join(locked.select("universe", "reference"), "universe", "left")
    fresh = measured.where(F.col("is_reference") & (F.col("accuracy") >= floor)).groupBy("universe").agg(F.max("accuracy").alias("fresh"))
    rows = rows.join(fresh, "universe", "left").withColumn("base", F.coalesce("reference", "fresh"))
    outcome = (
        F.when(F.col("is_reference"), F.when(F.col("reference").isNotNull(), "already_locked").when(F.col("accuracy") >= floor, "locked").otherwise("not_locked_sanity"))
        .when(F.col("base").isNull(), "no_baseline")
        .when(F.col("accuracy") >= F.col("base") - margin - 1e-12, "gate_pass")
        .otherwise("gate_fail")
    )
    shown = F.when(F.col("is_reference") & F.col("reference").isNull() & (F.col("accuracy") < floor), F.lit(None)).otherwise(F.col("base"))
    return rows.select("universe", "system", outcome.alias("outcome"), "accuracy", shown.alias("reference"))


def grading_template(question_id: Column, question_type: Column) -> Column:
    """Which template grades a question; null for an unknown type, which is an error of the row."""
    chain = F.when(is_abstention(question_id), "abstention")
    for kind, name in TEMPLATE_OF.items():
        chain = chain.when(question_type == kind, name)
    return chain


def answer_prompt(date: Column, context: Column, question: Column) -> Column:
    return F.format_string(ANSWER_PROMPT, date, context, question)


def parse_verdict(raw: Column) -> Column:
    return F.lower(raw).contains("yes")


def answer_hash(answer: Column) -> Column:
    return F.sha2(answer, 256)


CACHE_KEY = ["question_id", "answer_hash", "judge_model", "rubric_version", "variant"]


def judge_cache_split(answers: DataFrame, cache: DataFrame) -> DataFrame:
    """hit: whether the decision is known."""
    known = cache.select(*CACHE_KEY, "correct").dropDuplicates(CACHE_KEY).withColumn("_hit", F.lit(True))
    return answers.join(known, CACHE_KEY, "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def score_answers(answers: DataFrame, cache: DataFrame, judge: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """New decisions, for what the cache lacks: the key columns and correct."""
    misses = answers.join(cache.select(*CACHE_KEY), CACHE_KEY, "left_anti").select(*CACHE_KEY, "prompt").dropDuplicates(CACHE_KEY)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[CACHE_KEY].assign(correct=judge(batch["prompt"]).str.lower().str.contains("yes"))

    return misses.mapInPandas(run, "question_id string, answer_hash string, judge_model string, rubric_version string, variant string, correct boolean")


def variance_trials(questions: DataFrame, n: int, protocol: str = "answer") -> DataFrame:
    """n trials of each question, with the trial in the cache key so that each is judged anew. Under the protocol answer
    all trials share one context; under pipeline each trial builds its own (context_trial)."""
    trial = F.col("trial")
    out = questions.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out.withColumns({"protocol": F.lit(protocol), "variant": F.concat(F.lit("t"), trial.cast("string")), "context_trial": F.lit(0) if protocol == "answer" else trial})


def resume(questions: DataFrame, done: DataFrame) -> DataFrame:
    return questions.join(done.select("question_id").distinct(), "question_id", "left_anti")


def run_cost_stats(calls: DataFrame) -> DataFrame:
    """Per stage and mode: calls, cache hits, estimated tokens (a quarter of the characters)."""
    tokens = F.floor(F.char_length("prompt") / 4).cast("long")
    return calls.groupBy("stage", "mode").agg(F.count("*").alias("calls"), F.sum(F.col("hit").cast("int")).alias("cache_hits"), F.sum(tokens).alias("tokens"))


def cost_plan(turns: DataFrame, trials: int) -> DataFrame:
    """Turns to take in, and calls to answer and to judge."""
    per = turns.groupBy().agg(F.count("*").alias("turns"), F.count_distinct("session").alias("questions"))
    return per.select("turns", (F.col("questions") * trials).alias("answer_calls"), (F.col("questions") * trials).alias("judge_calls"))


def stratified_subset(questions: DataFrame, n: int) -> DataFrame:
    """n questions, of each type its share, by id; the rounding is made up by id."""
    by_type = Window.partitionBy("question_type")
    rows = questions.withColumn("_nth", F.row_number().over(by_type.orderBy("question_id"))).withColumn("_group", F.count("*").over(by_type))
    total = questions.count()
    rows = rows.withColumn("_picked", F.col("_nth") <= F.bround(n * F.col("_group") / F.lit(total)))
    return rows.orderBy(F.desc("_picked"), "question_id").limit(n).select(*questions.columns)
