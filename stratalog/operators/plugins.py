"""Places for user functions: extractors, embedders, adjudicators, answerers. Each gets whole Arrow batches or one keyed
group at a time, on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions.text import normalize_query, query_hash

CANDIDATE = "run_id string, pass_no int, source_seq long, kind string, content string"


def extract_with(windows: DataFrame, extract: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Candidates of each pass (run_id, pass_no, seq, payload): a pass is a bounded window, given in order of seq."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq")
        return extract(part).assign(run_id=part["run_id"].iat[0], pass_no=part["pass_no"].iat[0])[["run_id", "pass_no", "source_seq", "kind", "content"]]

    return windows.select("run_id", "pass_no", "seq", "payload").groupBy("run_id", "pass_no").applyInPandas(run, CANDIDATE)


def embed_with(contents: DataFrame, embed: Callable[[pd.Series], np.ndarray], dim: int) -> DataFrame:
    """content and vec of each distinct text; a vector of another size is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vec = np.asarray(embed(batch["content"]), dtype=np.float32)
            if vec.shape != (len(batch), dim):
                raise ValueError(f"vectors of {vec.shape[1:]} in place of {dim}")
            yield pd.DataFrame({"content": batch["content"], "vec": list(vec)})

    return contents.select("content").distinct().mapInPandas(run, "content string, vec array<float>")


def query_vectors(queries: DataFrame, cache: DataFrame, embed: Callable[[pd.Series], np.ndarray], dim: int) -> tuple[DataFrame, DataFrame]:
    """query_id and vec of each query, and the new rows of the cache: only texts that it lacks are embedded.

    An entry of the cache is for a query_hash, and for a project_id, model_id and norm_version where both sides name
    them, so that no vector of another model or another way of normalising is served.
    """
    keys = ["query_hash", *[c for c in ("project_id", "model_id", "norm_version") if c in queries.columns and c in cache.columns]]
    asked = queries.withColumns({"content": normalize_query(F.col("text")), "query_hash": query_hash(F.col("text"))}).select("query_id", "content", *keys)
    missing = asked.join(cache, keys, "left_anti").select("content", *keys).distinct()
    fresh = missing.join(embed_with(missing, embed, dim), "content").select(*keys, "vec")
    return asked.join(cache.select(*keys, "vec").unionByName(fresh), keys).select("query_id", "vec"), fresh


def adjudicate_with(claims: DataFrame, resolve: Callable[[str, str], tuple[str, str]]) -> DataFrame:
    """The value that a rule of (current, incoming) leaves for each subject, and its last reason.

    The rule sees the claims of a subject in order, so a subject is one sorted stream; rules that can be stated as
    columns (last write, field merge) have their own operators and need no such stream.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, value, reason = None, None, None
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                key = (r.project_id, r.entity, r.predicate)
                if key != held:
                    if held:
                        out.append((*held, value, reason))
                    held, value, reason = key, r.value, None
                else:
                    value, reason = resolve(value, r.value)
            yield pd.DataFrame(out, columns=["project_id", "entity", "predicate", "value", "reason"])
        if held:
            yield pd.DataFrame([(*held, value, reason)], columns=["project_id", "entity", "predicate", "value", "reason"])

    keys = ["project_id", "entity", "predicate"]
    ordered = claims.select(*keys, "value", "arrival", "id").repartition(*keys).sortWithinPartitions(*keys, "arrival", "id")
    return ordered.mapInPandas(run, "project_id string, entity string, predicate string, value string, reason string")


def answer_with(prompts: DataFrame, answer: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """question_id and answer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"question_id": batch["question_id"], "answer": answer(batch["prompt"])})

    return prompts.select("question_id", "prompt").mapInPandas(run, "question_id string, answer string")
