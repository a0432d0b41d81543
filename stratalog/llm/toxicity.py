"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The terms are words and word beginnings that labelled toxic texts hold far more often than labelled clean ones
do; all other words of a text are one more term, which every text has, so that a few terms among many words weigh
less than among few. Which terms, and the labelled examples themselves, come from a bounded sample of labelled rows;
how rare a term is comes from all documents. A document's nearest examples vote with the square of their similarity
(as a share of the largest), drawn a little towards the base rate; those examples are the evidence. A logistic curve
over the votes that the examples get from the others turns the share of toxic votes into the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_PATTERN, batches
from .tokens import Memory

#: At most this many labelled rows are examples: those whose ids have the smallest hashes.
SAMPLE = 20_000
#: At most this many terms, those that tell most.
TERMS = 4_000
BEGINNINGS = range(3, 8)
LEAST_TOXIC, LEAST_SHARE = 3, 0.5
NEIGHBOURS = 15
BASE_WEIGHT = 1.0
#: The idf of the other words: that of a term that no document lacks.
OTHERS_IDF = 1.0
REJECT = 0.7
BLOCK = 64
EVIDENCE = 5

_words = re.compile(WORD_PATTERN).findall
SCORED = "doc_id long, held_out boolean, score double, predicted int, similarity double, evidence array<long>, terms array<string>"


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def terms_of(word: str) -> list[str]:
    """The word, and its beginnings with a star."""
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) >= k)]


def sample_labels(labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id and toxic (0 or 1) of at most `most` rows that may be learned from."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


class Index:
    """Unit vectors of the examples; per term the examples that hold it, and per term and block the largest weight."""

    def __init__(self, vectors: list[dict[int, float]], n_terms: int):
        self.size = len(vectors)
        self.blocks = -(-self.size // BLOCK)
        rows = [(t, i, w) for i, v in enumerate(vectors) for t, w in v.items()]
        rows.sort()
        term = np.array([r[0] for r in rows], dtype=np.int64)
        self.example = np.array([r[1] for r in rows], dtype=np.int64)
        self.weight = np.array([r[2] for r in rows], dtype=np.float64)
        self.at = np.searchsorted(term, np.arange(n_terms + 1))
        key = term * max(1, self.blocks) + self.example // BLOCK
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
        self.first = np.append(first, len(key))
        self.block_of = self.example[first] // BLOCK
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.block_at = np.searchsorted(first, self.at)

    def nearest(self, query: dict[int, float], k: int) -> list[tuple[int, float]]:
        """The k examples of largest cosine over 0, exactly; of equals the first. Blocks that can't matter are skipped."""
        bound = np.zeros(self.blocks)
        for t, q in query.items():
            own = slice(self.block_at[t], self.block_at[t + 1])
            bound[self.block_of[own]] += q * self.most[own]
        order = np.argsort(-bound, kind="stable")
        best: list[tuple[float, int]] = []
        for at in range(0, len(order), 8):
            some = order[at : at + 8]
            if bound[some[0]] <= 0 or len(best) >= k and bound[some[0]] < -best[k - 1][0] - 1e-9:
                break
            total = np.zeros((len(some), BLOCK))
            place = np.full(self.blocks, -1)
            place[some] = np.arange(len(some))
            for t, q in query.items():
                own = self.block_of[self.block_at[t] : self.block_at[t + 1]]
                for j in np.flatnonzero(place[own] >= 0).tolist():
                    j += self.block_at[t]
                    part = slice(self.first[j], self.first[j + 1])
                    total[place[self.block_of[j]], self.example[part] % BLOCK] += q * self.weight[part]
            row, column = np.nonzero(total)
            found = zip((-total[row, column].round(9)).tolist(), (some[row] * BLOCK + column).tolist(), strict=True)
            best = sorted([*best, *found])[:k]
        return [(i, -s) for s, i in best]


class Model:
    def __init__(self, terms: list[str], idf: list[float], examples: list[tuple[int, int, dict[int, int]]]):
        self.terms, self.others, self.idf = terms, len(terms), [*idf, OTHERS_IDF]
        self.number = {t: i for i, t in enumerate(terms)}
        told = [(self.vector(tf), y, doc, tuple(sorted(tf.items()))) for doc, y, tf in examples if tf]
        told.sort(key=lambda x: (sorted(x[0].items()), x[2]))
        self.index = Index([v for v, *_ in told], len(terms) + 1)
        self.label, self.doc, self.key = [y for _, y, *_ in told], [x[2] for x in told], [x[3] for x in told]
        silent = [y for _, y, tf in examples if not tf]
        self.base = (sum(y for _, y, _ in examples) + 0.5) / (len(examples) + 1)
        self.silent = min(0.5, (sum(silent) + 0.5) / (len(silent) + 1))
        self.slope, self.shift = 1.0, 0.0
        self.memory = self.scores = None

    def __getstate__(self):
        return self.__dict__ | {"memory": None, "scores": None}

    def numbers(self, word: str) -> tuple[int, ...]:
        return tuple(self.number[t] for t in terms_of(word) if t in self.number)

    def count(self, text: str) -> dict[int, int]:
        """Times that each term stands in the text, and the number of its other words; nothing if it holds no term."""
        if self.memory is None:
            self.memory = Memory(200_000, self.numbers)
        out = Counter()
        words = _words(text.lower())
        told = [*filter(None, map(self.memory.__getitem__, words))]
        for numbers in told:
            out.update(numbers)
        if 0 < len(told) < len(words):
            out[self.others] = len(words) - len(told)
        self.memory.age()
        return out

    def vector(self, tf: dict[int, int]) -> dict[int, float]:
        raw = {t: (1 + math.log(n)) * self.idf[t] for t, n in sorted(tf.items())}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {t: x / norm for t, x in raw.items()}

    def score(self, text: str) -> tuple[float, float, list[int], list[str]]:
        """Score, largest similarity, nearest examples, terms."""
        tf = self.count(text)
        if not tf:
            return self.silent, 0.0, [], []
        if self.scores is None:
            self.scores = Memory(100_000, self.vote)
        out = self.scores[tuple(sorted(tf.items()))]
        self.scores.age()
        return out

    def share(self, key: tuple, alike: int = 0) -> tuple[float, list[tuple[int, float]]]:
        """Share of toxic votes and the nearest examples; where `alike` examples have this very key, without those."""
        near = self.index.nearest(self.vector(dict(key)), NEIGHBOURS + alike)
        near = [x for x in near if not alike or self.key[x[0]] != key][:NEIGHBOURS]
        weight = [(s / near[0][1]) ** 2 for _, s in near]
        toxic = sum(w for w, (i, _) in zip(weight, near, strict=True) if self.label[i])
        return (toxic + BASE_WEIGHT * self.base) / (sum(weight) + BASE_WEIGHT), near

    def vote(self, key: tuple) -> tuple[float, float, list[int], list[str]]:
        share, near = self.share(key)
        score = 1 / (1 + math.exp(-self.slope * math.log(share / (1 - share)) - self.shift))
        return score, near[0][1] if near else 0.0, [self.doc[i] for i, _ in near[:EVIDENCE]], [self.terms[t] for t, _ in key if t != self.others]


def logistic(share: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and shift over the log odds of a share of votes that tell best how toxic such texts are; drawn a little
    towards 1 and 0, which leave the share as it is."""
    x = np.log(share / (1 - share))
    n = toxic.sum()
    target = toxic * (n + 1) / (n + 2) + (1 - toxic) / (len(toxic) - n + 2)
    fit = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-fit[0] * x - fit[1]))
        w = p * (1 - p)
        slope = np.array([((p - target) * x).sum() + fit[0] - 1, (p - target).sum() + fit[1]])
        step = np.linalg.solve([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1]], slope)
        fit -= step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return (float(fit[0].round(9)), float(fit[1].round(9))) if fit[0] > 0 else (1.0, 0.0)


def calibrated(spark: SparkSession, model: Model) -> Model:
    """The model with its curve, from the votes that each example gets from the examples unlike it. Examples that are
    alike count once."""
    toxic, times = Counter(), Counter(model.key)
    for key, y in zip(model.key, model.label, strict=True):
        toxic[key] += y
    keys = list(times)
    if not keys:
        return model
    shared = spark.sparkContext.broadcast((model, [(key, times[key]) for key in keys]))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, asked = shared.value
        for batch in found:
            own = batch.column("id").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([judge.share(*asked[i])[0] for i in own], pa.float64())], names=["id", "share"])

    found = sorted(map(tuple, spark.range(len(keys)).mapInArrow(run, "id long, share double").collect()))
    model.slope, model.shift = logistic(np.array([s for _, s in found]), np.array([toxic[k] / times[k] for k in keys]))
    return model


def tells(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    """How unlikely the split of a term's documents is if it told nothing (log-likelihood ratio)."""
    n, total = toxic + clean, all_toxic + all_clean
    cells = ((toxic, all_toxic * n), (clean, all_clean * n), (all_toxic - toxic, all_toxic * (total - n)), (all_clean - clean, all_clean * (total - n)))
    return 2 * sum(o * math.log(o * total / e) for o, e in cells if o and e)


def strongest(terms: list[str]) -> list[str]:
    """Of terms in falling strength those that no stronger one holds, or is held by: one for each stem."""
    chosen: set[str] = set()
    above: set[str] = set()
    for term in terms:
        word = term.rstrip("*")
        held = [word[:k] + "*" for k in BEGINNINGS if k < len(word) or k == len(word) and term == word]
        if term not in above and chosen.isdisjoint(held):
            chosen.add(term)
            above.update(held)
    return [t for t in terms if t in chosen]


def fit(docs: DataFrame, labels: DataFrame, *, most: int = SAMPLE) -> Model:
    """Chooses terms, examples and the curve from the sample, and counts the terms' documents over all of `docs`."""
    sample = sample_labels(labels, most)
    known = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most `most` rows of two numbers

    def count_terms(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        rows = [0, 0]
        for batch in found:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                rows[y > 0] += 1
                seen[y > 0].update({t for w in set(_words((text or "").lower())) for t in terms_of(w)})
        terms = list(seen[0] | seen[1])
        columns = [pa.array([*terms, None], pa.string()), *(pa.array([*map(c.__getitem__, terms), n], pa.int64()) for c, n in ((seen[1], rows[1]), (seen[0], rows[0])))]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "toxic", "clean"])

    # A word that no toxic example holds can't be chosen, but how many words there are sets how much a term must tell.
    counted = known.select("text", "toxic").mapInArrow(count_terms, "term string, toxic long, clean long")
    counted = counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = counted.persist()
    try:
        all_toxic, all_clean = counted.where("term IS NULL").select("toxic", "clean").first() or (0, 0)
        n_terms = counted.count()
        likely = counted.where((F.col("term").isNotNull()) & (F.col("toxic") >= LEAST_TOXIC) & (F.col("toxic") >= LEAST_SHARE * (F.col("toxic") + F.col("clean"))))
        likely = likely.orderBy(F.desc("toxic"), "clean", "term").limit(25 * TERMS).collect()
    finally:
        counted.unpersist()
    told = [(tells(r.toxic, r.clean, all_toxic, all_clean), r.term) for r in likely]
    least = 2 * math.log(max(n_terms, 2))
    terms = strongest([t for s, t in sorted(told, key=lambda x: (-round(x[0], 6), -len(x[1]), x[1])) if s >= least])[:TERMS]
    chooser = docs.sparkSession.sparkContext.broadcast(Model(terms, [1.0] * len(terms), []))

    def count_documents(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = Counter(), 0
        for batch in found:
            rows += batch.num_rows
            for text in batch.column("text").to_pylist():
                held.update(chooser.value.count(text or "").keys())
        yield pa.RecordBatch.from_arrays([pa.array([-1, *held], pa.int32()), pa.array([rows, *held.values()], pa.int64())], names=["number", "documents"])

    documents = docs.select("text").mapInArrow(count_documents, "number int, documents long").groupBy("number").agg(F.sum("documents")).collect()
    documents = dict(map(tuple, documents))
    total = documents.get(-1, 0)
    idf = [1 + math.log((1 + total) / (1 + documents.get(i, 0))) for i in range(len(terms))]

    def examples(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            counts = [list(chooser.value.count(t or "").items()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("toxic").cast(pa.int32()), pa.array(counts, pa.list_(pa.list_(pa.int32())))], names=["doc_id", "toxic", "counts"])

    rows = known.select("doc_id", "text", "toxic").mapInArrow(examples, "doc_id long, toxic int, counts array<array<int>>").collect()
    rows = [(r.doc_id, int(r.toxic > 0), dict(map(tuple, r.counts))) for r in rows]
    rows.sort(key=lambda x: (x[0], sorted(x[2].items())))
    return calibrated(docs.sparkSession, Model(terms, idf, rows))


def score(docs: DataFrame, model: Model, *, reject: float = REJECT) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from `reject` on), similarity to the nearest example,
    evidence (doc_ids of the nearest examples) and the terms found.

    A null text is empty; a text without terms has the share of toxic among such examples as its score. Equal
    texts have equal scores. Repeated rows give repeated rows; an empty table gives no rows; without labels
    nothing is rejected.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found):
            scored = [shared.value.score(t or "") for t in batch.column("text").to_pylist()]
            value, similarity, evidence, terms = zip(*scored, strict=True)
            columns = [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(value, pa.float64()), pa.array([int(v >= reject) for v in value], pa.int32())]
            columns += [pa.array(similarity, pa.float64()), pa.array(evidence, pa.list_(pa.int64())), pa.array(terms, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCORED.split(", ")])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, SCORED)


def keep_clean(docs: DataFrame, model: Model, *, reject: float = REJECT) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text is not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found):
            yield batch.filter(pa.array([shared.value.score(t or "")[0] < reject for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
