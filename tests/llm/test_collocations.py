"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from stratalog.llm import collocations


def brute(rows, least, top):
    """Rows of each language by whole counts of all phrases."""
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(words)
            for i in range(len(words)):
                for m in range(1, 6):
                    if i + m <= len(words):
                        f[lang, words[i : i + m]] += 1
    frequent = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    dropped = set()
    for (lang, words), a in frequent.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                if 100 * a >= 100 * frequent[lang, words[i : i + m]]:
                    dropped.add((lang, words[i : i + m]))
    out = {}
    for (lang, words), a in frequent.items():
        if (lang, words) not in dropped:
            cuts = []
            for k in range(1, len(words)):
                left, right = f[lang, words[:k]], f[lang, words[k:]]
                cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, own in out.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top]))


def sample(seed=4):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abéñ日") for _ in range(rng.randint(1, 3))) for _ in range(30)] + ["New", "YORK", " ", "x\x1cy"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b", "!?"]
    rows = [(rng.choice(["en", "en", "de", None, "und"]), "".join(rng.choice(vocabulary) + rng.choice(ends) for _ in range(rng.randint(0, 200)))) for _ in range(300)]
    rows += [("en", "it was a very common line of seven words, more")] * 200 + [("fr", None), ("fr", ""), (None, None), ("es", " ".join(["ho"] * 900)), ("fr", "one two " * 40)]
    return rows


def found(spark, rows, **how):
    schema = "lang string, text string, word int, symbol int, n int, bucket int, depth int"
    docs = spark.createDataFrame([(*r, 7, 7, 7, 7, 7) for r in rows], schema).repartition(3)
    return sorted(tuple(r) for r in collocations.collocations(docs, **how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("hot", [None, 5, 100])
def test_collocations(spark, monkeypatch, hot):
    if hot is not None:  # small blocks and buckets, suffixes routed by three to five words
        for name, value in {"HOT": hot, "SLOT_BITS": 6, "BLOCK_WORDS": 3_000, "BUCKET_WORDS": 1_000, "MEMORY_WORDS": 40}.items():
            monkeypatch.setattr(collocations, name, value)
    rows = sample()
    want = brute(rows, 20, 50)
    assert len(want) > 100 and found(spark, rows, least=20, top=50) == want


def test_symbols_that_clash(spark, monkeypatch):
    """Two words with one symbol make another seed necessary."""
    real = collocations.xxhash.xxh64_intdigest
    monkeypatch.setattr(collocations, "SEEDS", range(2))
    rows = [("en", "a b c a b d")] * 30
    # The words are hashed in worker processes; a seed that clashes is put into the counted words.
    counted = collocations.counted

    def clashing(docs, seed):
        words, slots = counted(docs, seed)
        return (words.withColumn("symbol", words["symbol"] * 0) if seed == 0 else words), slots

    monkeypatch.setattr(collocations, "counted", clashing)
    assert found(spark, rows, least=20) == brute(rows, 20, 2000) and real(b"a", 1) != real(b"a", 0)
    monkeypatch.setattr(collocations, "SEEDS", range(1))
    with pytest.raises(RuntimeError):
        found(spark, rows, least=20)


def test_three_way():
    rng = np.random.default_rng(3)
    symbols = rng.integers(0, 4, (5, 3000))
    symbols[:2] = 1
    for d in range(3, 5):
        symbols[d][symbols[d - 1] == 0] = 0
    times = rng.integers(1, 5, 3000)
    count = Counter()
    for row, t in zip(symbols.T.tolist(), times.tolist()):
        for d in range(3, 6):
            if 0 not in row[:d]:
                count[tuple(row[:d])] += t
    got = {}
    for some, words, weight in collocations.three_way(symbols, times, np.arange(3000), np.array([0, 3000]), 2, 50):
        for s, w in zip(some.tolist(), weight.tolist(), strict=True):
            got[tuple(symbols[:words, s].tolist())] = w
    assert got == {k: v for k, v in count.items() if v >= 50}


def test_exact_products(spark):
    """Products beyond 64 bits."""
    phrases = spark.createDataFrame([("en", [1], 10**15), ("en", [2], 10**15 - 7), ("en", [1, 2], 10**15 - 9), ("de", [1], 101), ("de", [2], 103), ("de", [1, 2], 100)], "lang string, words array<long>, n long")
    totals = spark.createDataFrame([("en", 9 * 10**15 + 1), ("de", 9 * 10**15 + 1)], "lang string, n long")
    got = {r.lang: r.score for r in collocations.scored(phrases, totals).collect()}
    n = 9 * 10**15 + 1
    assert got == {"en": 1000 * (10**15 - 9) * n // (10**15 * (10**15 - 7)), "de": 1000 * 100 * n // (101 * 103)}


def test_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_against_sql(spark):
    """The whole table, by the SQL that the driver runs."""
    import duckdb

    from stratalog.llm import queries

    folder = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    columns = "lang, rank, phrase, a, l, r, n, score"
    want = sorted(db.sql(f"SELECT {columns} FROM ({queries.oracle_sql()['op11_phrase_collocations']})").fetchall())
    assert want and sorted(map(tuple, queries.op11_phrase_collocations(spark, folder).selectExpr(*columns.split(", ")).collect())) == want
