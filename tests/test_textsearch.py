"""Web-style text search against plain evaluation of queries over word lists."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from stratalog.functions.stem import stem
from stratalog.functions.text import STOP_WORDS
from stratalog.operators import textsearch


@pytest.mark.parametrize(
    "words",
    [
        "connect connected connecting connection connections", "happi happy", "caress caresses", "fli flies", "die dies died", "agre agreed agrees", "hop hopping hopped", "hope hoped hoping", "nation national nationally",
        "general general generally", "proceed proceeds", "troubl trouble troubled troubling", "relat relate related relational", "hope hopeful hopefulness", "adjust adjustable adjustment", "control controlling",
        "consist consistent consistency consisted", "knack knacks", "kneel kneeling", "replac replacement replaced", "run running runs",
    ],
)
def test_stems(words):
    first, *others = words.split()
    assert {stem(w) for w in others} <= {first}


def test_stem_details():
    assert [stem(w) for w in ("skies", "news", "gas", "this", "kiwis", "gaps", "cries", "ties", "generously", "communism", "youth", "boy", "say", "by", "é", "x1y", "vietnamization", "luxuriated", "rolled", "sing", "bead")] == [
        "sky", "news", "gas", "this", "kiwi", "gap", "cri", "tie", "generous", "communism", "youth", "boy", "say", "by", "é", "x1y", "vietnam", "luxuri", "roll", "sing", "bead",
    ]


def test_parse():
    p = textsearch.parse_query
    assert p('running "quick the fox" or -dogs foo-bar the') == [[(False, ["run"], [0]), (False, ["quick", "fox"], [0, 2])], [(True, ["dog"], [0]), (False, ["foo", "bar"], [0, 1])]]
    assert p("the of") == [] and p("") == [] and p("or or x or") == [[(False, ["x"], [0])]] and p('"open', None) == [[(False, ["open"], [0])]] and p('-"a b c"', None) == [[(True, ["b", "c"], [0, 1])]]


def holds(items, words):
    def at(ws, gaps):
        return [i for i in range(len(words)) if all(i + g < len(words) and words[i + g] == w for w, g in zip(ws, gaps))]

    return all(bool(at(ws, gaps)) != minus for minus, ws, gaps in items)


def brute(alternatives, words):
    """Rank by trying every stretch of words."""
    if not any(holds(items, words) for items in alternatives):
        return None
    live = [[x for x in items if not x[0]] for items in alternatives if holds(items, words)]
    named = {w for items in alternatives for minus, ws, _ in items if not minus for w in ws}
    good = [(b, e) for b, e in itertools.combinations_with_replacement(range(len(words)), 2) if any(items and holds(items, words[b : e + 1]) for items in live)]
    total = 0.0
    for b, e in good:
        if not any((b2, e2) != (b, e) and b <= b2 and e2 <= e for b2, e2 in good):
            entries = sum(w in named for w in words[b : e + 1])
            total += 0.1 / (1 + (e - b) - (entries - 1))
    return total


def test_against_brute_force(spark):
    rng = random.Random(6)
    vocabulary = ["cat", "cats", "dog", "running", "runs", "tree", "the", "blue", "house", "x"]
    memories = [(i, f"p{i % 2}", rng.choice([["a"], ["b"], ["a", "b"], None]), rng.choice(["", " "]) + rng.choice([" ", ", ", "-"]).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 14)))) for i in range(150)] + [(150, "p0", ["a"], None)]
    texts = ["cat dog", '"blue house"', "cat or tree", "cat -dog", "-cat", '"run the tree" or dog x', '-"blue house" cat', "the", "", "missing", "missing or cat", "cat missing", "blue-house", "run", '"dog" "x cat" or tree -run or -house -x', "CAT Dog"]
    queries = [(j, f"p{j % 2}", rng.choice([[], ["a"], None]), t) for j, t in enumerate(texts * 2)]
    m = spark.createDataFrame(memories, "id long, project_id string, scope_keys array<string>, content string").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, project_id string, scopes array<string>, text string")
    found = {(r.query_id, r.id): (round(r.rank, 6), r.pos) for r in textsearch.text_topk(q, m, 1000).collect()}
    want = {}
    for j, project, scopes, text in queries:
        spec = textsearch.parse_query(text.lower())
        for i, p, keys, content in memories:
            if p == project and (not scopes or set(scopes) & set(keys or [])) and spec:
                rank = brute(spec, [stem(w) for w in re.findall(r"\w+", (content or "").lower())])
                if rank is not None:
                    want[j, i] = round(rank, 6)
    assert {key: r for key, (r, _) in found.items()} == want and len(want) > 200
    few = textsearch.text_topk(q, m, 3)
    assert sorted((r.query_id, r.id, r.pos) for r in few.collect()) == sorted((j, i, pos) for (j, i), (_, pos) in found.items() if pos <= 3)
    assert "the" in STOP_WORDS and textsearch.text_topk(q.where(F.lit(False)), m).count() == 0 == textsearch.text_topk(q, m.where(F.lit(False))).count()


def test_leading_memories_and_blocks(spark, monkeypatch):
    """Few leading memories, small blocks and a short list: bounds pass over memories, and the best are still found."""
    monkeypatch.setattr(textsearch, "LEAD", 10)
    monkeypatch.setattr(textsearch, "ENTRIES", 200)
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.choice([3, 8, 40]))) for _ in range(300)]
    asked = ["aa", "aa bb", "aa bb cc", "aa or bb cc", "dd -ee", 'ff "gg hh"', "aa bb or -cc", "xx", "aa aa"]
    queries = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "query_id long, text string")
    memories = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id long, content string")
    found = {(r.query_id, r.pos): (r.id, round(r.rank, 9)) for r in textsearch.text_topk(queries, memories, 5, stem=None).collect()}
    for i, q in enumerate(asked):
        ranks = []
        for j, x in enumerate(texts):
            places = {w: textsearch.np.array([n for n, y in enumerate(x.split()) if y == w]) for w in {*x.split()}}
            rank = textsearch.cover_density(textsearch.parse_query(q, None), places)
            ranks += [] if rank is None else [(-round(rank, 9), j)]
        assert [(found.get((i, n + 1))) for n in range(5)] == [(j, -r) for r, j in sorted(ranks)[:5]] + [None] * max(0, 5 - len(ranks))
