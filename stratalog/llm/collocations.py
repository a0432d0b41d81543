"""Phrases whose words stand together far more often than chance, from sorted suffixes of the word sequence.

Every word begins a suffix of at most five words that ends with its piece of text. Blocks of documents send their
suffixes, equal ones once with their number, to the bucket of their leading words, so that all suffixes with these
words meet. There a partition of suffixes with equal leading words is abandoned if it is infrequent; the others are
sorted by a multikey three-way quicksort over pointers to suffixes: each round splits every partition by a pivot
symbol at its depth, parts that are infrequent are abandoned, and the part equal to the pivot is a phrase whose count
is the part's size, and goes on one symbol deeper, down to the last one.

Suffixes are routed by two leading words. Where too many share these, by three, four or five: a first pass counts the
suffixes of each hashed slot of leading words, and slots with too many are split by the next word. Counts of phrases
shorter than the routing are then sums over buckets.

A word's symbol is a 64-bit hash. All words are compared before symbols are trusted; should two words share one,
another seed is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, batches, mix, pack, stored, texts_of, unpack

DEPTH = 5
LEAST = 100
TOP = 2000
NO_LANG = "und"
#: Words of a block, different words that a task remembers, and suffixes of a bucket, about.
BLOCK_WORDS = 1_500_000
MEMORY_WORDS = 1_000_000
BUCKET_WORDS = 2_000_000
#: Bits of a slot's number, and suffixes of a slot beyond twice the mean that make it hot.
SLOT_BITS = 14
HOT = 400_000
#: Languages whose totals are sent to all tasks, at most; with more of them the totals are joined by a shuffle.
SENT_LANGS = 100_000
#: Seeds of the symbols, in the order in which they are tried.
SEEDS = range(16)

_PLAIN = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")
_FACTOR = np.uint64(0xD6E8FEB86659FD93)


class Numbers(dict):
    """Words of a block by number; 0 is the end of a piece, and what is no word has a negative number."""

    def __init__(self):
        super().__init__({b"": -1, b"\n": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) - 1
        return n


class Block:
    """Word sequences per language, with the block's own numbers of the words."""

    def __init__(self, numbers: Numbers, parts: dict[str, list[np.ndarray]], seed: int):
        self.words = [w for w, n in numbers.items() if n > 0]
        self.symbols = np.array([0, *(xxhash.xxh64_intdigest(w, seed) for w in self.words)], dtype=np.uint64)
        self.ids = {lang: np.concatenate([*found, np.zeros(DEPTH, dtype=np.int32)]) for lang, found in parts.items()}

    def suffixes(self, lang: str) -> list[np.ndarray]:
        """One column of numbers for each depth, of all suffixes of two words and more; 0 behind the end."""
        ids = self.ids[lang]
        n = len(ids) - DEPTH
        at = np.flatnonzero((ids[:n] > 0) & (ids[1 : n + 1] > 0))
        columns = [ids[at], ids[at + 1]]
        for d in range(2, DEPTH):
            columns.append(np.where(columns[-1] > 0, ids[at + d], 0))
        return columns

    def hashes(self, lang: str, columns: list[np.ndarray]) -> list[np.ndarray]:
        """A 64-bit hash of the language and the first words, for each depth from two on."""
        own = mix(self.symbols + np.uint64(0x9E3779B97F4A7C15))
        value = np.full(len(columns[0]), np.uint64(xxhash.xxh64_intdigest(lang.encode())), dtype=np.uint64)
        out = []
        for c in columns:
            value = mix(value * _FACTOR + own[c])
            out.append(value)
        return out[1:]


def blocks_of(found: Iterator[pa.RecordBatch], seed: int) -> Iterator[Block]:
    """The texts of a task as blocks of word sequences."""
    numbers, parts, words = Numbers(), {}, 0
    for batch in batches(found):
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch), strict=True):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            split = (b"\n".join(texts) + b"\n").lower().translate(_PLAIN).replace(b"\n", b" \n ").split(b" ")
            ids = np.fromiter(map(numbers.__getitem__, split), dtype=np.int32, count=len(split))
            ids = ids[ids >= 0]
            parts.setdefault(lang, []).append(ids)
            words += len(ids)
        if words >= BLOCK_WORDS or len(numbers) > MEMORY_WORDS:
            yield Block(numbers, parts, seed)
            numbers, parts, words = Numbers(), {}, 0
    if words:
        yield Block(numbers, parts, seed)


def with_lang(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text")


def counted(docs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Words with their symbols and counts, and suffixes per depth and slot of their leading words."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros((DEPTH - 2, 1 << SLOT_BITS), dtype=np.int64)

        def rows(lang, word, symbol, n, depth):
            size = len(n)
            return pa.RecordBatch.from_arrays(
                [pa.array(lang or [None] * size, pa.string()), pa.array(word or [None] * size, pa.binary()), pa.array(symbol.view(np.int64)), pa.array(n), pa.array(np.full(size, depth, dtype=np.int32))],
                names=["lang", "word", "symbol", "n", "depth"],
            )

        for block in blocks_of(found, seed):
            for lang, ids in block.ids.items():
                times = np.bincount(ids, minlength=len(block.symbols))
                times[0] = 0
                own = np.flatnonzero(times)
                yield rows([lang] * len(own), [block.words[i - 1] for i in own.tolist()], block.symbols[own], times[own], 1)
                for d, h in enumerate(block.hashes(lang, block.suffixes(lang))[: DEPTH - 2]):
                    slots[d] += np.bincount((h >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=1 << SLOT_BITS)
        for d in range(DEPTH - 2):
            own = np.flatnonzero(slots[d])
            yield rows(None, None, own.astype(np.int64), slots[d][own], d + 2)

    found = stored(with_lang(docs).mapInArrow(run, "lang string, word binary, symbol long, n long, depth int"), "counted")
    words = found.where("depth = 1").groupBy("lang", "word", "symbol").agg(F.sum("n").alias("n"))
    slots = found.where("depth > 1").groupBy("depth", F.col("symbol").alias("slot")).agg(F.sum("n").alias("n"))
    return stored(words, "words"), slots


ROUTED = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("depth", pa.int32()), ("symbols", pa.binary()), ("codes", pa.binary()), ("times", pa.binary())])
ROUTED_DDL = "bucket int, lang string, depth int, symbols binary, codes binary, times binary"
FOUND = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.int64())), ("n", pa.int64())])


def pack_codes(columns: np.ndarray) -> bytes:
    """Small numbers as planes of their bytes."""
    return pack(np.ascontiguousarray(columns.astype("<u4")).view("u1").reshape(*columns.shape, 4).transpose(0, 2, 1))


def unpack_codes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpack(data, "u1").reshape(DEPTH, 4, -1).transpose(0, 2, 1)).view("<u4")[:, :, 0].astype(np.int64)


def routed(docs: DataFrame, seed: int, hot: list[np.ndarray], buckets: int) -> DataFrame:
    """Suffixes of each block, equal ones once, in rows of a bucket, a language and a depth of routing."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(found, seed):
            for lang in block.ids:
                columns = block.suffixes(lang)
                if not len(columns[0]):
                    continue
                hashes = block.hashes(lang, columns)
                route, depth, open_ = hashes[0].copy(), np.full(len(columns[0]), 2, dtype=np.int64), np.ones(len(columns[0]), dtype=bool)
                for d, slots in enumerate(hot):
                    open_ &= slots[(hashes[d] >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
                    route[open_], depth[open_] = hashes[d + 1][open_], d + 3
                # The bucket, then the leading pair, then the whole suffix: equal suffixes stand together.
                bucket = (route >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                bits = np.uint64(max(1, int(buckets - 1).bit_length()))
                rest = (np.uint64(64) - bits) // np.uint64(2)
                key = bucket << (np.uint64(64) - bits) | (hashes[0] >> np.uint64(64 - int(rest))) << rest | hashes[-1] >> (np.uint64(64) - rest)
                order = np.argsort(key)
                columns = np.stack([c[order] for c in columns])
                first = np.flatnonzero(np.concatenate(([True], (columns[:, 1:] != columns[:, :-1]).any(axis=0))))
                times = np.diff(np.append(first, len(order)))
                columns, bucket, depth = columns[:, first], bucket[order][first].astype(np.int64), depth[order][first]
                for d in np.unique(depth).tolist():
                    own = np.flatnonzero(depth == d)
                    at = np.flatnonzero(np.concatenate(([True], bucket[own][1:] != bucket[own][:-1], [True])))
                    out = []
                    for b, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                        rows = own[b:e]
                        number, codes = np.unique(columns[:, rows], return_inverse=True)
                        out.append((int(bucket[rows[0]]), lang, d, pack(block.symbols[number].view("u1").reshape(-1, 8).T), pack_codes(codes.reshape(DEPTH, -1)), pack(times[rows].astype("<i8").view("u1").reshape(-1, 8).T)))
                    yield arrow_rows(ROUTED, out)

    return with_lang(docs).mapInArrow(run, ROUTED_DDL)


def three_way(symbols: np.ndarray, times: np.ndarray, order: np.ndarray, at: np.ndarray, depth: int, least: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Multikey three-way quicksort of the suffixes `order` in partitions that begin at `at` and agree on the first
    `depth` symbols; yields (a suffix of each frequent phrase, words of the phrase, its count), many at a time.

    All partitions take their rounds together. Partitions, and parts, whose times sum to less than `least` are left.
    """
    depths = np.full(len(at) - 1, depth, dtype=np.int64)
    begin, end = at[:-1], at[1:]
    while len(begin):
        size = end - begin
        starts = np.concatenate(([0], np.cumsum(size)))
        owner = np.repeat(np.arange(len(size)), size)
        order = order[np.arange(starts[-1]) - starts[owner] + begin[owner]]
        begin = starts[:-1]
        value = symbols[depths[owner], order]
        pivot = np.median(np.stack((value[begin], value[begin + size // 2], value[starts[1:] - 1])), axis=0).astype(np.int64)
        side = np.sign(value - pivot[owner]) + 1  # below, equal, above
        # Each part's suffixes move behind those of the parts before it.
        part = owner * 3 + side
        count = np.bincount(part, minlength=3 * len(size))
        weight = np.bincount(part, weights=times[order], minlength=3 * len(size)).astype(np.int64)
        to = np.concatenate(([0], np.cumsum(count)))
        moved = np.empty_like(order)
        for s in range(3):
            own = np.flatnonzero(side == s)
            within = np.arange(len(own)) - np.concatenate(([0], np.cumsum(count[s::3])))[:-1][owner[own]]
            moved[to[part[own]] + within] = order[own]
        order = moved
        keep = weight >= least
        deeper = np.repeat(depths, 3)
        equal = np.zeros(len(keep), dtype=bool)
        equal[1::3] = True
        equal &= keep
        keep[1::3] &= pivot > 0  # the end of a piece begins no phrase
        equal &= keep
        for d in np.unique(deeper[equal]).tolist():
            own = np.flatnonzero(equal & (deeper == d))
            yield order[to[own]], d + 1, weight[own]
        deeper[equal] += 1
        keep &= deeper < DEPTH
        begin, end, depths = to[:-1][keep], to[1:][keep], deeper[keep]


def phrases_of(group: list[tuple[bytes, bytes, bytes]], depth: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(symbols of each phrase, count) of the suffixes of one bucket, language and depth of routing. Phrases of `depth`
    words and more are frequent ones with their whole counts; of shorter ones all, with their counts in this bucket."""
    names = [np.ascontiguousarray(unpack(s, "u1").reshape(8, -1).T).view("<u8").ravel() for s, _, _ in group]
    known, number = np.unique(np.concatenate([np.zeros(1, dtype=np.uint64), *names]), return_inverse=True)  # 0, the end, is first
    codes, base = [], 1
    for own, (_, c, _) in zip(names, group, strict=True):
        codes.append(number[base : base + len(own)][unpack_codes(c)])
        base += len(own)
    symbols = np.concatenate(codes, axis=1)
    times = np.concatenate([np.ascontiguousarray(unpack(t, "u1").reshape(8, -1).T).view("<i8").ravel() for _, _, t in group])
    key = symbols[0] * len(known) + symbols[1]
    if depth > 2:
        _, key = np.unique(key, return_inverse=True)
    order, lead = None, 2
    while True:
        # Partitions by the leading words so far.
        order = np.argsort(key)
        at = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1], [True])))
        weight = np.add.reduceat(times[order], at[:-1])
        whole = symbols[lead - 1][order[at[:-1]]] > 0
        keep = whole & (weight >= least) if lead == depth else whole
        chosen = order[at[:-1][keep]]
        yield known[symbols[:lead, chosen]], weight[keep]
        if lead == depth:
            break
        _, key = np.unique(key * len(known) + symbols[lead], return_inverse=True)
        lead += 1
    if lead < DEPTH and keep.any():
        size = np.diff(at)[keep]
        starts = np.concatenate(([0], np.cumsum(size)))
        rows = np.arange(starts[-1]) - np.repeat(starts[:-1], size) + np.repeat(at[:-1][keep], size)
        for some, words, weight in three_way(symbols, times, order[rows], starts, lead, least):
            yield known[symbols[:words, some]], weight


def frequent_phrases(suffixes: DataFrame, least: int) -> DataFrame:
    """(lang, words as symbols, n) of all phrases of two words and more that occur `least` times."""

    def run(group: pa.Table) -> pa.Table:
        rows: dict[tuple[str, int], list[tuple[bytes, bytes, bytes]]] = {}
        for lang, depth, *data in zip(*(group.column(c).to_pylist() for c in ("lang", "depth", "symbols", "codes", "times")), strict=True):
            rows.setdefault((lang, depth), []).append(tuple(data))
        out = []
        for (lang, depth), own in rows.items():
            for words, n in phrases_of(own, depth, least):
                size = pa.array(np.arange(0, words.size + 1, len(words), dtype=np.int32))
                lists = pa.ListArray.from_arrays(size, pa.array(np.ascontiguousarray(words.T).view(np.int64).ravel()))
                out.append(pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), lists, pa.array(n)], schema=FOUND))
        return pa.Table.from_batches(out, schema=FOUND)

    found = suffixes.groupBy("bucket").applyInArrow(run, "lang string, words array<long>, n long")
    # Phrases shorter than their routing come in parts.
    return found.groupBy("lang", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """Each candidate with its lowest-scoring cut: a, l, r, n and score. Products are decimals of 38 digits."""
    parts = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.struct(k.alias("k"), F.slice("words", F.lit(1), k).alias("left"), F.slice("words", k + 1, F.lit(DEPTH)).alias("right")))
    candidates = phrases.where(F.size("words") > 1).select("lang", "words", F.col("n").alias("a"))
    cuts = candidates.select("lang", "words", "a", F.explode(parts).alias("cut")).select("lang", "words", "a", "cut.*")
    cuts = cuts.join(phrases.select("lang", F.col("words").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(phrases.select("lang", F.col("words").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    if totals.count() <= SENT_LANGS:
        totals = F.broadcast(totals)
    cuts = cuts.join(totals, "lang")
    score = F.expr("(CAST(1000 AS DECIMAL(4, 0)) * CAST(a AS DECIMAL(17, 0)) * CAST(n AS DECIMAL(17, 0))) DIV (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "words", "a", "best.l", "best.r", "n", "best.score")


def without_contained(candidates: DataFrame) -> DataFrame:
    """Candidates whose words don't stand in a longer candidate of equal count (dropped ones count as well)."""
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: F.slice("words", i, m))))
    longer = candidates.where(F.size("words") > 2).select("lang", F.explode(F.array_distinct(inner)).alias("words"), F.col("a").alias("longer"))
    longer = longer.groupBy("lang", "words").agg(F.max("longer").alias("longer"))
    return candidates.join(longer, ["lang", "words"], "left").where(F.coalesce(F.col("longer") < F.col("a"), F.lit(True))).drop("longer")


def collocations(docs: DataFrame, *, least: int = LEAST, top: int = TOP) -> DataFrame:
    """Each language's first `top` phrases of two to five words by score, then count (both descending), then phrase
    (in the order of its UTF-8 bytes): lang, rank, phrase, a, l, r, n, score.

    A null language is `und`, a null text is empty. Repeated rows count each. Phrases don't cross the end of a piece
    or of a document. An empty table, and one without frequent phrases, gives no rows.
    """
    for seed in SEEDS:
        words, slots = counted(docs, seed)
        if words.groupBy("symbol").agg(F.min("word").alias("one"), F.max("word").alias("other")).where("one <> other").isEmpty():
            break
    else:
        raise RuntimeError("every seed gives two words one symbol")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    n = int(totals.agg(F.sum("n")).first()[0] or 0)
    limit = 2 * (n >> SLOT_BITS) + HOT
    hot = [np.zeros(1 << SLOT_BITS, dtype=bool) for _ in range(DEPTH - 2)]
    for r in slots.where(F.col("n") > limit).collect():  # at most one row for each slot and depth
        hot[r.depth - 2][r.slot] = True
    suffixes = routed(docs, seed, hot, max(8, -(-n // BUCKET_WORDS)))
    single = words.where(F.col("n") >= least)
    phrases = frequent_phrases(suffixes, least).unionByName(single.select("lang", F.array("symbol").alias("words"), "n"))
    phrases = stored(phrases, "phrases")
    found = without_contained(scored(phrases, totals))
    order = [F.desc("score"), F.desc("a")]
    near = found.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top)
    spelled = near.select("*", F.posexplode("words").alias("at", "symbol")).join(single.select("lang", "symbol", F.col("word").cast("string").alias("word")), ["lang", "symbol"])
    spelled = spelled.groupBy("lang", "words", "a", "l", "r", "n", "score").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    return spelled.select("lang", rank.cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score").where(F.col("rank") <= top)


def oracle_sql() -> str:
    """The same by counting all phrases of one to five words, in SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH d AS (SELECT coalesce(lang, '{NO_LANG}') AS lang, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d)),
g AS (SELECT lang, w[i:i + m - 1] AS words FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p), (SELECT unnest(range(1, {DEPTH + 1})) AS m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, words, count(*) AS c FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY 1),
c AS (SELECT lang, words, c AS a FROM f WHERE len(words) > 1),
k AS (SELECT lang, words, a, unnest(range(1, len(words))) AS k FROM c),
s AS (SELECT k.lang, k.words, a, k, l.c AS l, r.c AS r, n, (CAST(1000 AS HUGEINT) * a * n) // (CAST(l.c AS HUGEINT) * r.c) AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.words = k.words[1:k] JOIN f r ON r.lang = k.lang AND r.words = k.words[k + 1:] JOIN t ON t.lang = k.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
i AS (SELECT lang, words[i:i + m - 1] AS words, max(a) AS longer FROM (SELECT lang, words, a, unnest(range(1, len(words))) AS i FROM c), (SELECT unnest(range(2, {DEPTH})) AS m) WHERE m < len(words) AND i + m - 1 <= len(words) GROUP BY ALL),
o AS (SELECT b.lang, array_to_string(b.words, ' ') AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM b LEFT JOIN i ON i.lang = b.lang AND i.words = b.words WHERE longer IS NULL OR longer < a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o) WHERE rank <= {TOP}"""
