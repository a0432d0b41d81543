"""Benchmark decontamination by Wu-Manber search for many test strings at once.

Texts become lower-cased words with one space between. The test strings are all windows of `width` words of the
items (a shorter item is one window). Strings of about one length share a table: for each block of bytes it says
how far the search may move on without missing a string. Where it may not move, the block at the end of the
strings' common length selects a bucket of strings, and each is compared byte by byte with the text.
Many stretches of text are searched in step, so every operation works on a whole array of places.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTE, batches, joined, stored, texts_of, word_bounds

WIDTH = 13
#: Bytes of item text whose windows are held in one task's tables; more items take more passes over the documents.
BLOCK_BYTES = 4 << 20
#: Longest block in bytes, and slots of the smallest table as a power of two.
MOST_BLOCK, LEAST_BITS = 16, 16
#: Test strings of these lengths or more are searched together, so that short ones don't shorten all moves.
CLASSES = (1, 12, 40)
LANE = 1024
#: Places and strings that may agree there, looked at in one go.
PAIRS = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def plain_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words with one space between and a line feed after each text; where words begin and end; words before each text."""
    data, text_at = joined([t.lower() for t in texts])
    begin, end = word_bounds(data)
    at = np.searchsorted(begin, text_at)
    inside = WORD_BYTE[data]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    out = data[keep]
    size = end - begin
    new_begin = np.zeros(len(size) + 1, dtype=np.int64)
    np.cumsum(size + 1, out=new_begin[1:])
    new_end = new_begin[1:] - 1
    out[new_end] = 32
    last = at[1:][np.diff(at) > 0] - 1
    out[new_end[last]] = 10
    return out, new_begin[:-1], new_end, at


class Search:
    """Tables for some strings: places of `data` of `start` and `length`.

    A block is as long as the strings are many (a letter of text counts as two bits here), and the table has eight
    slots or more for each block that stands in them: so most places of a text allow a long move at any number of strings.
    """

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.data, self.start, self.length = data, start, length
        self.m = int(length.min())
        many = math.ceil(math.log2(2 * len(start) * self.m) / 2)
        self.block = max(1, min(MOST_BLOCK, self.m // 2, many))
        keys = self.keys(data)
        moves = range(self.m - self.block + 1)
        standing = np.zeros(len(keys), dtype=bool)
        for j in moves:
            standing[start + j] = True
        self.bits = max(LEAST_BITS, int(8 * standing.sum() - 1).bit_length())
        self.table = np.full(1 << self.bits, min(127, self.m - self.block + 1), dtype=np.int8)
        for j in moves:  # from the longest move to none, so that the shortest one of a slot stays
            self.table[self.slot(keys[start + j])] = min(127, self.m - self.block - j)
        suffix = keys[start + self.m - self.block]
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]

    def keys(self, data: np.ndarray) -> np.ndarray:
        """The block from each place as one number, hashed; data must end with MOST_BLOCK spare bytes."""
        eight = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
        size = len(data) - MOST_BLOCK
        if self.block <= 8:
            return (eight[:size] & np.uint64((1 << (8 * self.block)) - 1)) * _MULTIPLIER
        last = eight[self.block - 8 : self.block - 8 + size]
        return (eight[:size] * _MULTIPLIER ^ last) * _MULTIPLIER

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and string number of all occurrences; data must end with MOST_BLOCK spare bytes."""
        size = len(data) - MOST_BLOCK
        keys, first, last = self.keys(data), self.m - self.block, size - self.block
        if last < first:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        place = np.arange(first, last + 1, LANE)
        stop = np.append(place[1:], last + 1)
        held = []
        while len(place):
            move = self.table[self.slot(keys[place])]
            still = move == 0
            if still.any():
                held.append(place[still])
            place = place + np.maximum(move, 1)
            on = place < stop
            place, stop = place[on], stop[on]
        if not held:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        place = np.concatenate(held)
        value = keys[place]
        low, high = np.searchsorted(self.suffix, value, "left"), np.searchsorted(self.suffix, value, "right")
        times = high - low
        # Short strings share their last block with many others, so places are looked at a bounded number of pairs at a time.
        ends, found, at = np.cumsum(times), [], 0
        while at < len(place):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
            t = times[at:to]
            which = self.order[np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t) + np.repeat(low[at:to], t)]
            begin = np.repeat(place[at:to], t) - first
            fits = begin + self.length[which] <= size
            found.append(self.confirm(data, begin[fits], which[fits]))
            at = to
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def confirm(self, data: np.ndarray, begin: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keeps the places where all bytes of the string stand."""
        good = []
        for at in range(0, len(begin), 4096):
            b, w = begin[at : at + 4096], which[at : at + 4096]
            size = self.length[w]
            owner = np.repeat(np.arange(len(b)), size)
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            same = data[b[owner] + within] == self.data[self.start[w[owner]] + within]
            good.append(np.bincount(owner[~same], minlength=len(b)) == 0)
        keep = np.concatenate(good) if good else np.zeros(0, dtype=bool)
        return begin[keep], which[keep]


class TestStrings:
    """All windows of some items, with the items that each belongs to. What is sent to tasks is the items' words once,
    places in them and numbers of items; each Python worker builds the tables when it needs them first."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str]], width: int = WIDTH):
        data, begin, end, at = plain_words([(text or "").encode() for _, text in items])
        count = np.diff(at)
        windows = np.maximum(np.minimum(count, 1), count - width + 1)
        item = np.repeat(np.arange(len(items)), windows)
        word = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + at[item]
        to = np.minimum(word + width, at[item + 1])
        raw, number = data.tobytes(), {}
        which = np.array([number.setdefault(raw[b:e], len(number)) for b, e in zip(begin[word].tolist(), end[to - 1].tolist(), strict=True)], dtype=np.int64)
        _, first = np.unique(which, return_index=True)
        self.names = np.array([name for name, _ in items], dtype=object)
        self.data = np.concatenate((data, np.zeros(MOST_BLOCK, dtype=np.uint8)))
        self.start = begin[word[first]].astype(np.int32)
        self.size = (end[to[first] - 1] - begin[word[first]]).astype(np.int32)
        self.width = (to - word)[first].astype(np.int32)
        pairs = np.unique(np.stack((which, item)), axis=1)
        self.owner = pairs[1].astype(np.int32)
        self.owner_at = np.searchsorted(pairs[0], np.arange(len(first) + 1)).astype(np.int32)
        self._searches: list[tuple[np.ndarray, Search]] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_searches": None}

    @property
    def searches(self) -> list[tuple[np.ndarray, Search]]:
        if self._searches is None:
            self._searches = []
            for low, high in zip(CLASSES, (*CLASSES[1:], 1 << 62), strict=True):
                own = np.flatnonzero((self.size >= low) & (self.size < high))
                if len(own):
                    self._searches.append((own, Search(self.data, self.start[own].astype(np.int64), self.size[own].astype(np.int64))))
        return self._searches

    def owners(self, string: int) -> np.ndarray:
        return self.names[self.owner[self.owner_at[string] : self.owner_at[string + 1]]]

    def scan(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """Per text: number of words, spans of hit words, items."""
        data, begin, end, at = plain_words(texts)
        spare = np.concatenate((data, np.full(MOST_BLOCK, 10, dtype=np.uint8)))
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        for own, search in self.searches:
            place, which = search.find(spare)
            if not len(place):
                continue
            which = own[which]
            word = np.searchsorted(begin, place)
            aligned = (word < len(begin)) & (begin[np.minimum(word, len(begin) - 1)] == place)
            word, which = word[aligned], which[aligned]
            to = word + self.width[which]
            whole = (to <= len(begin)) & (end[np.minimum(to, len(end)) - 1] == begin[word] + self.size[which])
            word, which, to = word[whole], which[whole], to[whole]
            text = np.searchsorted(at, word, side="right") - 1
            for t, w, e, k in zip(text.tolist(), word.tolist(), to.tolist(), which.tolist(), strict=True):
                spans[t].append((w - int(at[t]), e - int(at[t])))
                items[t].update(self.owners(k))
        return [(int(n), merged(s), sorted(i)) for n, s, i in zip(np.diff(at), spans, items, strict=True)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


FOUND = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<array<long>>, items array<string>"


def decided(n_words: int, spans: list[tuple[int, int]], items: list[str]) -> tuple:
    n_hit = sum(e - b for b, e in spans)
    digest = hashlib.sha256(",".join(items).encode()).hexdigest()
    return n_words, n_hit, len(items), digest, n_hit > 0 and 20 * n_hit >= n_words, [list(x) for x in spans], items


def rows_of(ids: list, found: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()),
        ("contaminated", pa.bool_()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string())),
    ])
    columns = list(zip(*found, strict=True)) if found else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((ids, *columns), schema.types, strict=True)], schema=schema)


def passes_for(benchmark: DataFrame, block_bytes: int) -> int:
    return max(1, math.ceil((benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))


def judged(docs: DataFrame, benchmark: DataFrame, width: int, block_bytes: int, key: str) -> DataFrame:
    """FOUND for each row, with `key` (doc_id, or a number of the row) in place of doc_id; with several blocks of
    items the key must tell rows apart."""
    blocks = passes_for(benchmark, block_bytes)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    passes = []
    for k in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        tables = docs.sparkSession.sparkContext.broadcast(TestStrings([tuple(r) for r in own.collect()], width))  # some four times block_bytes

        def scan(found: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            for batch in batches(found):
                yield rows_of(batch.column(key).to_pylist(), [decided(*x) for x in tables.value.scan(texts_of(batch))])

        found = docs.select(key, "text").mapInArrow(scan, FOUND)
        if blocks == 1:
            return found
        # Stored block by block, so that one block's strings are held at a time; the first pass has a row for each text.
        passes.append(stored(found.where("n_hit > 0") if passes else found, "block"))
        tables.destroy()
    every = reduce(DataFrame.unionByName, passes)
    together = every.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))

    def join_passes(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows = batch.to_pylist()
            yield rows_of([r["doc_id"] for r in rows], [decided(r["n_words"], merged([tuple(x) for x in r["spans"]]), sorted(set(r["items"]))) for r in rows])

    return together.mapInArrow(join_passes, FOUND)


def numbered_rows(docs: DataFrame) -> DataFrame:
    """row_number, row (all columns) and text, in a stored table, so that the numbers stay."""
    return stored(docs.select(F.monotonically_increasing_id().alias("row_number"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text"), "documents")


def contamination(docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of `docs`: words, hit words, items found, and whether at least a twentieth of its words are hit.

    A null text has no words. Items without words match nothing; items with equal texts all count. The items are
    dealt into as many blocks as their total size asks for, and each block is one pass over the documents; the
    result doesn't depend on that. Repeated rows, and texts under one doc_id, are judged each on its own.
    """
    if passes_for(benchmark, block_bytes) == 1:
        return judged(docs, benchmark, width, block_bytes, "doc_id")
    rows = numbered_rows(docs)
    found = judged(rows, benchmark, width, block_bytes, "row_number").withColumnRenamed("doc_id", "row_number")
    return rows.select("row_number", F.col("row.doc_id").cast("long").alias("doc_id")).join(found, "row_number").select([x.split()[0] for x in FOUND.split(", ")])


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs`, with all their columns, that are not contaminated; of repeated rows each is judged."""
    if passes_for(benchmark, block_bytes) > 1:
        rows = numbered_rows(docs)
        bad = judged(rows, benchmark, width, block_bytes, "row_number").where("contaminated").select(F.col("doc_id").alias("row_number"))
        return rows.join(bad, "row_number", "left_anti").select("row.*")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").collect()
    tables = docs.sparkSession.sparkContext.broadcast(TestStrings([tuple(r) for r in items], width))  # within block_bytes

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found):
            yield batch.filter(pa.array([not decided(*x)[4] for x in tables.value.scan(texts_of(batch))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
