"""Removal of long byte strings that stand earlier in the collection, by column-wise suffix sorting.

Sorting every suffix of a large collection column by column takes as many passes over all of it as its longest
text has bytes. So the places that can matter are found first: in each stretch of LENGTH bytes the short strings
with the least hash are its anchors, and equal stretches have equal anchors. A stretch with an anchor holds 68
bytes from the anchor on, or 33 before it and the anchor; only anchors of which one of these two strings stands
more than once are kept. Around each of these lies a segment that holds every stretch with that anchor. The segments of a
bucket of anchors are then sorted by the column-wise construction: in each round one symbol of every segment is
put in front of what was sorted before; the symbols in that order are the round's part of the Burrows-Wheeler
transform, and the common prefixes of neighbours follow from those of the round before. Where a common prefix
reaches LENGTH, the stretches are equal, and all but the earliest are marked. In place of sequential files the
buckets are Spark partitions.

Blocks of documents are the unit of all exchanges: a block names each anchor and each distinct segment once, so
no key of any exchange holds more rows than there are blocks; an anchor beside which stands a string of very many
blocks is exchanged by stretch too, and by segment only where its other string repeats in fewer blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, batches, ddl, each_row, pack, prefix_sums, run_hashes, span_hashes, stored, texts_of, unpack

LENGTH, ANCHOR = 100, 36
BEFORE = LENGTH - ANCHOR
SEGMENT = BEFORE + LENGTH
#: Every stretch with an anchor holds so many bytes before it, or else so many from it on.
LEFT = BEFORE // 2 + 1
RIGHT = LENGTH - LEFT + 1
BLOCK_BYTES = 3 << 20
BUCKET_BYTES = 4 << 20
#: A string beside an anchor that stands in more blocks than this is exchanged by stretch.
HOT_BLOCKS = 2_000
#: Places that are looked at in one go, and segments that are cut out in one go.
STEP, CUT = 1 << 18, 4_000
PAD = 255  # stands in no UTF-8 text
_EMPTY = np.zeros(0, dtype=np.int64)


def to_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, n_bytes, data: rows of documents (all columns, in order of doc_id) as compressed Arrow data."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def made():
            table = pa.Table.from_batches(held).sort_by([("doc_id", "ascending")]).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "n_bytes", "data"])

        for batch in batches(found):
            own = sum(map(len, texts_of(batch)))
            if held and size + own > block_bytes:
                yield made()
                block, held, size = block + 1, [], 0
            held.append(batch)
            size += own
        if held:
            yield made()

    return stored(docs.mapInArrow(run, "block long, n_bytes long, data binary"), "blocks")


def sliding(choose: np.ufunc, values: np.ndarray) -> np.ndarray:
    """The least or greatest of each run of BEFORE + 1 values."""
    width = 1
    while width * 2 <= BEFORE + 1:
        values = choose(values[:-width], values[width:])
        width *= 2
    more = BEFORE + 1 - width
    return choose(values[:-more], values[more:]) if more else values


class Block:
    """The texts of a block in one array, its anchors and the stretches around them."""

    def __init__(self, data: bytes):
        self.table = pa.ipc.open_stream(data).read_all().combine_chunks()
        texts = self.table.column("text").cast(pa.binary()).fill_null(b"").to_pylist()
        self.size = np.array([len(t) for t in texts], dtype=np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.size)))
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.doc = self.table.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Place and hash of each anchor."""
        n = len(self.data)
        if n < LENGTH:
            return _EMPTY, _EMPTY.astype(np.uint64)
        self.sums = prefix_sums(self.data)
        ends = np.repeat(self.at[1:].astype(np.int32), self.size)
        place, hashes = [], []
        for low in range(0, n - ANCHOR + 1, STEP):
            high = min(low + STEP, n - ANCHOR + 1)
            begin, end = max(0, low - BEFORE), min(n - ANCHOR + 1, high + BEFORE)
            own = run_hashes(self.sums, begin, end, ANCHOR) | np.uint64(1)
            least = sliding(np.minimum, own)
            # Stretches across two texts don't count.
            start = np.arange(begin, begin + len(least), dtype=np.int32)
            least[start + LENGTH > ends[begin : begin + len(least)]] = 0
            none = np.zeros(BEFORE, dtype=np.uint64)
            most = sliding(np.maximum, np.concatenate((none, least, none)))
            found = np.flatnonzero(most[low - begin : high - begin] == own[low - begin : high - begin])
            place.append(found + low)
            hashes.append(own[low - begin : high - begin][found])
        return np.concatenate(place), np.concatenate(hashes)

    def sides(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the string from each anchor on and of the one up to its end, and where the text has them."""
        before, after = self.reach(place)
        has_right, has_left = after >= RIGHT, before >= LEFT
        right, left = place[has_right], place[has_left]
        out = [np.zeros(len(place), dtype=np.uint64), np.zeros(len(place), dtype=np.uint64)]
        out[0][has_right] = span_hashes(self.sums, right, right + RIGHT)
        out[1][has_left] = span_hashes(self.sums, left - LEFT, left + ANCHOR)
        return out[0], out[1], has_right, has_left

    def reach(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the anchor's text before it and from it on, as far as a segment goes."""
        text = np.searchsorted(self.at, place, side="right") - 1
        return np.minimum(place - self.at[text], BEFORE), np.minimum(self.at[text + 1] - place, LENGTH)

    def segments(self, place: np.ndarray) -> np.ndarray:
        out = np.full((len(place), SEGMENT), PAD, dtype=np.uint8)
        column = np.arange(-BEFORE, LENGTH, dtype=np.int32)
        for at in range(0, len(place), CUT):
            some = place[at : at + CUT]
            before, after = self.reach(some)
            index = some[:, None].astype(np.int32) + column
            inside = (column >= -before[:, None]) & (column < after[:, None])
            out[at : at + CUT][inside] = self.data[index[inside]]
        return out

    def starts(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place at which a stretch with the anchor may begin."""
        before, after = self.reach(place)
        return place - before, place + after - LENGTH


def spans_row(block: int, first: np.ndarray, last: np.ndarray) -> tuple[int, bytes]:
    """Stretches that begin within first to last (both included) are marked."""
    fine = last >= first
    return block, pack(np.stack((first[fine], last[fine]), axis=1).astype("<i4"))


def bucket_rows(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Stretches of sorted 64-bit keys by equal ranges of their values; only the buckets that occur."""
    bucket = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(keys) else np.zeros(1, dtype=np.int64)
    for begin, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield int(bucket[begin]), slice(begin, end)


NAMED = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary())])
REPEATED = pa.schema([("block", pa.int64()), ("hashes", pa.binary()), ("hot", pa.binary())])
SENT = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary()), ("places", pa.binary()), ("bytes", pa.binary())])
MARKED = pa.schema([("block", pa.int64()), ("spans", pa.binary())])
def repeated_anchors(blocks: DataFrame, buckets: int, hot_blocks: int) -> DataFrame:
    """Per block the strings beside its anchors that other blocks hold too, and those of them that very many hold."""

    def name(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for r in each_row(batch):
                b = Block(r["data"])
                place, _ = b.anchors()
                right, left, has_right, has_left = b.sides(place) if len(place) else [_EMPTY.astype(np.uint64)] * 2 + [_EMPTY.astype(bool)] * 2
                hashes = np.unique(np.concatenate((right[has_right], left[has_left])))
                yield arrow_rows(NAMED, [(k, r["block"], hashes[own].tobytes()) for k, own in bucket_rows(hashes, buckets)])

    def repeated(group: pa.Table) -> pa.Table:
        raw = group.column("hashes").to_pylist()
        values = np.frombuffer(b"".join(raw), dtype=np.uint64)
        owner = np.repeat(np.arange(len(raw)), [len(x) // 8 for x in raw])
        _, number, times = np.unique(values, return_inverse=True, return_counts=True)
        times = times[number]
        rows = []
        at = np.searchsorted(owner, np.arange(len(raw) + 1))
        for i, block in enumerate(group.column("block").to_pylist()):
            own, often = values[at[i] : at[i + 1]], times[at[i] : at[i + 1]]
            rows.append((block, own[(often > 1) & (often <= hot_blocks)].tobytes(), own[often > hot_blocks].tobytes()))
        return pa.Table.from_batches([arrow_rows(REPEATED, rows)])

    named = blocks.select("block", "data").mapInArrow(name, ddl(NAMED))
    found = named.groupBy("bucket").applyInArrow(repeated, ddl(REPEATED))
    return found.groupBy("block").agg(F.collect_list("hashes").alias("hashes"), F.collect_list("hot").alias("hot"))


def exchange(block: int, data: bytes, hashes: list[bytes], hot: list[bytes], buckets: int) -> list[tuple]:
    """What a block sends: each distinct segment around a repeated anchor once, from its earliest place; each
    distinct stretch around a hot anchor once; and marks for what is a repetition within the block.

    Equal stretches agree on one of the two strings beside their anchors, but the other string may make only one of
    these anchors hot. So each string decides for itself: what agrees on one that is not hot goes by segment."""
    b = Block(data)
    place, own = b.anchors()
    if not len(place):
        return []
    elsewhere = np.frombuffer(b"".join(hashes), dtype=np.uint64)
    very = np.sort(np.frombuffer(b"".join(hot), dtype=np.uint64))
    wanted, is_hot = np.zeros(len(place), dtype=bool), np.zeros(len(place), dtype=bool)
    right, left, has_right, has_left = b.sides(place)
    for side, has in ((right, has_right), (left, has_left)):
        _, number, times = np.unique(side, return_inverse=True, return_counts=True)
        often = np.isin(side, very)
        wanted |= has & ~often & ((times[number] > 1) | np.isin(side, elsewhere))
        is_hot |= has & often
    rows, first_mark, last_mark = [], [], []
    doc_of = lambda p: b.doc[np.searchsorted(b.at, p, side="right") - 1]

    anchor, key = place[wanted], own[wanted]
    before, after = b.reach(anchor)
    whole = span_hashes(b.sums, anchor - before, anchor + after) + (before * 128 + after).astype(np.uint64)
    order = np.lexsort((anchor, whole))
    anchor, key, whole = anchor[order], key[order], whole[order]
    new = np.concatenate(([True], whole[1:] != whole[:-1])) if len(whole) else np.zeros(0, dtype=bool)
    leader = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else _EMPTY
    for at in range(0, len(anchor), CUT):  # equal hashes are looked at again, byte by byte
        some = np.arange(at, min(at + CUT, len(anchor)))
        some = some[~new[some]]
        differs = (b.segments(anchor[some]) != b.segments(anchor[leader[some]])).any(axis=1)
        new[some[differs]] = True
    first, last = b.starts(anchor[~new])
    first_mark.append(first), last_mark.append(last)
    anchor, key = anchor[new], key[new]
    order = np.argsort(key, kind="stable")
    anchor, key = anchor[order], key[order]
    for k, part in bucket_rows(key, buckets):
        p = anchor[part]
        rows.append((k, 0, block, pack(key[part]), pack(doc_of(p)), pack(p.astype("<i4")), pack(b.segments(p))))

    if is_hot.any():
        first, last = b.starts(place[is_hot])
        change = np.zeros(len(b.data) + 2, dtype=np.int64)
        fine = last >= first
        np.add.at(change, first[fine], 1)
        np.add.at(change, last[fine] + 1, -1)
        start = np.flatnonzero(np.cumsum(change) > 0)
        key = span_hashes(b.sums, start, start + LENGTH)
        check = span_hashes(b.sums, start + LENGTH // 4, start + 3 * LENGTH // 4)
        order = np.lexsort((start, check, key))
        start, key, check = start[order], key[order], check[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])))
        first_mark.append(start[~new]), last_mark.append(start[~new])
        start, key, check = start[new], key[new], check[new]
        for k, part in bucket_rows(key, buckets):
            rows.append((k, 1, block, pack(key[part]), pack(doc_of(start[part])), pack(start[part].astype("<i4")), pack(check[part])))
    mark = spans_row(block, np.concatenate(first_mark), np.concatenate(last_mark))
    rows.append((int(block) % buckets, 2, block, None, None, None, mark[1]))
    return rows


def equal_stretches(segments: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Column-wise sorting of segments, the earliest first: yields, for each number of bytes before the anchor,
    the segments in the order of what stands from there on, and the number of the group of equal stretches."""
    n = len(segments)
    columns = np.ascontiguousarray(segments.T)
    order, common = np.arange(n), np.zeros(n, dtype=np.uint8)
    for column in range(SEGMENT - 1, -1, -1):
        symbol = columns[column][order]
        turn = np.argsort(symbol, kind="stable")
        order, symbol = order[turn], symbol[turn]
        # The common prefix of new neighbours with one symbol is one more than the least between them before.
        low, high = turn[:-1], turn[1:]
        least = common[high]
        far = np.flatnonzero((high - low > 1) & (symbol[1:] == symbol[:-1]))
        if len(far):
            between = np.stack((low[far] + 1, high[far] + 1), axis=1).ravel()
            between[-1] = min(between[-1], n)
            padded = np.append(common, np.uint8(0))
            least[far] = np.minimum.reduceat(padded, between)[0::2]
        common = np.zeros(n, dtype=np.uint8)
        common[1:] = np.where(symbol[1:] == symbol[:-1], np.minimum(least, LENGTH - 1) + 1, 0)
        if column <= BEFORE:
            yield BEFORE - column, order, np.cumsum(common < LENGTH) - 1


def mark_bucket(group: pa.Table) -> pa.Table:
    """Marks of one bucket, by block."""
    kind = group.column("kind").to_numpy()
    rows = list(zip(*(group.column(c).to_pylist() for c in ("block", "keys", "docs", "places", "bytes")), strict=True))
    out = [(rows[i][0], rows[i][4]) for i in np.flatnonzero(kind == 2)]
    for one in (0, 1):
        own = [rows[i] for i in np.flatnonzero(kind == one)]
        if not own:
            continue
        key, doc, place = (np.concatenate([unpack(r[j], t) for r in own]) for j, t in ((1, "<u8"), (2, "<i8"), (3, "<i4")))
        size = [len(unpack(r[3], "<i4")) for r in own]
        block = np.repeat([r[0] for r in own], size)
        order = np.lexsort((place, block, doc))
        if one == 1:
            check = np.concatenate([unpack(r[4], "<u8") for r in own])[order]
            rank = np.lexsort((np.arange(len(order)), check, key[order]))
            k, c = key[order][rank], check[rank]
            later = np.concatenate(([False], (k[1:] == k[:-1]) & (c[1:] == c[:-1])))
            again = order[rank[later]]
            first = last = place[again].astype(np.int64)
            out += spread(block[again], first, last)
            continue
        segments, at = np.empty((len(order), SEGMENT), dtype=np.uint8), 0
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        for r, n in zip(own, size, strict=True):
            segments[rank[at : at + n]] = unpack(r[4], "<u1").reshape(-1, SEGMENT)
            at += n
        key, block, place = key[order], block[order], place[order].astype(np.int64)
        before = np.count_nonzero(segments[:, :BEFORE] != PAD, axis=1)
        after = np.count_nonzero(segments[:, BEFORE:] != PAD, axis=1)
        # Equal segments: all but the earliest are marked whole.
        view = segments.view([("", f"V{SEGMENT}")]).ravel()
        rank = np.lexsort((np.arange(len(key)), key))
        k = key[rank]
        group_at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        copy = np.zeros(len(key), dtype=bool)
        for begin, end in zip(group_at.tolist(), [*group_at[1:].tolist(), len(key)], strict=True):
            if end - begin > 1:
                seen = set()
                for i in rank[begin:end].tolist():
                    raw = view[i].tobytes()
                    copy[i] = raw in seen
                    seen.add(raw)
        out += spread(block[copy], (place - before)[copy], (place + after - LENGTH)[copy])
        # Anchors with several different segments: sort these, column by column.
        single = ~copy
        number = np.cumsum(np.concatenate(([0], k[1:] != k[:-1])))
        different = np.bincount(number, weights=single[rank], minlength=len(group_at))
        several = np.zeros(len(key), dtype=bool)
        several[rank] = different[number] > 1
        own = np.flatnonzero(single & several)
        if len(own) < 2:
            continue
        before, after, place, block = before[own], after[own], place[own], block[own]
        marked = np.zeros((len(own), BEFORE + 1), dtype=bool)
        for ahead, order, group_of in equal_stretches(segments[own]):
            first = np.minimum.reduceat(order, np.flatnonzero(np.diff(group_of, prepend=-1)))
            again = order != first[group_of]
            marked[order[again], ahead] = True
        ahead = np.arange(BEFORE + 1)
        marked &= (ahead <= before[:, None]) & (LENGTH - ahead <= after[:, None])
        edge = np.diff(np.pad(marked, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, begin = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        out += spread(block[row], place[row] - end + 1, place[row] - begin)
    return pa.Table.from_batches([arrow_rows(MARKED, out)])


def spread(block: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[tuple[int, bytes]]:
    order = np.argsort(block, kind="stable")
    block, first, last = block[order], first[order], last[order]
    at = np.flatnonzero(np.diff(block, prepend=-1, append=-1)) if len(block) else []
    return [spans_row(int(block[a]), first[a:b], last[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def removed(data: bytes, spans: list[bytes] | None) -> tuple[Block, np.ndarray]:
    """The block and which of its bytes go."""
    b = Block(data)
    change = np.zeros(len(b.data) + LENGTH + 1, dtype=np.int32)
    for raw in spans or []:
        pairs = unpack(raw, "<i4").reshape(-1, 2)
        np.add.at(change, pairs[:, 0], 1)
        np.add.at(change, pairs[:, 1] + LENGTH, -1)
    return b, np.cumsum(change)[: len(b.data)] > 0


def marked_blocks(docs: DataFrame, *, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """block, data and the marks that belong to it."""
    blocks = to_blocks(docs, block_bytes)
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(8, -(-total // bucket_bytes))
    repeated = repeated_anchors(blocks, buckets, hot_blocks)

    def send(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for r in each_row(batch):
                yield arrow_rows(SENT, exchange(r["block"], r["data"], r["hashes"] or [], r["hot"] or [], buckets))

    sent = blocks.select("block", "data").join(repeated, "block", "left").mapInArrow(send, ddl(SENT))
    marks = sent.groupBy("bucket").applyInArrow(mark_bucket, ddl(MARKED))
    return blocks.join(marks.groupBy("block").agg(F.collect_list("spans").alias("spans")), "block", "left").select("block", "data", "spans")


def over_blocks(marked: DataFrame, make: Callable[[Block, np.ndarray], pa.RecordBatch | pa.Table], schema: str | T.StructType) -> DataFrame:
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for r in each_row(batch):
                yield make(*removed(r["data"], r["spans"]))

    return marked.mapInArrow(run, schema)


FOUND = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def repeated_bytes(docs: DataFrame, **sizes: int) -> DataFrame:
    """Per document: bytes, removed bytes, removed runs, and the digest of what is left.

    A byte goes if it lies in a string of LENGTH bytes that also begins earlier: in a document of smaller doc_id, or
    earlier in the same one. A null text is empty, texts under LENGTH bytes lose nothing, a null doc_id comes
    first. Repeated rows count as separate documents, in any fixed order. An empty table gives no rows.
    """

    def make(b: Block, gone: np.ndarray) -> pa.RecordBatch:
        rows = []
        for i, doc in enumerate(b.table.column("doc_id").to_pylist()):
            own = slice(b.at[i], b.at[i + 1])
            flags = gone[own]
            runs = int(np.count_nonzero(flags[1:] & ~flags[:-1])) + int(len(flags) > 0 and flags[0])
            rows.append((doc, len(flags), int(flags.sum()), runs, hashlib.sha256(b.data[own][~flags].tobytes()).hexdigest()))
        return arrow_rows(pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]), rows)

    return over_blocks(marked_blocks(docs.select("doc_id", "text"), **sizes), make, FOUND)


def without_repeats(docs: DataFrame, **sizes: int) -> DataFrame:
    """The rows of `docs` with all their columns and the repeated bytes cut out of `text`.

    Parts of a character that a cut leaves are dropped too; a null text stays null; `n_chars`, where there is such
    a column, is counted anew.
    """
    schema = docs.schema

    def make(b: Block, gone: np.ndarray) -> pa.RecordBatch:
        texts = []
        for i, known in enumerate(b.table.column("text").is_valid().to_pylist()):
            own = slice(b.at[i], b.at[i + 1])
            texts.append(b.data[own][~gone[own]].tobytes().decode("utf-8", "ignore") if known else None)
        table = b.table.set_column(b.table.column_names.index("text"), "text", pa.array(texts, pa.string()))
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in table.columns], names=table.column_names)

    out = over_blocks(marked_blocks(docs, **sizes), make, schema)
    return out.withColumn("n_chars", F.char_length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
