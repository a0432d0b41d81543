"""Packing of documents into training windows by best-fit decreasing.

Documents longer than a window are first cut into full windows; what is left of each goes, longest first, to
the open window with the least room that still holds it. A segment tree over remaining room finds that window
in a number of steps that is the logarithm of the window's length.

Each shuffle partition of piece descriptions (not of ids) is packed on its own, in groups of a bounded size, so
no task sees more than its share and at most one group's last windows stay partly empty.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import batches
from .tokens import encoder

WINDOW = 4096
#: Pieces that are packed together; a task holds one group at a time.
GROUP_PIECES = 200_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long, padded_tokens long"


class OpenWindows:
    """Windows by remaining room: a segment tree counts them, so the tightest that fits is found by one walk."""

    def __init__(self, window: int):
        self.size = 1
        while self.size < window + 1:
            self.size *= 2
        self.count = [0] * (2 * self.size)
        self.held: list[list[int]] = [[] for _ in range(window + 1)]

    def change(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, window: int) -> None:
        self.held[room].append(window)
        self.change(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Room and number of the open window with the least room of at least `need`, which is then no longer open."""
        at, count = need + self.size, self.count
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at *= 2
                if not count[at]:
                    at += 1
        room = at - self.size
        self.change(room, -1)
        return room, self.held[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; lengths must not rise and lie within 1 and `window`."""
    numbers, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    open_windows, used = OpenWindows(window), 0
    for i, length in enumerate(lengths.tolist()):
        found = open_windows.take(length)
        if found is None:
            room, number = window, used
            used += 1
        else:
            room, number = found
        numbers[i], offsets[i] = number, window - room
        if room > length:
            open_windows.put(room - length, number)
    return numbers, offsets


def pieces(docs: DataFrame, tokenizer_path: str, *, window: int = WINDOW, end_id: int = 2) -> DataFrame:
    """One row per piece of each document's ids (with the end id): full windows, then the rest.

    A null text is empty and so is the single end id. Repeated rows are packed once each.
    """

    def cut(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        end = int(end_id).to_bytes(4, "little")
        for batch in batches(found):
            rows: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode(text or "") + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    part = ids[4 * start : 4 * (start + window)]
                    for column, value in zip(rows, (doc, start, len(part) // 4, zlib.crc32(part), total), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def pack(found: DataFrame, *, window: int = WINDOW, group: int = GROUP_PIECES) -> DataFrame:
    """Assigns each piece a sequence and an offset in it; offsets of a sequence leave no gap.

    padded_tokens is the length that the sequence takes: the window, or its own length where that is a power of two.
    An empty table gives no rows.
    """
    names = [x.split()[0] for x in PIECES.split(", ")]

    def place(table: pa.Table, first: int) -> tuple[pa.RecordBatch, int]:
        columns = {n: table.column(n).fill_null(np.iinfo(np.int64).min).to_numpy() for n in names}
        order = np.lexsort((columns["start"], columns["doc_id"], -columns["length"]))
        lengths = columns["length"][order]
        numbers, offsets = best_fit_decreasing(lengths, window)
        filled = np.bincount(numbers, weights=lengths).astype(np.int64)
        padded = np.where(filled & (filled - 1) == 0, filled, window)
        out = table.take(pa.array(order)).combine_chunks()
        arrays = [out.column(n).combine_chunks() for n in names]
        arrays += [pa.array(numbers + first), pa.array(offsets), pa.array(padded[numbers])]
        arrays = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in arrays]
        return pa.RecordBatch.from_arrays(arrays, names=[*names, "sequence_id", "offset", "padded_tokens"]), len(filled)

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, rows = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches_in:
            held.append(batch)
            rows += batch.num_rows
            if rows >= group:
                out, used = place(pa.Table.from_batches(held), first)
                yield out
                first, held, rows = first + used, [], 0
        if rows:
            yield place(pa.Table.from_batches(held), first)[0]

    return found.hint("rebalance", "doc_id").mapInArrow(run, PACKED)


def pack_documents(docs: DataFrame, tokenizer_path: str, *, window: int = WINDOW, end_id: int = 2) -> DataFrame:
    return pack(pieces(docs, tokenizer_path, window=window, end_id=end_id), window=window)
