"""Helpers that several corpus operators share: shared folders, Arrow batches, words, hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of these bytes after A-Z became a-z: digits, a-z and all of a multi-byte character.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BYTES = np.arange(256)
WORD_BYTE = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
#: Text that a task turns into numpy arrays at a time.
SLICE_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local run (one process, as in
    tests) gets a folder of its own; a cluster gets an error, as its executors would not see such a folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str, *, partition_by: str | None = None) -> DataFrame:
    """Writes a table in the shared folder and reads it back, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def batches(found: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the texts of each come to about `limit` bytes; a longer text is a batch of its own."""
    for batch in found:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < len(ends):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def each_row(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch one at a time, for rows that are large."""
    for i in range(batch.num_rows):
        yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}


def pack(array: np.ndarray) -> bytes:
    """The bytes of an array, compressed where that can pay; the first byte tells."""
    raw = np.ascontiguousarray(array).tobytes()
    return b"\1" + zstandard.ZstdCompressor(level=1).compress(raw) if len(raw) > 64 else b"\0" + raw


def unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]) if data[0] else data[1:], dtype=kind)


def arrow_rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


_SPARK = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SPARK[f.type]}" for f in schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of each row; a null is empty."""
    return batch.column(column).cast(pa.binary()).fill_null(b"").to_pylist()


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array with a line feed after each, and the place where each begins (and the end)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return data, starts


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word of lower-cased bytes that end with a separator."""
    inside = WORD_BYTE[data]
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        change = np.concatenate(([0], change))
    return change[0::2], change[1::2]


_BASE = 0x9E3779B97F4A7C15 | 1
_power = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base modulo 2**64, and of its inverse."""
    global _power, _inverse
    if len(_power) < n:
        size = max(n, 1 << 16)
        for name, base in (("_power", _BASE), ("_inverse", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)
    return _power[:n], _inverse[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters the bits of 64-bit numbers (the finishing step of a splitmix generator)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of byte * base**place before each place; one longer than the data."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    up, _ = powers(len(data))
    value = data.astype(np.uint64)
    value += np.uint64(1)
    value *= up
    np.cumsum(value, out=sums[1:])
    return sums


def run_hashes(sums: np.ndarray, begin: int, end: int, length: int) -> np.ndarray:
    """span_hashes of the spans of one length that begin at each place from begin to end."""
    _, down = powers(len(sums))
    raw = sums[begin + length : end + length] - sums[begin:end]
    raw *= down[begin:end]
    raw += np.uint64(length * 0xD6E8FEB86659FD93 % (1 << 64))
    return mix(raw)


def span_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes in each span."""
    _, down = powers(len(sums))
    raw = (sums[end] - sums[begin]) * down[begin]
    return mix(raw + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """The words of many texts as arrays: hash of each, and where each text's words begin."""

    def __init__(self, texts: list[bytes]):
        self.data, self.text_at = joined([t.lower() for t in texts])
        self.begin, self.end = word_bounds(self.data)
        self.at = np.searchsorted(self.begin, self.text_at)
        self.count = np.diff(self.at)
        self.hash = span_hashes(prefix_sums(self.data), self.begin, self.end)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of `width` words, and where each text's runs begin; a shorter text is one run."""
        n = len(self.hash)
        total = np.zeros(n, dtype=np.uint64)
        factor = mix(np.arange(1, width + 1, dtype=np.uint64))
        for j in range(width):
            if j < n:
                total[: n - j] += self.hash[j:] * (factor[j] | np.uint64(1))
        short = (self.count > 0) & (self.count < width)
        runs = np.where(short, 1, np.maximum(self.count - width + 1, 0))
        out_at = np.zeros(len(runs) + 1, dtype=np.int64)
        np.cumsum(runs, out=out_at[1:])
        place = np.arange(out_at[-1]) - np.repeat(out_at[:-1], runs) + np.repeat(self.at[:-1], runs)
        out = total[place]
        for i in np.flatnonzero(short):
            own = self.hash[self.at[i] : self.at[i + 1]]
            out[out_at[i]] = (own * (factor[: len(own)] | np.uint64(1))).sum(dtype=np.uint64) + np.uint64(len(own))
        return mix(out), out_at


def distinct_within(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each stretch, and where each stretch now begins."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(len(at)))
