"""Cross-entropy difference of documents between a target and a background language model.

Both models are bigram models over one vocabulary (all words of the corpus; where a size is given, the most
frequent ones, and one sign for all others) with the same smoothing: the counts of a pair are drawn towards the
word's own share by a fixed weight.
The background model is counted over all documents, the target model over the chosen ones. A document's score is
the mean, over its words, of the target loss less the background loss; the lower, the more like the target.

A word's number is its 64-bit hash, and counts stay distributed. Blocks of documents send each of their words and
pairs once, with its counts, to buckets; a bucket adds them up and sends back the totals, in the order in which the
block named them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, arrow_rows, batches, ddl, each_row, mix, pack, stored, texts_of, unpack
from .suffix_dedup import bucket_rows

WEIGHT = 4.0
BLOCK_WORDS = 500_000
BUCKET_WORDS = 600_000
LOCAL_WORDS = 150_000
#: Ids of the target documents are sent to all tasks if there are no more of them than this.
SENT_IDS = 1_000_000
OTHER, BEGIN = 0, 1
_FIRST = 2


def vocabulary(docs: DataFrame, size: int) -> list[bytes]:
    """The most frequent words over all documents, at most `size`: all that occur often enough, so that none is
    preferred to one of equal count. Only counts of counts and the chosen words reach the driver."""

    def count(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def made():
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches(found):
            words = Words(texts_of(batch))
            raw = words.data.tobytes()
            _, first, times = np.unique(words.hash, return_index=True, return_counts=True)
            for b, e, n in zip(words.begin[first].tolist(), words.end[first].tolist(), times.tolist(), strict=True):
                held[raw[b:e]] += n
            if len(held) > LOCAL_WORDS:
                yield made()
        yield made()

    counted = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = stored(counted, "words")
    least, chosen = None, 0
    # Each count is that of one word at least, so the greatest `size` counts decide.
    counts = counted.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(size + 1)
    for n, words in counts.collect():
        if chosen + words > size:
            break
        least, chosen = n, chosen + words
    rows = counted.where(F.col("n") >= F.lit(least)).collect() if chosen else []
    return [bytes(r.word) for r in sorted(rows, key=lambda r: (-r.n, bytes(r.word)))]


class Known:
    """The hashes of a chosen vocabulary."""

    def __init__(self, words: list[bytes]):
        self.hash = np.unique(np.maximum(Words([b" ".join(words)]).hash, np.uint64(_FIRST)))

    def of(self, hashes: np.ndarray) -> np.ndarray:
        return np.where(np.isin(hashes, self.hash), hashes, np.uint64(OTHER))


BLOCKS = pa.schema([("block", pa.int64()), ("n_words", pa.int64()), ("n_target", pa.int64()), ("docs", pa.binary()), ("known", pa.binary()), ("lengths", pa.binary()), ("target", pa.binary()), ("words", pa.binary()), ("places", pa.binary())])
NAMED = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
TOTALS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("seen", pa.int64()), ("totals", pa.binary())])


def pack_planes(numbers: np.ndarray) -> bytes:
    """64-bit numbers with equal bytes of all beside each other, as most of those bytes are alike."""
    return pack(numbers.astype("<u8").view("u1").reshape(-1, 8).T)


def unpack_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpack(data, "u1").reshape(8, -1).T).view("<u8").ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences."""
    return pack_planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_planes(data), dtype=np.uint64)


def numbered(docs: DataFrame, target: DataFrame, words: list[bytes] | None) -> DataFrame:
    """Blocks of documents as hashes of words (each once) and their places, with a flag for target documents."""
    known = None if words is None else docs.sparkSession.sparkContext.broadcast(Known(words))  # bounded by the size

    def block_up(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, size = TaskContext.get().partitionId() << 32, [], 0

        def made():
            docs_, lengths, flags, ids = (list(x) for x in zip(*rows, strict=True))
            distinct, place = np.unique(np.concatenate(ids), return_inverse=True)
            n_target = sum(n for n, y in zip(lengths, flags, strict=True) if y)
            return arrow_rows(BLOCKS, [(
                block, size, n_target, pack(np.array([d or 0 for d in docs_], dtype="<i8")), pack(np.array([d is not None for d in docs_], dtype="u1")),
                pack(np.array(lengths, dtype="<i8")), pack(np.array(flags, dtype="u1")), pack_keys(distinct), pack(place.astype("<u4")),
            )])

        for batch in batches(found):
            w = Words(texts_of(batch))
            ids = np.maximum(w.hash, np.uint64(_FIRST))
            if known is not None:
                ids = known.value.of(ids)
            for i, (doc, flag) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("is_target").to_pylist(), strict=True)):
                own = ids[w.at[i] : w.at[i + 1]]
                rows.append((doc, len(own), flag, own))
                size += len(own)
                if size >= BLOCK_WORDS:
                    yield made()
                    block, rows, size = block + 1, [], 0
        if rows:
            yield made()

    chosen = target.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("is_target", F.lit(True))
    if chosen.count() <= SENT_IDS:  # else the texts meet them in a shuffle
        chosen = F.broadcast(chosen)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    flagged = texts.join(chosen, "doc_id", "left").select("doc_id", "text", F.coalesce("is_target", F.lit(False)).alias("is_target"))
    return stored(flagged.mapInArrow(block_up, ddl(BLOCKS)), "numbered")


class NumberedBlock:
    def __init__(self, row: dict):
        self.docs = [d if k else None for d, k in zip(unpack(row["docs"], "<i8").tolist(), unpack(row["known"], "u1").tolist(), strict=True)]
        self.length = unpack(row["lengths"], "<i8")
        self.words, self.place = unpack_keys(row["words"]), unpack(row["places"], "<u4").astype(np.int64)
        self.target = np.repeat(unpack(row["target"], "u1"), self.length).astype(bool)
        self.at = np.concatenate(([0], np.cumsum(self.length)))
        # The place of the word before; BEGIN stands after the last word.
        self.before = np.empty(len(self.place), dtype=np.int64)
        self.before[1:] = self.place[:-1]
        self.before[self.at[:-1][self.length > 0]] = len(self.words)

    def singles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words and BEGIN in order, where that order has each place, and times of each as a word (over all,
        target) and as the word before (over all, target)."""
        key = np.append(self.words, np.uint64(BEGIN))
        order = np.argsort(key)
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        times = [np.bincount(x[own], minlength=len(key)) for x in (self.place, self.before) for own in (slice(None), self.target)]
        return key[order], rank, np.stack(times)[:, order]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct scattered pairs in order, a place of each, the number of each word's pair, and times over all and
        target words."""
        word = np.append(self.words, np.uint64(BEGIN))
        key = mix(mix(word + np.uint64(0x9E3779B97F4A7C15))[self.before] * np.uint64(0xD6E8FEB86659FD93) + word[self.place])
        key, first, number = np.unique(key, return_index=True, return_inverse=True)
        return key, first, number, np.stack((np.bincount(number, minlength=len(key)), np.bincount(number[self.target], minlength=len(key))))


def totals(blocks: DataFrame, name: Callable[[NumberedBlock], tuple[np.ndarray, np.ndarray]], kinds: int, buckets: int) -> DataFrame:
    """Per block and bucket the totals of the keys that the block named; `seen` comes to the keys with a first count."""

    def send(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for row in each_row(batch):
                key, times = name(NumberedBlock(row))
                yield arrow_rows(NAMED, [(k, row["block"], pack_keys(key[own]), pack_planes(times[:, own].ravel())) for k, own in bucket_rows(key, buckets)])

    def add(group: pa.Table) -> pa.Table:
        keys = [unpack_keys(x) for x in group.column("keys").to_pylist()]
        times = np.concatenate([unpack_planes(x).reshape(kinds, -1) for x in group.column("counts").to_pylist()], axis=1)
        distinct, number = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.stack([np.bincount(number, weights=t, minlength=len(distinct)).astype("<u8") for t in times])
        seen = [int(np.count_nonzero(sums[0])), *[0] * (len(keys) - 1)]
        ends = np.cumsum([len(k) for k in keys])
        return pa.Table.from_batches([arrow_rows(TOTALS, [
            (block, bucket, n, pack_planes(sums[:, number[e - len(k) : e]].ravel()))
            for block, bucket, n, k, e in zip(group.column("block").to_pylist(), group.column("bucket").to_pylist(), seen, keys, ends.tolist(), strict=True)
        ])])

    return blocks.mapInArrow(send, ddl(NAMED)).groupBy("bucket").applyInArrow(add, ddl(TOTALS))


SCORED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64()), ("score", pa.float64())])


def cross_entropy_difference(docs: DataFrame, target: DataFrame, *, size: int | None = None, weight: float = WEIGHT) -> DataFrame:
    """Per document: words, mean target loss, mean background loss (natural logarithms), and score, their difference.

    `target` names the documents of the target corpus by doc_id. A text without words (null ones too) has null
    losses and score. Repeated rows count each. Without target documents the target model is uniform over the
    vocabulary's seen words. `size` bounds the vocabulary; without it all words are in it. An empty table gives no
    rows.
    """
    blocks = numbered(docs, target, None if size is None else vocabulary(docs, size))
    words, target_words = (int(n or 0) for n in blocks.agg(F.sum("n_words"), F.sum("n_target")).first())
    buckets = max(8, -(-words // BUCKET_WORDS))
    singles = stored(totals(blocks, lambda b: b.singles()[::2], 4, buckets), "word_totals")
    seen = int(singles.agg(F.sum("seen")).first()[0] or 0)
    pairs = totals(blocks, lambda b: b.pairs()[::3], 2, buckets)

    def score(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for row in each_row(batch):
                b = NumberedBlock(row)
                _, rank, _ = b.singles()
                _, first, number, _ = b.pairs()
                answers = sorted(row["answers"] or [], key=lambda x: (x["kind"], x["bucket"]))
                single, pair = (np.concatenate([np.zeros((n, 0), dtype="<u8"), *(unpack_planes(x["totals"]).reshape(n, -1) for x in answers if x["kind"] == kind)], axis=1) for kind, n in ((0, 4), (1, 2)))
                word, before = rank[b.place[first]], rank[b.before[first]]
                loss = []
                for k, total in ((1, target_words), (0, words)):
                    share = (single[k][word] + 0.5) / (total + 0.5 * seen)
                    loss.append(-np.log((pair[k] + weight * share) / (single[k + 2][before] + weight)))
                loss = np.stack(loss)
                out = []
                for doc, begin, end in zip(b.docs, b.at[:-1].tolist(), b.at[1:].tolist(), strict=True):
                    if begin == end:
                        out.append((doc, 0, None, None, None))
                        continue
                    t, g = loss[:, number[begin:end]].mean(axis=1).tolist()
                    out.append((doc, end - begin, t, g, t - g))
                yield arrow_rows(SCORED, out)

    answers = singles.select("block", "bucket", "totals", F.lit(0).alias("kind")).unionByName(pairs.select("block", "bucket", "totals", F.lit(1).alias("kind")))
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("kind", "bucket", "totals")).alias("answers"))
    return blocks.join(answers, "block", "left").mapInArrow(score, "doc_id long, n_words long, target_loss double, background_loss double, score double")
