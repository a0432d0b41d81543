"""Cross-tokenizer alignment: the groups of tokens that two tokenizers cut at the same byte offsets.

Both tokenizers never join across a single space that stands between other characters, so a text is cut there and
equal parts are aligned once in a task. The new parts of a batch lie in one row of bytes; the ends of the first
tokenizer's tokens (A) and of the second one's (B) are two sorted lists, whose merging is cut into pieces of equal
work: binary searches along the diagonals of the merge path find where each piece begins in both lists. A piece
needs nothing of the others and gives the ends that both lists have; an end of A at the close of one piece and the
same end of B at the opening of the next are stitched by looking at the borders.

A link is a pair of tokens that end together. Blocks of documents name each of their id pairs once, with its links,
to hashed buckets; a bucket adds them up and sends back the totals in the order of the block. The greatest total of
each B id is a table of at most as many rows as B's vocabulary.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, batches, ddl, each_row, mix, pack, stored, unpack
from .lm_scoring import pack_keys, pack_planes, unpack_keys, unpack_planes
from .suffix_dedup import bucket_rows
from .tokens import byte_letters

SPACE = "▁"
#: Ends that a piece of the merge path holds.
PIECE_ENDS = 1 << 14
#: Parts that a task remembers at most, words of a block of documents, and named pairs of a bucket.
MEMORY_PARTS = 400_000
BLOCK_WORDS = 1_000_000
BUCKET_PAIRS = 2_000_000
#: A cut is before a space that no space precedes and no white space (or the end) follows.
_cut = re.compile(r"(?<! ) (?=\S)").split
_uneven = re.compile(r"  | (?=\s)|^ | $").search


def diagonals(a: np.ndarray, b: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces of `step` ends begin in each of two sorted lists (and the ends of both); of equal ends that of
    `a` comes first."""
    diagonal = np.append(np.arange(0, len(a) + len(b), step), len(a) + len(b))
    low, high = np.maximum(diagonal - len(b), 0), np.minimum(diagonal, len(a))
    while (low < high).any():
        middle = (low + high) >> 1
        open_ = low < high
        # a[middle] comes before b[diagonal - middle - 1] on the path: more of `a` belongs before the diagonal.
        more = np.zeros(len(low), dtype=bool)
        more[open_] = a[middle[open_]] <= b[(diagonal - middle - 1)[open_]]
        low, high = np.where(open_ & more, middle + 1, low), np.where(open_ & ~more, middle, high)
    return low, diagonal - low


def common_ends(a: np.ndarray, b: np.ndarray, step: int = PIECE_ENDS) -> tuple[np.ndarray, np.ndarray]:
    """Places in two lists of strictly rising ends, of the ends that both have."""
    at_a, at_b = diagonals(a, b, step)
    left, right = [], []
    for i, to_i, j, to_j in zip(at_a[:-1].tolist(), at_a[1:].tolist(), at_b[:-1].tolist(), at_b[1:].tolist(), strict=True):
        if i and j < len(b) and a[i - 1] == b[j]:  # the border runs between two equal ends
            left.append(np.array([i - 1])), right.append(np.array([j]))
        own, other = a[i:to_i], b[j:to_j]
        if len(own) and len(other):
            place = np.searchsorted(other, own)
            hit = np.flatnonzero(other[np.minimum(place, len(other) - 1)] == own)
            left.append(hit + i), right.append(place[hit] + j)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


class Tokens:
    """Ids and token bytes of both libraries."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        byte = {letter: b for b, letter in byte_letters().items()}
        self.a_bytes = {i: bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode() for entry, i in self.a.get_vocab().items()}
        self.b = SentencePieceProcessor(model_file=piece_path)
        self.b_bytes = {}
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes[i] = bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode()
        if any(re.search(f"[^{SPACE}]{SPACE}", self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())):
            raise ValueError("a piece of this model reaches across a space")

    def encode(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [x.ids for x in self.a.encode_batch(parts, add_special_tokens=False)], self.b.encode([p[1:] for p in parts], num_threads=1)


def parts_of(text: str) -> list[str]:
    """Parts of a space and the text, each without the space that it begins with; none where B's sign stands in it."""
    if SPACE in text:
        return []
    if not _uneven(text):
        return text.split(" ")
    first, *others = _cut(" " + text)
    return [first[1:], *others] if first else others


class Aligner:
    """Parts that a task has met: their tokens, groups and links."""

    def __init__(self, byte_path: str, piece_path: str):
        self.tokens = Tokens(byte_path, piece_path)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.n_a, self.n_b, self.n_links, self.good = (np.zeros(0, dtype=np.int64) for _ in range(4))
        self.pairs = np.zeros(0, dtype=np.uint64)
        self.at = np.zeros(1, dtype=np.int64)

    def learn(self, parts: list[str]) -> None:
        """Aligns parts that are new."""
        a_ids, b_ids = self.tokens.encode([" " + p for p in parts])
        n_a, n_b = (np.array([len(x) for x in ids], dtype=np.int64) for ids in (a_ids, b_ids))
        a_bytes, b_bytes = self.tokens.a_bytes, self.tokens.b_bytes
        good = np.zeros(len(parts), dtype=np.int64)
        for i, p in enumerate(parts):
            whole = b" " + p.encode()
            good[i] = b"".join([a_bytes[x] for x in a_ids[i]]) == whole == b"".join([b_bytes[x] for x in b_ids[i]])
            if not good[i]:
                a_ids[i], b_ids[i], n_a[i], n_b[i] = [], [], 0, 0
        flat_a, flat_b = (np.array([x for ids in all_ids for x in ids], dtype=np.int64) for all_ids in (a_ids, b_ids))
        end_a, end_b = (np.cumsum(np.array([len(of[x]) for ids in all_ids for x in ids], dtype=np.int64)) for of, all_ids in ((a_bytes, a_ids), (b_bytes, b_ids)))
        left, right = common_ends(end_a, end_b)
        owner = np.searchsorted(np.cumsum(n_a), left, side="right")
        links = np.bincount(owner, minlength=len(parts))
        names_a, names_b = [str(x) for x in flat_a.tolist()], [str(x) for x in flat_b.tolist()]
        made, i, j = [], 0, 0
        for to_i, to_j in zip((left + 1).tolist(), (right + 1).tolist(), strict=True):
            made.append(f"{','.join(names_a[i:to_i])}|{','.join(names_b[j:to_j])}")
            i, j = to_i, to_j
        at = np.concatenate(([0], np.cumsum(links)))
        base = len(self.groups)
        self.groups += [";".join(made[s:e]).encode() for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        self.number.update(zip(parts, range(base, base + len(parts)), strict=True))
        self.n_a, self.n_b, self.n_links, self.good = (np.concatenate(x) for x in ((self.n_a, n_a), (self.n_b, n_b), (self.n_links, links), (self.good, good)))
        self.pairs = np.concatenate((self.pairs, flat_a[left].astype(np.uint64) << np.uint64(32) | flat_b[right].astype(np.uint64)))
        self.at = np.concatenate((self.at, self.at[-1] + at[1:]))

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the parts of all texts, and how many each text has; none for a text without tokens."""
        split = [parts_of(t) if t else [] for t in texts]
        new = sorted(set().union(*split).difference(self.number))
        for at in range(0, len(new), 20_000):
            self.learn(new[at : at + 20_000])
        ids = np.array([self.number[p] for parts in split for p in parts], dtype=np.int64)
        n = np.array([len(x) for x in split], dtype=np.int64)
        bad = np.zeros(len(texts), dtype=bool)
        bad[np.repeat(np.arange(len(texts)), n)[self.good[ids] == 0]] = True
        return ids[~np.repeat(bad, n)], np.where(bad, 0, n)


def sums_of(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of these lengths."""
    return np.diff(np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))[np.concatenate(([0], np.cumsum(lengths)))])


BLOCKS = pa.schema([("block", pa.int64()), ("links", pa.int64()), ("docs", pa.binary()), ("known", pa.binary()), ("totals", pa.binary()), ("digests", pa.binary()), ("lengths", pa.binary()), ("places", pa.binary()), ("part_links", pa.binary()), ("link_places", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())])
NAMED = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("pairs", pa.binary()), ("counts", pa.binary())])
TOTALS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("totals", pa.binary()), ("heads", pa.binary())])
ALIGNED = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

_aligners: dict[tuple[str, str], Aligner] = {}
_MIXED = np.uint64(0x9E3779B97F4A7C15)


def blocks_of(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Blocks of aligned documents: per document its figures and parts, per distinct part its id pairs, each pair once
    with its links in the block (in the order of its scattered number)."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (byte_path, piece_path) not in _aligners:
            _aligners[byte_path, piece_path] = Aligner(byte_path, piece_path)
        aligner = _aligners[byte_path, piece_path]
        block, held, words = TaskContext.get().partitionId() << 32, [], 0

        def made():
            docs_, lengths, digests = ([x for h in held for x in h[k]] for k in range(3))
            totals, ids = (np.concatenate([h[k] for h in held], axis=-1) for k in (3, 4))
            distinct, place = np.unique(ids, return_inverse=True)
            n_links = aligner.n_links[distinct]
            spans = np.repeat(aligner.at[distinct] - np.concatenate(([0], np.cumsum(n_links)[:-1])), n_links) + np.arange(n_links.sum())
            key, link_place = np.unique(mix(aligner.pairs[spans] + _MIXED), return_inverse=True)
            pairs = np.zeros(len(key), dtype=np.uint64)
            pairs[link_place] = aligner.pairs[spans]
            times = np.bincount(link_place, weights=np.repeat(np.bincount(place, minlength=len(distinct)), n_links), minlength=len(key))
            return arrow_rows(BLOCKS, [(
                block, int(totals[2].sum()), pack(np.array([d or 0 for d in docs_], dtype="<i8")), pack(np.array([d is not None for d in docs_], dtype="u1")),
                pack_planes(totals.ravel().astype("<u8")), pack(np.frombuffer(b"".join(digests), dtype="u1")), pack(np.array(lengths, dtype="<i8")), pack(place.astype("<u4")),
                pack(n_links.astype("<u4")), pack(link_place.astype("<u4")), pack_planes(pairs), pack_planes(times.astype("<u8")),
            )])

        for batch in batches(found):
            ids, n = aligner.texts(batch.column("text").to_pylist())
            totals = np.stack([sums_of(of[ids], n) for of in (aligner.n_a, aligner.n_b, aligner.n_links)])
            name, at, digests = aligner.groups, 0, []
            numbers = ids.tolist()
            for k in n.tolist():
                digests.append(hashlib.sha256(b";".join([name[x] for x in numbers[at : at + k]])).digest())
                at += k
            held.append((batch.column("doc_id").to_pylist(), n.tolist(), digests, totals, ids))
            words += len(ids) + len(n)
            if words >= BLOCK_WORDS or len(aligner.groups) > MEMORY_PARTS:
                yield made()
                block, held, words = block + 1, [], 0
                if len(aligner.groups) > MEMORY_PARTS:
                    aligner.clear()
        if held:
            yield made()

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl(BLOCKS)), "aligned")


def pair_totals(blocks: DataFrame, buckets: int) -> DataFrame:
    """Per block and bucket the corpus-wide links of the pairs that the block named; `heads` of one row of a bucket has
    the bucket's greatest total of each B id."""

    def send(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for row in each_row(batch):
                pairs = unpack_planes(row["keys"])
                times, key = unpack_planes(row["counts"]), mix(pairs + _MIXED)
                yield arrow_rows(NAMED, [(k, row["block"], pack_keys(key[own]), pack_planes(pairs[own]), pack_planes(times[own])) for k, own in bucket_rows(key, buckets)])

    def add(group: pa.Table) -> pa.Table:
        keys = [unpack_keys(x) for x in group.column("keys").to_pylist()]
        times = np.concatenate([unpack_planes(x) for x in group.column("counts").to_pylist()])
        distinct, number = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(number, weights=times.astype(np.float64), minlength=len(distinct)).astype("<u8")
        ids = np.zeros(len(distinct), dtype=np.uint64)
        ids[number] = np.concatenate([unpack_planes(x) for x in group.column("pairs").to_pylist()])
        b, place = np.unique(ids & np.uint64(0xFFFFFFFF), return_inverse=True)
        most = np.zeros(len(b), dtype=np.uint64)
        np.maximum.at(most, place, sums)
        ends = np.cumsum([len(k) for k in keys])
        heads = [pack_planes(np.concatenate((b, most))), *[b""] * (len(keys) - 1)]
        return pa.Table.from_batches([arrow_rows(TOTALS, [
            (block, bucket, pack_planes(sums[number[e - len(k) : e]]), h)
            for block, bucket, k, e, h in zip(group.column("block").to_pylist(), group.column("bucket").to_pylist(), keys, ends.tolist(), heads, strict=True)
        ])])

    return stored(blocks.select("block", "keys", "counts").mapInArrow(send, ddl(NAMED)).groupBy("bucket").applyInArrow(add, ddl(TOTALS)), "pair_totals")


def align(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Per document: tokens of A and of B, groups, links, the links whose id pair is linked most often among all pairs of
    its B id over the corpus (`n_best`, ties included), the sum of the corpus-wide links of each link's pair
    (`count_sum`), and the SHA-256 of the groups written as `a1,a2|b1;a3|b2`.

    A encodes a space and the text, B the text (to which it adds the space). Texts that are null or empty, or that one
    tokenizer does not give back (a text with B's own sign for the space), have no tokens: zeros and ''. Repeated rows
    count each and give repeated rows; an empty table gives no rows.
    """
    blocks = blocks_of(docs, byte_path, piece_path)
    named = int(blocks.agg(F.sum("links")).first()[0] or 0)
    totals = pair_totals(blocks, max(8, -(-named // BUCKET_PAIRS)))

    def heads(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for x in batch.column("heads").to_pylist():
                b, most = unpack_planes(x).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int64)), pa.array(most.astype(np.int64))], names=["b", "most"])

    # One row for each id of B's vocabulary at most.
    best_rows = totals.where(F.length("heads") > 0).select("heads").mapInArrow(heads, "b long, most long").groupBy("b").agg(F.max("most").alias("most")).collect()
    best_of = np.zeros(max((r.b for r in best_rows), default=0) + 1, dtype=np.uint64)
    for r in best_rows:
        best_of[r.b] = r.most

    def finish(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for row in each_row(batch):
                answers = sorted(row["answers"] or [], key=lambda x: x["bucket"])
                pairs = unpack_planes(row["keys"])
                count = np.concatenate([np.zeros(0, dtype="<u8"), *(unpack_planes(x["totals"]) for x in answers)])
                best = (count == best_of[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)]).astype(np.uint64)
                part_links, of_part = unpack(row["part_links"], "<u4").astype(np.int64), unpack(row["link_places"], "<u4")
                lengths, place = unpack(row["lengths"], "<i8"), unpack(row["places"], "<u4")
                n_best, count_sum = (sums_of(sums_of(x[of_part], part_links)[place], lengths).tolist() for x in (best, count))
                n_a, n_b, n_links = (x.tolist() for x in unpack_planes(row["totals"]).reshape(3, -1))
                digests = unpack(row["digests"], "u1").tobytes()
                docs_ = [d if k else None for d, k in zip(unpack(row["docs"], "<i8").tolist(), unpack(row["known"], "u1").tolist(), strict=True)]
                yield arrow_rows(ALIGNED, [
                    (docs_[i], n_a[i], n_b[i], n_links[i], n_links[i], n_best[i], count_sum[i], digests[32 * i : 32 * i + 32].hex() if n_a[i] else "") for i in range(len(docs_))
                ])

    answers = totals.groupBy("block").agg(F.collect_list(F.struct("bucket", "totals")).alias("answers"))
    # Blocks and answers always meet in a shuffle: answers grow with the corpus and are not sent to all tasks.
    return blocks.join(answers.hint("shuffle_hash"), "block", "left").mapInArrow(finish, OUT)
