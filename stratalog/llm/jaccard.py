"""N-gram Jaccard join by a MinHash forest, with exact verification.

Each text is the set of its runs of five words. A forest holds several trees; in each, a text stands under a
sequence of minimum hashes. A tree is kept as sorted keys: what a key begins with is the prefix at which shortening
stops, so the texts under one node of the trie are a run of equal prefixes, and deeper nodes are runs within it.
A text is linked to the first one of the longest prefix that it shares. Shortening starts at the whole sequence and goes on, one hash at a time, while a pair at the limit of similarity
would still be missed with more than the allowed probability. Blocks of texts join their own nodes first, so that a node in the exchange
has one row for each block, whatever it holds.

Texts that meet, directly or through others, are compared exactly, block against block. A block goes to its partners
as one packed row, its runs named once for all its texts, so near copies cost little more than one of them. No table
of candidate pairs is made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, arrow_rows, batches, ddl, distinct_within, each_row, mix, pack, stored, texts_of, unpack
from .components import components

WIDTH, SIMILARITY = 5, 0.8
TREES, DEPTH, RECALL = 20, 6, 0.9999
#: Texts, and runs of words, of a candidate group that are compared in one step with another such block.
BLOCK, BLOCK_RUNS = 1024, 2_000_000
#: Texts whose own nodes are joined before the exchange, at a time.
FOREST_TEXTS = 50_000
#: Bits of a key that tell the minima after the prefix at which shortening stops.
DEEPER = 8


def stop_depth(similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest first stretch at which texts of that similarity meet in one of the trees with that probability."""
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def signatures(values: np.ndarray, at: np.ndarray, number: int) -> np.ndarray:
    """Minimum of each of `number` hashes over each stretch of values; no stretch may be empty."""
    factors = mix(np.arange(1, number + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.empty((len(at) - 1, number), dtype=np.uint64)
    if len(at) > 1:
        for j in range(number):
            out[:, j] = np.minimum.reduceat(values * factors[j], at[:-1])
    return out


SKETCH = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_runs", pa.int64()), ("digest", pa.binary()), ("keys", pa.binary())])


def trie_keys(sign: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """Per text and tree the key that sorts it into the trie: the first `depth` minima, then the deeper ones in turn."""
    keys = np.zeros((len(sign), trees), dtype=np.uint64)
    for d in range(depth):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + sign[:, d::DEPTH] + np.uint64(d))
    for d in range(depth, DEPTH):
        keys = (keys << np.uint64(DEEPER)) | (sign[:, d::DEPTH] >> np.uint64(64 - DEEPER))
    return keys


def digest_of(values: np.ndarray) -> bytes:
    return hashlib.md5(values.astype("<u8").tobytes()).digest()


def sketch(docs: DataFrame, *, width: int = WIDTH, trees: int = TREES, depth: int | None = None) -> DataFrame:
    """doc_id, words, distinct runs, digest of the set of runs, and the key of each tree.

    Texts without words (null ones too) have neither digest nor keys.
    """
    depth = depth or stop_depth(trees=trees)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found):
            words = Words(texts_of(batch))
            values, at = distinct_within(*words.shingles(width))
            size = np.diff(at)
            filled = np.flatnonzero(size)
            keys = trie_keys(signatures(values, np.append(at[:-1][filled], len(values)), trees * DEPTH), trees, depth)
            own = iter(keys.astype("<u8"))
            rows = [(doc, int(w), int(n), digest_of(values[at[i] : at[i + 1]]) if n else None, next(own).tobytes() if n else None) for i, (doc, w, n) in enumerate(zip(batch.column("doc_id").to_pylist(), words.count, size, strict=True))]
            yield arrow_rows(SKETCH, rows)

    return docs.select("doc_id", "text").mapInArrow(run, ddl(SKETCH))


def joined_nodes(prefixes: np.ndarray) -> np.ndarray:
    """For rows of prefixes (one column a tree), in order of preference, the first row that each meets, directly or through others."""
    label = np.arange(len(prefixes))
    nodes = []
    for prefix in prefixes.T:
        order = np.argsort(prefix, kind="stable")
        begin = np.flatnonzero(np.concatenate(([True], prefix[order][1:] != prefix[order][:-1])))
        nodes.append((order, begin, np.diff(begin, append=len(order))))
    while True:
        before = label.copy()
        for order, begin, size in nodes:
            label[order] = np.repeat(np.minimum.reduceat(label[order], begin), size)
        if (label == before).all():
            return label


def forest_links(reps: DataFrame, depth: int) -> DataFrame:
    """a, b: links between texts (rep, keys) that stand under one node of some tree at that depth.

    A block of texts links its own, and names each of its nodes once, by the first text there. In the exchange the
    keys are sorted, so that nodes are runs; each text is linked to the first one of the longest prefix that it shares.
    """
    beyond = np.uint64(DEEPER * (DEPTH - depth))
    levels = [DEEPER * k for k in range(DEPTH - depth + 1)]

    def name(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids = [], []

        def made():
            keys = np.frombuffer(b"".join(held), dtype="<u8").reshape(len(held), -1)
            own = np.array(ids, dtype=np.int64)
            # In order of id, then of the whole key, so that the first of a node is the least.
            order = np.argsort(own, kind="stable")
            own, keys = own[order], keys[order]
            prefixes = keys >> beyond
            first = own[joined_nodes(prefixes)]
            at, deeper, a = [], [], []
            for tree, prefix in enumerate(prefixes.T):
                prefix, place = np.unique(prefix, return_index=True)
                at.append(mix(prefix * np.uint64(0x9E3779B97F4A7C15) + np.uint64(tree)))
                deeper.append(keys[place, tree] & ((np.uint64(1) << beyond) - np.uint64(1)))
                a.append(first[place])
            later = np.flatnonzero(first != own)
            at = np.concatenate((*at, mix(own[later].view(np.uint64)))).view(np.int64)
            deeper = np.concatenate((*deeper, np.zeros(len(later), dtype=np.uint64))).astype(np.int32)
            a = np.concatenate((*a, own[later]))
            b = pa.concat_arrays([pa.nulls(len(a) - len(later), pa.int64()), pa.array(first[later], pa.int64())])
            held.clear(), ids.clear()
            return pa.RecordBatch.from_arrays([pa.array(at), pa.array(deeper), pa.array(a), b], names=["at", "deeper", "a", "b"])

        for batch in found:
            held += batch.column("keys").to_pylist()
            ids += batch.column("rep").to_pylist()
            if len(held) >= FOREST_TEXTS:
                yield made()
        if held:
            yield made()

    def star(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the last key, and the first text of its run at each level
        for batch in found:
            known = batch.column("b").is_valid().to_numpy(zero_copy_only=False)
            ends = batch.column("b").fill_null(0).to_numpy()
            at, deeper, a = (batch.column(c).to_numpy() for c in ("at", "deeper", "a"))
            yield pa.RecordBatch.from_arrays([pa.array(a[known]), pa.array(ends[known])], names=["a", "b"])
            at, deeper, a = at[~known], deeper[~known], a[~known]
            if not len(at):
                continue
            target, firsts = a.copy(), []
            for level, bits in enumerate(levels):
                node, prefix, text = at, deeper >> bits, a
                if last is not None:
                    node, prefix, text = np.append(last[0], node), np.append(last[1] >> bits, prefix), np.append(last[2][level], text)
                begin = np.concatenate(([True], (node[1:] != node[:-1]) | (prefix[1:] != prefix[:-1])))
                first = text[np.flatnonzero(begin)[np.cumsum(begin) - 1]]
                firsts.append(first[-1])
                target = np.where(target == a, first[len(first) - len(a) :], target)
            last = at[-1], deeper[-1], firsts
            yield pa.RecordBatch.from_arrays([pa.array(a[target != a]), pa.array(target[target != a])], names=["a", "b"])

    named = reps.select("rep", "keys").mapInArrow(name, "at long, deeper int, a long, b long")
    return named.repartition("at").sortWithinPartitions("at", "deeper", "a").mapInArrow(star, "a long, b long")


def compare(first: list[np.ndarray], second: list[np.ndarray] | None, similarity: float) -> np.ndarray:
    """Which sets of the one block are similar to which of the other (of the same block: with itself, if None)."""
    sets = first if second is None else first + second
    size = np.array([len(s) for s in sets], dtype=np.float64)
    owner = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    values, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[number] > 1
    owner, number = owner[shared], number[shared]
    _, number = np.unique(number, return_inverse=True)
    n, m = len(first), len(first if second is None else second)
    common = np.zeros((n, m), dtype=np.float32)
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    step = 1024
    edges = np.searchsorted(number, np.arange(0, (number[-1] if len(number) else -1) + step + 1, step))
    for k in range(len(edges) - 1):
        own = slice(edges[k], edges[k + 1])
        if own.start == own.stop:
            continue
        table = np.zeros((len(sets), step), dtype=np.float32)
        table[owner[own], number[own] - k * step] = 1
        common += table[:n] @ (table[:n] if second is None else table[n:]).T
    left, right = size[:n, None], (size[:n] if second is None else size[n:])[None, :]
    # The counts are whole; as float64 their products err by far less than the margin, so the limit itself is similar.
    return common.astype(np.float64) * (1 + similarity) >= similarity * (left + right) - 1e-6


def links_of(similar: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a block's links: each node with the least node that it reaches."""
    label = np.arange(len(ids))
    order = np.argsort(ids)
    place = np.empty_like(order)
    place[order] = label
    a, b = np.nonzero(similar)
    best = place.copy()
    while True:
        new = best.copy()
        np.minimum.at(new, a, best[b])
        np.minimum.at(new, b, best[a])
        new = np.minimum(new, new[order[new]])
        if (new == best).all():
            return [(int(ids[i]), int(ids[order[t]])) for i, t in enumerate(best) if order[t] != i]
        best = new


JUDGED = pa.schema([
    ("doc_id", pa.int64()), ("links", pa.int64()), ("other", pa.int64()), ("component", pa.int64()), ("own", pa.int32()), ("blocks", pa.int32()),
    ("ids", pa.binary()), ("copies", pa.binary()), ("sizes", pa.binary()), ("numbers", pa.binary()), ("values", pa.binary()),
])
_NO_BLOCK = (None,) * 8


class Sets:
    """A block of texts as sets of runs, with their ids and numbers of copies."""

    def __init__(self, ids: list[int], copies: list[int], sets: list[np.ndarray]):
        self.ids, self.copies, self.sets = np.array(ids, dtype=np.int64), np.array(copies, dtype=np.int64), sets

    def packed(self) -> tuple:
        values, number = np.unique(np.concatenate(self.sets), return_inverse=True)
        sizes = np.array([len(x) for x in self.sets])
        return tuple(pack(x) for x in (self.ids.astype("<i8"), self.copies.astype("<i8"), sizes.astype("<i8"), number.astype("<u4"), values.astype("<u8")))

    @classmethod
    def unpacked(cls, row: dict) -> Sets:
        sizes, values = unpack(row["sizes"], "<i8"), unpack(row["values"], "<u8")
        sets = np.split(values[unpack(row["numbers"], "<u4")], np.cumsum(sizes)[:-1])
        return cls(unpack(row["ids"], "<i8"), unpack(row["copies"], "<i8"), sets)


def judged_rows(first: Sets, second: Sets | None, similarity: float) -> list[tuple]:
    """How many documents each text of the blocks is linked to there, and a spanning forest of the links."""
    similar = compare(first.sets, None if second is None else second.sets, similarity)
    if second is None:
        np.fill_diagonal(similar, False)
        found, forest = [(first.ids, similar @ first.copies)], links_of(similar, first.ids)
    else:
        found = [(first.ids, similar @ second.copies), (second.ids, similar.T @ first.copies)]
        n, m = similar.shape
        whole = np.zeros((n + m, n + m), dtype=bool)
        whole[:n, n:] = similar
        forest = links_of(whole, np.concatenate((first.ids, second.ids)))
    out = [(int(i), int(c), None, *_NO_BLOCK) for own, counts in found for i, c in zip(own, counts, strict=True) if c]
    return out + [(a, 0, b, *_NO_BLOCK) for a, b in forest]


def judge(members: DataFrame, *, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """Compares members (component, own, blocks, doc_id, digest, copies, text): first those of each block with each
    other, then block against block.

    Rows with `other` link two texts (a spanning forest of the links in one comparison); other rows count the
    documents that a text is linked to there. A row whose text has another digest than the member is passed over.
    """

    def within(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, held = None, set(), ([], [], [])

        def made():
            sets = Sets(*held)
            rows = judged_rows(sets, None, similarity)
            if now[2] > 1:
                rows.append((None, None, None, *now, *sets.packed()))
            return arrow_rows(JUDGED, rows)

        for batch in batches(found):
            values, at = distinct_within(*Words(texts_of(batch)).shingles(width))
            keys = zip(*(batch.column(c).to_pylist() for c in ("component", "own", "blocks", "doc_id", "digest", "copies")), strict=True)
            for i, (component, own, blocks, doc, digest, copies) in enumerate(keys):
                if (component, own, blocks) != now:
                    if held[0]:
                        yield made()
                    now, seen, held = (component, own, blocks), set(), ([], [], [])
                runs = values[at[i] : at[i + 1]]
                if (doc, digest) in seen or digest_of(runs) != digest:
                    continue
                seen.add((doc, digest))
                for column, value in zip(held, (doc, copies, runs.copy()), strict=True):
                    column.append(value)
        if held[0]:
            yield made()

    def across(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first = None, None
        for batch in found:
            for row in each_row(batch):
                if (row["component"], row["left"], row["right"]) == key:
                    yield arrow_rows(JUDGED, judged_rows(first, Sets.unpacked(row), similarity))
                key, first = (row["component"], row["left"], row["right"]), Sets.unpacked(row)

    dealt = members.repartition("component", "own").sortWithinPartitions("component", "own", "doc_id")
    inner = stored(dealt.select("component", "own", "blocks", "doc_id", "digest", "copies", "text").mapInArrow(within, ddl(JUDGED)), "judged")
    packed = inner.where("values IS NOT NULL").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("with <> own")
    packed = packed.withColumns({"left": F.least("own", "with"), "right": F.greatest("own", "with")}).repartition("component", "left", "right").sortWithinPartitions("component", "left", "right", "own")
    outer = packed.select("component", "left", "right", "ids", "copies", "sizes", "numbers", "values").mapInArrow(across, ddl(JUDGED))
    columns = ["doc_id", "links", "other"]
    return inner.where("doc_id IS NOT NULL").select(columns).unionByName(stored(outer.select(columns), "judged"))


def similar_classes(docs: DataFrame, *, similarity: float = SIMILARITY, block: int = BLOCK, block_runs: int = BLOCK_RUNS) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id linked to it, directly or through others), n_links
    (documents of similarity `similarity` or more, copies counted), n_words.

    A text of fewer than five words is one run; texts without words, null ones too, are linked to nothing. Texts
    with equal sets of runs are copies. Repeated rows give repeated rows, which count as copies. Different texts of
    one doc_id are one document, which has the links of all of them. A null doc_id has a null class and no links.
    An empty table gives no rows.
    """
    depth = stop_depth(similarity)
    sketches = stored(sketch(docs, depth=depth), "sketches")
    filled = sketches.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    # One row per different text.
    reps = filled.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_runs").alias("n_runs"), F.first("keys").alias("keys"))
    reps = stored(reps, "texts")
    groups = components(forest_links(reps, depth))
    groups = groups.join(reps.select(F.col("rep").alias("node"), "digest", "copies", "n_runs"), "node")
    # A large group is dealt into blocks; each pair of blocks is one comparison.
    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_runs") / block_runs)).cast("int")
    groups = groups.join(groups.groupBy("component").agg(blocks.alias("blocks")), "component")
    own = F.pmod(F.xxhash64("node", "digest"), F.col("blocks").cast("long")).cast("int")
    members = groups.select("component", F.col("node").alias("doc_id"), "digest", "copies", own.alias("own"), "blocks")
    texts = docs.select("doc_id", "text").where("text IS NOT NULL")
    judged = judge(members.join(texts, "doc_id"), similarity=similarity)
    links = judged.where("other IS NULL").groupBy("doc_id").agg(F.sum("links").alias("links"))
    linked = components(judged.where("other IS NOT NULL").select(F.col("doc_id").alias("a"), F.col("other").alias("b")))
    rep = reps.select("digest", "rep", "copies").join(linked.select(F.col("node").alias("rep"), "component"), "rep", "left").join(links.withColumnRenamed("doc_id", "rep"), "rep", "left")
    rep = rep.select("digest", F.coalesce("component", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = sketches.select("doc_id", "digest", "n_words").join(rep, "digest", "left")
    alone = F.col("digest").isNull() | F.col("doc_id").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"), "n_words")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, with all their columns, without those whose text is linked, directly or through others, to
    one of smaller doc_id (of equal ids: of smaller digest).

    Texts are judged, not ids: of several texts under one id each stays or goes by its own links. Of rows with equal id
    and text one stays. Texts without words and rows without an id stay.
    """
    own = "_digest"
    while own in docs.columns:
        own += "_"
    marked = docs.withColumn(own, F.coalesce(F.sha2("text", 256), F.lit("")))
    known = marked.where("doc_id IS NOT NULL")
    if docs.where("doc_id IS NULL").isEmpty() and known.groupBy("doc_id").count().where("count > 1").isEmpty():
        spare = similar_classes(docs, **options).where("class_id <> doc_id").select("doc_id")
        return docs.join(spare, "doc_id", "left_anti").select(docs.columns)
    texts = known.select("doc_id", "text", F.col(own).alias("digest")).dropDuplicates(["doc_id", "digest"])
    texts = stored(texts.withColumn("node", F.monotonically_increasing_id()), "numbered_texts")
    classes = similar_classes(texts.select(F.col("node").alias("doc_id"), "text"), **options).select(F.col("doc_id").alias("node"), "class_id")
    first = texts.join(classes, "node").groupBy("class_id").agg(F.min(F.struct("doc_id", "digest")).alias("x"))
    first = first.select("x.doc_id", F.col("x.digest").alias(own))
    kept = known.join(first, ["doc_id", own], "left_semi").unionByName(marked.where("doc_id IS NULL"))
    return kept.dropDuplicates(["doc_id", own]).select(docs.columns)
