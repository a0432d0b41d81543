"""Token counts of whole texts under a byte-pair piece model, by merging arrays in step.

A text is cut before each space that follows something else; no piece of such a model reaches across that cut
(checked when the model is read), so each part can be merged on its own and equal parts need merging once. For the
same reason a long part is cut where no piece that stands in it reaches across, so texts without spaces need no more
rounds than others. The new parts of a batch are held together as one ragged array of symbols. In each round every part merges its pair
of lowest rank, all parts at the same time; what is left at the end is counted, a symbol that the model lacks as
its bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import batches
from .tokens import Memory

SPACE = "▁"
MEMORY_PARTS = 500_000
#: Parts of more characters than this are cut further.
LONG_PART = 64
LIMIT = 4096
_parts = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall


class Merger:
    """Ranks and results of all merges of a sentencepiece BPE model."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        own = [(p.piece, p.score) for p in model.pieces if p.type == 1]
        if model.normalizer_spec.name != "identity" or model.normalizer_spec.remove_extra_whitespaces or not model.normalizer_spec.add_dummy_prefix or not model.trainer_spec.byte_fallback:
            raise ValueError("only models with the identity normaliser, a leading space and byte fallback")
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _ in own):
            raise ValueError("a piece of this model reaches across a space")
        scores = sorted({s for _, s in own}, reverse=True)
        rank = {s: i for i, s in enumerate(scores)}
        self.number = {p: i for i, (p, _) in enumerate(own)}
        ranks = np.array([rank[s] for _, s in own], dtype=np.int64)
        self.char = {p: i for p, i in self.number.items() if len(p) == 1}
        self.beginnings = {p[:j] for p in self.number for j in range(2, len(p) + 1)}
        left, right, made = [], [], []
        for p, i in self.number.items():
            for j in range(1, len(p)):
                a, b = self.number.get(p[:j]), self.number.get(p[j:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(i)
        self.base = len(own) + 1  # symbols beyond are characters that the model lacks
        key = np.array(left, dtype=np.int64) * self.base + np.array(right)
        order = np.argsort(key)
        self.key, self.made = key[order], np.array(made)[order]
        self.rank = ranks[self.made]
        # A result is safe if no pair that holds it comes as early or earlier: then all its places can merge at once.
        l, r, m = np.array(left), np.array(right), np.array(made)
        self.safe = np.ones(len(own), dtype=bool)
        early_l, early_r = ranks[m] <= ranks[l], ranks[m] <= ranks[r]
        self.safe[l[early_l]] = False
        self.safe[r[early_r]] = False
        self.never = np.int64(len(scores))

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        known = (self.key[at] == key) & (left < self.base - 1) & (right < self.base - 1)
        return np.where(known, self.rank[at], self.never), self.made[at]

    def cut(self, part: str) -> list[str]:
        """The part, cut at each place that no occurrence of a piece reaches across: whatever merges stays on one side."""
        out, begin, reach, n = [], 0, 0, len(part)
        for i in range(n):
            if begin < i and reach <= i:
                out.append(part[begin:i])
                begin = i
            end = i + 2
            while end <= n and part[i:end] in self.beginnings:
                if end > reach and part[i:end] in self.number:
                    reach = end
                end += 1
        out.append(part[begin:])
        return out

    def count(self, parts: list[str]) -> list[int]:
        """Tokens of each part."""
        if max(map(len, parts), default=0) <= LONG_PART:
            return self.count_whole(parts)
        cuts = [self.cut(p) if len(p) > LONG_PART else [p] for p in parts]
        place = {p: i for i, p in enumerate(dict.fromkeys(p for own in cuts for p in own))}
        counts = self.count_whole(list(place))
        return [sum(counts[place[p]] for p in own) for own in cuts]

    def count_whole(self, parts: list[str]) -> list[int]:
        """Tokens of each part, which is merged as it is."""
        if not parts:
            return []
        lack, owner, sizes = self.base - 1, [], []
        symbols: list[int] = []
        for p in parts:
            symbols += [self.char.get(c, lack) for c in p]
            sizes.append(len(p))
        extra = np.zeros(len(parts), dtype=np.int64)
        ids = np.array(symbols, dtype=np.int64)
        owner = np.repeat(np.arange(len(parts)), sizes)
        if (ids == lack).any():
            all_chars = "".join(parts)
            for at in np.flatnonzero(ids == lack).tolist():
                extra[owner[at]] += len(all_chars[at].encode()) - 1
        done = np.zeros(len(parts), dtype=np.int64)
        while len(ids):
            same = owner[1:] == owner[:-1]
            rank, made = self.ranks_of(ids[:-1], ids[1:])
            rank = np.where(same, rank, self.never)
            ids, owner, done = self.rounds(ids, owner, rank, made, done)
        return (done + extra).tolist()

    def rounds(self, ids, owner, rank, made, done):
        """Merges until about half of the symbols are settled, so that what is left can be packed together."""
        n, start = len(ids), len(ids)
        while True:
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            padded = np.append(rank, self.never)  # the pair that begins at each symbol
            least = np.minimum.reduceat(padded, first)
            active = least < self.never
            size = np.diff(np.append(first, n))
            if not active.all():
                gone = np.flatnonzero(~active)
                done[owner[first[gone]]] = size[gone]
                keep = np.repeat(active, size)
                ids, owner, padded = ids[keep], owner[keep], padded[keep]
                made = np.append(made, 0)[keep]
                n = len(ids)
                if not n:
                    return ids, owner, done
                size, least = size[active], least[active]
                first = np.cumsum(size) - size
            else:
                made = np.append(made, 0)
            hit = np.flatnonzero(padded == np.repeat(least, size))
            # Of overlapping pairs the left one counts: every second place of a run of neighbours.
            run = np.flatnonzero(np.concatenate(([True], np.diff(hit) != 1)))
            within = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
            hit = hit[within % 2 == 0]
            # Where a result is not safe, only the leftmost place of the part merges in this round.
            part = owner[hit]
            leftmost = np.concatenate(([True], part[1:] != part[:-1]))
            unsafe = ~self.safe[made[hit]]
            if unsafe.any():
                careful = np.isin(part, part[unsafe])
                hit = hit[~careful | leftmost]
            ids[hit] = made[hit]
            keep = np.ones(n, dtype=bool)
            keep[hit + 1] = False
            new_at = np.cumsum(keep) - 1
            changed = new_at[hit]
            ids, owner = ids[keep], owner[keep]
            # The pair that begins at a kept symbol is unchanged but at a merged symbol and just before one.
            padded, made = padded[keep], made[keep]
            n = len(ids)
            again = np.unique(np.concatenate((changed, changed - 1)))
            again = again[again >= 0]
            inner = again[again < n - 1]
            fresh, result = self.ranks_of(ids[inner], ids[inner + 1])
            padded[inner] = np.where(owner[inner] == owner[inner + 1], fresh, self.never)
            made[inner] = result
            padded[n - 1] = self.never
            rank, made = padded[:-1], made[:-1]


class Counter:
    """n_tokens of a text: without begin, end or special tokens."""

    def __init__(self, path: str, memory: int = MEMORY_PARTS):
        self.merger = Merger(path)
        self.known = Memory(memory, None)

    def parts(self, text: str) -> list[str]:
        """The text as parts; a leading space is added, as the model's library does."""
        if not text:
            return []
        text = text.replace(" ", SPACE)
        if SPACE + SPACE in text or text[0] == SPACE or text[-1] == SPACE:
            return _parts(SPACE + text)
        return text.split(SPACE)  # each stands for the part with one space before it

    def count(self, texts: list[str]) -> list[int]:
        split = [self.parts(t) for t in texts]
        self.known.age()
        wanted = set().union(*split).difference(self.known)
        old = self.known.old
        new = []
        for p in wanted:
            if p in old:
                self.known[p] = old[p]
            else:
                new.append(p)
        new.sort(key=len)
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            self.known.update(zip(some, self.merger.count([p if p[0] == SPACE else SPACE + p for p in some]), strict=True))
        get = self.known.__getitem__
        return [sum(map(get, x)) for x in split]


_counters: dict[str, Counter] = {}
COUNTED = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(docs: DataFrame, model_path: str, *, limit: int = LIMIT) -> DataFrame:
    """One row per document: its UTF-8 bytes, its tokens, and whether these are more than `limit`.

    A null text is empty (0 bytes, 0 tokens). Repeated rows give repeated rows; an empty table gives no rows.
    """

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _counters:
            _counters[model_path] = Counter(model_path)
        counter = _counters[model_path]
        for batch in batches(found):
            size = pc.binary_length(batch.column("text")).fill_null(0).cast(pa.int64())
            counts = counter.count([t or "" for t in batch.column("text").to_pylist()])
            tokens = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), size, tokens, pc.greater(tokens, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, COUNTED)
