"""Secrets in texts: known shapes, and strings in a sensitive context that a primed compressor finds new.

Known shapes (assignments, access keys, long hexadecimal runs) come from patterns. Beside them, a candidate is a long
run of letters and digits that follows a sensitive word closely. A zstandard compressor, primed with the identifiers
that stand most often around such places in the corpus, compresses the surroundings with and without the candidate;
the difference is what the candidate adds. A name made of known identifiers, or one that the surrounding text
repeats, adds little; a string of chance adds about its own length, and is reported.

Texts are scanned twice: once for the identifiers, once for the spans.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, joined, texts_of

# The patterns of the known shapes, and the least lengths that count.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN_LEAST = 6
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ACCESS_LEAST = 20
HEX_LEAST = 24
KINDS = ("assign", "access", "hex", "novel")

#: Words that make what follows them sensitive.
CONTEXT_WORDS = (*ASSIGN_WORDS, b"passphrase", b"api-key", b"access_key", b"access-key", b"accesskey", b"private_key", b"private-key", b"credential", b"authorization", b"bearer", b"signature", b"cookie", b"pwd")
#: Bytes between such a word and a candidate, at most, and bytes of a candidate, at least.
REACH = 40
LEAST = 16
RUN = re.compile(rb"[A-Za-z0-9+/_~.-]{16,}={0,2}")
_letter, _digit = re.compile(rb"[A-Za-z]").search, re.compile(rb"[0-9]").search
#: Text on each side of a span that the compressor is given.
AROUND = 256
IDENTIFIER = re.compile(rb"[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]{3,39}")
#: Identifiers of the dictionary, at most.
IDENTIFIERS = 2048
#: Bytes that a reported candidate adds, at least, for each of its own.
NOVELTY = 0.9
LOCAL_IDENTIFIERS = 200_000

_HEX = np.zeros(256, dtype=bool)
_HEX[list(b"0123456789abcdef")] = True


def places_of(data: bytes, words: tuple[bytes, ...]) -> list[tuple[int, int]]:
    """Begin and end of each occurrence of any of the words, in order."""
    found = []
    for w in words:
        at = data.find(w)
        while at >= 0:
            found.append((at, at + len(w)))
            at = data.find(w, at + 1)
    return sorted(found)


def known_shapes(data: bytes, low: bytes, codes: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(begin, kind, end, begin of the value) of each match that counts, kind by kind."""
    found, end = [], 0
    for at, _ in places_of(low, ASSIGN_WORDS):
        if at >= end and (m := ASSIGN.match(data, at)):
            end = m.end()
            if end - m.start(2) >= ASSIGN_LEAST:
                found.append((at, 0, end, m.start(2)))
    end = 0
    for at, _ in places_of(data, (b"AKIA",)):
        if at >= end and (m := ACCESS.match(data, at)):
            end = m.end()
            if end - at >= ACCESS_LEAST:
                found.append((at, 1, end, at))
    other = np.flatnonzero(~_HEX[codes])  # the last byte is one of these
    begin = np.concatenate(([0], other[:-1] + 1))
    for i in np.flatnonzero(other - begin >= HEX_LEAST).tolist():
        found.append((int(begin[i]), 2, int(other[i]), int(begin[i])))
    return found


def candidates(data: bytes, low: bytes) -> list[tuple[int, int]]:
    """Runs with a letter and a digit that begin within reach of a sensitive word, on its line and not as a part of it."""
    found = {}
    for _, end in places_of(low, CONTEXT_WORDS):
        line = data.find(b"\n", end, end + REACH + LEAST)
        for m in RUN.finditer(data, end, end + REACH + LEAST if line < 0 else line):
            at = m.start()
            if at > end and at not in found:
                run = RUN.match(data, at).group().rstrip(b".-")
                if len(run) >= LEAST and _letter(run) and _digit(run):
                    found[at] = at + len(run)
    return sorted(found.items())


def spans_of(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, list[tuple[int, int, int, int]], np.ndarray]:
    """All texts in one row of bytes, where each begins, the row's codes, spans in order with candidates that lie
    outside of known shapes as the last kind, and the text of each span."""
    codes, starts = joined(texts)
    data = codes.tobytes()
    low = data.lower()
    found = known_shapes(data, low, codes)
    open_ = np.array(sorted((b, e) for b, _, e, _ in found), dtype=np.int64).reshape(-1, 2)
    reach = np.maximum.accumulate(open_[:, 1])
    for begin, end in candidates(data, low):
        before = np.searchsorted(open_[:, 0], end)  # known spans that begin before this end
        if not before or reach[before - 1] <= begin:
            found.append((begin, 3, end, begin))
    found.sort()
    owner = np.searchsorted(starts, np.array([f[0] for f in found], dtype=np.int64), side="right") - 1
    return data, starts, codes, found, owner


def surroundings(data: bytes, begin: int, end: int, low: int, high: int) -> tuple[bytes, bytes]:
    """Text before and after a span, within its document."""
    return data[max(low, begin - AROUND) : begin], data[end : min(high, end + AROUND)]


def identifiers(docs: DataFrame, most: int = IDENTIFIERS) -> list[bytes]:
    """The identifiers that stand around spans in most documents, the most frequent last, at most `most`. What a
    span or a candidate itself holds is none."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def made():
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["name", "n"])
            held.clear()
            return batch

        for batch in batches(found):
            data, starts, _, spans, owner = spans_of(texts_of(batch))
            at = 0
            for doc in np.unique(owner).tolist():
                to = int(np.searchsorted(owner, doc, side="right"))
                low, high = int(starts[doc]), int(starts[doc + 1]) - 1
                text, last = [], low
                for begin, _, end, value in spans[at:to]:  # stretches around the spans, without their values
                    text.append(data[max(last, begin - AROUND) : value] if value > last else b"")
                    last = max(last, end)
                    text.append(data[last : min(high, last + AROUND)])
                values = {data[value:end] for _, _, end, value in spans[at:to]}
                names = set(IDENTIFIER.findall(b"\n".join(text)))
                held.update(n for n in names if not any(n in v for v in values))
                at = to
            if len(held) > LOCAL_IDENTIFIERS:
                yield made()
        yield made()

    counted = docs.select("text").mapInArrow(run, "name binary, n long").groupBy("name").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "name").limit(most).collect()  # at most `most` names of 40 bytes
    return [bytes(r.name) for r in reversed(rows)]


class Novelty:
    """Bytes that a string adds to its surroundings, by a compressor that knows the identifiers. Its literals stay as
    they are (a fast strategy with a target length), so that what is added is what no match covers."""

    def __init__(self, names: list[bytes]):
        how = zstandard.ZstdCompressionParameters.from_level(1, strategy=zstandard.STRATEGY_FAST, target_length=1, min_match=4, write_content_size=False)
        known = zstandard.ZstdCompressionDict(b"\n".join(names), dict_type=zstandard.DICT_TYPE_RAWCONTENT) if sum(map(len, names)) >= 8 else None
        if known:
            known.precompute_compress(compression_params=how)
        self.compress = zstandard.ZstdCompressor(dict_data=known, compression_params=how).compress

    def of(self, value: bytes, before: bytes, after: bytes) -> int:
        """The same string elsewhere in the surroundings is taken out, so that a secret that is repeated stays new."""
        before, after = before.replace(value, b""), after.replace(value, b"")
        return len(self.compress(before + value + after)) - len(self.compress(before + after))


SPANS = "array<struct<kind: string, start: long, end: long, marginal_bytes: long, novelty: double>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("marginal_bytes", pa.int64()), ("novelty", pa.float64())]))


def find_secrets(docs: DataFrame, *, novelty: float = NOVELTY, names: list[bytes] | None = None) -> DataFrame:
    """One row per document with its spans in order of start, then kind: assign, access, hex (all matches that are long
    enough), novel (candidates outside of those whose marginal bytes are at least `novelty` for each of their own).

    Places are code points, the end is exclusive. marginal_bytes is measured for every span, of an assignment for its
    value. A null text has no spans; repeated rows give repeated rows; an empty table gives no rows. `names` is the
    dictionary, by default `identifiers(docs)`.
    """
    names = identifiers(docs) if names is None else names

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Novelty(names)
        for batch in batches(found):
            data, starts, codes, spans, owner = spans_of(texts_of(batch))
            out: list[list[tuple]] = [[] for _ in range(batch.num_rows)]
            points, of = None, -1
            for (begin, kind, end, value), doc in zip(spans, owner.tolist(), strict=True):
                low, high = int(starts[doc]), int(starts[doc + 1]) - 1
                added = measure.of(data[value:end], *surroundings(data, value, end, low, high))
                share = added / (end - value)
                if kind == 3 and share < novelty:
                    continue
                if of != doc:  # code points before each byte of this text
                    points, of = np.concatenate(([0], np.cumsum((codes[low:high] & 0xC0) != 0x80))), doc
                out[doc].append({"kind": KINDS[kind], "start": int(points[begin - low]), "end": int(points[end - low]), "marginal_bytes": added, "novelty": share})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(out, _ARROW_SPANS)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, spans {SPANS}")


def counted(found: DataFrame) -> DataFrame:
    """Per document the numbers of known shapes, the SHA-256 of their list, and the list of all spans."""

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of_kind(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *(of_kind(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] != "novel")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
