"""Interleaved text and media: pages become ordered sequences of text and media references, references are resolved
by digest against a store of payloads, and positions and captions stay with their media."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, stored, text_or_empty, texts_of

#: Samples in a row of an image.
ROW = 192
TAIL = 16
SIGNATURE = b"\x89PNG\r\n\x1a\n"
PART = "position int, kind string, text string, src string, digest string, caption string"
#: References to one payload that go to it in one row.
TOGETHER = 1_000
STORED = "digest string, media binary"
RESOLVED = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(text: bytes, row: int = ROW) -> bytes:
    """The text and then spaces up to the next multiple of `row`, at least one row."""
    return text + b" " * (max(row, -(-len(text) // row) * row) - len(text))


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, row: int = ROW) -> bytes:
    """An 8-bit grey image, one sample per byte, without loss."""
    height = len(payload) // row
    lines = np.zeros((height, row + 1), dtype=np.uint8)
    lines[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(height, row)
    head = struct.pack(">IIBBBBB", row, height, 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image that to_png made; raises on damage."""
    if media[:8] != SIGNATURE:
        raise ValueError("not an image of this store")
    at, data, shape = 8, [], None
    while at < len(media):
        (size,) = struct.unpack(">I", media[at : at + 4])
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("an image chunk is damaged")
        if kind == b"IHDR":
            shape = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("this store only writes unfiltered lines")
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """64 bits, one for each equal stretch of the samples: brighter than the mean or not; then the mean."""
    values = np.frombuffer(samples, dtype=np.uint8)
    at = np.linspace(0, len(values), 65).astype(np.int64)[:-1]
    total = np.add.reduceat(values.astype(np.int64), at)
    size = np.diff(np.append(at, len(values)))
    whole = int(values.sum(dtype=np.int64))
    bits = total * len(values) > whole * size
    return np.packbits(bits).tobytes().hex() + f"-{whole // len(values):02x}"


class PageParser(HTMLParser):
    """Text and media references of a page in order; a figure's caption goes to the media of that figure. References
    of the form media:digest name a payload of the store, others have no digest."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.in_figure: list[dict] = []
        self.hidden = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.parts.append({"kind": "text", "text": text, "src": None, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "figure":
            self.flush()
            self.in_figure = []
        elif tag == "figcaption":
            self.caption = []
        elif tag in ("img", "audio", "video", "source") and named.get("src"):
            self.flush()
            src = named["src"]
            part = {"kind": "media", "text": None, "src": src, "digest": src[6:] if src.startswith("media:") else None, "caption": named.get("alt") or None}
            self.parts.append(part)
            self.in_figure.append(part)
        elif tag in ("p", "div", "br", "h1", "h2", "h3", "li", "tr", "article", "section"):
            self.flush()

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            said = " ".join("".join(self.caption).split()) or None
            for part in self.in_figure:
                part["caption"] = said
            self.caption = None
        elif tag in ("p", "div", "figure", "article", "section", "li", "tr", "h1", "h2", "h3"):
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)

    def close(self):
        super().close()
        self.flush()


def parse_page(html: str | None) -> list[dict]:
    parser = PageParser()
    parser.feed(html or "")
    parser.close()
    return [x | {"position": i} for i, x in enumerate(parser.parts)]


def sequences(pages: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns `keep`, and parts: the ordered text and media-reference structs of each page's html; a null
    page has none."""
    kind = pa.list_(pa.struct([("position", pa.int32()), *((x, pa.string()) for x in ("kind", "text", "src", "digest", "caption"))]))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found, "html"):
            parts = [parse_page(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *keep)), pa.array(parts, kind)], names=["doc_id", *keep, "parts"])

    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in pages.select("doc_id", *keep).schema)
    return pages.select("doc_id", *keep, "html").mapInArrow(run, f"{kept}parts array<struct<{PART.replace(' ', ':').replace(',:', ',')}>>")


def store_payloads(docs: DataFrame) -> DataFrame:
    """Writes each text's payload as an image into the shared folder, under the digest of the text, and reads it back.

    A text that a task has just stored is not stored again; copies elsewhere are, and any of them serves.
    """

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches(found):
            kept = {}
            for text in texts_of(batch):
                digest = hashlib.sha256(text).hexdigest()
                if digest not in seen:
                    kept[digest] = to_png(padded(text))
            seen = set(kept) if len(seen) > 200_000 else seen | set(kept)
            yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.binary())], names=["digest", "media"])

    return stored(docs.select("text").mapInArrow(run, STORED), "media")


def read_media(store: DataFrame) -> DataFrame:
    """Decodes the stored media; one row per digest with sizes, digests and the feature."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found, "media"):
            rows = []
            for digest, media in zip(batch.column("digest").to_pylist(), batch.column("media").to_pylist(), strict=True):
                payload = from_png(media)
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in RESOLVED.split(", ")])

    return store.mapInArrow(run, RESOLVED).dropDuplicates(["digest"])


def resolve(references: DataFrame, resolved: DataFrame) -> DataFrame:
    """References (digest and other columns) with what their payloads have; null where there is no such payload.

    Before the join, each task brings its references to one payload together, in rows of TOGETHER at most, so that a
    payload that many documents show is no hot key.
    """
    others = [f for f in references.schema if f.name != "digest"]
    kind = ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in others).replace(", ", ",")

    def together(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            digest = batch.column("digest")
            rows = pa.StructArray.from_arrays([batch.column(f.name) for f in others], names=[f.name for f in others])
            coded = digest.dictionary_encode()
            code = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            code = code[order]
            begin = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            ends = np.append(begin[1:], len(code))
            cuts = np.concatenate([np.arange(b, e, TOGETHER) for b, e in zip(begin, ends, strict=True)])
            lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(code)).astype(np.int32)), rows.take(pa.array(order)))
            yield pa.RecordBatch.from_arrays([digest.take(pa.array(order[cuts])), lists], names=["digest", "shown"])

    packed = references.select("digest", *[f.name for f in others]).mapInArrow(together, f"digest string, shown array<struct<{kind}>>")
    return packed.join(resolved, "digest", "left").withColumn("_one", F.explode("shown")).select("_one.*", *resolved.columns)


def page_of(text: Column, caption: Column) -> Column:
    """A page of the text: its lines as paragraphs, and after the first one its payload as a figure with a caption."""
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    first = F.substring_index(safe, "\n", 1)
    rest = F.replace(F.substring(safe, F.char_length(first) + 2, 2**31 - 1), F.lit("\n"), F.lit("</p><p>"))
    figure = F.concat(F.lit("<figure><img src='media:"), F.sha2(text, 256), F.lit("'><figcaption>"), caption, F.lit("</figcaption></figure>"))
    return F.concat(F.lit("<article><p>"), first, F.lit("</p>"), figure, F.lit("<p>"), rest, F.lit("</p></article>"))


def media_columns(docs: DataFrame) -> DataFrame:
    """Per document the media column of its text: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, and of the media in the document's sequence of texts and media: position,
    caption, and parts, the length of the sequence.

    A null text is empty and makes one row of spaces. Equal texts have equal values. Repeated rows give repeated
    rows; extra columns are left out; an empty table gives no rows. A payload that the store lacks has null values.
    """
    resolved = read_media(store_payloads(docs))
    text = text_or_empty()
    n_bytes = F.octet_length(text).cast("long")
    caption = F.concat(n_bytes.cast("string"), F.lit(" bytes of text"))
    pages = docs.select("doc_id", n_bytes.alias("n_bytes"), page_of(text, caption).alias("html"))
    shown = sequences(pages, "n_bytes").select("doc_id", "n_bytes", F.size("parts").alias("parts"), F.inline("parts"))
    shown = shown.where("kind = 'media'").select("digest", "doc_id", "n_bytes", "position", "caption", "parts")
    return resolve(shown, resolved).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "parts",
    )
