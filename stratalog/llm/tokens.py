"""Ids of whole texts by a public tokenizer file, with a bounded memory of pieces and words seen before.

The library drops white space and never joins across it, so the ids of a text are those of its pieces between
spaces, in a row. A piece that the worker has met before is not encoded again; a new piece of plain Latin
letters is cut by the file's own pattern into words, and only words that are new go to the library's model.
Pieces with any other character, or with the mark that special strings begin with, go to the library whole.
A text of plain letters throughout is lower-cased at once, so that its pieces are remembered in one form among the words.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces, and words, that a worker remembers at most.
MEMORY_PIECES = 700_000
MEMORY_WORDS = 1_000_000
#: Characters that composing leaves alone and that lower-case one by one (but for the dotted I).
PLAIN = "[!-~À-ſ]+"
PLAIN_TEXT = "[ -~À-įı-ſ]*"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the
    others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Memory(dict):
    """A bounded map that makes what it lacks. Of its two generations, what is asked for moves to the young one
    (the map itself), and the old one is dropped when the young one is full."""

    def __init__(self, most: int, make):
        super().__init__()
        self.half, self.make, self.old = most // 2, make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def age(self) -> None:
        if len(self) > self.half:
            self.old = dict(self)
            self.clear()


class Encoder:
    """encode(text) gives the library's encode(text, add_special_tokens=False).ids as little-endian 32-bit bytes."""

    def __init__(self, path: str, pieces: int = MEMORY_PIECES, words: int = MEMORY_WORDS):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.pieces, self.words = Memory(pieces, self.piece), Memory(words, self.word)
        self.plain = regex.compile(PLAIN).fullmatch
        self.plain_text = re.compile(PLAIN_TEXT).fullmatch
        steps = (json.loads(self.library.to_str())["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.cut = None
        if [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]:
            self.cut = regex.compile(steps[0]["pattern"]["Regex"]).findall
        self.model, self.letters = self.library.model, byte_letters()
        self.raw = [i.to_bytes(4, "little") for i in range(max(self.library.get_vocab().values()) + 1)]
        # For many texts at once: pieces known, where the ids of each begin among `ids`, and how many these are. The first stands for the end of a text.
        self.most, self.known, self.begin, self.size, self.ids = words // 2, pa.array(["\0"]), np.zeros(1, dtype=np.int64), np.ones(1, dtype=np.int64), np.zeros(1, dtype="<u4")

    def word(self, word: str) -> bytes:
        """Ids of one word that the pattern gave, or of a lower-case piece of plain letters."""
        if not word.isalpha():
            if word[:-1].isalpha() and word[-1] in ",.;:!?":
                return self.words[word[:-1]] + self.words[word[-1]]
            cut = self.cut(word)
            if cut != [word]:
                return b"".join(map(self.words.__getitem__, cut))
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.raw[x.id] for x in self.model.tokenize(letters)])

    def ask(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, p: str) -> bytes:
        if not p:
            return b""
        if self.cut and (p.isascii() or max(p) <= "ſ" and "İ" not in p):
            if p.isalpha():
                return self.words[p.lower()]
            if p[:-1].isalpha() and p[-1] in ",.;:!?":
                return self.words[p[:-1].lower()] + self.words[p[-1]]
            if self.plain(p) and "<|" not in p:
                return b"".join(map(self.words.__getitem__, self.cut(p.lower())))
        return self.ask(p)

    def is_plain(self, text: str) -> bool:
        return bool(self.cut and self.plain_text(text)) and "<|" not in text

    def encode_many(self, texts: list[str], end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, with the id `end` after each, and how many each has with it. Plain texts are looked
        up together; another one takes part as one piece, which is a name that no plain text holds."""
        shown, others = [], {}
        self.ids[:1] = np.frombuffer(end, dtype="<u4")
        for i, text in enumerate(texts):
            text = text.replace("\n", " ")
            if self.is_plain(text):
                shown.append(text.lower())
            else:
                shown.append(f"\0{i}")
                others[shown[-1]] = self.encode(text)
        pieces = pc.split_pattern(pa.array(["".join([t + " \0 " for t in shown])[:-1]], pa.large_string()), " ").values.cast(pa.string())
        at = pc.index_in(pieces, value_set=self.known)
        lacks = at.is_null()
        new = pieces.filter(lacks).dictionary_encode()
        names = new.dictionary.to_numpy(zero_copy_only=False).tolist()
        # Of plain pieces only words are remembered here; a piece with other signs is known by itself.
        values = [others[p] if p in others else self.words[p] if p.isalpha() else self.word(p) for p in names]
        sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4
        begin, size = np.append(self.begin, len(self.ids) + np.cumsum(sizes) - sizes), np.append(self.size, sizes)
        ids = np.append(self.ids, np.frombuffer(b"".join(values), dtype="<u4"))
        place = at.fill_null(0).to_numpy().astype(np.int64)
        place[lacks.to_numpy(zero_copy_only=False)] = len(self.known) + new.indices.to_numpy()
        own = size[place]
        ends = np.cumsum(own)
        from_ = np.repeat(begin[place] - (ends - own), own)
        from_ += np.arange(len(from_))
        lengths = np.diff(ends[place == 0], prepend=0)
        out, known = ids[from_], pa.concat_arrays([self.known, new.dictionary])
        if others or len(known) > self.most:  # where there is no more room, what these texts lack is forgotten
            keep = np.append(np.ones(len(self.known), dtype=bool), np.array([p not in others for p in names], dtype=bool))
            if len(known) > self.most:
                keep &= np.bincount(place, minlength=len(keep)) > 0
            known, size, moved = known.filter(pa.array(keep)), size[keep], begin[keep]
            begin = np.cumsum(size) - size
            kept = np.repeat(moved - begin, size)
            ids = ids[kept + np.arange(len(kept))]
        self.known, self.begin, self.size, self.ids = known, begin, size, ids
        self.pieces.age()
        self.words.age()
        return out, lengths

    def encode(self, text: str) -> bytes:
        text = text.replace("\n", " ")
        if self.is_plain(text):
            out = b"".join(map(self.words.__getitem__, text.lower().split(" ")))
        else:
            out = b"".join(map(self.pieces.__getitem__, text.split(" ")))
        self.pieces.age()
        self.words.age()
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
