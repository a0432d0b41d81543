"""Cross-tokenizer alignment against both libraries and plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from stratalog.llm import alignment
from stratalog.llm.tokens import byte_letters

BYTE_BPE, PIECE_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_of_the_merge_path():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(2))
        step = int(rng.integers(1, 9))
        left, right = alignment.common_ends(a, b, step)
        assert a[left].tolist() == b[right].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
        at_a, at_b = alignment.diagonals(a, b, step)
        assert all(x == step for x in (np.diff(at_a) + np.diff(at_b))[:-1])


def brute(texts):
    """One row per text, by the libraries on whole texts and loops over tokens."""
    a_lib, b_lib = Tokenizer.from_file(BYTE_BPE), SentencePieceProcessor(model_file=PIECE_BPE)
    a_lib.encode_special_tokens = True
    byte = {letter: b for b, letter in byte_letters().items()}
    out, links = [], []
    for t in texts:
        a, b = (a_lib.encode(" " + t, add_special_tokens=False).ids, b_lib.encode(t)) if t else ([], [])
        a_bytes = [bytes(byte[c] for c in a_lib.id_to_token(x)) if x != 50256 else b"<|endoftext|>" for x in a]
        b_bytes = [bytes([int(b_lib.id_to_piece(x)[3:5], 16)]) if b_lib.is_byte(x) else b_lib.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not t or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + t).encode():
            out.append((0, 0, 0, "")), links.append([])
            continue
        groups, own, i, j, end_a, end_b = [], [], 0, 0, 0, 0
        for to_i, x in enumerate(a, 1):
            end_a += len(a_bytes[to_i - 1])
            to_j, end = j, end_b
            while to_j < len(b) and end < end_a:
                end += len(b_bytes[to_j])
                to_j += 1
            if end == end_a:
                groups.append(",".join(map(str, a[i:to_i])) + "|" + ",".join(map(str, b[j:to_j])))
                own.append((x, b[to_j - 1]))
                i, j, end_b = to_i, to_j, end
        out.append((len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest())), links.append(own)
    count = Counter(x for own in links for x in own)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return [(n_a, n_b, g, len(own), sum(count[x] == best[x[1]] for x in own), sum(count[x] for x in own), sha) for (n_a, n_b, g, sha), own in zip(out, links, strict=True)]


def sample():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeéñstr") for _ in range(rng.randint(2, 9))) for _ in range(200)]
    texts = [None, "", " ", "   ", " a", "a ", "a\n b", "a \nb", "a  b", "\n", "x▁y z", "<s> a</s> <|endoftext|> b", "é日本 日", "a\n\n  b c\t\td", "\x00 a", "a \x1c b", "don't  STOP  now", "x" * 5000, "日本語の" * 300]
    texts += ["".join(rng.choice(" \n\tab é.'s1") for _ in range(40)) for _ in range(200)]
    texts += [" ".join(rng.choice(words) for _ in range(n)) for n in (3, 50, 50, 4000)]
    return texts + texts[-3:]


@pytest.mark.parametrize("small", [False, True])
def test_alignment(spark, monkeypatch, small):
    if small:  # many blocks, buckets and forgotten parts
        for name, value in {"MEMORY_PARTS": 50, "BLOCK_WORDS": 300, "BUCKET_PAIRS": 100, "PIECE_ENDS": 7}.items():
            monkeypatch.setattr(alignment, name, value)
    texts = sample()
    # All columns but the ids clash with names that the operator uses; ids repeat and one is null.
    rows = [(None if i == 5 else i % 200, t, 1, 2, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block long, links long, keys string").repartition(3)
    found = Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in alignment.align(docs, BYTE_BPE, PIECE_BPE).collect())
    assert found == Counter((row[0], *x) for row, x in zip(rows, brute(texts), strict=True))


def test_alignment_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(empty, BYTE_BPE, PIECE_BPE).count() == 0
