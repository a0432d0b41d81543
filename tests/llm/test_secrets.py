"""Secret scan against plain patterns over whole texts, and its judgement of planted strings."""

import hashlib
import random
import re
import string

import pytest

from stratalog.llm import secret_scan

PLAIN = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]
CLASH = "spans start end kind novelty name n".split()


def brute(text):
    found = [(m.start(), k, m.end()) for k, (_, p, good) in enumerate(PLAIN) for m in p.finditer(text or "") if good(m)]
    return [f"{PLAIN[k][0]}:{b}:{e}" for b, k, e in sorted(found)]


def sample():
    rng = random.Random(5)
    bits = ["password", "PassWord", "passwd", "token", "ſecret", "secret", "Secret", "api_key", "APIKEY", "toKen", '"', "'", " ", "  ", ":", "=", "==", "AKIA", "AKIAAKIA", "\n", "é", "日", "abc", "0123456789abcdef", "deadbeef" * 3, "ABCDEFGH12345678", "x/y+z.", "tokentoken", "-"]
    texts = [None, "", "a", "token=", "token=12345", "token=123456", "TOKEN = 'abcdef'", "secret:secret:secret=abcdef", "f" * 23, "f" * 24, "x" + "f" * 100_000, "password=" + "a" * 50_000, "AKIA" + "Z" * 16, "AKIA" + "Z" * 15]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(600)]
    return texts + ["é " * 500 + 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ' + "ü" * 9] * 3


@pytest.mark.parametrize("clash", [False, True])
def test_known_shapes(spark, clash):
    texts = sample()
    rows = [(None if i == 3 else i % 500, i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, place int, text string").repartition(3)
    docs = docs.selectExpr("doc_id", "text", *(f"7 AS {c}" for c in CLASH)) if clash else docs
    found = secret_scan.counted(secret_scan.find_secrets(docs)).collect()
    base = lambda s: [x for x in s.split(",") if x and not x.startswith("novel")]
    assert sorted((str(r.doc_id), base(r.spans)) for r in found) == sorted((str(i), brute(t)) for i, _, t in rows)
    for r in found:
        own = base(r.spans)
        assert r.base_sha256 == hashlib.sha256(",".join(own).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in own) for k, _, _ in PLAIN)
        places = [(int(x.split(":")[1]), secret_scan.KINDS.index(x.split(":")[0])) for x in r.spans.split(",") if x]
        assert places == sorted(places)


def test_novel_strings(spark):
    """Strings of chance after sensitive words are found, in copies and when repeated too; names are not."""
    rng = random.Random(8)
    parts = ["configuration", "manager", "server", "timeout", "request", "client", "database", "connection", "version1", "handler2"]
    name = lambda: "_".join(rng.choice(parts) for _ in range(3)) + "_v2"
    chance = lambda: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(31)) + "7"
    code = lambda: "\n".join(f"{name()} = {name()}({name()})" for _ in range(6))
    secrets = [chance() for _ in range(40)]
    texts = [f"{code()}\nAuthorization: Bearer {s}\n{code()}" for s in secrets]
    texts += [f"{code()}\nAuthorization: Bearer {name()}\n{code()}" for _ in range(40)]
    texts += [f"{code()}\nplain words and {chance()} far from any such word\n{code()}" for _ in range(20)]
    copied = f"cookie {secrets[0]}\n{code()}\ncookie {secrets[0]}"
    texts += [copied] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r.doc_id: [x for x in r.spans if x.kind == "novel"] for r in secret_scan.find_secrets(docs).collect()}
    hit = [sum(texts[i][x.start : x.end] == secrets[i] for x in found[i]) for i in range(40)]
    assert sum(hit) >= 39 and sum(len(found[i]) for i in range(40, 80)) <= 2
    assert not any(found[i] for i in range(80, 100))
    assert all([texts[i][x.start : x.end] for x in found[i]] == [secrets[0]] * 2 for i in range(100, 130))
    names = secret_scan.identifiers(docs)
    assert b"configuration" not in names and len(names) <= secret_scan.IDENTIFIERS and not any(s.encode()[:39] in names for s in secrets)


def test_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert secret_scan.find_secrets(empty).count() == 0
