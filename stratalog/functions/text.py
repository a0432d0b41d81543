"""Column functions over text, tokens, hashes and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of Unicode white space.
SPACE_RUN = r"[\t\n\x0B\f\r \x{85}\p{Z}]+"
FINGERPRINT_VERSION = "v1"
QUANTUM = 1e-4
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"]


#: Runs of other characters part words; letters and digits of all scripts belong to them.
BETWEEN_WORDS = r"[^\p{L}\p{N}]+"


def scope_overlap(scope_keys: Column, scopes: Column) -> Column:
    """Whether a row may be found by who asks with these scopes; no scopes are all."""
    return scopes.isNull() | (F.size(scopes) == 0) | F.arrays_overlap(scope_keys, scopes)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), SPACE_RUN, " "))


def normalize_content(text: Column) -> Column:
    """Lower case, single spaces, no punctuation at the end."""
    return F.regexp_replace(collapse(text), r"[.!?,;: ]+$", "")


def normalize_query(text: Column) -> Column:
    return collapse(text)


def query_hash(text: Column) -> Column:
    return F.sha2(normalize_query(text), 256)


def sized(text: Column) -> Column:
    """The bytes of a text after their number as eight bytes, so that neighbours can't run together."""
    raw = F.encode(text, "UTF-8")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw).cast("long")), 16, "0")), raw)


def context_bytes(kind: Column, names: Column) -> Column:
    ordered = F.array_sort(F.coalesce(names, F.array().cast("array<string>")))
    head = F.concat(sized(F.lit(FINGERPRINT_VERSION)), sized(kind), F.unhex(F.lpad(F.hex(F.size(ordered).cast("long")), 16, "0")))
    return F.aggregate(ordered, head, lambda acc, x: F.concat(acc, sized(x)))


def context_fingerprint(kind: Column, names: Column) -> Column:
    return F.sha2(context_bytes(kind, names), 256)


def content_fingerprint(kind: Column, names: Column, content: Column) -> Column:
    """Equal for equal kind, set of names and normalised content, and only then."""
    return F.sha2(F.concat(context_bytes(kind, names), sized(normalize_content(content))), 256)


def fingerprint_prefix(fingerprint: Column) -> Column:
    return F.substring(fingerprint, 1, 16)


def est_tokens(text: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def est_tokens_chars(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.char_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def flatten(text: Column) -> Column:
    return F.translate(text, "\r\n", "  ")


def clip(text: Column, most: int) -> Column:
    """At most that many bytes, cut before a character that doesn't fit, and an ellipsis where cut."""
    raw = F.encode(text, "UTF-8")
    tries = [F.substring(raw, 1, most - back) for back in range(4)]
    cut = F.coalesce(*[F.try_validate_utf8(t.cast("string")) for t in tries])
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(cut, F.lit("…")))


def one_line(text: Column, most: int) -> Column:
    return clip(flatten(text), most)


def agent_label(agent: Column, most: int = 64) -> Column:
    return F.when(F.coalesce(agent, F.lit("")) == "", F.lit("-")).otherwise(one_line(agent, most))


def clamp_int32(number: Column) -> Column:
    return F.least(F.greatest(number.cast("long"), F.lit(-(2**31)).cast("long")), F.lit(2**31 - 1).cast("long")).cast("int")


def scope_keys(scopes: Column) -> Column:
    """A map of scopes as `key:value` strings."""
    return F.transform(F.map_entries(scopes), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))


def lenient_timestamp(text: Column) -> Column:
    """An RFC 3339 time, or null."""
    good = text.rlike(r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")
    return F.when(good, F.try_to_timestamp(text))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def quantize(score: Column) -> Column:
    return F.round(score / QUANTUM).cast("long")


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """A unit vector that depends on nothing but the text; a stand-in for a model."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.sha2(F.concat(F.unhex(F.lpad(F.hex(i.cast("long")), 16, "0")), F.encode(text, "UTF-8")), 256))
    part = F.transform(raw, lambda h: F.conv(F.substring(h, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**63) - 1)
    # Each step wraps its result, so that it is computed once and not once per component.
    whole = F.transform(F.array(part), lambda p: F.struct(p.alias("p"), F.sqrt(dot(p, p)).alias("norm")))
    return F.transform(whole, lambda s: F.transform(s["p"], lambda x: x / s["norm"]))[0]


def leg_status(status: Column) -> Column:
    return F.when(status.isin("stub", "timeout"), status).otherwise("ok")


def section_rank(kind: Column) -> Column:
    """Order of a memory's section in a pack; null for kinds that no section shows."""
    return F.when(kind == "semantic", 1).when(kind == "episodic", 2).when(kind == "procedural", 3)
