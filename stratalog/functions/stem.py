"""English stems of words, after Porter's second algorithm."""

from __future__ import annotations

import re
from functools import lru_cache

# Fixed values of the published algorithm.
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
REGION_PREFIXES = ("gener", "commun", "arsen")
SECOND = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous",
    "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
FOURTH = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")

_VOWEL = "[aeiouy]"
_region = re.compile(f"{_VOWEL}[^aeiouy]").search
_has_vowel = re.compile(_VOWEL).search
_short_end = re.compile(f"(?:^{_VOWEL}[^aeiouy]|[^aeiouy]{_VOWEL}[^aeiouywxY])$").search
_double_end = re.compile(r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$").search


def _begin_of_region(word: str, start: int) -> int:
    """Where what follows the first consonant after a vowel begins, from `start` on."""
    m = _region(word[start:])
    return start + m.end() if m else len(word)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of other letters than a to z stay as they are."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    prefix = next((p for p in REGION_PREFIXES if w.startswith(p)), None)
    r1 = len(prefix) if prefix else _begin_of_region(w, 0)
    r2 = _begin_of_region(w, r1)
    # Plurals.
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _has_vowel(w[:-2]):
        w = w[:-1]
    if w in KEPT:
        return w
    # Past and present participles.
    m = re.search(r"(?:eedly|ingly|edly|eed|ing|ed)$", w)
    if m and m.group().startswith("eed"):
        w = w[: m.start()] + "ee" if m.start() >= r1 else w
    elif m and _has_vowel(w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double_end(w):
            w = w[:-1]
        elif len(w) <= r1 and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # Longer endings, by region.
    for endings, least in ((SECOND, r1), (THIRD, r1)):
        end = next((e for e in sorted(endings, key=len, reverse=True) if w.endswith(e)), None)
        if end and len(w) - len(end) >= least:
            before = w[: -len(end)]
            if not (end == "ogi" and not before.endswith("l") or end == "li" and before[-1:] not in "cdeghkmnrt" or end == "ative" and len(before) < r2):
                w = before + endings[end]
    end = next((e for e in FOURTH if w.endswith(e)), None)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) > r2 or len(w) > r1 and not _short_end(w[:-1])) or w.endswith("l") and len(w) > r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.lower()
