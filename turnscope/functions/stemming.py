"""Full-text tokens: case and accents folded, cut at what is no letter or number, and stemmed (Porter, 1980)."""

from __future__ import annotations

import functools
import re
import unicodedata

_VOWELS = "aeiou"


def _kept(c: str) -> bool:
    return unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co"


@functools.lru_cache(1 << 16)
def fold(c: str) -> str:
    """A character as the index sees it: a blank, or lower case without accent."""
    if unicodedata.category(c) == "Mn":
        return ""
    if not _kept(c):
        return " "
    low = c.lower()
    if len(low) > 1:
        low = low[0]
    base = unicodedata.normalize("NFD", low)
    return base[0] if len(base) == 2 and unicodedata.category(base[1]) == "Mn" else low  # letters with two marks stay


def words(text: str) -> list[str]:
    if text.isascii():
        return re.findall(r"[a-z0-9]+", text.lower())
    return "".join(map(fold, text)).split()


def _shape(w: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(w):
        vowel = c in _VOWELS or (c == "y" and i > 0 and out[i - 1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and len(w) >= 3 and w[-1] not in "wxy"


# Fixed values of the published algorithm: suffix -> replacement, by step.
_STEP2 = dict(
    pair.split("-") for pair in "ational-ate tional-tion enci-ence anci-ance izer-ize logi-log bli-ble alli-al entli-ent eli-e ousli-ous ization-ize ation-ate ator-ate alism-al iveness-ive fulness-ful ousness-ous aliti-al iviti-ive biliti-ble".split()
)
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _swap(w: str, table: dict[str, str]) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            return stem + table[suffix] if _measure(stem) > 0 else w
    return w


@functools.lru_cache(1 << 18)
def stem(w: str) -> str:
    """The stem; suffixes are looked for among bytes, and bytes beyond ASCII are consonants."""
    if w.isascii():
        return _stem(w)
    return _stem(w.encode().decode("latin-1")).encode("latin-1").decode(errors="ignore")


def _stem(w: str) -> str:
    if len(w) < 3 or len(w) > 64:
        return w
    if (w.endswith("sses") and len(w) > 4) or (w.endswith("ies") and len(w) > 3):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and "v" in _shape(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and "v" in _shape(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        w = cut
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short_end(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(w, _STEP2)
    w = _swap(w, _STEP3)
    for suffix in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if w.endswith(suffix):
            rest = w[: -len(suffix)]
            if _measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))):
                w = rest
            break
    if w.endswith("e"):
        rest = w[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _short_end(rest)):
            w = rest
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def stems(text: str) -> list[str]:
    return [stem(w) for w in words(text)]
