"""Secret redaction as a transition table over classified tokens.

A line is a row of tokens, cut at single blanks. One pass of anchored patterns gives each token two symbols: what it is to a
line that already expects a secret (a scheme word, credential-shaped, or neither), and what it is otherwise (an assignment,
a scheme word, a key, a word). The symbols alone then drive the tables ``EXPECTING`` and ``RESTING``, which say what becomes of the
token and what the line expects next. Tokens between several blanks are empty and change nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# They decide what counts as a secret.
MARK = "<redacted>"
NAME_PARTS = ("api_key", "apikey", "secret", "token", "password", "passwd", "credential", "authorization", "auth_token", "access_key", "private_key", "session_key")
KEY_STARTS = ("sk-", "sk_", "ghp_", "gho_", "ghs_", "github_pat_", "xoxb-", "xoxp-", "xapp-")
SCHEMES = ("Bearer", "Basic", "Digest", "Token")
CLOUD_KEY_STARTS = ("AKIA", "ASIA", "AGPA", "AIDA", "AROA", "ANPA", "ANVA", "ASCA", "ABIA", "ACCA")
OPENING, CLOSING = "([\"'<", ",.;:)]\"'>!?"
BOT_TOKEN = r"\b[MNO][A-Za-z0-9_-]{23,27}\.[A-Za-z0-9_-]{6}\.[A-Za-z0-9_-]{27,40}\b"

_any = lambda words: "|".join(map(re.escape, words))
_wrapped = lambda core, flags=0: re.compile(rf"[{re.escape(OPENING)}]*{core}[{re.escape(CLOSING)}]*\Z", flags)
#: A scheme word: the first group as HTTP writes the one that is hardly ever prose, the second the others.
_SCHEME = _wrapped(rf"(?:({SCHEMES[0]})|({_any(SCHEMES[1:])})|(?i:{_any(SCHEMES)}))", re.A)
#: At least 16 characters with a letter and a digit; trailing full stops belong to the sentence.
_SHAPED = _wrapped(r"(?=[\w\-.=+/~]*[0-9])(?=[\w\-.=+/~]*[A-Za-z])[\w\-.=+/~]{15,}[\w\-=+/~]", re.A)
_KEY = re.compile(rf"(?i:{_any(KEY_STARTS)})", re.A)
_CLOUD_KEY = _wrapped(rf"(?:{_any(CLOUD_KEY_STARTS)})[A-Z0-9]{{16,}}")
#: ``name=value``, else ``name:value``, of which the name says that the value is a secret.
_ASSIGNED = tuple(re.compile(rf"([^{c}]*(?:{_any(NAME_PARTS)})[^{c}]*{c})(.*)\Z", re.I | re.A | re.S) for c in "=:")
#: Lines without any of these cannot hold anything that a rule replaces.
SUSPECT = rf"{_any(NAME_PARTS)}|{_any(KEY_STARTS)}|{_any(SCHEMES).lower()}|{_any(CLOUD_KEY_STARTS)}"
_SUSPECT = re.compile(SUSPECT, re.I | re.A)
_BOT = re.compile(BOT_TOKEN)
_SPACED = re.compile(rf"(?i)(\w*(?:{_any(NAME_PARTS)})\w*\s+[=:]\s+)(\"[^\"\n]+\"|'[^'\n]+'|\S+)")

#: What a line expects: nothing, a secret if it looks like one, or a secret whatever it looks like.
REST, MAYBE, SURELY = range(3)
#: What becomes of a token: it stays, goes as a whole, or goes behind its name.
KEEP, DROP, DROP_VALUE = range(3)

#: (expectation, first symbol) -> (what becomes of the token, next expectation); other cases are those of RESTING.
EXPECTING = {
    (SURELY, "Scheme"): (KEEP, SURELY),
    (SURELY, "scheme"): (KEEP, SURELY),
    (SURELY, "shaped"): (DROP, REST),
    (SURELY, "other"): (DROP, REST),
    (MAYBE, "Scheme"): (KEEP, SURELY),
    (MAYBE, "scheme"): (KEEP, MAYBE),
    (MAYBE, "shaped"): (DROP, REST),
}
#: (second symbol, first symbol of the next token) -> the same; a missing next symbol stands for all others.
RESTING = {
    ("name=Scheme", None): (KEEP, SURELY),
    ("name=scheme", None): (KEEP, MAYBE),
    ("name=value", None): (DROP_VALUE, REST),
    ("name=", "Scheme"): (KEEP, MAYBE),
    ("name=", "scheme"): (KEEP, MAYBE),
    ("name=", "shaped"): (KEEP, MAYBE),
    ("name=", None): (KEEP, REST),
    ("Bearer", None): (KEEP, SURELY),
    ("scheme", "shaped"): (KEEP, MAYBE),
    ("scheme", None): (KEEP, REST),
    ("key", None): (DROP, REST),
    ("word", None): (KEEP, REST),
}


class Symbols(NamedTuple):
    expected: str
    resting: str
    name: str


def symbols(token: str) -> Symbols:
    """Both symbols of a token, and the name that a value is assigned to."""
    scheme = _SCHEME.match(token)
    expected = ("Scheme" if scheme[1] or scheme[2] else "scheme") if scheme else "shaped" if _SHAPED.match(token) else "other"
    assigned = next(filter(None, (p.match(token) for p in _ASSIGNED)), None)
    if assigned:
        value = _SCHEME.match(assigned[2])
        kind = ("name=Scheme" if value[1] or value[2] else "name=scheme") if value else "name=value" if assigned[2] else "name="
        return Symbols(expected, kind, assigned[1])
    if scheme:
        return Symbols(expected, "Bearer" if scheme[1] else "scheme", "")
    return Symbols(expected, "key" if _KEY.match(token) or _CLOUD_KEY.match(token) else "word", "")


def _line(line: str) -> str:
    tokens = line.split(" ")
    seen = [(i, symbols(t)) for i, t in enumerate(tokens) if t]
    expects = REST
    for (i, own), (_, then) in zip(seen, [*seen[1:], (0, Symbols("other", "word", ""))], strict=True):
        rest = RESTING.get((own.resting, then.expected)) or RESTING[own.resting, None]
        becomes, expects = EXPECTING.get((expects, own.expected), rest)
        if becomes != KEEP:
            tokens[i] = MARK if becomes == DROP else own.name + MARK
    return " ".join(tokens)


def redact(text: str, spaced_assignments: bool = False) -> str:
    """``text`` without secrets. ``spaced_assignments`` also covers ``name = value``, which tokens alone keep."""
    plain = _BOT.sub(MARK, "\n".join(_line(t) if _SUSPECT.search(t) else t for t in text.split("\n")))
    return _SPACED.sub(rf"\1{MARK}", plain) if spaced_assignments else plain


class Redaction(NamedTuple):
    text: str
    strict_text: str
    kinds: list[str]


def redaction(text: str) -> Redaction:
    """The text in both forms, and the kinds of content that were removed from the plain one."""
    plain = redact(text)
    return Redaction(plain, _SPACED.sub(rf"\1{MARK}", plain), ["secret"] if plain != text else [])


_STRUCT = T.StructType([T.StructField("text", T.StringType()), T.StructField("strict_text", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))])


@F.pandas_udf(_STRUCT)
def _redactions(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([redaction(t) if t is not None else (None, None, None) for t in texts], columns=list(Redaction._fields))


def redaction_col(text: Column) -> Column:
    """struct<text, strict_text, kinds>; null where the text is null. Texts that cannot hold a secret stay in the JVM."""
    suspect = text.rlike(f"(?i){SUSPECT}") | text.rlike(BOT_TOKEN)
    same = F.struct(text.alias("text"), text.alias("strict_text"), F.array().cast("array<string>").alias("kinds"))
    return F.when(suspect, _redactions(F.when(suspect, text))).when(text.isNotNull(), same)


def redact_col(text: Column, spaced_assignments: bool = False) -> Column:
    return redaction_col(text)["strict_text" if spaced_assignments else "text"]
