"""Text helpers: byte caps, clips, first lines, formats. Column forms use built-in functions wherever Spark has them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ELLIPSIS = "…"
#: What Unicode counts as white space, as a character class of both Java and Python.
SPACE = r"[\s\u0085   -     　]"


def head_bytes(s: str, most: int) -> str:
    """The longest prefix of at most ``most`` UTF-8 bytes."""
    return s.encode()[:most].decode(errors="ignore")


def tail_bytes(s: str, most: int) -> str:
    """The longest suffix of at most ``most`` UTF-8 bytes."""
    raw = s.encode()
    return raw[max(0, len(raw) - most) :].decode(errors="ignore") if most else ""


def head_and_tail(s: str, head: int, tail: int) -> str:
    """``s`` if it fits, else its two ends around an ellipsis."""
    if len(s.encode()) <= head + tail:
        return s
    return f"{head_bytes(s, head)} {ELLIPSIS} {tail_bytes(s, tail)}"


def first_line(s: str) -> str:
    """The first line that is not blank, trimmed."""
    return next((t for t in (line.strip() for line in s.split("\n")) if t), "")


def clip(s: str, most: int) -> str:
    """White space collapsed, cut to ``most`` characters with an ellipsis."""
    flat = " ".join(s.split())
    return flat if len(flat) <= most else flat[: max(0, most - 1)] + ELLIPSIS


def fit(s: str, most: int) -> str:
    """Cut to ``most`` characters with an ellipsis; white space is kept."""
    if len(s) <= most:
        return s
    return s[: most - 1] + ELLIPSIS if most > 0 else ""


def fnv1a64(data: bytes) -> int:
    """FNV-1a, 64 bits, as a signed number."""
    h = 0xCBF29CE484222325
    for byte in data:
        h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h - (1 << 64) if h >> 63 else h


def _by_row(f: Callable[[str], str]) -> Callable[[Column], Column]:
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run


def head_bytes_col(text: Column, most: int) -> Column:
    """Python is entered only for texts that are too long."""
    short = F.octet_length(text) <= most
    return F.when(short, text).otherwise(_by_row(lambda s: head_bytes(s, most))(F.when(~short, text)))


def head_and_tail_col(text: Column, head: int, tail: int) -> Column:
    short = F.octet_length(text) <= head + tail
    return F.when(short, text).otherwise(_by_row(lambda s: head_and_tail(s, head, tail))(F.when(~short, text)))


def trim_col(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def first_line_col(text: Column) -> Column:
    return F.coalesce(trim_col(F.regexp_extract(text, rf"(?m)^(.*[^\s\u0085   -     　].*)$", 1)), F.lit(""))


def clip_col(text: Column, most: int) -> Column:
    flat = trim_col(F.regexp_replace(text, f"{SPACE}+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, max(0, most - 1)), F.lit(ELLIPSIS)))


def fit_col(text: Column, most: int) -> Column:
    cut = F.concat(F.substring(text, 1, most - 1), F.lit(ELLIPSIS)) if most > 0 else F.lit("")
    return F.when(F.length(text) <= most, text).otherwise(cut)


def thousands(n: int) -> str:
    return f"{n:,}"


def plural(n: int, word: str) -> str:
    return f"{n:,} {word}" + ("" if n == 1 else "s")


def byte_size(n: int) -> str:
    for unit, factor, digits in (("MB", 1 << 20, 1), ("KB", 1 << 10, 0)):
        if n >= factor:
            return f"{n / factor:.{digits}f} {unit}"
    return f"{n} B"


def how_long_ago(ms: int) -> str:
    seconds = max(ms, 0) // 1000
    if seconds < 60:
        return "just now"
    for limit, unit, name in ((3600, 60, "min"), (86_400, 3600, "h"), (None, 86_400, "d")):
        if limit is None or seconds < limit:
            return f"{seconds // unit} {name} ago"
    raise AssertionError


def fnv1a64_col(text: Column) -> Column:
    """``fnv1a64`` of a text's UTF-8 bytes; null for null."""

    @F.pandas_udf(T.LongType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: fnv1a64(t.encode()), na_action="ignore").astype("Int64")

    return run(text)
