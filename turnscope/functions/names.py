"""Names: projects from working directories, session ids, similarity of names, and dates in requests."""

from __future__ import annotations

import os
import re
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnscope.functions.paths import join, lexical
from turnscope.operators.errors import BadRequest

DAY_MS = 86_400_000
_UUID_SHAPE = r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
_UUID = re.compile(_UUID_SHAPE + r"\Z")
_AGE = re.compile(r"([0-9]+)([dwm])\Z")
_AGE_DAYS = {"d": 1, "w": 7, "m": 30}
_DATE = re.compile(r"([0-9]{4})(?:-([0-9]+))?(?:-([0-9]+))?\Z")


def git_root(folder: str) -> str | None:
    """The repository that holds ``folder``: for a linked worktree its main repository, for a submodule itself."""
    while True:
        mark = join(folder.rstrip("/"), ".git") if folder != "/" else "/.git"
        if os.path.isdir(mark):
            return folder
        if os.path.isfile(mark):
            return _main_repository(folder, mark) or folder
        if folder == "/":
            return None
        folder = os.path.dirname(folder)


def _read(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except (OSError, UnicodeDecodeError):
        return None


def _main_repository(folder: str, mark: str) -> str | None:
    target = next((line.removeprefix("gitdir:").strip() for line in (_read(mark) or "").splitlines() if line.startswith("gitdir:")), None)
    if target is None:
        return None
    git_dir = lexical(join(folder, target))
    shared = _read(f"{git_dir}/commondir")
    if shared is None:
        return None
    common = lexical(join(git_dir, shared.strip()))
    return os.path.dirname(common) if os.path.basename(common) == ".git" else common


def project_of(cwd: str) -> tuple[str, str]:
    """(key, name) of the project that a working directory belongs to."""
    if not cwd.startswith("/"):
        return cwd, "unknown"
    path = lexical(cwd)
    root = git_root(path) or path
    return root, os.path.basename(root) or root


def is_uuid(s: str) -> bool:
    return bool(_UUID.match(s))


def display_id(session: str, entry_id: int) -> str:
    return f"{session[:8] if is_uuid(session) else session}:{entry_id}"


def display_id_col(session: Column, entry_id: Column) -> Column:
    short = F.when(session.rlike(rf"\A{_UUID_SHAPE}\z"), F.substring(session, 1, 8)).otherwise(session)
    return F.concat_ws(":", short, entry_id.cast("string"))


def jaro_winkler(a: str, b: str) -> float:
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(len(a), len(b)) // 2 - 1
    free = [True] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, f in zip(b, free, strict=True) if not f]
    swapped = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


@F.pandas_udf(T.DoubleType())
def jaro_winkler_col(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def parse_date(text: str, now_ms: int, end: bool, zone: str = "UTC") -> int:
    """Unix milliseconds of ``YYYY``, ``YYYY-MM`` or ``YYYY-MM-DD`` (the period's first or last millisecond in
    ``zone``), or of ``Nd``, ``Nw``, ``Nm`` before now."""
    text = text.strip()
    bad = BadRequest(f"bad date '{text}': use YYYY, YYYY-MM, YYYY-MM-DD, or Nd / Nw / Nm")
    ago = _AGE.match(text)
    if ago and int(ago[1]) < 1 << 32:
        return now_ms - int(ago[1]) * _AGE_DAYS[ago[2]] * DAY_MS
    found = _DATE.match(text)
    if not found:
        raise bad
    year, month, day = (int(x) if x else None for x in found.groups())
    try:
        first = date(year, month or 1, day or 1)
        if day:
            after = first + timedelta(days=1)
        elif month:
            after = date(year + month // 12, month % 12 + 1, 1)
        else:
            after = date(year + 1, 1, 1)
    except (ValueError, OverflowError):
        raise bad from None
    local = lambda d: int(datetime(d.year, d.month, d.day, tzinfo=ZoneInfo(zone)).timestamp() * 1000)
    return local(after) - 1 if end else local(first)
