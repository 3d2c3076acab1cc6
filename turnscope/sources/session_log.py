"""Session logs: one append-only JSONL file per session, read with byte offsets.

A file becomes one ``file`` row and one ``entry`` row for every valid entry. A last line without its line feed
is left for the next read. Spark's text reader has neither offsets nor that rule, so files are parsed in Arrow
batches, one file at a time. Whatever bytes a file holds, each of its lines is an entry, the header or a skipped line.
"""

from __future__ import annotations

import json
import math
import os
import re
from dataclasses import dataclass, field

BLOCK = "struct<type:string,text:string,name:string,args:string,content:string,is_error:boolean>"
SCHEMA = (
    "session string, kind string, offset long, entry_id long, parent_id long, ts long, boundary boolean, role string, "
    f"blocks array<{BLOCK}>, on_branch boolean, cwd string, root long, skipped array<long>"
)


@dataclass
class Log:
    cwd: str | None = None
    entries: list[dict] = field(default_factory=list)
    skipped: list[int] = field(default_factory=list)
    branch: list[int] = field(default_factory=list)

    @property
    def root(self) -> int | None:
        return self.entries[self.branch[0]]["entry_id"] if self.branch else None


def _typed(value: object, kind: type, default):
    """``value`` if JSON gave it that type; a boolean is no number, and neither is what 64 bits do not hold."""
    if kind is int and isinstance(value, int) and (isinstance(value, bool) or not -(1 << 63) <= value < 1 << 63):
        return default
    return value if isinstance(value, kind) else default


def _number(digits: str) -> int | float:
    return int(digits) if len(digits) <= 20 else _finite(digits)


def _finite(digits: str) -> float:
    value = float(digits)
    if math.isinf(value):
        raise ValueError("number out of range")
    return value


def _constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


_JSON = json.JSONDecoder(parse_int=_number, parse_float=_finite, parse_constant=_constant)
#: Half a surrogate pair that is written as an escape; only lines that have one are looked at more closely.
_HALF = re.compile(rb"\\u[dD][89a-fA-F]")


def _line(raw: bytes) -> object:
    """The JSON value of a line; ValueError or RecursionError if it is none, or holds text that is not Unicode."""
    value = _JSON.decode(raw.decode("utf-8").strip(" \t\r\x0c"))
    if _HALF.search(raw):
        json.dumps(value, ensure_ascii=False).encode("utf-8")
    return value


def _dump(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _block(raw: object) -> dict:
    """The fields of a content block that later steps read; anything else is dropped."""
    raw = raw if isinstance(raw, dict) else {}
    content = raw.get("content")
    return {
        "type": _typed(raw.get("type"), str, ""),
        "text": _typed(raw.get("text"), str, None),
        "name": _typed(raw.get("name"), str, ""),
        "args": _dump(raw.get("args")),
        "content": content if isinstance(content, str) else "" if "content" not in raw else _dump(content),
        "is_error": _typed(raw.get("is_error"), bool, False),
    }


def _entry(line: dict, offset: int) -> dict:
    message = _typed(line.get("message"), dict, {})
    content = message.get("content")
    if isinstance(content, str):
        content = [{"type": "text", "text": content}]
    return {
        "offset": offset,
        "entry_id": line["entry_id"],
        "parent_id": _typed(line.get("parent_id"), int, None),
        "ts": _typed(line.get("timestamp"), int, 0),
        "boundary": _typed(line.get("compaction_boundary"), bool, False),
        "role": _typed(message.get("role"), str, ""),
        "blocks": [_block(b) for b in _typed(content, list, [])],
    }


def branch_of(ids: list[int], parents: list[int | None]) -> list[int]:
    """Positions on the way from the last entry to its root, in file order. A repeated id means its last entry."""
    place = {entry: i for i, entry in enumerate(ids)}
    walked: dict[int, None] = {}
    at = len(ids) - 1 if ids else None
    while at is not None and at not in walked:
        walked[at] = None
        at = place.get(parents[at])
    return sorted(walked)


def parse(data: bytes, base: int = 0) -> Log:
    """Parse ``data``, which starts at byte ``base`` of its file."""
    log, at = Log(), 0
    *lines, _ = data.split(b"\n")
    for raw in lines:
        offset, at = base + at, at + len(raw) + 1
        if not raw.strip(b" \t\r\x0c"):
            continue
        try:
            line = _line(raw)
        except (ValueError, RecursionError):
            line = None
        if isinstance(line, dict) and _typed(line.get("entry_id"), int, None) is not None:
            log.entries.append(_entry(line, offset))
        elif isinstance(line, dict) and "id" in line and offset == 0:
            log.cwd = _typed(line.get("cwd"), str, None)
        else:
            log.skipped.append(offset)
    log.branch = branch_of([e["entry_id"] for e in log.entries], [e["parent_id"] for e in log.entries])
    return log


def rows_of(session: str, log: Log) -> list[dict]:
    """The log as rows of SCHEMA."""
    on = set(log.branch)
    none = dict.fromkeys(("offset", "entry_id", "parent_id", "ts", "boundary", "role", "blocks", "on_branch", "cwd", "root", "skipped"))
    rows = [none | {"session": session, "kind": "file", "cwd": log.cwd, "root": log.root, "skipped": log.skipped}]
    return rows + [none | e | {"session": session, "kind": "entry", "on_branch": i in on} for i, e in enumerate(log.entries)]


def list_sessions(folder: str) -> list[tuple[str, str]]:
    """(session, path) of the regular ``*.jsonl`` files directly in ``folder``; none if it does not exist."""
    if not os.path.isdir(folder):
        return []
    found = [(e.name.removesuffix(".jsonl"), e.path) for e in os.scandir(folder) if e.name.endswith(".jsonl") and e.is_file(follow_symlinks=False)]
    return sorted((s, p) for s, p in found if s)
