"""What is indexed of a turn: reply, gist, commands, files, commits and whether a command failed."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnscope.functions.paths import command_paths, touched
from turnscope.functions.redaction import redact_col
from turnscope.functions.text import clip, clip_col, first_line_col, head_and_tail_col

# Fixed values.
REPLY_HEAD, REPLY_TAIL = 2048, 6144
GIST_CHARS = COMMAND_CHARS = 300
COMMANDS_BYTES = 4096
FILE_TOOLS = ("read", "edit", "write")
PATH_KEYS = ("path", "file_path")
DETAIL_KEYS = ("path", "file_path", "url", "query", "pattern")
COMMIT_LINE = r"(?m)^\[[^\]\s]+(?: \(root-commit\))? ([0-9a-f]{7,40})\] "
EXIT_LINE = r"^exit ([0-9]+)"
LARGEST_CODE = (1 << 64) - 1


def _argument(args: dict, key: str) -> str | None:
    value = args.get(key)
    return value if isinstance(value, str) and value.strip() else None


def command_line(name: str, args: dict) -> str | None:
    """How a tool call is listed: a shell command itself, else the tool and its first telling argument."""
    if not name:
        return None
    if name == "bash":
        command = _argument(args, "command")
        return clip(command, COMMAND_CHARS) if command else None
    detail = next(filter(None, (_argument(args, k) for k in DETAIL_KEYS)), None)
    return clip(f"{name} {detail}" if detail else name, COMMAND_CHARS)


def command_list(tools: list[tuple[str, dict]]) -> str:
    """The listed calls that fit; one that does not is passed over, and shorter ones may follow."""
    out: list[str] = []
    used = 0
    for name, args in tools:
        line = command_line(name, args)
        size = len(line.encode()) if line else 0
        if line and used + size < COMMANDS_BYTES:
            used += size + 1
            out.append(line)
    return "\n".join(out)


def file_list(tools: list[tuple[str, dict]], cwd: str, root: str) -> list[str]:
    raw: list[str] = []
    for name, args in tools:
        if name in FILE_TOOLS:
            raw += filter(None, (_argument(args, k) for k in PATH_KEYS))
        elif name == "bash":
            raw += command_paths(_argument(args, "command") or "")
    return touched(raw, cwd, root)


def _calls(tools) -> list[tuple[str, dict]]:
    out = []
    for t in tools if tools is not None else []:
        args = json.loads(t["args"]) if t["args"] else {}
        out.append((t["name"] or "", args if isinstance(args, dict) else {}))
    return out


_FOUND = T.StructType([T.StructField("commands", T.StringType()), T.StructField("files", T.ArrayType(T.StringType()))])


@F.pandas_udf(_FOUND)
def _tool_fields(tools: pd.Series, cwd: pd.Series, root: pd.Series) -> pd.DataFrame:
    calls = [_calls(t) for t in tools]
    return pd.DataFrame({"commands": [command_list(c) for c in calls], "files": [file_list(c, w or "", r or "") for c, w, r in zip(calls, cwd, root, strict=True)]})


def commits_col(contents: Column) -> Column:
    """Distinct commit ids in order of appearance over an array of outputs."""
    return F.array_distinct(F.flatten(F.transform(contents, lambda c: F.regexp_extract_all(c, F.lit(COMMIT_LINE), F.lit(1)))))


def failed_col(results: Column) -> Column:
    """Whether any result is an error or starts with a nonzero exit code; a code beyond 64 bits is none."""

    def bad(r: Column) -> Column:
        code = F.regexp_extract(first_line_col(r["content"]), EXIT_LINE, 1)
        digits = F.regexp_replace(code, "^0+", "")
        fits = (F.length(digits) < 20) | ((F.length(digits) == 20) & (digits <= str(LARGEST_CODE)))
        return r["is_error"] | ((digits != "") & fits)

    return F.exists(results, bad)


def extract(turns: DataFrame, redacted: bool = True) -> DataFrame:
    """Turns with ``cwd``, ``project_key`` and ``project_name`` as rows of the index; secrets are removed unless told otherwise."""
    last = F.coalesce(F.try_element_at("texts", F.lit(-1)), F.lit(""))
    fields = turns.withColumn("found", F.when(F.size("tools") > 0, _tool_fields("tools", "cwd", "project_key")))
    clean = redact_col if redacted else (lambda c: c)
    return fields.select(
        "session",
        "entry_id",
        "project_key",
        "project_name",
        "cwd",
        "date",
        clean(F.col("prompt")).alias("prompt"),
        clean(head_and_tail_col(F.array_join("texts", "\n\n"), REPLY_HEAD, REPLY_TAIL)).alias("reply"),
        clean(clip_col(first_line_col(last), GIST_CHARS)).alias("gist"),
        clean(F.coalesce("found.commands", F.lit(""))).alias("commands"),
        F.coalesce(_clean_each(F.col("found.files"), redacted), F.array().cast("array<string>")).alias("files"),
        commits_col(F.transform("results", lambda r: r["content"])).alias("commits"),
        failed_col(F.col("results")).alias("failed"),
        (F.size("texts") > 0).alias("has_reply"),
    )


def _clean_each(files: Column, redacted: bool) -> Column:
    """Paths hold no line feeds, so they can be cleaned joined."""
    return F.when(F.size(files) > 0, F.split(redact_col(F.array_join(files, "\n")), "\n")) if redacted else files
