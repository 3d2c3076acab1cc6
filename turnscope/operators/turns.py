"""Turn assembly over entry rows: active branch, compaction windows, prompts, and one row per turn."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnscope.functions.text import head_bytes_col, trim_col
from turnscope.sources.session_log import branch_of

# Prompts that nobody typed, the copies' distance from a compaction, the cap of a prompt in bytes.
INJECTED = (
    r"^(?:\[Background task notification\]"
    r"|Another language model started to solve this problem"
    r"|\[\w+ loop guard:"
    r"|The conversation history before this point was compacted)"
)
COPY_WINDOW_MS = 500
PROMPT_BYTES = 2048
SKILL_START = '<skill name="'


def active_branch(entries: DataFrame) -> DataFrame:
    """Entries (session, offset, entry_id, parent_id, ...) on the way from each session's last entry to its root.

    The walk needs a session's ids together, so only those thin columns are gathered, a row a session; the rest is joined back.
    """
    kind = dict(entries.dtypes)["session"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for own in batch.column(1).to_pylist():
                branch = branch_of([e["entry_id"] for e in own], [e["parent_id"] for e in own])
                kept.append([own[i]["offset"] for i in branch])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.list_(pa.int64()))], ["session", "kept"])

    whole = F.array_sort(F.collect_list(F.struct("offset", "entry_id", "parent_id"))).alias("entries")
    walked = entries.groupBy("session").agg(whole).mapInArrow(walk, f"session {kind}, kept array<long>")
    return entries.join(walked.select("session", F.explode("kept").alias("offset")), ["session", "offset"], "left_semi")


def branch_roots(branch: DataFrame) -> DataFrame:
    """(session, root): the first entry of each branch."""
    return branch.groupBy("session").agg(F.min_by("entry_id", "offset").alias("root"))


def skip_compaction(branch: DataFrame) -> DataFrame:
    """Branch entries without compaction boundaries and the copies right after them."""
    so_far = Window.partitionBy("session").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    rows = branch.withColumn("__after", F.sum(F.col("boundary").cast("int")).over(so_far))
    in_run = Window.partitionBy("session", "__after").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    outside = F.abs(F.col("ts") - F.first("ts").over(in_run)) > COPY_WINDOW_MS
    rows = rows.withColumn("__outside", outside.cast("int"))
    left = F.max("__outside").over(in_run) == 1
    return rows.withColumn("__left", left).filter(~F.col("boundary") & ((F.col("__after") == 0) | F.col("__left"))).drop("__after", "__outside", "__left")


def _of_type(blocks: Column, kind: str) -> Column:
    return F.filter(blocks, lambda b: b["type"] == kind)


def prompt_of(blocks: Column) -> Column:
    """The prompt with which a user message opens a turn, null if it is no real prompt."""
    texts = F.filter(F.transform(_of_type(blocks, "text"), lambda b: b["text"]), lambda t: t.isNotNull())
    text = trim_col(F.array_join(texts, "\n"))
    injected = text.rlike(INJECTED)
    skill = F.concat(F.lit("[skill "), F.substring_index(F.substring(text, len(SKILL_START) + 1, 1 << 30), '"', 1), F.lit("]"))
    real = (F.size(_of_type(blocks, "tool_result")) == 0) & (text != "") & ~injected
    return F.when(real, F.when(text.startswith(SKILL_START), skill).otherwise(text))


def assemble_turns(kept: DataFrame) -> DataFrame:
    """(session, entry_id, date, offset, prompt, texts, tools, results): one row per prompt and what followed it."""
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    rows = kept.withColumn("prompt", F.when(user, prompt_of(F.col("blocks"))))
    so_far = Window.partitionBy("session").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("turn", F.sum(F.col("prompt").isNotNull().cast("int")).over(so_far)).filter("turn > 0")
    spoken = F.transform(_of_type(F.col("blocks"), "text"), lambda b: b["text"])
    none = F.array()
    parts = rows.select(
        "session",
        "turn",
        "offset",
        F.struct("entry_id", F.col("ts").alias("date"), "offset", "prompt").alias("head"),
        F.col("prompt").isNotNull().alias("opens"),
        F.when(assistant, F.filter(spoken, lambda t: t.isNotNull() & (trim_col(t) != ""))).otherwise(none.cast("array<string>")).alias("texts"),
        F.when(assistant, F.transform(_of_type(F.col("blocks"), "tool_use"), lambda b: F.struct(b["name"].alias("name"), b["args"].alias("args")))).otherwise(none.cast("array<struct<name:string,args:string>>")).alias("tools"),
        F.when(user & F.col("prompt").isNull(), F.transform(_of_type(F.col("blocks"), "tool_result"), lambda b: F.struct(b["content"].alias("content"), b["is_error"].alias("is_error")))).otherwise(none.cast("array<struct<content:string,is_error:boolean>>")).alias("results"),
    )
    ordered = lambda name: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", name))), lambda s: s[name])).alias(name)
    turns = parts.groupBy("session", "turn").agg(F.max(F.when(F.col("opens"), F.col("head"))).alias("head"), ordered("texts"), ordered("tools"), ordered("results"))
    return turns.select("session", "head.entry_id", "head.date", "head.offset", head_bytes_col(F.col("head.prompt"), PROMPT_BYTES).alias("prompt"), "texts", "tools", "results")


def turns_of(log_rows: DataFrame) -> DataFrame:
    """Turns of parsed logs (rows of ``session_log.SCHEMA``)."""
    return assemble_turns(skip_compaction(log_rows.filter("kind = 'entry' AND on_branch")))


def chunked(rows: list, size: int) -> Iterator[list]:
    for lo in range(0, len(rows), size):
        yield rows[lo : lo + size]
