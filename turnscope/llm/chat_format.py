"""Chat formatting by columnar byte assembly, and reading the output back.

A turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a backslash is doubled and
``<|`` becomes ``<\\|`` (in roles a line feed becomes ``\\n``), so no text can forge a control string and
``parse`` gets every role and text back. The loss mask covers the escaped text of assistant turns.

Turns of a conversation are sorted together and streamed: a batch's segment lengths, offsets and scatter
indices are computed in numpy and headers and contents are copied into one preallocated buffer. A task holds
one block of turns at a time, however long a conversation is; a conversation longer than a block comes out
in several parts, numbered in order.

Defined results: a null role or text counts as empty; a null turn comes first; rows with the same turn are
ordered by role and text; repeated rows are turns of their own; an empty table gives no rows. Rows without a
conv_id form a conversation of their own, with a null conv_id. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscope.llm.common import blocks, bound_batches, utf8_buffers

START, END = "<|im_start|>", "<|im_end|>"
BLOCK_BYTES = 1 << 20


def escape(values: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(values, "\\", "\\\\"), "<|", "<\\|")


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return "\\".join(part.replace("\\|", "|").replace("\\n", "\n") for part in text.split("\\\\"))


def assemble(columns: list[pa.Array | bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Concatenate, row by row, constant bytes and string columns into one buffer.

    Returns the buffer, each row's first byte (and the end), and for each segment its first byte in each row.
    """
    rows = next(len(c) for c in columns if not isinstance(c, bytes))
    parts = [(np.frombuffer(c, np.uint8), None) if isinstance(c, bytes) else utf8_buffers(c) for c in columns]
    lengths = np.stack([np.full(rows, len(d)) if o is None else np.diff(o) for d, o in parts], axis=1)
    ends = np.cumsum(lengths.ravel()).reshape(lengths.shape) if rows else lengths
    begins = ends - lengths
    out = np.empty(int(ends[-1, -1]) if rows else 0, np.uint8)
    for k, (data, offsets) in enumerate(parts):
        size = lengths[:, k]
        total = int(size.sum())
        if not total:
            continue
        source = np.tile(np.arange(len(data)), rows) if offsets is None else np.arange(offsets[0], offsets[-1])
        shift = begins[:, k] - (np.cumsum(size) - size)
        out[np.repeat(shift, size) + np.arange(total)] = data[source]
    return out, np.append(begins[:, 0] if rows else [], len(out)).astype(np.int64), [begins[:, k] for k in range(len(parts))]


def format_chats(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, part, text, loss): the formatted turns of a conversation in parts that hold whole turns,
    and the byte ranges under the loss mask as [start, end, start, end, ...] within the part."""
    bound_batches(conversations.sparkSession)
    kind = dict(conversations.select("conv_id").dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = None, -1
        for batch in batches:
            size = pc.add(pc.binary_length(batch.column(1)), pc.binary_length(batch.column(2))).to_numpy()
            for lo, hi in blocks(np.concatenate(([0], np.cumsum(size))), BLOCK_BYTES):
                block = batch.slice(lo, hi - lo)
                ids = block.column(0)
                role, text = (escape(block.column(i)) for i in (1, 2))
                role = pc.replace_substring(role, "\n", "\\n")
                out, turn_at, begins = assemble([START.encode(), role, b"\n", text, (END + "\n").encode()])
                assistant = pc.equal(block.column(1), "assistant").to_numpy(zero_copy_only=False)
                keys = ids.to_pylist()
                first = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
                parts, loss = [], []
                for a, b in zip(first, [*first[1:], len(keys)], strict=True):
                    part = part + 1 if part >= 0 and keys[a] == last else 0
                    last = keys[a]
                    parts.append(part)
                    marked = np.flatnonzero(assistant[a:b]) + a
                    loss.append(np.stack([begins[3][marked], begins[4][marked]], axis=1).ravel() - turn_at[a])
                cuts = np.append(turn_at[first], len(out)).astype(np.int32)
                texts = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(cuts), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.array(parts, pa.int64()), texts, pa.array(loss, pa.list_(pa.int64()))], ["conv_id", "part", "text", "loss"])

    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    turns = conversations.select("conv_id", "turn", empty("role"), empty("text"))
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return turns.mapInArrow(run, f"conv_id {kind}, part long, text string, loss array<long>")


def parse(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, first character, end) of each turn of a formatted part; the range is that of the escaped text."""
    at = 0
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        line = text.index("\n", at)
        end = text.index(END, line)
        yield unescape(text[at + len(START) : line]), unescape(text[line + 1 : end]), line + 1, end
        at = end + len(END) + 1


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of conversations, read from the output of ``format_chats`` in the order in which it made it.

    The SHA-256 of a conversation is sequential, so its parts pass through one task, one part at a time.
    """
    kind = dict(formatted.select("conv_id").dtypes)["conv_id"]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        rows: list[list] = []
        hashes: list = []

        def done() -> None:
            if now is not None:
                rows.append([now[0], now[1], hashes[0].hexdigest(), now[2], hashes[1].hexdigest(), now[3]])

        def flush() -> pa.RecordBatch:
            types = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
            rows.clear()
            return out

        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for key, part, text, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part == 0:
                    done()
                    now, hashes = [key, 0, 0, 0], [hashlib.sha256(), hashlib.sha256()]
                for role, said, _, _ in parse(text):
                    hashes[0].update(f"{role}\n{said}\n".encode())
                    now[1] += 1
                raw = text.encode()
                for a, b in zip(loss[::2], loss[1::2], strict=True):
                    said = unescape(raw[a:b].decode())
                    hashes[1].update(said.encode())
                    now[2] += len(said)
                now[3] += len(text)
            if rows:
                yield flush()
        done()
        if rows:
            yield flush()

    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
