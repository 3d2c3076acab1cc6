"""Packing by power-of-two decomposition.

A document's ids (with the end id) are split into pieces whose lengths are the powers of two of its binary
length, the largest as often as needed. Each piece is a sequence of its own and pieces of equal length share
a bucket, which is the power, so no sequence crosses documents and none has padding. ``write_buckets`` stores each bucket in a
folder of its own, so that any rows of a file stack to a full tensor.

Ids are those of the ``tokenizers`` library for the vocabulary. They come from the ranks file beside it by a library that is
three to four times as fast; the tests hold both against each other over a whole table.

Defined results: a null or empty text has the end id alone, one piece of length 1. Repeated rows are packed
each. An empty table gives no rows. Ids of a very long text are held once, in the task that has the text.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscope.llm.common import bound_batches, text_or_empty
from turnscope.llm.token_count import PATTERN

END_ID = 0
#: A pretoken's merge time in the library grows with the square of its length; longer texts without a
#: break go to the other library, whose merges take n log n.
LONGEST_RUN = 2000


class Encoder:
    """Ids of a byte-level vocabulary (``.json``), through the ranks of the same vocabulary beside it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        with open(os.path.splitext(path)[0] + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        special = {t["content"]: t["id"] for t in added}
        self.path, self.special = path, set(special)
        self._long_run = re.compile(rf"\S{{{LONGEST_RUN}}}|\s{{{LONGEST_RUN}}}")
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @functools.cached_property
    def slow(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> list[int]:
        if len(text) > LONGEST_RUN and self._long_run.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode(text, allowed_special=self.special, disallowed_special=())


@functools.lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def binary_pieces(length: int, longest: int) -> list[int]:
    """Piece lengths, longest first: as many of ``longest`` (a power of two) as fit, then the bits of the rest."""
    pieces = [longest] * (length // longest)
    rest = length % longest
    return pieces + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pieces(docs: DataFrame, vocabulary: str, longest: int, digests: bool) -> DataFrame:
    bound_batches(docs.sparkSession)
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    names = ["doc_id", "start", "length", "doc_tokens", "ids_crc32" if digests else "ids"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).ids
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                rows, starts, totals, lengths, flat = [], [], [], [], []
                for row, text in enumerate(part.column(1)):
                    ids = np.append(np.array(encode(text.as_py()), np.int32), np.int32(END_ID))
                    sizes = binary_pieces(len(ids), longest)
                    rows += [row] * len(sizes)
                    starts.append(np.cumsum([0, *sizes[:-1]]))
                    totals += [len(ids)] * len(sizes)
                    lengths += sizes
                    flat.append(ids)
                if not rows:
                    continue
                ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                ids = np.concatenate(flat).astype("<i4")
                if digests:
                    last = pa.array([zlib.crc32(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(np.concatenate(starts), pa.int64()), pa.array(lengths, pa.int64()), pa.array(totals, pa.int64()), last], names)

    last = "ids_crc32 long" if digests else "ids array<int>"
    pieces = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(split, f"doc_id {kind}, start long, length long, doc_tokens long, {last}")
    # Numbered by partition and row: unique, and the same again when a lost task is run again.
    bucket = F.log2("length").cast("int")
    return pieces.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), bucket.alias("bucket"))


def pack(docs: DataFrame, vocabulary: str, longest: int = 1024) -> DataFrame:
    """One row per sequence: doc_id, start, length, doc_tokens, ids, sequence_id, offset (always 0), bucket (length is 2 to its power)."""
    return _pieces(docs, vocabulary, longest, digests=False)


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write the result of ``pack`` with a folder for each bucket; sequences keep their ids, and no row is moved between tasks."""
    packed.write.partitionBy("bucket").parquet(path)


def piece_digests(docs: DataFrame, vocabulary: str, longest: int = 1024) -> DataFrame:
    """``pack`` with each piece's ids reduced to their CRC-32 where they are made, so they need not be moved."""
    return _pieces(docs, vocabulary, longest, digests=True)
