"""Token counts by heap-and-linked-list byte-pair merging, without emitting identifiers.

A text is cut into pretokens by the vocabulary's pattern. In each, symbols start as bytes; the adjacent
pair of lowest rank is popped from a heap and merged in a doubly linked list until no ranked pair is left.
The count is the number of initial symbols minus the number of merges. Counts of pretokens seen before come
from a cache of bounded size.

Defined results: a null text counts as empty and has no tokens. Special strings inside a text count one
token each. Very long pretokens cost n log n. Repeated rows are counted each; extra columns are not read.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscope.llm.common import bound_batches, text_or_empty

#: How byte-level vocabularies of this family cut a text before merging (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_ENTRIES = 400_000
CACHE_LENGTH = 64


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary file writes for each byte, as letter -> byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairMerger:
    """The merge rules of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        number = {letter: byte for letter, byte in letters.items()}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            joined = number.setdefault(left + right, len(number))
            self.pairs.setdefault((number[left], number[right]), (rank, joined))
        self.specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self._special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self._cut = regex.compile(PATTERN)
        self._cache: dict[str, int] = {}

    def merged(self, piece: bytes) -> int:
        """Initial symbols minus merges of one pretoken."""
        size = len(piece)
        if size < 2:
            return size
        pairs = self.pairs
        symbol = list(piece)
        before = list(range(-1, size - 1))
        after = list(range(1, size + 1))
        heap = []
        for i in range(size - 1):
            rule = pairs.get((symbol[i], symbol[i + 1]))
            if rule:
                heap.append((rule[0], i, symbol[i], symbol[i + 1], rule[1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right, joined = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != left or j >= size or symbol[j] != right:
                continue  # one of the two has been merged meanwhile
            merges += 1
            symbol[i], symbol[j] = joined, -1
            k = after[i] = after[j]
            if k < size:
                before[k] = i
                rule = pairs.get((joined, symbol[k]))
                if rule:
                    heapq.heappush(heap, (rule[0], i, joined, symbol[k], rule[1]))
            h = before[i]
            if h >= 0:
                rule = pairs.get((symbol[h], joined))
                if rule:
                    heapq.heappush(heap, (rule[0], h, symbol[h], joined, rule[1]))
        return size - merges

    def _new(self, word: str) -> int:
        count = self.merged(word.encode())
        if len(word) <= CACHE_LENGTH:
            if len(self._cache) >= CACHE_ENTRIES:
                self._cache.clear()
            self._cache[word] = count
        return count

    def count(self, text: str) -> int:
        total, parts = 0, [text]
        if self._special and self._special.search(text):
            parts = self._special.split(text)
            total = len(parts) - 1
        get, new = self._cache.get, self._new
        for part in parts:
            total += sum([get(w) or new(w) for w in self._cut.findall(part)])
        return total


@functools.lru_cache(4)
def merger(path: str) -> PairMerger:
    return PairMerger(path)


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row; ``vocabulary`` is a path that every executor can open."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = merger(vocabulary)
        for batch in batches:
            counts = [rules.count(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id"), F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), text_or_empty().alias("text"))
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
