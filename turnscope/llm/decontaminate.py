"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Word rates are counted over all documents, in one pass, for the words of the benchmark. From every place of a test item the
shortest n-gram that the rates say is rare becomes a seed. The rate of an n-gram is the product of its words' rates, not
its own count: an item that leaked into a third of the corpus keeps its seeds, and a phrase whose words go together more often
than chance costs alignments, not results. Seeds are a table of (hash, item, place). A second pass over the documents looks
their n-grams up in a two-way bitmap of the seeds, whose size follows their number up to BITMAP_BITS; only documents with a
candidate are handed on, and their candidates are joined to the seeds by hash. Around each hit the item is aligned
with the document's words; the alignment's score decides, as a share of a perfect one or, for parts of long
items, by a run of words that item and document have alike.

Both passes are the same whatever the benchmark's size. The seeds are sent to every task while they are at most SENT_SEEDS,
else joined by merge, where Spark splits a hash that a large part of the documents has. Alignments are as many as there are
groups of hits.

Defined results: items and documents that are null, empty or without words match nothing. An item of fewer
words than a seed needs is one seed itself. Repeated items count once; repeated documents are reported each. A
document that holds an item several times has one row for it, with its best alignment. A document that quotes less
than the threshold has the share of its best alignment as its score and the longest run of words as its place. Empty tables give
no leaks. Extra columns are not read, and kept by ``drop_leaks``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscope.llm.common import bound_batches, free_name, materialize, text_or_empty
from turnscope.llm.words import ngrams, word_blocks

THRESHOLD = 0.5
#: So many words in a row that a document quotes of an item are a leak, however long the item is.
RUN = 13
#: Chance hits of all seeds together that a word of a document may have.
CHANCE = 5e-5
LENGTHS = (2, 3, 4, 6, 8, 12)
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bits of a bitmap at least and at most (16 MB).
BITMAP_BITS = (16, 27)
#: Seeds, and characters of items, that are sent to every task.
SENT_SEEDS, SENT_CHARS = 1 << 19, 16 << 20
#: Words that a task counts before it hands the counts on.
COUNTED_WORDS = 1 << 20


class Bitmap:
    """Which places of two tables the hashes of a column fall on: by their first bits, and by the bits after these."""

    def __init__(self, hashes: DataFrame, column: str, number: int):
        least, most = BITMAP_BITS
        self.bits = min(max((64 * number).bit_length(), least), most)
        self.tables = [self._table(hashes, F.col(column)), self._table(hashes, F.shiftleft(column, 64 - 2 * self.bits if self.bits < 32 else 0))]

    def _table(self, hashes: DataFrame, value) -> np.ndarray:
        """At most 2 to the power of ``bits`` bits come to the driver."""
        place = F.shiftrightunsigned(value, 64 - self.bits) + 1  # Spark's bitmaps count from 1
        parts = hashes.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
        table = np.zeros(1 << self.bits, bool)
        for r in parts:
            own = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
            lo = (r["part"] - 1) * len(own)
            table[lo : lo + len(own)] = own[: len(table) - lo]
        return table

    def maybe(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be in the column."""
        shift = np.uint64(64 - self.bits)
        at = np.flatnonzero(self.tables[0][(h >> shift).astype(np.int64)])
        return at[self.tables[1][(h[at] << np.uint64(64 - 2 * self.bits if self.bits < 32 else 0) >> shift).astype(np.int64)]]


def seeds_of(words: np.ndarray, rates: np.ndarray, limit: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, hashes, places) of an item's seeds: at each place the shortest n-gram whose words' rates make it rare."""
    logs = np.concatenate(([0.0], np.cumsum(np.log(rates))))
    open_ = np.ones(len(words), bool)
    for n in LENGTHS:
        count = len(words) - n + 1
        if count > 0:
            rare = np.flatnonzero(open_[:count] & (logs[n:] - logs[:count] <= limit))
            open_[rare] = False
            if len(rare):
                yield n, ngrams(words, n)[rare], rare
    if open_.all() and len(words):
        n = min(len(words), LENGTHS[-1])
        yield n, ngrams(words, n), np.arange(len(words) - n + 1)


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """(best local alignment score, end of it in ``words``), Smith-Waterman with one numpy pass per item word."""
    along = np.arange(len(words)) * -GAP
    before = np.zeros(len(words) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        now = np.maximum(before[:-1] + np.where(words == w, MATCH, MISMATCH), before[1:] + GAP)
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + along) - along  # gaps in the item
        top = int(now.argmax())
        if now[top] > best:
            best, end = int(now[top]), top + 1
        before[1:] = now
    return best, end


def longest_run(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """(the most words in a row that both have, end of them in ``words``)."""
    before = np.zeros(len(words) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        now = np.where(words == w, before[:-1] + 1, 0)
        top = int(now.argmax()) if len(now) else 0
        if len(now) and now[top] > best:
            best, end = int(now[top]), top + 1
        before[1:] = now
    return best, end


def best_leak(item: np.ndarray, own: np.ndarray, shifts: np.ndarray, threshold: float) -> tuple[float, int, int] | None:
    """(score, first word, end) of the best place of an item in a document's words, given how far its seeds are shifted there."""
    margin = len(item) // 2 + 4
    best, run = (0, 0, 0), (0, 0)
    shifts = np.sort(shifts)
    i = 0
    while i < len(shifts):  # hits whose windows overlap share one
        first, last = shifts[i], shifts[i]
        while i < len(shifts) and shifts[i] <= last + len(item):
            last = shifts[i]
            i += 1
        start = max(0, int(first) - margin)
        window = own[start : int(last) + len(item) + margin]
        score, end = align(item, window)
        if score > best[0]:
            best = (score, start, end)
        if RUN * MATCH <= score < threshold * MATCH * len(item):  # a run scores as much
            length, end = longest_run(item, window)
            if length > run[0]:
                run = (length, start + end)
    share = best[0] / (MATCH * len(item))
    if share >= threshold:
        _, start, end = best
        _, back = align(item[::-1], own[start : start + end][::-1])
        return share, start + end - back, start + end
    return (share, run[1] - run[0], run[1]) if run[0] >= RUN else None


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words) of the distinct items that have words; ``words`` are 64-bit hashes."""
    spark = benchmark.sparkSession
    kind = dict(benchmark.select("item_id").dtypes)["item_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, h, _, rows in word_blocks(batch.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], ["item_id", "words"])

    read = benchmark.select("item_id", F.lower(text_or_empty()).alias("text")).distinct().mapInArrow(run, f"item_id {kind}, words array<long>")
    return materialize(spark, read.filter("size(words) > 0").withColumn("item", F.monotonically_increasing_id()), "benchmark-items")


def _word_counts(texts: DataFrame, known: Bitmap) -> DataFrame:
    """(word, n) of the known words over all documents, and a null word with the number of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, held, size, total = sent.value, [], 0, 0

        def handed() -> pa.RecordBatch:
            word, at = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([c for _, c in held])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

        for batch in batches:
            for _, _, h, _, _ in word_blocks(batch.column(0)):
                total += len(h)
                held.append(np.unique(h[bitmap.maybe(h)], return_counts=True))
                size += len(held[-1][0])
                if size > COUNTED_WORDS:
                    yield handed()
                    held, size = [], 0
        if held:
            yield handed()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([total])], ["word", "n"])

    sent = texts.sparkSession.sparkContext.broadcast(known)
    return texts.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _seeds(items: DataFrame, texts: DataFrame) -> DataFrame:
    """(hash, n, item, place) of all seeds."""
    spark = items.sparkSession
    spoken = items.select("item", F.posexplode("words").alias("place", "word"))
    places = spoken.count()
    counts = materialize(spark, _word_counts(texts, Bitmap(spoken, "word", places)), "word-counts")
    total = counts.filter("word IS NULL").agg(F.sum("n")).first()[0] or 0
    limit = math.log(CHANCE / max(places, 1))
    rated = spoken.join(counts.filter("word IS NOT NULL"), "word", "left").withColumn("rate", (F.coalesce("n", F.lit(0)) + 1) / F.lit(float(total + 1)))
    whole = rated.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("place", "word", "rate"))).alias("words"))  # one item's words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = words.values.field("word").to_numpy().view(np.uint64)
                for n, seeds, place in seeds_of(h, words.values.field("rate").to_numpy(), limit):
                    yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), pa.array(np.full(len(seeds), n)), pa.array(np.full(len(seeds), item)), pa.array(place)], ["hash", "n", "item", "place"])

    return materialize(spark, whole.mapInArrow(run, "hash long, n long, item long, place long"), "seeds")


def _candidates(texts: DataFrame, bitmap: Bitmap, lengths: list[int]) -> DataFrame:
    """(row, doc_id, text_key, words, hits): the documents that may hold a seed, with their words and the (hash, place) that may be one."""
    spark = texts.sparkSession
    kind = dict(texts.dtypes)["doc_id"]
    sent = spark.sparkContext.broadcast(bitmap)
    hit = pa.struct([("hash", pa.int64()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = sent.value
        for batch in batches:
            for lo, _, h, _, rows in word_blocks(batch.column(2)):
                found = [np.zeros((3, 0), np.int64)]
                for n in lengths:
                    g = ngrams(h, n)
                    at = seeds.maybe(g)
                    row = np.searchsorted(rows, at, side="right") - 1
                    inside = at + n <= rows[row + 1]
                    found.append(np.stack([row[inside], at[inside] - rows[row[inside]], g[at[inside]].view(np.int64)]))
                row, place, seed = np.concatenate(found, axis=1)
                order = np.argsort(row, kind="stable")
                own, starts = np.unique(row[order], return_index=True)
                hits = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(seed[order]), pa.array(place[order])], fields=list(hit)))
                words = pa.array([h[rows[i] : rows[i + 1]].tobytes() for i in own], pa.binary())
                picked = pa.array(lo + own)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(picked), batch.column(1).take(picked), words, hits], ["doc_id", "text_key", "words", "hits"])

    found = texts.select("doc_id", "text_key", "text").mapInArrow(run, f"doc_id {kind}, text_key long, words binary, hits array<struct<hash:long,place:long>>")
    return materialize(spark, found.withColumn("row", F.monotonically_increasing_id()), "leak-candidates")


def _leaks(docs: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    """One row for each document and item that it leaks, with the document's ``text_key``."""
    spark = docs.sparkSession
    bound_batches(spark)
    kinds = dict(docs.select("doc_id").dtypes)["doc_id"], dict(benchmark.select("item_id").dtypes)["item_id"]
    schema = f"doc_id {kinds[0]}, text_key long, item_id {kinds[1]}, n_seeds long, score double, first_word long, end_word long"
    texts = docs.select("doc_id", _text_key().alias("text_key"), F.lower(text_or_empty()).alias("text"))
    items = _items(benchmark)
    seeds = _seeds(items, texts)
    number = seeds.count()
    lengths = sorted(r["n"] for r in seeds.select("n").distinct().collect())  # of LENGTHS, or a short item's own
    candidates = _candidates(texts, Bitmap(seeds, "hash", number), lengths)

    small = number <= SENT_SEEDS
    near = lambda df, few: F.broadcast(df) if few else df.hint("merge")  # noqa: E731  a merge join can be split
    hits = candidates.select("row", F.explode("hits").alias("hit")).select("row", F.col("hit.hash").alias("hash"), F.col("hit.place").alias("at"))
    met = hits.join(near(seeds.select("hash", "item", "place"), small), "hash")
    groups = met.groupBy("row", "item").agg(F.collect_list(F.col("at") - F.col("place")).alias("shifts"))  # bounded by one document's length
    few = small and (items.agg(F.sum(F.size("words"))).first()[0] or 0) * 8 <= SENT_CHARS
    pairs = groups.join(candidates.select("row", "doc_id", "text_key", "words"), "row")
    pairs = pairs.join(near(items.select("item", "item_id", F.col("words").alias("wanted")), few), "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, found, n = [], [], []
            for i in range(len(batch)):
                shifts, wanted = (batch.column(c)[i].values.to_numpy() for c in (4, 5))
                leak = best_leak(wanted.view(np.uint64), np.frombuffer(batch.column(3)[i].as_py(), np.uint64), shifts, threshold)
                if leak:
                    place.append(i)
                    found.append(leak)
                    n.append(len(shifts))
            score, first, end = zip(*found, strict=True) if found else [()] * 3
            picked = pa.array(place, pa.int64())
            ids = [batch.column(c).take(picked) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(n, pa.int64()), pa.array(score, pa.float64()), pa.array(first, pa.int64()), pa.array(end, pa.int64())], ["doc_id", "text_key", "item_id", "n_seeds", "score", "first_word", "end_word"])

    return pairs.select("doc_id", "text_key", "item_id", "words", "shifts", "wanted").mapInArrow(run, schema)


def _text_key(name: str = "text"):
    return F.xxhash64(F.coalesce(F.col(name), F.lit("")))


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document and item that it leaks: doc_id, item_id, n_seeds, score, first_word, end_word."""
    return _leaks(docs, benchmark, threshold).drop("text_key")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that leak no item. Leaking rows are told by doc_id and text, so rows that share only one of them stay."""
    key = free_name(docs, "text_key")
    gone = _leaks(docs, benchmark, threshold).select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key")).distinct()
    gone = materialize(docs.sparkSession, gone, "leaks")
    marked = docs.withColumn(key, _text_key())
    return marked.join(gone, marked["doc_id"].eqNullSafe(gone["__doc"]) & (marked[key] == gone["__key"]), "left_anti").drop(key)
