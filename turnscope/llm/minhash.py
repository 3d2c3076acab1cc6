"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its five-word shingles. A shingle's weight is its count in the document times an
inverse document frequency, 1 + IDF_SPAN * ln(1 / f) / ln(1 / RARE), where f is the share of all documents that have it, at
least RARE; so weights mean the same at every corpus size. Shares are counted over all documents, in two tables of
IDF_BUCKETS hashed features of which the lesser count holds. Weights are rounded to geometric levels, which
lets the sampler's logarithms be tabulated. Samples are banded; documents that share a band are verified by
the weighted Jaccard similarity of their whole texts, and links make components.

Copies cost nothing twice: documents with equal weighted sets are one class before banding. The members of a band's
bucket meet in three steps, each of which hands on links that were verified where they were found, at most as many as join
different components. First all members are compared with one pivot, the one whose shingles are the most common ones (of
edited copies, the one closest to the others, and mostly the same one in every bucket). Then each bucket that still
holds several components is dealt into chunks of about CHUNK members, in each of which all pairs of different components
are compared. In buckets of several chunks, last, members outside the largest component meet all chunks. So no bucket is
capped or lands in one task, and what is handed on grows with the members, not with their pairs. A bucket of which many
members stay alone still costs a comparison of samples for each pair that the bounds below leave, inside tasks.

What a text shares with no other text of such buckets bounds its similarity to each of them, so heavily edited copies
are settled by two numbers each instead of one by one. Pairs of which less than AGREEMENT of the samples agree are not
verified. Both that and the bands miss a pair at exactly the similarity once in some hundred times, and rarely ones above.

Defined results: a text without words (null, empty, only punctuation) is in a class of its own. A text of 1
to 4 words has one shingle. A class's id is its smallest doc_id. Rows that repeat a doc_id stand or fall
together. An empty table gives no rows. Extra columns are not read, and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnscope.llm.common import bound_batches, materialize, text_or_empty, utf8_buffers
from turnscope.llm.components import connected_components
from turnscope.llm.words import mix, shingles, word_blocks

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 6
IDF_BUCKETS = 1 << 18
IDF_SPAN = 0.25
RARE = 1 / 1024
LEVEL = 0.1
#: Members of a bucket that are compared with each other in one row, and the bytes of their weighted sets.
CHUNK, CHUNK_BYTES = 64, 2 << 20
#: A hot bucket's last step is dealt to so many tasks at least.
SALTS = 16
#: Pairs of members whose samples agree less often are not verified. At the least similarity that links, so few of the
#: samples agree once in some hundred times, as seldom as no band agrees.
AGREEMENT = 0.68
#: Room for rounding in bounds.
SLACK = 1e-9
_VARIATES = 512

_rng = np.random.Generator(np.random.PCG64(7))
_K = BANDS * ROWS
_R = _rng.gamma(2.0, 1.0, (_K, _VARIATES))
_C = _rng.gamma(2.0, 1.0, (_K, _VARIATES))
_BETA = _rng.random((_K, _VARIATES))
_ODD = _rng.integers(0, 1 << 63, _K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = np.uint64(64 - 9)
_WEIGHT = np.exp(np.arange(256) * LEVEL)


class Sampler:
    """Samples of weighted sets. For weight exp(level * LEVEL) and variates (r, c, beta) the sample is
    t = floor(ln S / r + beta), ln a = ln c - r (t - beta) - r; the element with the least a, with its t, is drawn.
    The variates of an element are picked by its hash from a table, so (a, t) is looked up by level and hash."""

    def __init__(self) -> None:
        self.levels = 0
        self.table = np.zeros((_K, 0), np.uint64)

    def _grow(self, levels: int) -> None:
        ln_s = (np.arange(self.levels, levels) * LEVEL)[None, :, None]
        r, c, beta = _R[:, None, :], _C[:, None, :], _BETA[:, None, :]
        t = np.floor(ln_s / r + beta)
        bits = (np.log(c) - r * (t - beta) - r).astype(np.float32).view(np.uint32)
        ordered = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
        low = mix(t.astype(np.int64).view(np.uint64)) & np.uint64(0xFFFFFFFF)
        more = (ordered << np.uint64(32) | low).reshape(_K, -1)
        self.table = np.concatenate((self.table, more), axis=1)
        self.levels = levels

    def bands(self, elements: np.ndarray, levels: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(band hashes, one byte of every sample) of each set (no set is empty), one row per set."""
        if levels.max() >= self.levels:
            self._grow(int(levels.max()) + 1)
        low = mix(elements) & np.uint64(0xFFFFFFFF)
        at = levels.astype(np.int64) * _VARIATES
        out = np.zeros((len(starts), BANDS), np.uint64)
        sketch = np.zeros((len(starts), _K), np.uint8)
        for k in range(_K):
            key = self.table[k][at + (elements * _ODD[k] >> _SHIFT).astype(np.int64)] ^ low
            drawn = np.minimum.reduceat(key, starts)
            out[:, k // ROWS] += drawn * _BAND[k % ROWS]
            sketch[:, k] = mix(drawn) & np.uint64(0xFF)
        return mix(out + np.arange(BANDS, dtype=np.uint64)), sketch


def weighted_sets(texts: pa.Array, ln_idf: np.ndarray | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, shingles sorted within each row, their levels, row starts) by blocks of rows."""
    for lo, hi, h, _, rows in word_blocks(texts):
        s, starts = shingles(h, rows, SHINGLE)
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            s[a:b].sort()
        first = np.ones(len(s), bool)
        first[1:] = s[1:] != s[:-1]
        first[starts[:-1][starts[:-1] < len(s)]] = True
        place = np.flatnonzero(first)
        count = np.diff(place, append=len(s))
        unique = s[place]
        own = np.searchsorted(place, starts)
        ln = np.log(count)
        if ln_idf is not None:
            ln = ln + _looked_up(ln_idf, unique)
        yield lo, hi, unique, np.minimum(np.rint(ln / LEVEL), 255).astype(np.int32), own


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted shingles, levels)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    wa, wb = _WEIGHT[a[1]], _WEIGHT[b[1]]
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = b[0][at] == a[0]
    shared = np.minimum(wa[both], wb[at[both]]).sum()
    return float(shared / (wa.sum() + wb.sum() - shared))


def _features(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shingle's places in the two tables of hashed features."""
    bits = np.uint64(64 - IDF_BUCKETS.bit_length() + 1)
    return (shingles >> bits).astype(np.int64), IDF_BUCKETS + (shingles << np.uint64(24) >> bits).astype(np.int64)


def _looked_up(ln_idf: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """Of the two features of a shingle the rarer one tells its frequency."""
    one, other = _features(shingles)
    return np.maximum(ln_idf[one], ln_idf[other])


def _ln_idf(texts: DataFrame) -> np.ndarray:
    """ln of the inverse document frequency by hashed feature, from all documents."""
    part = IDF_BUCKETS // 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(2 * IDF_BUCKETS, np.int64), 0
        for batch in batches:
            n += len(batch)
            for _, _, unique, _, _ in weighted_sets(batch.column(0), None):
                for places in _features(unique):
                    counts += np.bincount(places, minlength=2 * IDF_BUCKETS)
        parts = [p.tobytes() for p in counts.astype(np.int32).reshape(-1, part)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts))), pa.array(parts, pa.binary()), pa.array([n] * len(parts))], ["part", "counts", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        rows: dict[int, int] = {}
        for batch in batches:
            for k, raw, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(raw, np.int32).astype(np.int64)
                rows[k] = rows.get(k, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([t.tobytes() for t in total.values()], pa.binary()), pa.array(list(rows.values()), pa.int64())], ["part", "counts", "n"])

    schema = "part long, counts binary, n long"
    counts, n = np.zeros(2 * IDF_BUCKETS), 0
    for r in texts.select("text").mapInArrow(count, schema).repartition("part").mapInArrow(add, schema).collect():  # 32 rows, 4 MB together
        counts[r["part"] * part : (r["part"] + 1) * part] = np.frombuffer(r["counts"], np.int64)
        n = r["n"]
    share = np.clip(counts / max(n, 1), RARE, 1)
    return np.log1p(IDF_SPAN * np.log(1 / share) / np.log(1 / RARE)).astype(np.float32)


def _signatures(texts: DataFrame, ln_idf) -> DataFrame:
    """(doc_id, key, weight, rarity, sketch, bands): key identifies the weighted set, null if it is empty; rarity is the
    mean inverse document frequency of its shingles; sketch has one byte of every sample."""
    kind = dict(texts.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for batch in batches:
            keys: list[bytes | None] = []
            weight, rarity = np.zeros(len(batch)), np.zeros(len(batch))
            bands: list[np.ndarray] = []
            sketches: list[bytes | None] = []
            for lo, hi, unique, levels, starts in weighted_sets(batch.column(1), ln_idf.value):
                full = np.flatnonzero(np.diff(starts))
                own = [None] * (hi - lo)
                drawn: list[bytes | None] = [None] * (hi - lo)
                if len(full):
                    for i, raw in zip(full, _keys(unique, levels, starts[full]), strict=True):
                        own[i] = raw
                    hashes, sketch = sampler.bands(unique, levels, starts[full])
                    bands.append(hashes)
                    for i, raw in zip(full, sketch, strict=True):
                        drawn[i] = raw.tobytes()
                    weight[lo + full] = np.add.reduceat(np.exp(levels * LEVEL), starts[full])
                    idf = _looked_up(ln_idf.value, unique)
                    rarity[lo + full] = np.add.reduceat(idf, starts[full]) / np.diff(starts)[full]
                keys += own
                sketches += drawn
            present = np.array([k is not None for k in keys], bool)
            offsets = np.concatenate(([0], np.cumsum(present * BANDS))).astype(np.int32)
            flat = np.concatenate(bands).ravel().view(np.int64) if bands else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(weight), pa.array(rarity), pa.array(sketches, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "key", "weight", "rarity", "sketch", "bands"])

    return texts.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, key binary, weight double, rarity double, sketch binary, bands array<long>")


def _keys(unique: np.ndarray, levels: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """128 bits for each weighted set."""
    element = mix(unique + mix(levels.astype(np.uint64) + np.uint64(1)))
    halves = np.stack([np.add.reduceat(element, starts), np.add.reduceat(mix(element ^ np.uint64(0x9E3779B97F4A7C15)), starts)], axis=1)
    return [row.tobytes() for row in halves]


def _verified(pairs: DataFrame, texts: DataFrame, ln_idf, threshold: float) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold. Only texts of candidates are moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, cached = None, None
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                right = [(u[s[i] : s[i + 1]], v[s[i] : s[i + 1]]) for a, b, u, v, s in weighted_sets(part.column(3), ln_idf.value) for i in range(b - a)]
                similar = []
                for i, key in enumerate(part.column(0).to_pylist()):
                    if key != last:
                        (_, _, u, v, _), *_ = weighted_sets(part.column(2).slice(i, 1), ln_idf.value)
                        last, cached = key, (u, v)
                    similar.append(similarity(cached, right[i]) >= threshold)
                kept = part.filter(pa.array(similar, pa.bool_()))
                yield pa.RecordBatch.from_arrays(kept.columns[:2], ["a", "b"])

    t = lambda k: texts.select(F.col("key").alias(k), F.col("text").alias(f"text_{k}"))
    joined = pairs.join(t("b"), "b").join(t("a"), "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a binary, b binary")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` by key with the root of their component: the key itself where it has no link."""
    return rows.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))


def _several(placed: DataFrame) -> DataFrame:
    """The rows (bucket, key, root, ..) of the buckets that hold several components."""
    several = placed.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("bucket")
    several = materialize(placed.sparkSession, several, "several")
    return placed.join(several.hint("merge"), "bucket", "left_semi")  # a merge join of a hot bucket can be split


def _unshared(candidates: DataFrame, open_: DataFrame, ln_idf) -> DataFrame:
    """(key, own): the weight of the shingles that no other text of the open buckets has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, unique, levels, starts in weighted_sets(batch.column(1), ln_idf.value):
                owner = np.repeat(np.arange(lo, hi), np.diff(starts))
                yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), batch.column(0).take(pa.array(owner)), pa.array(np.exp(levels * LEVEL))], ["shingle", "key", "w"])

    texts = candidates.join(open_.select("key").distinct(), "key", "left_semi").select("key", "text")
    counted = texts.mapInArrow(run, "shingle long, key binary, w double").groupBy("shingle").agg(F.count("*").alias("n"), F.min("key").alias("key"), F.max("w").alias("w"))
    own = F.sum(F.when(F.col("n") == 1, F.col("w")).otherwise(0.0)).alias("own")
    return open_.select("key").distinct().join(counted.groupBy("key").agg(own), "key", "left").select("key", F.coalesce("own", F.lit(0.0)).alias("own"))


_MEMBER = ("key", "root", "weight", "common", "sketch", "elements", "levels")
_LINK = "a binary, b binary"


class Members:
    """The members of one row, with their weighted sets."""

    def __init__(self, rows: pa.StructArray):
        field = {name: rows.field(name) for name in _MEMBER}
        self.keys, self.roots, elements, levels = (field[c].to_pylist() for c in ("key", "root", "elements", "levels"))
        self.weight, self.common = field["weight"].to_numpy(), field["common"].to_numpy()
        sketches, at = utf8_buffers(field["sketch"])
        self.sketch = sketches[at[0] : at[-1]].reshape(-1, _K)
        self.sets = [(np.frombuffer(e, np.uint64), np.frombuffer(v, np.uint8)) for e, v in zip(elements, levels, strict=True)]


class Forest:
    """Components as far as one task has seen links."""

    def __init__(self) -> None:
        self.up: dict[bytes, bytes] = {}

    def root(self, x: bytes) -> bytes:
        while (y := self.up.get(x, x)) != x:
            x = y
        return x

    def links(self, a: Members, b: Members, threshold: float) -> Iterator[tuple[bytes, bytes]]:
        """Verified links of members of ``a`` to members of ``b``, each of which joins two components. The likeliest pairs come first, so
        that few are verified in vain."""
        agree = np.stack([(b.sketch == own).mean(axis=1) for own in a.sketch])
        most = np.minimum(a.common[:, None], b.common[None, :])
        bound = most / (a.weight[:, None] + b.weight[None, :] - most)
        left, right = np.nonzero((agree >= AGREEMENT) & (bound >= threshold - SLACK))
        for k in np.argsort(-agree[left, right], kind="stable"):
            i, j = left[k], right[k]
            x, y = self.root(a.roots[i]), self.root(b.roots[j])
            if x != y and similarity(a.sets[i], b.sets[j]) >= threshold:
                self.up[x] = y
                yield a.keys[i], b.keys[j]


def _as_links(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], ["a", "b"])


def _within_chunks(members: DataFrame, threshold: float) -> DataFrame:
    """Links inside each row of ``members``, at most as many as it has members less one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                own = Members(batch.column(0)[i].values)
                yield _as_links(list(Forest().links(own, own, threshold)))

    return members.select("members").mapInArrow(run, _LINK)


def _between_chunks(some: DataFrame, all_: DataFrame, threshold: float) -> DataFrame:
    """Links between the members of a row of ``some`` and those of the rows of ``all_`` of the same bucket. Rows of one row of
    ``some`` mostly come one after the other, so their links are known to each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own, forest = None, None, Forest()
        for batch in batches:
            for i in range(len(batch)):
                at = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if at != last:
                    last, own, forest = at, Members(batch.column(2)[i].values), Forest()
                yield _as_links(list(forest.links(own, Members(batch.column(3)[i].values), threshold)))

    salts = F.least(F.col("some_chunks"), F.lit(SALTS))
    left = some.withColumn("salt", F.col("chunk") % salts)
    right = all_.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).select("bucket", "salt", F.col("members").alias("others"))
    met = left.join(right.hint("merge"), ["bucket", "salt"])
    return met.select("bucket", "chunk", "members", "others").mapInArrow(run, _LINK)


def _chunked(rows: DataFrame, chunks: Column) -> DataFrame:
    """(bucket, chunk, some_chunks, members): the rows of each bucket dealt into ``chunks`` chunks by their keys' hashes."""
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("key"), chunks))
    own = F.collect_list(F.struct(*_MEMBER)).alias("members")  # about CHUNK members and CHUNK_BYTES
    return dealt.groupBy("bucket", "chunk").agg(F.first("some_chunks").alias("some_chunks"), own)


def _weighted(candidates: DataFrame, wanted: DataFrame, ln_idf) -> DataFrame:
    """(key, elements, levels): the weighted sets of the wanted keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, u, v, s in weighted_sets(batch.column(1), ln_idf.value):
                elements = [u[s[i] : s[i + 1]].tobytes() for i in range(hi - lo)]
                levels = [v[s[i] : s[i + 1]].astype(np.uint8).tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(elements, pa.binary()), pa.array(levels, pa.binary())], ["key", "elements", "levels"])

    return candidates.join(wanted, "key", "left_semi").select("key", "text").mapInArrow(run, "key binary, elements binary, levels binary")


def _candidate_texts(texts: DataFrame, wanted: DataFrame, ln_idf) -> DataFrame:
    """(key, text) of the wanted classes (key, doc_id), one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = []
            keys = batch.column(0).to_pylist()
            for lo, hi, unique, levels, starts in weighted_sets(batch.column(1), ln_idf.value):
                full = np.flatnonzero(np.diff(starts))
                own = dict(zip(full.tolist(), _keys(unique, levels, starts[full]), strict=True)) if len(full) else {}
                same += [own.get(i) == keys[lo + i] for i in range(hi - lo)]
            yield batch.filter(pa.array(same, pa.bool_()))  # a repeated doc_id may have another text

    met = texts.join(wanted.hint("shuffle_hash"), texts["doc_id"].eqNullSafe(wanted["rep_id"])).select("key", "text")
    return met.mapInArrow(run, "key binary, text string").groupBy("key").agg(F.first("text").alias("text"))


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, copies (rows with the same weighted set), kept."""
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select("doc_id", F.lower(text_or_empty()).alias("text"))
    ln_idf = spark.sparkContext.broadcast(_ln_idf(texts))
    signed = materialize(spark, _signatures(texts, ln_idf), "signatures")
    classes = signed.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep_id"), F.count("*").alias("copies"), F.first("weight").alias("weight"), F.first("rarity").alias("rarity"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    classes = materialize(spark, classes, "classes")

    members = classes.select("key", "rarity", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min(F.struct("rarity", "key")).alias("pivot"), F.count("*").alias("n")).filter("n > 1")
    shared = materialize(spark, shared.select("bucket", F.col("pivot.key").alias("pivot"), "n"), "pivots")
    members = materialize(spark, members.join(shared.hint("merge"), "bucket").select("bucket", "key", "pivot", "n"), "buckets")  # a merge join can be split
    wanted = members.select("key").distinct().join(classes.select("key", "rep_id"), "key")
    candidates = materialize(spark, _candidate_texts(texts, wanted, ln_idf), "candidate-texts")

    pairs = members.filter("key <> pivot").select(F.least("pivot", "key").alias("a"), F.greatest("pivot", "key").alias("b")).distinct()
    roots = connected_components(_verified(pairs, candidates, ln_idf, threshold))

    # Buckets of two are settled. A text of which too large a share is its own cannot be similar to any other.
    open_ = materialize(spark, _several(_rooted(members.filter("n > 2").select("bucket", "key"), roots)), "unsettled")
    common = classes.select("key", "weight", "sketch").join(_unshared(candidates, open_, ln_idf), "key").withColumn("common", F.col("weight") - F.col("own"))
    open_ = open_.join(common.filter(F.col("common") >= (threshold - SLACK) * F.col("weight")).drop("own"), "key")
    open_ = materialize(spark, _several(open_), "open")
    sets = materialize(spark, _weighted(candidates, open_.select("key").distinct(), ln_idf), "weighted-sets")
    room = lambda n, size: F.greatest(F.ceil(n / CHUNK), F.ceil(size / CHUNK_BYTES))
    bytes_ = sets.select("key", (F.length("elements") + F.length("levels")).alias("bytes"))
    sized = open_.select("bucket", "key").join(bytes_, "key").groupBy("bucket").agg(room(F.count("*"), F.sum("bytes")).alias("chunks"))
    sized = materialize(spark, sized, "chunks")
    full = open_.join(sized.hint("merge"), "bucket").withColumn("some_chunks", F.lit(1).cast("long")).join(sets, "key")
    links = materialize(spark, _within_chunks(_chunked(full, F.col("chunks")), threshold), "links")
    roots = _merged(roots, links)

    left = _several(_rooted(open_.drop("root").join(sized.filter("chunks > 1").hint("merge"), "bucket"), roots)).join(bytes_, "key")
    left = materialize(spark, left, "unsettled")
    sizes = left.groupBy("bucket", "root").agg(F.count("*").alias("m"), F.sum("bytes").alias("bytes"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("m", "root", "bytes")).alias("top"), F.sum("m").alias("m"), F.sum("bytes").alias("all"))
    main = main.select("bucket", F.col("top.root").alias("main"), room(F.col("m") - F.col("top.m"), F.col("all") - F.col("top.bytes")).alias("some_chunks"))
    left = left.join(materialize(spark, main, "main-components").hint("merge"), "bucket").join(sets, "key")
    some = _chunked(left.filter("root <> main"), F.col("some_chunks"))
    found = _between_chunks(some, _chunked(left, F.col("chunks")), threshold)
    roots = _merged(roots, materialize(spark, found, "links"))

    return _labelled(signed, classes, roots)


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components of what is known and new links."""
    return roots if links.isEmpty() else connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))


def _labelled(signed: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    linked = classes.select("key", "rep_id").join(roots.select(F.col("node").alias("key"), "root").union(roots.select("root", "root").distinct()), "key")
    ids = linked.groupBy("root").agg(F.min("rep_id").alias("class_id"))
    named = materialize(classes.sparkSession, linked.join(ids, "root").select("key", "class_id"), "class-ids")
    known = classes.select("key", "rep_id", "copies").join(named, "key", "left").select("key", F.coalesce("class_id", "rep_id").alias("class_id"), "copies")
    words = signed.filter("key IS NOT NULL").select("doc_id", "key").join(known, "key").select("doc_id", "class_id", "copies")
    rest = signed.filter("key IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("copies"))
    return words.union(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def drop_near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the id of a class: one document of each group."""
    kept = near_duplicates(docs, threshold).filter("kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(kept.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(kept["__id"]), "left_semi")
