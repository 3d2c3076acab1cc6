"""Minimax contiguous partition of documents into shards, law ``bytes``.

Rows with equal texts form an atomic group, and groups are ordered by digest. The smallest shard capacity
for which a greedy walk over the ordered group sizes needs no more than the wanted shards is found by binary
search, and the order is cut where that walk cuts.

The driver never holds the groups. It holds a bounded number of segments of the digest order with their
sizes and splits further, in Spark, only segments in which a cut can fall, until those are single groups;
the result is that of the walk over all groups. A group larger than an even share has a shard of its own and
the others share the rest, so one hot group does not starve the remaining shards. Such groups are taken out, largest
first, as long as the stretches between them fit the remaining shards at no larger capacity than before, so no shard is
ever larger than in the walk over all groups. Each stretch is cut at the least capacity for its own number of shards.

Defined results: a null text counts as empty; a row's size is its UTF-8 bytes plus 1. With fewer groups than
shards some shards are empty. An empty table gives no rows. Rows of a shard are numbered from 0 without
gaps; repeated rows are numbered each. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnscope.llm.common import materialize, text_or_empty

#: A key is the first 60 bits of a digest; segments are split by so many bits at a time.
KEY_BITS = 60
FIRST_BITS = 12
NEXT_BITS = 6
SLOT_BINS = 1024


@dataclass(frozen=True)
class Segment:
    """Groups with keys in [low, high]; ``atomic`` if it is one group."""

    low: int
    high: int
    size: int
    atomic: bool


def greedy(sizes: list[int], capacity: int) -> list[int]:
    """Where a greedy walk cuts: the index of the first segment of every shard but the first."""
    cuts, filled = [], 0
    for i, size in enumerate(sizes):
        if filled and filled + size > capacity:
            cuts.append(i)
            filled = 0
        filled += size
    return cuts


def smallest_capacity(runs: list[list[int]], shards: int) -> int:
    """The least capacity with which the greedy walks over all runs need at most ``shards`` shards."""
    need = lambda c: sum(len(greedy(r, c)) + 1 for r in runs if r)
    low = max([1, *(max(r) for r in runs if r)])
    high = max(low, sum(map(sum, runs)))
    while low < high:
        middle = (low + high) // 2
        if need(middle) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def _levels(segments: list[Segment], shards: int) -> list[tuple[list[list[Segment]], list[Segment], int]]:
    """[(the stretches between giants, the giants, the stretches' capacity)], with one giant more each time.

    Giants by themselves exceed an even share of the rest. The first level has none: it is the walk over all. Each
    later level fits the shards at no larger capacity than the one before, but the last may be one that does not
    (its capacity is larger) and is there as what decides; ``_best`` is the last that does.
    """
    size = lambda runs: [[s.size for s in r] for r in runs]
    giants: list[Segment] = []
    rest, left = sum(s.size for s in segments), shards
    levels = [([segments], giants, smallest_capacity(size([segments]), shards))]
    for s in sorted((s for s in segments if s.atomic), key=lambda s: -s.size):
        if left <= 1 or s.size * left <= rest:
            break
        giants = [*giants, s]
        rest, left = rest - s.size, left - 1
        runs = _between(segments, set(giants))
        if len(runs) > left:
            break
        levels.append((runs, giants, smallest_capacity(size(runs), left)))
        if levels[-1][2] > levels[-2][2]:
            break
    return levels


def _best(levels: list[tuple[list[list[Segment]], list[Segment], int]]) -> tuple[list[list[Segment]], list[Segment], int]:
    return levels[-2] if len(levels) > 1 and levels[-1][2] > levels[-2][2] else levels[-1]


def _between(segments: list[Segment], giants: set[Segment]) -> list[list[Segment]]:
    runs, now = [], []
    for s in segments:
        if s in giants:
            runs, now = [*runs, now], []
        else:
            now.append(s)
    return [r for r in [*runs, now] if r]


def _loose(runs: list[list[Segment]], capacity: int, most: int) -> set[Segment]:
    """Segments of several groups in which a cut may fall for some capacity between an even share and ``capacity``."""
    found: set[Segment] = set()
    total = sum(s.size for r in runs for s in r)
    least = max(1, -(-total // most), *(s.size for r in runs for s in r if s.atomic)) if total else 1
    for run in runs:
        early, late = [], []  # of each cut, the first and the last byte at which it can be
        at, spot = 0, 0
        bounds = []
        for s in run:
            bounds.append((at, at + s.size, s))
            at += s.size
        cut = 0
        while cut < at:  # whole segments only, least capacity: never later than any real cut
            limit, best = cut + least, cut
            while spot < len(bounds) and bounds[spot][1] <= limit:
                best = bounds[spot][1]
                spot += 1
            if best == cut:
                best = min(limit, at)
                early.append(cut)
                cut = best
                while spot < len(bounds) and bounds[spot][1] <= cut:
                    spot += 1
            else:
                cut = best
                early.append(cut)
        reach, spot = capacity, 0
        while reach < at:  # a cut is never inside a group, and never later than a walk that may cut anywhere else
            while bounds[spot][1] <= reach:
                spot += 1
            cut = bounds[spot][0] if bounds[spot][2].atomic else reach
            late.append(cut)
            reach = cut + capacity
        late += [at] * (len(early) - len(late))
        for lo, hi in zip(early, late, strict=False):
            found.update(s for a, b, s in bounds if not s.atomic and b > lo - 1 and a < hi + 1)
    return found


def plan_cuts(groups: DataFrame, shards: int) -> list[tuple[int, int, int]]:
    """[(low, high, shard)] over the keys. ``groups``: (key, size), one row for each atomic group."""
    step = KEY_BITS - FIRST_BITS
    summed = lambda df, bits: df.groupBy(F.shiftright("key", bits).alias("p")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
    pull = lambda df: [Segment(r["low"], r["high"], r["size"], r["n"] == 1) for r in sorted(df.collect(), key=lambda r: r["low"])]
    segments = pull(summed(groups, step))
    while segments:
        levels = _levels(segments, shards)
        open_: set[Segment] = set()
        for runs, giants, capacity in levels:
            open_ |= _loose(runs, capacity, max(shards - len(giants), 1))
        runs, _, capacity = _best(levels)
        for run, own, count in _own_capacities(runs, capacity):
            open_ |= _loose([run], own, count)
        # A segment of several groups may also hide a giant.
        open_ |= {s for s in segments if not s.atomic and s.size * shards > sum(x.size for x in segments)}
        if not open_ or step == 0:
            break
        step = max(0, step - NEXT_BITS)
        spans = [(s.low, s.high) for s in sorted(open_, key=lambda s: s.low)]
        inside = groups.sparkSession.createDataFrame(spans, "a long, b long")
        finer = pull(summed(_within(groups, inside), step))
        segments = sorted([s for s in segments if s not in open_] + finer, key=lambda s: s.low)
    cuts: list[tuple[int, int, int]] = []
    shard = 0
    runs, giants, capacity = _best(_levels(segments, shards)) if segments else ([], [], 1)
    parts = [(run, own) for run, own, _ in _own_capacities(runs, capacity)] + [([g], g.size) for g in giants]
    for part, own in sorted(parts, key=lambda p: p[0][0].low):
        starts = [0, *greedy([s.size for s in part], own), len(part)]
        for a, b in zip(starts, starts[1:], strict=False):
            cuts.append((part[a].low, part[b - 1].high, shard))
            shard += 1
    return cuts


def _own_capacities(runs: list[list[Segment]], capacity: int) -> list[tuple[list[Segment], int, int]]:
    """(run, the least capacity for as many shards as it needs at ``capacity``, that number): evens out each run."""
    out = []
    for run in runs:
        sizes = [s.size for s in run]
        count = len(greedy(sizes, capacity)) + 1
        out.append((run, smallest_capacity([sizes], count), count))
    return out


def _within(groups: DataFrame, spans: DataFrame) -> DataFrame:
    """The groups inside the spans, which are at most as many as the driver's segments, so few enough to send."""
    keyed = groups.withColumn("p", F.shiftright("key", KEY_BITS - FIRST_BITS))
    spans = spans.withColumn("p", F.shiftright("a", KEY_BITS - FIRST_BITS))  # no segment crosses a first prefix
    return keyed.join(F.broadcast(spans), "p").filter("key BETWEEN a AND b").select("key", "size")


def shard_by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    text = text_or_empty()
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.conv(F.substring(F.sha2(text, 256), 1, KEY_BITS // 4), 16, 10).cast("long").alias("key"),
    )
    rows = materialize(spark, rows, "shard-rows")
    groups = materialize(spark, rows.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    cuts = plan_cuts(groups, shards)
    # At most as many comparisons as shards, and code for them stays in the JVM.
    shard = F.lit(None).cast("int")
    for low, _, number in cuts:
        shard = F.when(F.col("key") >= low, F.lit(number)).otherwise(shard)
    placed = rows.withColumn("shard", shard).withColumn("bin", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SLOT_BINS)).cast("int"))
    placed = materialize(spark, placed, "shard-placed")
    return _slots(placed)


def _slots(placed: DataFrame) -> DataFrame:
    """Number each shard's rows: first where each of its bins starts, then the rows within each bin."""
    counts = placed.groupBy("shard", "bin").agg(F.count("*").alias("n"))  # shards x SLOT_BINS rows at most
    starts = counts.select("shard", "bin", (F.sum("n").over(Window.partitionBy("shard").orderBy("bin")) - F.col("n")).alias("first"))
    within = F.row_number().over(Window.partitionBy("shard", "bin").orderBy("doc_id", "key")) - 1
    numbered = placed.withColumn("within", within).join(F.broadcast(starts), ["shard", "bin"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("within")).cast("long").alias("slot"))
