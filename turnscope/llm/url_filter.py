"""URL filters over a sorted digest array.

A blocklist of hosts and ``host/path`` prefixes, which may be a table of any size, is hashed and sorted in Spark and
stored as an array of sorted 64-bit xxhash keys and, in the same order, the strings themselves. The driver passes the sorted
rows on to three files block by block. Executors get the files through Spark and memory-map them, so a list takes disk
and not memory there; the keys of a URL (its host and every parent domain, with no path and with every path prefix that ends in a slash) are
looked up together by vectorised binary search, and a hit counts only when the stored string is equal.
Explicit rules, longest first, override the list.

Defined results: host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
path is what follows up to ``?``, ``#`` or the end. URLs of any length are judged whole. A null URL, or one without ``://``, has neither: no rule
and no key fits, so it is allowed. Null and repeated entries of the list count for nothing. Repeated pages are judged each; an empty table gives no rows.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscope.llm.common import ascii_lower, plain_names, scratch_path

#: Hosts blocked by the production list: the spam, gambling, adware and adult families of the crawl.
BLOCKED_HOSTS = tuple(f"{name}.example.{tld}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for tld in ("com", "net", "org"))


#: Rows of the sorted list that the driver holds at once.
BLOCK_ROWS = 1 << 16
SEED = 42


def digest(entry: bytes) -> int:
    """What Spark's ``xxhash64`` makes of a string, as a signed number."""
    return (xxhash.xxh64_intdigest(entry, SEED) ^ 1 << 63) - (1 << 63)


class DigestArray:
    """Sorted keys and their strings, memory-mapped from files beside each other: keys, ends of the strings, strings."""

    def __init__(self, keys: str, ends: str, strings: str):
        mapped = lambda path, kind: np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
        self.keys, self.ends, self.data = mapped(keys, np.int64), mapped(ends, np.int64), mapped(strings, np.uint8)
        self.longest = int(np.diff(self.ends, prepend=0).max()) if len(self.ends) else 0

    def entry(self, i: int) -> bytes:
        return self.data[self.ends[i - 1] if i else 0 : self.ends[i]].tobytes()

    def contains(self, probes: Sequence[bytes], digest=digest) -> np.ndarray:
        """Which probes are entries: entries whose keys collide stand next to each other and are compared in full."""
        keys = np.fromiter((digest(p) for p in probes), np.int64, len(probes))
        at = np.searchsorted(self.keys, keys, side="left")
        end = np.searchsorted(self.keys, keys, side="right")
        found = np.zeros(len(probes), bool)
        for i in np.flatnonzero(end > at):
            found[i] = any(self.entry(j) == probes[i] for j in range(at[i], end[i]))
        return found


def encoded(rows: Iterator[tuple[int, str]]) -> Iterator[tuple[bytes, bytes, bytes]]:
    """Blocks of the three files' contents, of rows (key, entry) in the order of their keys."""
    end = 0
    while block := list(islice(rows, BLOCK_ROWS)):
        words = [entry.encode() for _, entry in block]
        ends = end + np.cumsum([len(w) for w in words], dtype=np.int64)
        end = int(ends[-1])
        yield np.array([key for key, _ in block], np.int64).tobytes(), ends.tobytes(), b"".join(words)


def publish(spark: SparkSession, entries: DataFrame | Sequence[str]) -> list[str]:
    """Write the list's files to the shared folder and have Spark hand each executor a copy; their names. ``entries``: texts, or a
    table of which the first column has them."""
    if not isinstance(entries, DataFrame):
        entries = spark.createDataFrame([(e,) for e in entries], "entry string")
    listed = plain_names(entries).select(F.col("c0").alias("entry")).filter("entry IS NOT NULL").distinct()
    rows = listed.select(F.xxhash64("entry").alias("key"), "entry").orderBy("key", "entry")
    sc = spark.sparkContext
    folder, names, streams = scratch_path(spark, "urls"), [], []
    for kind in ("keys", "ends", "strings"):
        names.append(f"urls-{uuid.uuid4().hex}.{kind}")
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{folder}/{names[-1]}")
        streams.append(path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path))
    for block in encoded((r["key"], r["entry"]) for r in rows.toLocalIterator()):
        for stream, content in zip(streams, block, strict=True):
            stream.write(bytearray(content))
    for stream, name in zip(streams, names, strict=True):
        stream.close()
        sc.addFile(f"{folder}/{name}")
    return names


def probes(host: str, path: str, longest: int) -> list[bytes]:
    """Every string of at most ``longest`` characters that, listed, would block this URL. A longer one cannot equal
    an entry of the list, so a very long URL costs no more than the list's longest entry."""
    if not host:
        return []
    starts = [0, *(i + 1 for i, c in enumerate(host) if c == ".")]
    hosts = [host[i:] for i in starts if len(host) - i <= longest]
    paths = [""] + [path[: i + 1] for i, c in enumerate(path[:longest]) if c == "/"]
    return [(h + p).encode() for h in hosts for p in paths if len(h) + len(p) <= longest]


def split_url(url: Column) -> tuple[Column, Column]:
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.when(has, ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))).otherwise("")
    path = F.when(has, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")
    return host, path


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest fitting rule, as ``host/path``; null if none fits."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        own, _, prefix = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + prefix)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def judge(pages: DataFrame, rules: dict[str, str], entries: DataFrame | Sequence[str] = BLOCKED_HOSTS) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, listed (whether the list blocks it)."""
    names = publish(pages.sparkSession, entries)
    kind = dict(pages.select("page_id").dtypes)["page_id"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = DigestArray(*map(SparkFiles.get, names))
        for batch in batches:
            wanted, owner = [], []
            for row, (host, path) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                own = probes(host, path, listed.longest)
                wanted += own
                owner += [row] * len(own)
            hit = np.zeros(len(batch), bool)
            hit[np.array(owner, np.int64)[listed.contains(wanted)]] = True
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], [*batch.schema.names, "listed"])

    host, path = split_url(F.col("url"))
    probed = pages.select("page_id", host.alias("host"), path.alias("path")).mapInArrow(probe, f"page_id {kind}, host string, path string, listed boolean")
    verdicts = F.create_map(*(F.lit(x) for pair in rules.items() for x in pair)) if rules else F.create_map().cast("map<string,string>")
    ruled = probed.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return ruled.select("page_id", "host", "path", "rule", F.coalesce(verdicts[F.col("rule")], method).alias("verdict"), "listed")
