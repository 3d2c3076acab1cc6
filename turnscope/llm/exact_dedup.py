"""Exact deduplication as a stateful stream, in DataFrame and SQL functions only.

Arriving rows are appended to a scratch table with an arrival number, which locates the row and its content there, and the
digest of their normalised text (A-Z lower-cased). A Structured Streaming aggregation keyed by the digest reads no more than
identifier, arrival and digest, and holds, in a disk-backed (RocksDB) state store without a watermark - so
nothing expires - the identifier of the row that stays, its locator, and the row count. Each batch of
the stream then checks what hit the state: the full texts of all rows with a digest that was hit are fetched by their locators
and compared. Rows whose digests agree but whose texts do not are grouped by text instead.

Defined results: a null text counts as empty, and empty texts are equal to each other. Of equal texts the
row with the largest doc_id stays; of rows with that same doc_id, the last arrival. A null doc_id is smaller
than any other. An empty table gives no rows. Extra columns are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscope.llm.common import ascii_lower, materialize, scratch_path, text_or_empty

#: Bits of an arrival number below the number of its ingest: rows are numbered within a table's partitions, 2**20 of them at most.
RUN_BITS = 53
_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    # Else every state partition reserves 4 MB of disk for a manifest of some hundred bytes.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class DedupState:
    """The keyed state of one stream. ``ingest`` may be called again and again, also by a later state over the same ``folder``."""

    def __init__(self, spark: SparkSession, folder: str | None = None, digest: Callable[[Column], Column] = sha256_digest):
        self.spark, self.digest = spark, digest
        self.folder = folder or scratch_path(spark, "dedup")
        self.runs = 0 if folder is None else (self.arrived().agg(F.max("arrival")).first()[0] >> RUN_BITS) + 1

    def ingest(self, docs: DataFrame, whole: bool = False) -> None:
        """Take in the rows of ``docs``: doc_id and text, and, if they are to be handed out ``whole``, the other columns as ``row``."""
        arrival = F.monotonically_increasing_id() + F.lit(self.runs << RUN_BITS)
        rows = docs.select("doc_id", "text", arrival.alias("arrival"), self.digest(_normalised()).alias("digest"), *_whole(docs, whole))
        rows.write.mode("append").parquet(f"{self.folder}/arrivals")
        self.runs += 1
        before = {k: self.spark.conf.get(k, None) for k in _ROCKS}
        try:
            for k, v in _ROCKS.items():
                self.spark.conf.set(k, v)
            stream = (
                self.spark.readStream.schema(rows.select("doc_id", "arrival", "digest").schema)
                .parquet(f"{self.folder}/arrivals")
                .groupBy("digest")
                .agg(F.max(F.struct("doc_id", "arrival")).alias("keep"), F.count("*").alias("group_size"))
                .writeStream.outputMode("update")
                .option("checkpointLocation", f"{self.folder}/checkpoint")
                .trigger(availableNow=True)
                .foreachBatch(self._checked)
                .start()
            )
            stream.awaitTermination()
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def _checked(self, batch: DataFrame, number: int) -> None:
        """Store what changed in the state, and which of the digests that were hit have several texts."""
        updates = f"{self.folder}/updates/batch={number}"
        batch.write.mode("overwrite").parquet(updates)
        hit = self.spark.read.schema(batch.schema).parquet(updates).filter("group_size > 1").select("digest")
        self._several_texts(hit).write.mode("overwrite").parquet(f"{self.folder}/collided/batch={number}")

    def _several_texts(self, digests: DataFrame) -> DataFrame:
        """Of the digests those with several texts. Texts meet the locators of the hits first, which is even, and a task then hands
        on at most the two extreme texts of a digest, so a large group never gathers in one place."""
        arrived = self.arrived()
        rows = arrived.select("arrival", "digest").join(digests.hint("merge"), "digest", "left_semi").select("arrival")
        texts = arrived.select("arrival", "digest", _normalised().alias("full"))
        met = texts.join(rows.hint("shuffle_hash"), "arrival", "left_semi")
        return met.groupBy("digest").agg(F.min("full").alias("a"), F.max("full").alias("b")).filter("a <> b").select("digest")

    def arrived(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/arrivals")

    def collided(self) -> DataFrame:
        """The digests with several texts."""
        return self.spark.read.schema("digest binary").parquet(f"{self.folder}/collided/*").distinct()

    def kept(self) -> DataFrame:
        """One row per digest that has one text: (digest, keep, group_size). Updates only grow, so the largest is the last."""
        updates = self.spark.read.parquet(f"{self.folder}/updates")
        last = updates.groupBy("digest").agg(F.max("keep").alias("keep"), F.max("group_size").alias("group_size"))
        return last.join(self.collided(), "digest", "left_anti")

    def decided(self) -> DataFrame:
        """One row per arrival: doc_id, arrival, digest, keep_id, keep_arrival, group_size, kept."""
        columns = ["doc_id", "arrival", "digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.arrival").alias("keep_arrival"), "group_size"]
        rows = self.arrived().select("doc_id", "arrival", "digest")
        kept = materialize(self.spark, self.kept(), "dedup-kept")  # a table, so that a hot digest's join can be split
        out = rows.join(kept, "digest").select(columns)
        collided = materialize(self.spark, self.collided(), "dedup-collided")
        if not collided.isEmpty():
            texts = self.arrived().select("doc_id", "arrival", "digest", _normalised().alias("full")).join(collided, "digest", "left_semi")
            best = texts.groupBy("digest", "full").agg(F.max(F.struct("doc_id", "arrival")).alias("keep"), F.count("*").alias("group_size"))
            out = out.unionByName(texts.join(best, ["digest", "full"]).select(columns))
        return materialize(self.spark, out.withColumn("kept", F.col("arrival") == F.col("keep_arrival")), "dedup-decided")


def _normalised() -> Column:
    return ascii_lower(text_or_empty())


def _others(docs: DataFrame) -> list[int]:
    """Places of the columns that are neither identifier nor text."""
    return [i for i, c in enumerate(docs.columns) if c.lower() not in ("doc_id", "text")]


def _whole(docs: DataFrame, wanted: bool) -> list[Column]:
    """The other columns as one, named by place, so that no name clashes."""
    quoted = {i: "`" + docs.columns[i].replace("`", "``") + "`" for i in _others(docs)}
    return [F.struct(*(F.col(c).alias(f"c{i}") for i, c in quoted.items())).alias("row")] if wanted and quoted else []


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256_digest) -> DataFrame:
    """One row per row of ``docs``: doc_id, arrival, digest, keep_id, keep_arrival, group_size, kept."""
    state = DedupState(docs.sparkSession, digest=digest)
    state.ingest(docs)
    return state.decided()


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns unchanged, fetched by their locators."""
    state = DedupState(docs.sparkSession)
    state.ingest(docs, whole=True)
    stay = state.decided().filter("kept").select("arrival")
    rows = state.arrived().join(stay.hint("shuffle_hash"), "arrival", "left_semi")
    others = _others(docs)
    return rows.select(*(F.col(f"row.c{i}") if i in others else F.col(c) for i, c in enumerate(docs.columns))).toDF(*docs.columns)
