"""The training-data pipeline: what is toxic goes, one of equal and of similar texts stays, test passages go, the rest is packed.

Each stage takes the session, the rows that its predecessor kept, and the folder of the input tables; all but
the last return the columns of ``documents``. ``run`` writes each stage as Parquet in the shared checkpoint
folder and reads it again, so a lost executor costs no more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnscope.llm import decontaminate, exact_dedup, minhash, packing, toxicity
from turnscope.llm.common import materialize, read_table
from turnscope.llm.queries import TRAINING, VOCABULARY


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"), TRAINING)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.piece_digests(docs, VOCABULARY)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("decontamination", drop_leaks), ("packing", pack)]

#: SQL expresses neither the classifier nor the sampler; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        rows = materialize(spark, stage(spark, rows, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, rows, sf_dir)
