"""What the operators of this subpackage share: input tables, shared scratch tables and Arrow buffers.

Scratch tables are written below the folder that the session names in ``spark.checkpoint.dir``, which
driver and executors share, so they outlive any executor. Only where that setting is missing (tests
in local mode) is a temporary folder of this machine used instead.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_SCRATCH: dict[str, str] = {}

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``, which may be any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared checkpoint folder; Hadoop deletes it when the driver exits."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _LOCAL_SCRATCH.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="turnscope-"))
    path = f"{base}/turnscope/{label}-{uuid.uuid4().hex}"
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialize(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a scratch table and read it back: cuts the lineage and survives lost executors."""
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches small: ten thousand long texts at once would not fit a Python worker."""
    as_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = as_bytes(spark.conf.get(key))
        if now <= 0 or now > most:
            spark.conf.set(key, most)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. ``lower`` does exactly that for pure ASCII, and is faster."""
    pure = F.length(text) == F.octet_length(text)
    return F.when(pure, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def free_name(df: DataFrame, label: str) -> str:
    """A column name that ``df`` does not have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    while label.lower() in taken:
        label += "_"
    return label


def plain_names(df: DataFrame) -> DataFrame:
    """``df`` with its columns named by place: Spark hands no column with a dot in its name to Python."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def utf8_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array without copying; nulls become empty."""
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) else "")
    kind = array.type
    wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
    _, offsets, data = array.buffers()
    if offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)
    ends = ends[array.offset : array.offset + len(array) + 1].astype(np.int64)
    if len(ends) == 0:
        ends = np.zeros(1, np.int64)
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)), ends


def blocks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes stay within ``most``; a longer row is a range of its own."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end
