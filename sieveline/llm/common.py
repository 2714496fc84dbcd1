"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and the controls from tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share; a local one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sieveline-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/sieveline-{uuid.uuid4().hex}"


#: Rows of an Arrow batch while a step is written: Python workers keep what their largest batch took.
BATCH_ROWS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """The rows written to the shared folder and read again: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}"
    before = spark.conf.get(_BATCH_CONF)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(_BATCH_CONF, BATCH_ROWS)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH_CONF, before)
    return spark.read.schema(df.schema).parquet(path)


def released(run):
    """A mapInPandas or mapInArrow function that gives memory back at the end of a task: workers are reused, by later stages too."""

    def of(batches):
        import ctypes
        import gc

        import pyarrow as pa

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return of


def fresh(df: DataFrame, name: str) -> str:
    """A column name that clashes with none of df's."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def held_out(doc_id) -> object:
    """True for the rows that no classifier may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """text and label of at most `bound` labelled rows outside the held-out quarter, written once.

    The rows are those whose ids have the smallest hashes, so that the sample does not depend on partitioning. Rows
    without id or label teach nothing; of a repeated id, the largest label counts. Bytes that are not UTF-8 become
    replacement characters.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    # The sample of ids is bounded by its parameter, hence the hint.
    return written(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(F.make_valid_utf8(F.coalesce("text", F.lit(""))).alias("text"), "label"), "labelled")


#: Keys of rows to be removed are broadcast up to this number (some 16 bytes each), beyond it they are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def without(df: DataFrame, removed: DataFrame) -> DataFrame:
    """The rows of df whose values in the columns of `removed` are not among its rows; nulls are equal to nulls."""
    keys = removed.columns
    few = removed.count() <= BROADCAST_KEYS
    other = removed.toDF(*(f"removed_{c}" for c in keys))
    same = [df[c].eqNullSafe(other[f"removed_{c}"]) for c in keys]
    return df.join(F.broadcast(other) if few else other, same, "left_anti")
