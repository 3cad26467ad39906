"""Small helpers shared by the text operators: keyed inputs, checked broadcasts, shared-folder checkpoints."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it was counted and has at most this many rows.
BROADCAST_ROWS = 200_000


#: Bytes of an Arrow batch. Spark's own bound is 10,000 rows, and so many long texts don't fit into a task.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, unless the session does already; results don't depend on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1))) >= 2**31 - 1:
        spark.conf.set(key, str(BATCH_BYTES))


def released(run: Callable) -> Callable:
    """An Arrow stage that gives its memory back at the end of a partition.

    A worker waits for its next task with what its allocators keep; beside the workers of later stages that counts in full.
    """

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
        if trim is not None:
            trim(0)

    return stage


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; set a local one only in local mode where none is named (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint (shared folder, survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def round_result(df: DataFrame) -> DataFrame:
    """checkpointed(), for the rounds of an iteration: the frame comes back without what the optimizer knew of it.

    A checkpointed frame keeps its plan's estimated size, constraints and partitionings. A join multiplies the sizes, so
    over the rounds of an iteration their digits double and planning takes longer than the work.
    """
    spark = df.sparkSession
    rows = checkpointed(df)._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(rows.toJavaRDD(), rows.schema()), spark)


def lower_ascii(col):
    """Lower-case A-Z only, so that results don't depend on a locale or on Unicode case tables."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and a content key, whatever other columns the table has.

    (doc_id, _h) identifies a row up to rows that are equal in both; such rows get equal results.
    """
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("_h", F.xxhash64("text"))


def same_row(a: DataFrame, b: DataFrame):
    """Join condition on (doc_id, _h) that also matches null ids."""
    return (a["_h"] == b["_h"]) & a["doc_id"].eqNullSafe(b["doc_id"])


def maybe_broadcast(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if the frame was counted below the limit; otherwise leave the join to shuffle."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def held_out(doc_id, modulus: int, remainder: int):
    """crc32 of the id's decimal text, modulo; null ids count as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder
