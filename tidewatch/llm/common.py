"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import scratch_folder

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
WORD = r"[^\x20\x09-\x0D]+"
#: Documents in an Arrow batch where the session sets no number: at Spark's 10,000 a worker
#: that sketches texts took 227 MB, at this 148 MB. Batches don't change results.
BATCH_ROWS = 1000
#: Row groups of kept tables of texts.
ROW_GROUP_BYTES = 16 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return table(spark, sf_dir, "documents")


def keep(df: DataFrame, name: str, row_group_bytes: int | None = None) -> DataFrame:
    """Write the rows to the shared scratch folder and read them back.

    Cuts the lineage, fixes values that a second evaluation could give anew, and
    outlives lost executors. The folder lies below `spark.checkpoint.dir` and is
    cleared with it. `row_group_bytes` bounds what a task that writes texts holds on the heap.
    """
    path = scratch_folder(df.sparkSession, name)
    writer = df.write if row_group_bytes is None else df.write.option("parquet.block.size", row_group_bytes)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The same function for mapInArrow, giving the memory of a task back at its end.

    Python workers live on from task to task; what Arrow's pool and the allocator hold on to
    after one (some 50 MB) would else stay for the life of the executor.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library than glibc
                pass

    return wrapped


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def word_key(text: Column) -> Column:
    """MD5 of the words joined by single spaces."""
    return F.md5(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")).cast("binary"))


def document_rows(df: DataFrame) -> DataFrame:
    """The columns of `documents`, with `n_chars` following the text."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)
