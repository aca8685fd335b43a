"""Helpers that several operators of this folder share."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusdiff.session import scratch_table_path, ship_package

#: The white space of the word rule: space and the five control characters from tab to carriage return.
SPACES = " \t\n\x0b\f\r"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; also sees to it that Python workers can import this package."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")  # whole texts go to Python
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, null for a null text."""
    return F.filter(F.split(text, SPACE_PATTERN, -1), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def trained_on(doc_id: Column, fold: int) -> Column:
    """True for documents outside the held-out fold of five; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 != fold


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, its lineage cut, safe if executors are lost."""
    path = scratch_table_path(df.sparkSession, name)
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.stored_path_ = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote. Only for those that nothing still to be computed reads, also not after a lost executor."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_path_)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release_memory() -> None:
    """Give freed memory of this Python worker back to the system: workers stay, and two of them share an executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Number of 64-bit blocks of a membership filter, as a power of two: 8 million bits.
FILTER_BLOCK_BITS = 17


def maybe_among(df: DataFrame, key: Column, keys: DataFrame, out: str) -> DataFrame:
    """``df`` with boolean ``out``: false only where ``key`` is none of ``keys`` (one column). A blocked Bloom filter, one row per block that has a bit, is all that is broadcast; its
    size is fixed. Rows that are surely not concerned need no shuffle; the others go to an exact join of the caller. With very many keys more rows are true; none is ever wrongly false.
    """

    def parts(column: Column) -> tuple[Column, Column]:
        h = F.xxhash64(column)
        one = F.lit(1).cast("long")
        bits = [F.call_function("shiftleft", one, F.shiftright(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(3)]
        return F.shiftrightunsigned(h, 64 - FILTER_BLOCK_BITS), bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])

    block, mask = parts(F.col(keys.columns[0]))
    blocks = stored(keys.select(block.alias("block_"), mask.alias("mask_")).groupBy("block_").agg(F.bit_or("mask_").alias("held_")), "filter")
    block, mask = parts(key)
    placed = df.withColumns({"block_": block, "mask_": mask}).join(F.broadcast(blocks), "block_", "left")
    return placed.withColumn(out, F.coalesce(F.col("held_").bitwiseAND(F.col("mask_")) == F.col("mask_"), F.lit(False))).drop("block_", "mask_", "held_")


def slices(spark: SparkSession, amount: int, each: int, least: int = 1) -> int:
    """How many partitions hold ``amount`` if one is to hold ``each``."""
    return max(least, -(-int(amount) // each))
