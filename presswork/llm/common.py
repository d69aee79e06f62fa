"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _LIBC = None

#: White space that separates words in every word count of this package (a fixed value).
WORD_GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset on one machine (tests) a temporary folder is made and set; on a
    cluster that is an error, as executors would not see each other's files.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="presswork-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs a re-read and not a re-run, and
    lets several later steps read one result.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that no later step reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return a Python worker's free memory to the system, as workers live on between stages."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def giving_back(kernel: Callable) -> Callable:
    """An Arrow kernel that returns free memory when its task ends."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            give_back()

    return of


def join_aggregate(rows: DataFrame, aggregate: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of an aggregate by ``keys``, in a join whose hot keys can be split.

    An aggregate is dealt by its keys already; a join on the same keys would reuse that,
    and the engine splits a skewed join only where both sides are shuffled for it. As one
    struct the keys are dealt anew. Null keys join nothing; other than inner joins must have
    none.
    """
    mine = rows.withColumn("__join", F.struct(*keys))
    theirs = aggregate.withColumn("__join", F.struct(*keys)).drop(*keys)
    some = [F.col(k).isNotNull() for k in keys]
    if how == "inner":
        mine = mine.where(reduce(Column.__and__, some))
    return mine.join(theirs, "__join", how).drop("__join")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of ``text`` (null: none), by a split that stays in generated code."""
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(GAP_CHARS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WORD_GAP))


def unit(column: Column, salt: str) -> Column:
    """A number strictly between 0 and 1 fixed by the text of ``column`` and ``salt``.

    Taken from an MD5 digest, so that any SQL engine can repeat it.
    """
    digest = F.substring(F.md5(F.concat(F.lit(salt), F.coalesce(column.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    return (F.conv(digest, 16, 10).cast("bigint").cast("double") + 0.5) / float(16**13)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes, so that a Python worker never holds many long texts at once.

    A bound that the session sets itself stays.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
