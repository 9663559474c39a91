"""What the training-data operators share: reading tables, durable intermediates, white space."""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words (space, tab, newline, vertical tab, form feed, return).
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"

#: Bytes of the batches in which whole texts go to Python and back.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir, or a folder of our own where that is unset (tests)."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="plumbline-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def durable(df: DataFrame, parts: int | None = None) -> DataFrame:
    """The same rows, computed once and kept in the shared folder; a lost executor loses none of them.

    parts: in so many partitions at most, for tables of a few numbers a row."""
    shared_dir(df.sparkSession)
    return (df.coalesce(parts) if parts else df).checkpoint()


def parts_for(spark: SparkSession, rows: int, rows_of_a_part: int = 500_000) -> int:
    """Partitions for rows of a few numbers each."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // rows_of_a_part))


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """docs with each row's place as column row, written once to the shared folder: a later scan of the input may deal its
    rows to other partitions, and then gives them other numbers."""
    folder = f"{shared_dir(docs.sparkSession)}/numbered-{uuid.uuid4().hex}"
    docs.withColumn(row, F.monotonically_increasing_id()).write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def placed(docs: DataFrame, row: str) -> DataFrame:
    """docs with a number for each row as column row, alike in each scan. docs: a table as read, no row twice.

    Rows read from files that tell places (Parquet) are numbered by file and place in it, and nothing is written; all
    others as numbered() does."""
    try:
        own = docs.metadataColumn("_metadata")
        file, index, number = (spare_name(docs, f"{row}_{x}") for x in ("file", "index", "number"))
        at = docs.select("*", own["file_path"].alias(file), own["row_index"].alias(index))
    except AnalysisException:
        return numbered(docs, row)
    names = sorted(r[0] for r in at.select(file).distinct().collect())
    files = docs.sparkSession.createDataFrame(list(enumerate(names)), f"{number} long, {file} string")
    return at.join(F.broadcast(files), file).withColumn(row, F.shiftleft(number, 33).bitwiseOR(F.col(index))).drop(file, index, number)


def _told_apart(docs: DataFrame, row: str, listed: DataFrame, are_listed: bool) -> DataFrame:
    """Rows of docs meet a bit each, 4 KB for 32,768 numbers that follow each other. The bits are written first, so that Spark
    knows how few bytes they are and leaves the texts where they stand."""
    folder = f"{shared_dir(docs.sparkSession)}/listed-{uuid.uuid4().hex}"
    bucket, bits, number = spare_name(docs, f"{row}_bucket"), spare_name(docs, f"{row}_bits"), F.col(listed.columns[0])
    listed.groupBy(F.bitmap_bucket_number(number).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias(bits)).write.parquet(folder)
    kind, position = "inner" if are_listed else "left", F.bitmap_bit_position(F.col(row))
    met = docs.withColumn(bucket, F.bitmap_bucket_number(F.col(row))).join(docs.sparkSession.read.parquet(folder), bucket, kind)
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(position, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_listed = F.coalesce(F.getbit(byte, (position % 8).cast("int")) == 1, F.lit(False))
    return met.filter(is_listed if are_listed else ~is_listed).drop(bucket, bits)


def only_rows(docs: DataFrame, row: str, listed: DataFrame) -> DataFrame:
    """The rows of docs whose number (a long in column row, 0 at least) stands in listed's only column."""
    return _told_apart(docs, row, listed, True)


def without_rows(docs: DataFrame, row: str, listed: DataFrame) -> DataFrame:
    """The rows of docs whose number (a long in column row, 0 at least) does not stand in listed's only column."""
    return _told_apart(docs, row, listed, False)


def unestimated(df: DataFrame) -> DataFrame:
    """The same durable rows without Spark's estimate of their size. Estimates of joins are products, so in loops their digits
    multiply from round to round until planning takes minutes."""
    own = df._jdf
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(own.queryExecution().toRdd(), own.schema(), False), df.sparkSession)


def spare_name(df: DataFrame, wish: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def unit_uniform(*parts: Column) -> Column:
    """A number in (0, 1) that the given columns decide."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers in batches of BATCH_BYTES, from here on in this session; what the user has set stays.

    Spark's own limit is 64 MB. A batch stands in an executor several times (Arrow's buffers, what is sent, what the worker
    makes of it), for each task, beside a heap that earlier stages have filled."""
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def memory_back[T](rows: Iterator[T]) -> Iterator[T]:
    """The same rows; at their end the worker, which waits for the tasks of later stages, gives free memory back to the system."""
    yield from rows
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application, as --py-files would."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).resolve().parent.parent
        target = tempfile.mkdtemp(prefix="plumbline-package-")
        shutil.copytree(package, os.path.join(target, "files", package.name), ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(target, package.name), "zip", os.path.join(target, "files")))
        _SHIPPED.add(app)
