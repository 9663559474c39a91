"""Work along an order, in ranges: numbers, running totals and neighbours of keys of any size.

A window by key puts all of a key's rows into one task. Here the rows are sorted into ranges by key and order, a
range is worked on by itself, and what a range needs of those before it (a count, a sum, the last row) is one row
for each range and key. A key with most of the rows is spread over all ranges that it fills.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a range, about; ranges are no fewer than the session's parallelism.
RANGE_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="plumbline-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def durable(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder; a lost executor loses none of them."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Spark's setting that a query's shuffle files go when it has ended, since version 4.1.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind; else those of all steps stand beside each other until the driver
    happens to collect its garbage. What they give is to be written or collected."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder as Parquet: for large tables, which a checkpoint would not compress."""
    folder = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    with swept(df.sparkSession):
        df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


class Ranges:
    """rows in ranges by key and order; every method gives the rows back with one more column. Rows that neither tells
    apart stand in any order."""

    def __init__(self, rows: DataFrame, by: Sequence[str], order: Sequence[str], parts: int | None = None) -> None:
        self.by, self.columns = list(by), rows.columns
        kept = durable(rows)
        parts = parts or max(kept.sparkSession.sparkContext.defaultParallelism, -(-kept.count() // RANGE_ROWS))
        tied = kept.withColumn("tie_", F.monotonically_increasing_id())  # equal rows, too, are dealt to several ranges
        # The place: the range in the upper bits, the row's number in the range in the lower 33.
        self.rows = durable(tied.repartitionByRange(parts, *self.by, *order, "tie_").sortWithinPartitions(*self.by, *order).drop("tie_").withColumn("place_", F.monotonically_increasing_id())).withColumn("range_", F.shiftright("place_", 33))
        self.inside = Window.partitionBy("range_", *self.by).orderBy("place_")
        self.earlier = Window.partitionBy(*self.by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)

    def _with(self, name: str, own: Column, whole: Column, carried: Column, join: Column, place: bool = False) -> DataFrame:
        """own: within the range; whole: a range's summary; carried: what the summaries of earlier ranges give; join: of both.
        place: with the rows' place_ along all ranges, too."""
        summaries = self.rows.groupBy("range_", *self.by).agg(whole.alias("whole_"))
        carry = summaries.select("range_", *[F.col(c).alias(f"{c}_of_") for c in self.by], carried.alias("carried_"))
        same = F.col("r.range_") == F.col("c.range_")
        for c in self.by:
            same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}_of_"))
        joined = self.rows.withColumn("own_", own).alias("r").join(carry.alias("c"), same)
        return joined.select(*[F.col(f"r.{c}") for c in [*self.columns, *["place_"] * place]], join.alias(name))

    def number(self, name: str) -> DataFrame:
        """From 1."""
        before = F.coalesce(F.sum("whole_").over(self.earlier), F.lit(0))
        return self._with(name, F.row_number().over(self.inside), F.count("*"), before, (F.col("own_") + F.col("carried_")).cast("long"))

    def total_before(self, name: str, value: Column, place: bool = False) -> DataFrame:
        """The sum of value over the rows before."""
        before = F.coalesce(F.sum("whole_").over(self.earlier), F.lit(0))
        own = F.coalesce(F.sum(value).over(self.inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return self._with(name, own, F.sum(value), before, F.col("own_") + F.col("carried_"), place)

    def largest_before(self, name: str, value: Column, place: bool = False) -> DataFrame:
        """The largest value of the rows before, null for the first; a null value is passed over."""
        before = F.max("whole_").over(self.earlier)
        own = F.max(value).over(self.inside.rowsBetween(Window.unboundedPreceding, -1))
        return self._with(name, own, F.max(value), before, F.greatest("own_", "carried_"), place)

    def previous(self, name: str, column: str, default: object = None) -> DataFrame:
        """The column of the row before; default for the first."""
        last = F.last("whole_").over(self.earlier)
        return self._with(name, F.struct((F.row_number().over(self.inside) == 1).alias("first"), F.lag(column).over(self.inside).alias("v")), F.max_by(column, "place_"), last, F.coalesce(F.when(F.col("own_.first"), F.col("carried_")).otherwise(F.col("own_.v")), F.lit(default)))
