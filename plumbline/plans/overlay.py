"""A knowledge base that valuation runs may change without touching it: changes by run, merged on read, dropped on rollback.

The base is a table with a key. A run's additions, replacements and removals are rows of a folder of changes; its view is the base
without the keys that it changed, and its own rows. The base is never copied, many runs have their views at once, and a
rollback is one row that makes all that the run wrote before it count for nothing, whether the run ended well or not.

changes/run_id=…    key, place (order of writing), op (put or remove), row
rollbacks/run_id=…  place: what was written up to it is void
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUT, REMOVE = "put", "remove"


class Overlay:
    """Views of base by run. Keys that are null are no keys: such base rows are in every view and can't be changed; a change
    without a key is refused. A key that the base holds more than once is replaced, or removed, in all its rows."""

    def __init__(self, base: DataFrame, folder: str, key: str) -> None:
        self.base, self.folder, self.key, self.spark = base, folder.rstrip("/"), key, base.sparkSession
        of_key = base.schema[key].dataType
        self.schema = T.StructType([T.StructField("key", of_key), T.StructField("place", T.LongType()), T.StructField("op", T.StringType()), T.StructField("row", base.schema), T.StructField("run_id", T.StringType())])

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def _last_place(self, run_id: str) -> int:
        return self._read("changes", self.schema).filter(F.col("run_id") == run_id).agg(F.max("place")).first()[0] or 0

    def _write(self, run_id: Column, keys: Column, rows: DataFrame, op: str, place: Column) -> None:
        row = F.struct(*[F.col(f"`{c}`").cast(self.base.schema[c].dataType).alias(c) for c in self.base.columns]) if op == PUT else F.lit(None).cast(self.base.schema)
        checked = F.when(keys.isNull(), F.raise_error(F.lit("a change has no key"))).otherwise(keys).cast(self.schema["key"].dataType)
        out = rows.select(checked.alias("key"), place.cast("long").alias("place"), F.lit(op).alias("op"), row.alias("row"), run_id.cast("string").alias("run_id"))
        out.write.mode("append").partitionBy("run_id").parquet(f"{self.folder}/changes")

    def put(self, run_id: str, rows: DataFrame) -> None:
        """Adds rows (columns of the base) to the run's view, in place of those with their keys. Of rows with one key, any one counts."""
        self._write(F.lit(run_id), F.col(self.key), rows, PUT, F.lit(self._last_place(run_id) + 1))

    def remove(self, run_id: str, keys: DataFrame) -> None:
        """Takes keys (a column of the key's name) from the run's view."""
        self._write(F.lit(run_id), F.col(self.key), keys, REMOVE, F.lit(self._last_place(run_id) + 1))

    def put_many(self, rows: DataFrame, run_id: Column) -> None:
        """Adds rows to the views of many fresh runs at once; one write, whatever the number of runs."""
        self._write(run_id, F.col(self.key), rows, PUT, F.lit(2))

    def remove_many(self, keys: DataFrame, run_id: Column) -> None:
        """Takes keys from the views of many fresh runs at once, before what put_many adds."""
        self._write(run_id, F.col(self.key), keys, REMOVE, F.lit(1))

    def rollback(self, *run_ids: str) -> None:
        """Their views are the base again; what they write later counts."""
        rows = [(max(self._last_place(r), 2), r) for r in run_ids]
        self.spark.createDataFrame(rows, "place long, run_id string").coalesce(1).write.mode("append").partitionBy("run_id").parquet(f"{self.folder}/rollbacks")

    @contextmanager
    def session(self, run_id: str) -> Iterator[DataFrame]:
        """The run's view inside; rolled back at the end, after an error, too."""
        try:
            yield self.view(run_id)
        finally:
            self.rollback(run_id)

    def changes(self) -> DataFrame:
        """What holds: the last change of each (run_id, key) that no rollback voids."""
        void = self._read("rollbacks", T.StructType([T.StructField("place", T.LongType()), T.StructField("run_id", T.StringType())]))
        void = void.groupBy("run_id").agg(F.max("place").alias("void"))
        valid = self._read("changes", self.schema).join(void, "run_id", "left").filter(F.col("void").isNull() | (F.col("place") > F.col("void")))
        return valid.groupBy("run_id", "key").agg(F.max_by(F.struct("op", "row"), F.struct("place", "op")).alias("last")).select("run_id", "key", "last.op", "last.row")

    def view(self, run_id: str) -> DataFrame:
        """The run's whole knowledge, as columns of the base."""
        mine = self.changes().filter(F.col("run_id") == run_id)
        kept = self.base.join(mine.select(F.col("key").alias("key_")), F.col(self.key) == F.col("key_"), "left_anti")
        return kept.unionByName(mine.filter(F.col("op") == PUT).select("row.*"))

    def lookup(self, requests: DataFrame, run_id: str = "run_id", key: str = "key") -> DataFrame:
        """requests (run_id, key, any more) with row: what each run's view holds for the key, null where nothing does. Every
        request meets the base once and the changes once, so no view is made. Where the base repeats a key, any of its rows."""
        first = self.base.groupBy(F.col(self.key).alias("base_key_")).agg(F.any_value(F.struct(*[F.col(f"`{c}`") for c in self.base.columns])).alias("base_row_"))
        mine = self.changes().select(F.col("run_id").alias("run_"), F.col("key").alias("key_"), F.col("op").alias("op_"), F.col("row").alias("row_"))
        met = requests.join(mine, (F.col(run_id) == F.col("run_")) & (F.col(key) == F.col("key_")), "left").join(first, F.col(key) == F.col("base_key_"), "left")
        return met.select(*[F.col(f"`{c}`") for c in requests.columns], F.when(F.col("op_").isNull(), F.col("base_row_")).when(F.col("op_") == PUT, F.col("row_")).alias("row"))

    def totals(self, value: Column) -> DataFrame:
        """(run_id, n, total) of every changed run's view, for a value of a row's columns: the base is added up once, and each run adds
        what its changes add to or take from that."""
        whole = self.base.agg(F.count("*").alias("n"), F.coalesce(F.sum(value), F.lit(0)).alias("total"))
        keyed = self.base.withColumn("value_", value).groupBy(F.col(self.key).alias("key")).agg(F.count("*").alias("n_"), F.coalesce(F.sum("value_"), F.lit(0)).alias("total_"))
        changed = self.changes()
        new = changed.filter(F.col("op") == PUT).select("run_id", "row.*").groupBy("run_id").agg(F.count("*").alias("n_new"), F.coalesce(F.sum(value), F.lit(0)).alias("total_new"))
        old = changed.join(keyed, "key", "left").groupBy("run_id").agg(F.coalesce(F.sum("n_"), F.lit(0)).alias("n_old"), F.coalesce(F.sum("total_"), F.lit(0)).alias("total_old"))
        row = whole.first()
        both = old.join(new, "run_id", "left")
        return both.select("run_id", (F.lit(row["n"]) - F.col("n_old") + F.coalesce("n_new", F.lit(0))).alias("n"), (F.lit(row["total"]) - F.col("total_old") + F.coalesce("total_new", F.lit(0))).alias("total"))
