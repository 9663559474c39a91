"""A warehouse of runs as Parquet folders: facts, content and events apart, each by run.

outcomes/run_id=…  facts; its row is a case's done-mark, so it is written last
traces/run_id=…    content; purge deletes this folder and no number
waves/run_id=…     raw answers of a wave until they are recorded; purge deletes what a stopped run left
events/run_id=…    the event spine; also a streaming source
runs/              versions of runs; the highest version of an id holds
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline import errors, schemas
from plumbline.operators.outcomes import first_writer_wins

SCHEMA_VERSION = 1


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._check_version()

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _exists(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.exists(at)

    def _check_version(self) -> None:
        path = f"{self.root}/schema_version"
        if self._exists(path):
            found = self.spark.read.schema("version int").json(path).first()["version"]
            if found > SCHEMA_VERSION:
                raise errors.INVALID_INPUT(f"the store has version {found}, this code knows {SCHEMA_VERSION}", "use newer code")
        else:
            self.spark.createDataFrame([(SCHEMA_VERSION,)], "version int").coalesce(1).write.json(path)

    def _read(self, name: str, schema: T.StructType, run_id: str | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        if not self._exists(path):
            return self.spark.createDataFrame([], schema)
        rows = schemas.conform(self.spark.read.schema(schema).parquet(path), schema)
        return rows.filter(F.col("run_id") == run_id) if run_id is not None else rows

    def _append(self, rows: DataFrame, name: str, schema: T.StructType) -> None:
        schemas.conform(rows, schema).write.mode("append").partitionBy("run_id").parquet(f"{self.root}/{name}")

    def runs(self) -> DataFrame:
        rows = self._read("runs", schemas.RUNS)
        return rows.withColumn("turn", F.row_number().over(Window.partitionBy("id").orderBy(F.col("version").desc()))).filter("turn = 1").drop("turn")

    def run(self, run_id: str) -> Row | None:
        return self.runs().filter(F.col("id") == run_id).first()

    def put_run(self, values: dict, *, new: bool = False) -> None:
        known = self.run(values["id"])
        if new and known is not None:
            raise errors.INVALID_INPUT(f"run {values['id']} exists")
        merged = {f.name: (known[f.name] if known is not None else None) for f in schemas.RUNS.fields} | values
        merged["version"] = (known["version"] if known is not None else 0) + 1
        self.spark.createDataFrame([tuple(merged[f.name] for f in schemas.RUNS.fields)], schemas.RUNS).coalesce(1).write.mode("append").parquet(f"{self.root}/runs")

    def outcomes(self, run_id: str) -> DataFrame:
        return self._read("outcomes", schemas.OUTCOMES, run_id)

    def record(self, run_id: str, outcomes: DataFrame, traces: DataFrame) -> None:
        """First content, then facts; the first writer of a case wins. Exactly one of score and error is there."""
        if self.run(run_id) is None:
            raise errors.INVALID_INPUT(f"no run {run_id}")
        both = (F.col("scored") & F.col("err_code").isNotNull()) | (~F.col("scored") & F.col("err_code").isNull())
        checked = outcomes.withColumn("scored", F.when(both, F.raise_error(F.lit("an outcome has both a score and an error, or neither"))).otherwise(F.col("scored")))
        fresh = first_writer_wins(checked.withColumn("run_id", F.lit(run_id)), ["run_id", "case_id"], ["case_id"])
        told = first_writer_wins(traces.withColumn("run_id", F.lit(run_id)), ["run_id", "case_id"], ["case_id"])
        # A stopped write may have left content without facts; such a case's content is not written twice.
        self._append(told.join(self._read("traces", schemas.TRACES, run_id).select("case_id"), "case_id", "left_anti"), "traces", schemas.TRACES)
        self._append(fresh.join(self.outcomes(run_id).select("case_id"), "case_id", "left_anti"), "outcomes", schemas.OUTCOMES)

    def traces(self, run_id: str) -> DataFrame:
        """Content of recorded cases; what a stopped write left behind is not seen."""
        return self._read("traces", schemas.TRACES, run_id).join(self.outcomes(run_id).select("case_id"), "case_id", "left_semi")

    def events(self, run_id: str | None = None) -> DataFrame:
        return self._read("events", schemas.EVENTS, run_id)

    def append_events(self, rows: DataFrame, run_id: str) -> None:
        """Events of one run; sequences begin at 1, and one already there stays as it is."""
        if self.run(run_id) is None:
            raise errors.INVALID_INPUT(f"no run {run_id}")
        own = rows.withColumn("run_id", F.when(F.col("run_id") == run_id, F.col("run_id")).otherwise(F.raise_error(F.lit("an event of another run"))))
        checked = own.withColumn("sequence", F.when(F.col("sequence") > 0, F.col("sequence")).otherwise(F.raise_error(F.lit("an event's sequence is not positive"))))
        unique = first_writer_wins(checked, ["run_id", "sequence"], ["case_id"])
        self._append(unique.join(self.events(run_id).select("run_id", "sequence"), ["run_id", "sequence"], "left_anti"), "events", schemas.EVENTS)

    def max_sequence(self, run_id: str) -> int:
        return self.events(run_id).agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("n")).first()["n"]

    def purgeable(self, run_id: str) -> int:
        return self._read("traces", schemas.TRACES, run_id).filter("output is not null or rationale is not null").count()

    def wave_path(self, run_id: str, name: str) -> str:
        """Where a wave's raw answers stand until they are recorded."""
        return f"{self.root}/waves/run_id={run_id}/{name}"

    def delete(self, path: str) -> None:
        fs, at = self._fs(path)
        if fs.exists(at) and not fs.delete(at, True):
            raise errors.INVALID_INPUT(f"{path} could not be deleted")

    def purge(self, run_id: str, *, confirmed: bool, force: bool = False) -> int:
        """Deletes a run's content, bytes and all; its facts stay, so it can still be resumed."""
        run = self.run(run_id)
        if run is None:
            raise errors.INVALID_INPUT(f"no run {run_id}")
        if run["status"] == "RUNNING" and not force:
            raise errors.INVALID_INPUT(f"run {run_id} is running", "wait for its end, or force")
        n = self.purgeable(run_id)
        if not confirmed:
            raise errors.CONFIRMATION_REQUIRED(f"{n} cases of run {run_id} have content")
        for name in ("traces", "waves"):
            self.delete(f"{self.root}/{name}/run_id={run_id}")
        return n
