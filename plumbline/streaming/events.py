"""The event spine as a stream: progress, windows, and results as tables; ordered state is in ordered.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_events(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def running_progress(events: DataFrame, run: str = "run_id") -> DataFrame:
    """Counts by run so far, for update or complete mode."""
    return events.groupBy(run).agg(F.count_if("scored").alias("scored"), F.count_if(~F.col("scored")).alias("errored"), F.count("*").alias("attempted"))


def windowed_progress(events: DataFrame, *, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts by window of event time; a window closes once the watermark has passed it, later events are dropped."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    grouped = events.withWatermark("ts", late).groupBy(window.alias("w")).agg(F.count_if("scored").alias("scored"), F.count("*").alias("attempted"))
    return grouped.select(F.col("w.start").alias("window_start"), "scored", "attempted")


def unique_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each (run, sequence) once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id", "sequence"])


def run_to_table(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Runs a stream over all that is there now; each batch is written as Parquet below folder, by its number, so that a
    batch that is run again replaces itself. In complete mode the last batch is the result, else all of them are, those
    of earlier runs from the same folder included."""
    written: list[str] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batches/number={number}")
        written.append(f"{folder}/batches/number={number}")

    if mode != "complete":
        stream.sparkSession.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{folder}/batches/number=-1")  # so that there is something to read
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    read = stream.sparkSession.read.schema(stream.schema)
    if mode == "complete":
        return read.parquet(written[-1]) if written else stream.sparkSession.createDataFrame([], stream.schema)
    return read.option("basePath", f"{folder}/batches").parquet(f"{folder}/batches").select(*stream.columns)
