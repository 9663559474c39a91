"""What a run's persisted rows say: counts, spend, scores, gates, sequences. Nulls stay nulls; a mean of nothing is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.ranges import Ranges
from plumbline.sources.cases import UNDERPOWERED

MAX_ERROR_RATE = 0.05


def outcome_counts(outcomes: DataFrame, *by: str) -> DataFrame:
    return outcomes.groupBy(*by).agg(F.count_if("scored").alias("scored"), F.count_if(~F.col("scored")).alias("errored"))


def settled_spend(outcomes: DataFrame, *by: str) -> DataFrame:
    return outcomes.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("calls", "cost_usd_micros", "tokens")])


def score_sum(outcomes: DataFrame, *by: str) -> DataFrame:
    """unrecoverable: scored rows whose score is gone; where there are any, no mean may be told."""
    lost = F.count_if(F.col("scored") & F.col("score_value").isNull())
    return outcomes.groupBy(*by).agg(F.sum("score_value").alias("score_sum"), F.count("score_value").alias("score_rows"), lost.alias("unrecoverable"), F.when(lost == 0, F.avg("score_value")).alias("mean_score"))


def case_execution(outcomes: DataFrame, *by: str) -> DataFrame:
    flags = [F.count_if(c).alias(c) for c in ("refused", "truncated", "usage_estimated")]
    return outcomes.groupBy(*by).agg(*flags, F.array_sort(F.collect_set("provider_build_id")).alias("provider_builds"), F.array_sort(F.collect_set("resolved_model")).alias("resolved_models"))


def error_gate(errored: Column, attempted: Column, most: float = MAX_ERROR_RATE) -> Column:
    """More errors than allowed; just as many are allowed."""
    return F.coalesce(errored / F.nullif(attempted, F.lit(0)) > F.lit(most), F.lit(False))


def report(counts: DataFrame) -> DataFrame:
    """Gates and warnings of rows with scored, errored, mean_score and holdout."""
    attempted = F.col("scored") + F.col("errored")
    gated = counts.withColumn("attempted", attempted).withColumn("error_rate_exceeded", error_gate(F.col("errored"), attempted))
    under = (F.col("holdout") > 0) & (F.col("holdout") < UNDERPOWERED)
    warnings = F.array_compact(F.array(
        F.when(under, F.lit("underpowered holdout")), F.when(F.col("error_rate_exceeded"), F.lit("error rate exceeded")), F.when(F.col("mean_score").isNull(), F.lit("nothing scored")),
    ))
    return gated.withColumn("underpowered", under).withColumn("warnings", warnings)


def first_writer_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    turn = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("write_turn", F.row_number().over(turn)).filter("write_turn = 1").drop("write_turn")


def not_yet_done(cases: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return cases.join(done.select(*key), key, "left_anti")


def resume_coordinates(planned: DataFrame, outcomes: DataFrame, run: str, case: str) -> DataFrame:
    """Where each planned run stands: already_completed of total_cases over all its lives, and remaining, which is what
    this session counts up to; with the spend to restore, that of cases no longer planned included."""
    done = outcomes.select(run, case, F.lit(1).alias("done")).distinct()
    cases = planned.select(run, case).distinct().join(done, [run, case], "left")
    counts = cases.groupBy(run).agg(F.count("done").alias("already_completed"), F.count_if(F.col("done").isNull()).alias("remaining"), F.count("*").alias("total_cases"))
    spent = outcomes.groupBy(run).agg(F.sum("cost_usd_micros").alias("cost"), F.sum("calls").alias("made"))
    restored = {"restored_cost_usd_micros": F.coalesce("cost", F.lit(0)).cast("long"), "restored_calls": F.coalesce("made", F.lit(0)).cast("long")}
    return counts.join(spent, run, "left").withColumns(restored).drop("cost", "made")


def number_events(events: DataFrame, run: str, order: list[str], after: Column | None = None) -> DataFrame:
    """Sequences from 1, or on from what a resumed run has (after), which numbers one wave of one run."""
    if after is None:
        return Ranges(events, [run], order).number("sequence")
    at = F.row_number().over(Window.partitionBy(run).orderBy(*order))
    return events.withColumn("sequence", (at + after).cast("long"))


def sequence_gaps(events: DataFrame, run: str) -> DataFrame:
    """Where events are missing: the last before and the first behind each gap."""
    seen = Ranges(events.select(run, "sequence"), [run], ["sequence"]).previous("previous", "sequence", 0)
    return seen.filter(F.col("sequence") > F.col("previous") + 1)


def terminal_outcomes(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of each case the last event that is not to be retried."""
    turn = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return events.filter(~F.col("will_retry")).withColumn("terminal_turn", F.row_number().over(turn)).filter("terminal_turn = 1").drop("terminal_turn")


def progress(events: DataFrame, run: str) -> DataFrame:
    """Attempted cases and their pace; seconds from the first event to the last."""
    seconds = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / F.lit(1e6)
    return events.groupBy(run).agg(F.count_if("scored").alias("scored"), F.count_if(~F.col("scored")).alias("errored"), F.count("*").alias("attempted"), F.when(seconds > 0, F.count("*") / seconds).alias("cases_per_second"))
