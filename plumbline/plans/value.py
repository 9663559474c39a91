"""From valuation to export: what the later stages make of measured scores."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import errors, schemas
from plumbline.operators import select as choose
from plumbline.operators import value
from plumbline.operators.ranges import durable
from plumbline.operators.seal import open_holdout


def valuations(pairs: DataFrame, costs: DataFrame, rates: Mapping[str, float], *, mode: str, quantile: float | None = None, run_id: str = "") -> DataFrame:
    """One row for each asset of costs. pairs: asset_id, slice (ROUTED or CONTROL), delta; an asset without routed
    pairs stays, with an error. costs: asset_id and the columns of rates."""
    if mode not in schemas.INJECTION_MODES:
        raise errors.INVALID_INPUT(f"unknown injection mode {mode}")
    by_slice = durable(value.deltas(pairs, "asset_id", "slice", quantile=quantile))  # two rows for each asset, read twice
    side = lambda name, prefix: by_slice.filter(F.col("slice") == name).select("asset_id", F.col("n").alias(f"{prefix}_n"), F.col("mean_delta").alias(prefix), value.interval(F.col("low"), F.col("high"), 0.95, "t").alias(f"{prefix}_interval"))
    joined = costs.join(side("ROUTED", "delta_goal"), "asset_id", "left").join(side("CONTROL", "delta_control"), "asset_id", "left")
    return joined.select(
        F.lit(run_id).alias("run_id"), "asset_id", "delta_goal", "delta_goal_interval", "delta_control", "delta_control_interval", F.lit(mode).alias("injection_mode"), F.coalesce("delta_goal_n", F.lit(0)).alias("routed_cases"),
        choose.per_cost(F.col("delta_goal"), rates).alias("delta_per_cost"), F.when(F.col("delta_goal_interval").isNull(), "not enough measured cases").alias("error"),
    )


def portfolio(candidates: DataFrame, caps: Mapping[str, int], links: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(selected, rejected): every candidate is in one of them. candidates: asset_id, kind, delta_per_cost, reason (or
    null where nothing speaks against it) and a column for each cap; links: near copies (asset_id, other_id, similarity)."""
    told = choose.greedy(candidates.filter("reason is null"), caps, links=links)
    chosen = told.filter("position is not null").select("asset_id", (F.col("position") + 1).cast("int").alias("selection_rank"))
    selected = candidates.join(chosen, "asset_id").withColumn("destination", choose.destination(F.col("kind"), F.lit(True)))
    refused = told.filter("position is null").select("asset_id", F.col("reason").alias("refused_for"), "redundant_with")
    rest = candidates.join(chosen, "asset_id", "left_anti").join(refused, "asset_id", "left")
    like = F.when(F.col("redundant_with").isNotNull(), F.array(F.col("redundant_with").cast("string")))
    return selected, rest.select("asset_id", F.coalesce("reason", "refused_for").alias("reason"), F.lit("REJECTED").alias("destination"), like.alias("redundant_with_asset_ids"))


def dev_estimated_gain(pairs: DataFrame, selected: DataFrame, *, quantile: float | None = None) -> DataFrame:
    """The selected assets' gain over the dev pairs (asset_id, delta) they were chosen by: an estimate that the choice
    itself inflates, never a result; validate() gives that."""
    own = pairs.join(selected.select("asset_id").distinct(), "asset_id", "left_semi")
    return value.deltas(own, quantile=quantile).withColumnRenamed("mean_delta", "dev_estimated_gain").withColumn("is_inflated", F.lit(True))


def validate(cases: DataFrame, baseline_scores: DataFrame, portfolio_scores: DataFrame, *, quantile: float | None = None) -> DataFrame:
    """The gain on the holdout, over the cases that both have scored there."""
    held = open_holdout(cases, "VALIDATE").select(F.col("id").alias("case_id"))
    pairs = value.paired(portfolio_scores, baseline_scores, ["case_id"]).join(held, "case_id", "left_semi")
    return value.deltas(pairs, quantile=quantile).withColumnRenamed("mean_delta", "holdout_gain")


def training_records(selected: DataFrame) -> DataFrame:
    """Chat records (one JSON object each, column value) of what goes into the tuning set; rows: asset_id, input, expected, destination."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    record = F.struct(F.array(message("user", F.col("input")), message("assistant", F.col("expected"))).alias("messages"), F.struct(F.col("asset_id").cast("string").alias("asset_id")).alias("provenance"))
    return selected.filter(F.col("destination") == "TUNING_SET").select(F.to_json(record).alias("value"))


def export(selected: DataFrame, root: str) -> None:
    """training_set as JSON lines, and the assets by destination."""
    training_records(selected).write.mode("overwrite").text(f"{root}/training_set")
    selected.write.mode("overwrite").partitionBy("destination").parquet(f"{root}/assets")
