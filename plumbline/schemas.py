"""The data model: explicit schemas and closed vocabularies. Absent is null and never zero; money is whole micro-dollars."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The closed vocabularies. None of them has a default; an unknown value is an error.
SPLITS = ("DEV", "HOLDOUT")
ROLES = ("SYSTEM", "USER", "ASSISTANT", "TOOL")
STOP_REASONS = ("STOP", "LENGTH", "TOOL_CALLS", "CONTENT_FILTER", "OTHER")
KINDS = ("KNOWLEDGE", "BEHAVIOR")
DIRECTIONS = ("MAXIMIZE", "MINIMIZE")
DESTINATIONS = ("CONTEXT", "KNOWLEDGE_BASE", "TUNING_SET", "REJECTED")
INJECTION_MODES = ("CONTEXT", "KNOWLEDGE", "PROXY_FINETUNE", "FINETUNE")
REJECTION_REASONS = ("NO_EFFECT", "REGRESSION", "REDUNDANT", "COST_DOMINATED", "WRONG_MECHANISM", "IRRELEVANT", "BUDGET_EXHAUSTED", "MEASUREMENT_FAILED")
STAGES = ("BASELINE", "VALUE", "SELECT", "VALIDATE", "EXPORT")
RUN_STATUSES = ("RUNNING", "COMPLETED", "FAILED", "BUDGET_STOPPED", "INTERRUPTED")
EVENT_KINDS = ("run_started", "case_scored", "case_errored", "stage_progress", "spend_recorded", "run_finished", "run_resumed", "retry_attempted", "rate_limit_waiting", "settlement_overshoot")

TURN = "struct<role:string,content:string,tool_calls:array<struct<id:string,name:string,arguments:string>>>"
PROVENANCE = "struct<source:string,source_ref:string,fetched_at:string,derived:boolean>"
COSTS = "struct<context_tokens:bigint,ft_tokens:bigint,acquisition_usd_micros:bigint,stale:boolean>"
INTERVAL = "struct<low:double,high:double,level:double,method:string>"


#: The tables, by name; schemas.CASES and so on are their StructTypes, made on demand since reading DDL needs a session.
DDL = {
    "RECORD": "id string, input string, expected string, rubric string, tags array<string>",
    "CASES": f"id string, input string, expected string, rubric string, split string, tags array<string>, provenance {PROVENANCE}, history array<{TURN}>",
    "ASSETS": f"id string, kind string, content binary, tags array<string>, costs {COSTS}, provenance {PROVENANCE}, user_override boolean",
    "RESPONSES": "case_id string, output string, prompt_tokens bigint, completion_tokens bigint, cost_usd_micros bigint, latency_ms bigint, stop_reason string, refused boolean, usage_estimated boolean, provider_build_id string, resolved_model string, attempts int",
    "OUTCOMES": ("run_id string, case_id string, scored boolean, err_code string, calls bigint, cost_usd_micros bigint, tokens bigint, score_value double, score_passed boolean, " "refused boolean, truncated boolean, usage_estimated boolean, provider_build_id string, resolved_model string"),
    "TRACES": "run_id string, case_id string, output string, rationale string",
    "RUNS": ("id string, version bigint, stage string, status string, input_fingerprint string, eval_content_hash string, goal string, goal_direction string, agent_ref string, created_at string, finished_at string, " "dev_cases bigint, holdout_cases bigint, attempted bigint, scored bigint, errored bigint, aggregate_score double, error_rate_exceeded boolean, incomplete_reason string, " "refused bigint, truncated bigint, usage_estimated bigint, provider_builds array<string>, resolved_models array<string>"),
    "EVENTS": "run_id string, sequence bigint, emitted_at string, payload_kind string, case_id string, score double, err_code string, will_retry boolean, cost_usd_micros bigint, attempted bigint, total bigint, status string, aggregate_score double",
    "VALUATIONS": f"run_id string, asset_id string, delta_goal double, delta_goal_interval {INTERVAL}, delta_control double, delta_control_interval {INTERVAL}, injection_mode string, routed_cases bigint, delta_per_cost double, error string",
    "REJECTIONS": "run_id string, asset_id string, reason string, redundant_with_asset_ids array<string>",
}


@cache
def __getattr__(name: str) -> T.StructType:
    if name not in DDL:
        raise AttributeError(name)
    return T.StructType.fromDDL(DDL[name])


def one_of(column: Column, vocabulary: tuple[str, ...]) -> Column:
    """The column, or an error for a value outside the vocabulary (an unset one too)."""
    return F.when(column.isin(*vocabulary), column).otherwise(F.raise_error(F.concat(F.lit("not a known value: "), F.coalesce(column, F.lit("(none)")))))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the schema's columns, in order; those it lacks are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
