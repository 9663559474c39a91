"""Agents and goals as extension points, and the built-in ones as columns."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import errors, schemas
from plumbline.functions.hashing import fnv1a_mod
from plumbline.functions.text import exact_match


@dataclass(frozen=True)
class Capabilities:
    injection_modes: frozenset[str] = frozenset()
    estimates: bool = False

    def need(self, mode: str) -> None:
        if mode not in self.injection_modes:
            raise errors.CAPABILITY_UNSUPPORTED(mode)


class Agent(Protocol):
    capabilities: Capabilities

    def respond(self, cases: DataFrame) -> DataFrame:
        """Rows of schemas.RESPONSES with error_code, one for each case."""


class Estimator(Protocol):
    """An agent that also prices each case before it is asked."""

    def estimate(self, cases: DataFrame) -> DataFrame:
        """cases with est_cost_usd_micros and est_calls (of one call), and estimate_error where there is no price."""


class Goal(Protocol):
    name: str
    direction: str

    def score(self, output: Column, expected: Column) -> Column: ...


@dataclass(frozen=True)
class ExactMatch:
    trim: bool = False
    ignore_case: bool = False
    name: str = "exact-match"
    direction: str = "MAXIMIZE"

    def score(self, output: Column, expected: Column) -> Column:
        return exact_match(output, expected, trim=self.trim, ignore_case=self.ignore_case)


@dataclass(frozen=True)
class FakeAgent:
    """Echoes what is expected. A share of ids gets a wrong answer, every n-th id (by hash) fails or is rate limited."""

    wrong_share: float = 0.0
    cost_usd_micros: int = 0
    fail_every: int = 0
    rate_limit_every: int = 0
    capabilities: Capabilities = field(default_factory=lambda: Capabilities(frozenset({"CONTEXT"}), True))

    def respond(self, cases: DataFrame) -> DataFrame:
        answer = fake_answer(F.col("id"), F.col("expected"), self.wrong_share)
        size = lambda c: F.octet_length(F.coalesce(c, F.lit(""))).cast("long")
        fails = fnv1a_mod(F.col("id"), self.fail_every) == 0 if self.fail_every else F.lit(False)
        limited = fnv1a_mod(F.col("id"), self.rate_limit_every, "rate") == 0 if self.rate_limit_every else F.lit(False)
        rows = cases.select(
            F.col("id").alias("case_id"), answer.alias("output"), size(F.col("input")).alias("prompt_tokens"), size(answer).alias("completion_tokens"), F.lit(self.cost_usd_micros).alias("cost_usd_micros"),
            F.lit("STOP").alias("stop_reason"), F.lit(False).alias("refused"), F.lit(False).alias("usage_estimated"), F.when(limited, 3).otherwise(1).alias("attempts"),
            F.when(fails, "AGENT_ERROR").when(limited, "RATE_LIMITED").alias("error_code"),
        )
        return rows


def fake_answer(case_id: Column, expected: Column, wrong_share: float) -> Column:
    told = F.coalesce(expected, F.lit(""))
    return F.when(fnv1a_mod(case_id, 1000) / F.lit(1000.0) < F.lit(wrong_share), F.concat(F.lit("wrong: "), F.upper(told))).otherwise(told)


@dataclass(frozen=True)
class FunctionAgent:
    """Any Python callable from input to output, called in Arrow batches; only RATE_LIMITED is tried again, at most
    attempts times. A failure leaves the type of its error, never its words."""

    call: Callable[[str], str]
    attempts: int = 3
    backoff_s: float = 0.0  # before the second attempt; doubles each time
    capabilities: Capabilities = field(default_factory=Capabilities)

    def respond(self, cases: DataFrame) -> DataFrame:
        call, most, backoff = self.call, self.attempts, self.backoff_s

        def batches(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in rows:
                out = []
                for case_id, text in zip(batch["id"], batch["input"], strict=True):
                    output = code = None
                    for attempt in range(1, most + 1):
                        try:
                            output, code = call(text), None
                            break
                        except errors.Actionable as error:
                            code = error.code
                            if code != errors.RATE_LIMITED.code:
                                break
                            if attempt < most:
                                time.sleep(backoff * 2 ** (attempt - 1))
                        except Exception as error:  # noqa: BLE001  one case's failure is that case's result
                            code = type(error).__name__
                            break
                    out.append((case_id, output, len(text.encode()), len((output or "").encode()), 0, "STOP", False, True, attempt, code))
                yield pd.DataFrame(out, columns=["case_id", "output", "prompt_tokens", "completion_tokens", "cost_usd_micros", "stop_reason", "refused", "usage_estimated", "attempts", "error_code"])

        ddl = "case_id string, output string, prompt_tokens long, completion_tokens long, cost_usd_micros long, stop_reason string, refused boolean, usage_estimated boolean, attempts int, error_code string"
        return cases.select("id", "input").mapInPandas(batches, ddl)


def with_context(cases: DataFrame, assets: DataFrame) -> DataFrame:
    """Cases with an asset's content before their input: a row for each pair in assets (case_id, asset_id, content)."""
    told = assets.withColumnRenamed("case_id", "id")
    return cases.join(told, "id").withColumn("input", F.concat_ws("\n\n", F.decode("content", "UTF-8"), "input")).drop("content")
