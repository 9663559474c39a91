"""The baseline stage: validate, restore, admit and run waves of cases, close."""

from __future__ import annotations

import json
import secrets
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import errors
from plumbline.functions.money import show_usd
from plumbline.operators import outcomes as facts
from plumbline.operators.agents import Agent, Goal
from plumbline.operators.budget import Limits, Spend, admit, denial_reason, resolve_estimates, wave_size
from plumbline.operators.ranges import durable
from plumbline.operators.seal import seal
from plumbline.plans.store import Store
from plumbline.sources.cases import SplitCounts, count_splits

CONFIRM_FROM_USD_MICROS = 1_000_000
STATUS_NAMES = {"COMPLETED": "completed", "FAILED": "failed", "BUDGET_STOPPED": "budget-stopped", "INTERRUPTED": "interrupted", "RUNNING": "running"}
NEXT_STEPS = {
    "BUDGET_STOPPED": "The budget is used up. `plumbline baseline --resume` goes on from here.",
    "INTERRUPTED": "Stopped before the end. `plumbline baseline --resume` goes on without paying twice.",
    "FAILED": "The run failed. Correct the error above and run it again.",
}


def new_run_id() -> str:
    return f"{datetime.now(UTC):%Y%m%dT%H%M%S}-{secrets.token_hex(6)}"


def now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds").replace("+00:00", "Z")


@dataclass(frozen=True)
class Options:
    agent: Agent
    agent_ref: str
    goal: Goal
    fingerprint: str
    limits: Limits = Limits()
    worst_cost_usd_micros: int = 0
    attempts: int = 3
    wave: int = 100_000
    max_error_rate: float = facts.MAX_ERROR_RATE
    holdout: float = 0.0
    confirm: Callable[[int], bool] | None = None


@dataclass(frozen=True)
class Report:
    run_id: str
    status: str
    counts: SplitCounts
    scored: int
    errored: int
    score: float | None
    spent: Spend
    error_rate_exceeded: bool
    incomplete_reason: str | None

    @property
    def exit_code(self) -> int:
        return {"COMPLETED": errors.EXIT_OK, "BUDGET_STOPPED": errors.EXIT_BUDGET, "INTERRUPTED": errors.EXIT_INTERRUPTED}.get(self.status, errors.EXIT_ERROR)

    def warnings(self) -> list[str]:
        found = []
        if self.counts.underpowered:
            found.append(f"only {self.counts.holdout} cases are held back, too few for a useful interval at validation")
        if self.error_rate_exceeded:
            found.append("too many cases failed for a baseline to rely on")
        if self.score is None:
            found.append("no case was scored, so there is no baseline number")
        return found

    def text(self) -> str:
        score = "none" if self.score is None else f"{self.score:.3f}"
        lines = [
            "", f"Baseline {self.run_id}", f"  cases      {self.scored} scored, {self.errored} errored (of {self.counts.dev} dev; {self.counts.holdout} held back)", f"  score      {score}",
            f"  spent      {show_usd(self.spent.cost_usd_micros)} over {self.spent.calls} call(s)", f"  status     {STATUS_NAMES[self.status]}",
        ]
        lines += [x for w in self.warnings() for x in ("", f"  warning: {w}")]
        if self.incomplete_reason:
            lines += ["", f"  {self.incomplete_reason}"]
        return "\n".join([*lines, "", NEXT_STEPS.get(self.status, "Next: `plumbline value` to measure what each asset is worth."), ""])

    def json(self, agent_ref: str, goal: str) -> str:
        """score is null where there is none; the last two are left out where empty."""
        out = {
            "run_id": self.run_id, "status": STATUS_NAMES[self.status], "agent": agent_ref, "goal": goal, "dev_cases": self.counts.dev, "holdout_cases": self.counts.holdout,
            "attempted": self.scored + self.errored, "scored": self.scored, "errored": self.errored, "score": self.score, "spent_usd": show_usd(self.spent.cost_usd_micros),
        }
        if self.incomplete_reason:
            out["incomplete_reason"] = self.incomplete_reason
        if self.warnings():
            out["warnings"] = self.warnings()
        return json.dumps(out, indent=2)


def check_resumable(run, options: Options) -> None:
    """The inputs, the goal, its direction and the agent must be those of the recorded run."""
    for what, recorded, given in (("inputs", run["input_fingerprint"], options.fingerprint), ("goal", run["goal"], options.goal.name), ("goal's direction", run["goal_direction"], options.goal.direction), ("agent", run["agent_ref"], options.agent_ref)):
        if recorded != given:
            raise errors.CHECKPOINT_STALE(f"the {what} changed")


def settled(store: Store, run_id: str) -> Spend:
    row = facts.settled_spend(store.outcomes(run_id)).first()
    return Spend(row["calls"], row["cost_usd_micros"], row["tokens"])


def baseline(store: Store, cases: DataFrame, options: Options, *, run_id: str | None = None, resume: bool = False) -> Report:
    """Waves of admitted cases, each one job whose results are recorded before the next is admitted. Spend, counts and
    the score come from recorded rows alone, so a resumed run tells of the whole run. Within a wave every case
    reserves all its attempts, since a task cannot ask again."""
    counts = count_splits(cases)
    counts.check(options.holdout)
    estimates = options.agent.estimate if hasattr(options.agent, "estimate") else None
    if options.limits.max_cost_usd_micros and options.worst_cost_usd_micros <= 0 and estimates is None:
        raise errors.INVALID_INPUT("a cost cap needs an estimate of a call's cost")
    # Asked before anything is stored: a refusal leaves no run behind.
    if options.worst_cost_usd_micros >= CONFIRM_FROM_USD_MICROS and not (options.confirm and options.confirm(options.worst_cost_usd_micros)):
        raise errors.CONFIRMATION_REQUIRED(f"a call may cost {show_usd(options.worst_cost_usd_micros)}")
    run_id = run_id or new_run_id()
    if resume:
        run = store.run(run_id)
        if run is None:
            raise errors.INVALID_INPUT(f"no run {run_id}")
        check_resumable(run, options)
        store.put_run({"id": run_id, "status": "RUNNING"})
    else:
        store.put_run({
            "id": run_id, "stage": "BASELINE", "status": "RUNNING", "input_fingerprint": options.fingerprint, "eval_content_hash": options.fingerprint, "goal": options.goal.name, "goal_direction": options.goal.direction,
            "agent_ref": options.agent_ref, "created_at": now(), "dev_cases": counts.dev, "holdout_cases": counts.holdout,
        }, new=True)
    _emit(store, run_id, [("run_resumed" if resume else "run_started", {"total": counts.dev})])
    status, reason = "COMPLETED", None
    worst = options.worst_cost_usd_micros * options.attempts
    # Waves take cases in the order of their ids, so what is left is what is not yet recorded and beyond the last wave's end.
    left = durable(facts.not_yet_done(seal(cases).dev(), store.outcomes(run_id).select(F.col("case_id").alias("id")), ["id"]))
    spent, end, limited = settled(store, run_id), None, 0
    try:
        while True:
            ahead = left if end is None else left.filter(F.col("id") > end)
            one = _priced(ahead, estimates, options)
            size = wave_size(options.limits, spent, worst, options.wave)
            priced = one.withColumns({c: F.col(c) * options.attempts for c in ("est_cost_usd_micros", "est_calls")})
            wave = durable(admit(priced, options.limits, spent, size))
            if wave.isEmpty():
                # All attempts of a case may not fit where one call does; such a case runs alone with the one.
                wave = durable(admit(one, options.limits, spent, 1))
                if wave.isEmpty():
                    if not ahead.isEmpty():
                        binds = denial_reason(options.limits, spent, 1, options.worst_cost_usd_micros)
                        status, reason = "BUDGET_STOPPED", f"stopped at the cap on {binds}"
                    break
            cost, not_recorded = _run_wave(store, run_id, wave, options)
            spent = Spend(spent.calls + cost.calls, spent.cost_usd_micros + cost.cost_usd_micros, spent.tokens + cost.tokens)
            end, limited = wave.agg(F.max("id").alias("id")).first()["id"], limited + not_recorded
        if limited and reason is None:
            reason = f"{limited} cases were rate limited to the end; `plumbline baseline --resume` asks them again"
    except KeyboardInterrupt:
        status, reason = "INTERRUPTED", errors.INTERRUPTED.message
    except Exception:
        store.put_run({"id": run_id, "status": "FAILED", "finished_at": now()})
        raise
    return _close(store, run_id, counts, options, status, reason)


def _priced(cases: DataFrame, estimates: Callable[[DataFrame], DataFrame] | None, options: Options) -> DataFrame:
    """Cases with what one call of each may cost. A case that cannot be priced under a cost cap ends the run."""
    worst = F.lit(options.worst_cost_usd_micros).cast("long")
    if estimates is None:
        return cases.withColumn("est_cost_usd_micros", worst).withColumn("est_calls", F.lit(1).cast("long"))
    resolved = resolve_estimates(estimates(cases), options.worst_cost_usd_micros, capped=bool(options.limits.max_cost_usd_micros))
    refused = resolved.filter(F.col("unpriceable").isNotNull()).orderBy("id").select("id", "unpriceable").first()
    if refused is not None:
        raise errors.INVALID_INPUT(f"case {refused['id']} cannot be priced: {refused['unpriceable']}", "run without a cost cap, or with an agent that can price this model")
    return resolved.drop("unpriceable", "estimate_error")


def _run_wave(store: Store, run_id: str, wave: DataFrame, options: Options) -> tuple[Spend, int]:
    """The agent is asked once: its answers are written before anything is made of them. A case without an answer is
    recorded as an error at the cost that was reserved for it, so no case is asked and paid again in the same run. One that
    was rate limited to the end is not recorded: a resumed run asks it again. Gives what was spent, and how many those are."""
    answers = options.agent.respond(wave.drop("est_cost_usd_micros", "est_calls"))
    raw = store.wave_path(run_id, secrets.token_hex(6))
    answers.write.parquet(raw)
    asked = wave.select(F.col("id").alias("case_id"), "expected", "est_cost_usd_micros", "est_calls")
    told = asked.join(store.spark.read.parquet(raw).withColumn("answered", F.lit(True)), "case_id", "left").withColumn("error_code", F.when(F.col("answered"), F.col("error_code")).otherwise("AGENT_ERROR"))
    told = durable(told.filter(F.coalesce(F.col("error_code"), F.lit("")) != errors.RATE_LIMITED.code))
    scored = told.withColumn("scored", F.col("error_code").isNull()).withColumn("score_value", F.when(F.col("error_code").isNull(), options.goal.score(F.col("output"), F.col("expected"))))
    attempts = F.coalesce(F.col("attempts"), F.lit(1)).cast("long")
    calls, cost = F.when(F.col("answered"), attempts).otherwise(F.col("est_calls")).cast("long"), F.when(F.col("answered"), F.col("cost_usd_micros") * attempts).otherwise(F.col("est_cost_usd_micros")).cast("long")
    scored = scored.withColumns({"calls": calls, "cost_usd_micros": cost})
    outcomes = scored.select(
        "case_id", "scored", F.col("error_code").alias("err_code"), "calls", "cost_usd_micros", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"),
        "score_value", (F.col("score_value") >= 1).alias("score_passed"), "refused", (F.col("stop_reason") == "LENGTH").alias("truncated"), "usage_estimated",
    )
    store.record(run_id, outcomes, scored.select("case_id", "output"))
    kind = F.when(F.col("scored"), "case_scored").otherwise("case_errored")
    events = facts.number_events(scored.select("case_id", kind.alias("payload_kind"), F.col("score_value").alias("score"), F.col("error_code").alias("err_code"), F.lit(False).alias("will_retry"), "cost_usd_micros", F.lit(run_id).alias("run_id"), F.lit(now()).alias("emitted_at")), "run_id", ["case_id"], F.lit(store.max_sequence(run_id)))
    store.append_events(events, run_id)
    store.delete(raw)
    row = facts.settled_spend(facts.first_writer_wins(outcomes, ["case_id"], ["case_id"])).first()
    return Spend(row["calls"], row["cost_usd_micros"], row["tokens"]), wave.select(F.col("id").alias("case_id")).join(told, "case_id", "left_anti").count()


def _emit(store: Store, run_id: str, payloads: list[tuple[str, dict]]) -> None:
    from plumbline import schemas

    after = store.max_sequence(run_id)
    rows = [{"run_id": run_id, "sequence": after + i, "emitted_at": now(), "payload_kind": kind} | values for i, (kind, values) in enumerate(payloads, 1)]
    store.append_events(store.spark.createDataFrame([tuple(r.get(f.name) for f in schemas.EVENTS.fields) for r in rows], schemas.EVENTS), run_id)


def _close(store: Store, run_id: str, counts: SplitCounts, options: Options, status: str, reason: str | None) -> Report:
    rows = store.outcomes(run_id)
    n, sums, ran = facts.outcome_counts(rows).first(), facts.score_sum(rows).first(), facts.case_execution(rows).first()
    attempted = n["scored"] + n["errored"]
    exceeded = attempted > 0 and n["errored"] / attempted > options.max_error_rate
    if exceeded and status == "COMPLETED":
        reason = f"{n['errored']} of {attempted} cases failed, more than {options.max_error_rate:.0%}"
    spent = settled(store, run_id)
    store.put_run({
        "id": run_id, "status": status, "finished_at": now(), "attempted": attempted, "scored": n["scored"], "errored": n["errored"], "aggregate_score": sums["mean_score"], "error_rate_exceeded": exceeded, "incomplete_reason": reason,
        "refused": ran["refused"], "truncated": ran["truncated"], "usage_estimated": ran["usage_estimated"], "provider_builds": ran["provider_builds"], "resolved_models": ran["resolved_models"],
    })
    _emit(store, run_id, [("run_finished", {"status": status, "aggregate_score": sums["mean_score"], "attempted": attempted, "total": counts.dev, "cost_usd_micros": spent.cost_usd_micros})])
    return Report(run_id, status, counts, n["scored"], n["errored"], sums["mean_score"], spent, exceeded, reason)
