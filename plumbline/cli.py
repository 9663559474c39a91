"""Commands: baseline and purge. Exit codes are those of plumbline.errors."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from plumbline import errors
from plumbline.operators.agents import Agent, ExactMatch, FakeAgent, Goal
from plumbline.operators.budget import Limits
from plumbline.plans.baseline import Options, baseline
from plumbline.plans.store import Store
from plumbline.sources import agent_ref
from plumbline.sources.cases import JsonLines


def agent_of(text: str) -> Agent:
    ref = agent_ref.parse(text)
    if ref.scheme != "fake":
        raise errors.CAPABILITY_UNSUPPORTED(f"no adapter for {ref.scheme} is part of this build")
    return FakeAgent()


def goal_of(name: str) -> Goal:
    if name != "exact-match":
        raise errors.INVALID_INPUT(f"unknown goal {name}")
    return ExactMatch()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="plumbline")
    commands = top.add_subparsers(dest="command", required=True)
    run = commands.add_parser("baseline", help="score an agent over the dev cases")
    run.add_argument("--evals", required=True)
    run.add_argument("--store", required=True)
    run.add_argument("--agent", default="fake:")
    run.add_argument("--goal", default="exact-match")
    run.add_argument("--run-id")
    run.add_argument("--resume", action="store_true")
    run.add_argument("--seed", default="")
    run.add_argument("--holdout", type=float, default=0.0)
    run.add_argument("--max-calls", type=int, default=0)
    run.add_argument("--max-cost-usd", type=float, default=0.0)
    run.add_argument("--call-cost-usd", type=float, default=0.0)
    run.add_argument("--max-error-rate", type=float, default=0.05)
    run.add_argument("--json", action="store_true")
    run.add_argument("--yes", action="store_true")
    clean = commands.add_parser("purge", help="delete a run's content; its numbers stay")
    clean.add_argument("--store", required=True)
    clean.add_argument("--run", required=True)
    clean.add_argument("--yes", action="store_true")
    clean.add_argument("--force", action="store_true")
    return top


def run(spark: SparkSession, argv: Sequence[str]) -> tuple[int, str]:
    """Exit code and what to print."""
    try:
        args = parser().parse_args(argv)
    except SystemExit as stopped:
        return (errors.EXIT_OK if stopped.code in (0, None) else errors.EXIT_ERROR), ""
    try:
        store = Store(spark, args.store)
        if args.command == "purge":
            n = store.purge(args.run, confirmed=args.yes, force=args.force)
            return errors.EXIT_OK, f"content of {n} cases deleted from run {args.run}; its numbers stay"
        if args.max_calls < 0 or args.max_cost_usd < 0 or args.call_cost_usd < 0:
            raise errors.INVALID_INPUT("a cap or cost is negative")
        source = JsonLines(spark, args.evals, seed=args.seed, fraction=args.holdout)
        micros = lambda usd: int(usd * 1e6 + 0.5)
        ref = str(agent_ref.parse(args.agent))
        options = Options(agent_of(args.agent), ref, goal_of(args.goal), source.content_hash(), Limits(micros(args.max_cost_usd), args.max_calls), micros(args.call_cost_usd), max_error_rate=args.max_error_rate, holdout=args.holdout, confirm=lambda _: args.yes)
        report = baseline(store, source.cases(), options, run_id=args.run_id, resume=args.resume)
        return report.exit_code, report.json(ref, args.goal) if args.json else report.text()
    except errors.Actionable as error:
        return errors.exit_code_of(error), str(error)


def main() -> None:
    code, text = run(SparkSession.builder.appName("plumbline").getOrCreate(), sys.argv[1:])
    print(text, file=sys.stdout if code in (errors.EXIT_OK, errors.EXIT_BUDGET) else sys.stderr)
    sys.exit(code)


if __name__ == "__main__":
    main()
