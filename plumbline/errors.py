"""Errors that say what happened, why, and what to do; identity is the code."""

from __future__ import annotations

from dataclasses import dataclass, replace

EXIT_OK, EXIT_ERROR, EXIT_BUDGET, EXIT_VALIDATION, EXIT_INTERRUPTED = 0, 1, 2, 3, 4


@dataclass(frozen=True)
class Kind:
    code: str
    message: str
    fix: str
    exit_code: int = EXIT_ERROR

    def __call__(self, why: str = "", fix: str = "") -> Actionable:
        return Actionable(replace(self, fix=fix or self.fix), why)


class Actionable(Exception):
    def __init__(self, kind: Kind, why: str = "") -> None:
        super().__init__(f"{kind.message}{f': {why}' if why else ''}\n  fix: {kind.fix}")
        self.kind, self.why = kind, why

    @property
    def code(self) -> str:
        return self.kind.code


BUDGET_EXCEEDED = Kind("BUDGET_EXCEEDED", "the run's next call does not fit its budget", "raise the cap, or resume later from what is recorded", EXIT_BUDGET)
HOLDOUT_SEALED = Kind("HOLDOUT_SEALED", "the holdout stays closed until validation", "open it through the validate stage only")
CAPABILITY_UNSUPPORTED = Kind("CAPABILITY_UNSUPPORTED", "this adapter cannot do what was asked", "choose an injection mode it declares")
CHECKPOINT_STALE = Kind("CHECKPOINT_STALE", "the recorded run was made from other inputs", "start a fresh run, without resuming")
INVALID_INPUT = Kind("INVALID_INPUT", "the input cannot be used", "correct what is named above")
INTERRUPTED = Kind("INTERRUPTED", "the run was stopped before its end", "resume it; recorded cases are not paid for again", EXIT_INTERRUPTED)
CONFIRMATION_REQUIRED = Kind("CONFIRMATION_REQUIRED", "nothing was changed, since nobody confirmed", "confirm with --yes")
RATE_LIMITED = Kind("RATE_LIMITED", "the provider limits this run's rate", "lower the concurrency or wait")


def code_of(error: BaseException) -> str:
    """The code to record for a failed case; never the provider's words."""
    if isinstance(error, Actionable):
        return error.code
    return INTERRUPTED.code if isinstance(error, KeyboardInterrupt) else "AGENT_ERROR"


def exit_code_of(error: BaseException | None) -> int:
    if error is None:
        return EXIT_OK
    return error.kind.exit_code if isinstance(error, Actionable) else EXIT_INTERRUPTED if isinstance(error, KeyboardInterrupt) else EXIT_ERROR
