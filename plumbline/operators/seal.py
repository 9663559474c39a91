"""The seal: stages before validation get a type that holds dev cases alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import errors


class SealedCases:
    """Dev cases. Rows without a known split are dropped with the holdout."""

    def __init__(self, cases: DataFrame) -> None:
        self._dev = cases.filter(F.col("split") == "DEV")

    def dev(self) -> DataFrame:
        return self._dev


def seal(cases: DataFrame) -> SealedCases:
    return SealedCases(cases)


def open_holdout(cases: DataFrame, stage: str) -> DataFrame:
    """The holdout, for the validate stage and no other."""
    if stage != "VALIDATE":
        raise errors.HOLDOUT_SEALED(f"asked for by {stage}")
    return cases.filter(F.col("split") == "HOLDOUT")
