"""Exact deduplication with a heavy-hitter split.

Texts are equal when identical after replacing each run of white space by one space; a null text is an empty
one. Misra-Gries summaries of every partition, added up, find the digests that may be frequent; an exact count
over all rows verifies them. The winners of the frequent digests (their number is bounded by ``1 / share``) are
broadcast and settle all their rows where these stand, without a shuffle; all other digests are shuffled, and
none of those groups holds more than about ``share`` of the rows.

Defined results: of equal texts the row with the smallest id stays (null ids come last); rows that repeat an id
too are told apart by their place in the input, so that exactly one row of each group stays. An empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import SPACE_RUN, durable, numbered, ship, spare_name, without_rows

#: A digest with more than this share of the rows is frequent; counters of each Misra-Gries summary.
SHARE, COUNTERS = 1 / 256, 2048


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE_RUN, " ")


def misra_gries(batches: Iterator[pd.DataFrame], counters: int = COUNTERS) -> Iterator[pd.DataFrame]:
    """A Misra-Gries summary of a partition's digests: each count is too low by rows / counters at most."""
    kept: dict[bytes, int] = {}
    for batch in batches:
        for digest, n in batch["digest"].value_counts().items():
            kept[digest] = kept.get(digest, 0) + int(n)
        if len(kept) > counters:
            cut = sorted(kept.values(), reverse=True)[counters]
            kept = {k: n - cut for k, n in kept.items() if n > cut}
    yield pd.DataFrame({"digest": list(kept), "low": list(kept.values())}).astype({"low": "int64"})


def frequent_digests(rows: DataFrame, share: float, counters: int) -> DataFrame:
    """Every digest of more than share of the rows is here, with few others: 2 / share at most."""
    ship(rows.sparkSession)
    n = rows.count()
    least = max(2, int(n * share) - n // counters)
    summaries = rows.select("digest").mapInPandas(lambda it: misra_gries(it, counters), "digest binary, low long")
    return summaries.groupBy("digest").agg(F.sum("low").alias("low")).filter(F.col("low") >= least).select("digest")


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, share: float = SHARE, counters: int = COUNTERS) -> DataFrame:
    """Every row: doc_id, keep_id, group_size, kept, text_sha256, row (row_col, else its place in the input)."""
    rows = durable(docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(F.encode(normalised(F.col(text_col)), "UTF-8"), 256)).alias("digest"), (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row")))
    frequent = durable(frequent_digests(rows, share, counters))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    winners = durable(rows.join(F.broadcast(frequent), "digest").groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("group_size")))
    settled = rows.join(F.broadcast(winners), "digest")
    same = Window.partitionBy("digest")
    others = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select("*", F.min(order).over(same).alias("first"), F.count("*").over(same).alias("group_size"))
    return settled.unionByName(others).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "row",
    )


def drop_exact_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns. Without row_col, which numbers rows as placed() does, docs is written."""
    row = row_col or spare_name(docs, "row_number_here")
    docs = docs if row_col else numbered(docs, row)
    groups = exact_groups(docs, id_col=id_col, text_col=text_col, row_col=row)
    stay = without_rows(docs, row, groups.filter(~F.col("kept")).select("row"))
    return stay if row_col else stay.drop(row)
