"""Selection: greedy by gain for its cost, within every cap; a log that names each rejected asset once."""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.ranges import durable, stored, swept


def per_cost(delta: Column, costs: Mapping[str, float]) -> Column:
    """Gain for each dollar; costs maps columns to dollars for each unit. A free asset ranks by its gain alone, first."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) * F.lit(rate) for c, rate in costs.items()), F.lit(0.0))
    return F.when(total > 0, delta / total).otherwise(F.when(delta > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf"))))


#: Candidates of a pool that are decided in one task.
RANGE = 1000


def _walk(pool: pd.DataFrame, caps: Mapping[str, int], size: int) -> pd.DataFrame:
    """Decides the first candidates of a pool, best first. Their worth only falls as others are chosen, so a worth that was
    right before is a bound: a candidate is weighed anew when it comes to the top and goes back where it now belongs."""
    pool = pool.sort_values("turn")
    room = {c: cap - int(pool[f"used_{c}"].iloc[0]) for c, cap in caps.items()}
    position = int(pool["chosen_before"].iloc[0])
    rest = pool[pool["turn"] > size]
    floor = (-float(rest["bound"].iloc[0]), rest["asset_id"].iloc[0]) if len(rest) else None
    rows = {r.asset_id: r for r in pool[pool["turn"] <= size].itertuples(index=False)}
    alike = {r.kin: (r.penalty, r.nearest) for r in rows.values()}
    heap = [(-float(r.bound), i) for i, r in rows.items()]
    heapq.heapify(heap)
    out = []
    while heap:
        bound, i = heapq.heappop(heap)
        row = rows[i]
        penalty, nearest = alike[row.kin]
        worth = row.delta_per_cost * (1 - penalty) if penalty < 1 else 0.0
        if penalty > 0 and worth <= 0:
            out.append((i, "REDUNDANT", worth, None, nearest))
        elif -worth > bound and floor is not None and (-worth, i) > floor:
            out.append((i, "LATER", worth, None, nearest))
        elif -worth > bound:
            heapq.heappush(heap, (-worth, i))
        elif any(getattr(row, c) > room[c] for c in caps):
            out.append((i, "BUDGET_EXHAUSTED", worth, None, None))
        else:
            for c in caps:
                room[c] -= getattr(row, c)
            out.append((i, "CHOSEN", worth, position, None))
            position += 1
            near = [(o["other_id"], o["similarity"]) for o in row.neighbours] if row.neighbours is not None else []
            for other, similarity in [(row.kin, 1.0), *near]:
                before = alike.get(other, (0.0, None))
                if (-similarity, i) < (-before[0], before[1] if before[1] is not None else i):
                    alike[other] = (similarity, i)
    return pd.DataFrame(out, columns=["asset_id", "decision", "bound", "position", "nearest"])


def greedy(candidates: DataFrame, caps: Mapping[str, int], *by: str, links: DataFrame | None = None, copies: DataFrame | None = None, size: int = RANGE) -> DataFrame:
    """A decision for each candidate (asset_id, delta_per_cost and a column for each cap): position (from 0; null if it is
    not chosen), reason (null if it is), redundant_with and worth, what it was worth at its turn.

    Best worth first, then least id. links (asset_id, other_id, similarity) are near copies: a candidate is worth its
    delta_per_cost times one less its largest similarity to a chosen one; with nothing left of it, it is REDUNDANT. copies
    (asset_id, other_id) are equal ones, each beside one that stands for them: their similarity is 1, and that one's links are
    the links of all, which no table writes out. One that does not fit is skipped and leaves its room to later ones. Pools (by)
    are walked side by side, each in ranges of size candidates in order of what they may be worth at most. From one range to the
    next go the room that is left and the chosen ids; a candidate that fell below its range waits for a later one, so the order is that of the whole
    pool. Candidates that no longer fit are never ranked, so ranges end soon after the room does.
    """
    names, key = list(caps), list(by) or ["pool_"]
    kind = candidates.schema["asset_id"].dataType.simpleString()
    rows = candidates.select(*([F.col(c) for c in by] or [F.lit(0).alias("pool_")]), "asset_id", F.col("delta_per_cost").cast("double").alias("delta_per_cost"), *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in names])
    if copies is None:
        rows = rows.withColumn("kin", F.col("asset_id"))
    else:
        of = copies.groupBy(F.col("other_id").alias("asset_id")).agg(F.min("asset_id").alias("head"))
        rows = rows.join(of, "asset_id", "left").withColumn("kin", F.coalesce("head", "asset_id")).drop("head")
    with swept(candidates.sparkSession):
        return _greedy(rows, caps, by, key, kind, links, size)


def _greedy(rows: DataFrame, caps: Mapping[str, int], by: Sequence[str], key: list[str], kind: str, links: DataFrame | None, size: int) -> DataFrame:
    names, every = list(caps), stored(rows)
    waiting = every.withColumn("bound", F.col("delta_per_cost"))
    near = None
    if links is not None:
        one = links.select("asset_id", "other_id", "similarity")
        near = durable(one.unionByName(one.select(F.col("other_id").alias("asset_id"), F.col("asset_id").alias("other_id"), "similarity")).groupBy("asset_id", "other_id").agg(F.max("similarity").alias("similarity")))
    decided: DataFrame | None = None
    schema = f"{', '.join(f'{c} {rows.schema[c].dataType.simpleString()}' for c in key)}, asset_id {kind}, decision string, bound double, position long, nearest {kind}"
    while True:
        if decided is not None:
            chosen = every.join(decided.filter("decision = 'CHOSEN'").select(*key, "asset_id"), [*key, "asset_id"])
            used = chosen.groupBy(*key).agg(F.count("*").alias("chosen_before"), *[F.sum(c).alias(f"used_{c}") for c in names])
            waiting = waiting.join(used, key, "left").na.fill(0, ["chosen_before", *[f"used_{c}" for c in names]])
        else:
            waiting = waiting.withColumns({"chosen_before": F.lit(0).cast("long")} | {f"used_{c}": F.lit(0).cast("long") for c in names})
        for c in names:
            waiting = waiting.filter(F.col(c) + F.col(f"used_{c}") <= caps[c])
        turn = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("bound"), "asset_id"))
        batch = durable(waiting.withColumn("turn", turn).filter(F.col("turn") <= size + 1))
        if batch.isEmpty():
            break
        own = batch.select(*key, "asset_id", F.col("kin").alias("other_id"), F.lit(1.0).alias("similarity"))
        if near is None:
            batch = batch.withColumn("neighbours", F.lit(None).cast(f"array<struct<other_id: {kind}, similarity: double>>"))
        else:
            linked = batch.select(*key, "asset_id", "kin").join(near.withColumnRenamed("asset_id", "kin"), "kin").drop("kin")
            here = linked.join(batch.select(*key, F.col("kin").alias("other_id")), [*key, "other_id"], "left_semi").groupBy(*key, "asset_id").agg(F.collect_list(F.struct("other_id", "similarity")).alias("neighbours"))
            batch, own = batch.join(here, [*key, "asset_id"], "left"), own.unionByName(linked)
        if decided is None:
            batch = batch.withColumns({"penalty": F.lit(0.0), "nearest": F.lit(None).cast(kind)})
        else:
            # Of equal ones that are chosen, the least id stands for them.
            known = chosen.groupBy(*key, F.col("kin").alias("other_id")).agg(F.min("asset_id").alias("known"))
            before = own.join(known, [*key, "other_id"]).groupBy(*key, "asset_id").agg(F.max("similarity").alias("penalty"), F.min_by("known", F.struct(-F.col("similarity"), F.col("known"))).alias("nearest"))
            batch = batch.join(before, [*key, "asset_id"], "left").na.fill(0.0, ["penalty"])

        def walk(k: tuple, pool: pd.DataFrame) -> pd.DataFrame:
            found = _walk(pool, caps, size)
            for n, c in enumerate(key):
                found.insert(n, c, k[n])
            return found.astype({"position": "Int64"})

        told = durable(batch.groupBy(*key).applyInPandas(walk, schema))
        final = told.filter("decision <> 'LATER'")
        decided = durable(final if decided is None else decided.unionByName(final))
        waiting = waiting.drop("chosen_before", *[f"used_{c}" for c in names]).join(final.select(*key, "asset_id"), [*key, "asset_id"], "left_anti")
        later = told.filter("decision = 'LATER'").select(*key, "asset_id", F.col("bound").alias("bound_now"))
        waiting = stored(waiting.join(later, [*key, "asset_id"], "left").withColumn("bound", F.coalesce("bound_now", "bound")).drop("bound_now"))
    if decided is None:
        decided = rows.sparkSession.createDataFrame([], schema)
    all_decided = every.join(decided, [*key, "asset_id"], "left")
    reason = F.when(F.col("decision") == "CHOSEN", None).otherwise(F.coalesce("decision", F.lit("BUDGET_EXHAUSTED")))
    return all_decided.select(*by, "asset_id", "position", reason.alias("reason"), F.when(F.col("decision") == "REDUNDANT", F.col("nearest")).alias("redundant_with"), F.coalesce("bound", "delta_per_cost").alias("worth"))


def rejection_reason(*, routed: Column, measured: Column, low: Column, high: Column, mechanism_ok: Column, redundant: Column, worth: Column, fits: Column) -> Column:
    """The first reason that holds; null where an asset has none."""
    return (
        F.when(~routed, "IRRELEVANT").when(~measured, "MEASUREMENT_FAILED").when(high < 0, "REGRESSION").when((low <= 0) & (high >= 0), "NO_EFFECT")
        .when(~mechanism_ok, "WRONG_MECHANISM").when(redundant, "REDUNDANT").when(~worth, "COST_DOMINATED").when(~fits, "BUDGET_EXHAUSTED")
    )


def destination(kind: Column, selected: Column) -> Column:
    """Knowledge never goes into a tuning set."""
    return F.when(~selected, "REJECTED").when(kind == "KNOWLEDGE", "KNOWLEDGE_BASE").when(kind == "BEHAVIOR", "TUNING_SET").otherwise("CONTEXT")


def portfolio_cost(selected: DataFrame, *by: str) -> DataFrame:
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("context_tokens", "ft_tokens", "acquisition_usd_micros")]
    return selected.groupBy(*by).agg(*sums, F.coalesce(F.bool_or("stale"), F.lit(False)).alias("stale"))


def gaps(clusters: DataFrame, improved: DataFrame, attempts: DataFrame) -> DataFrame:
    """Clusters that no asset improved, with the assets that were tried on them."""
    tried = attempts.groupBy("cluster").agg(F.array_sort(F.collect_set("asset_id")).alias("attempted_asset_ids"))
    return clusters.join(improved.select("cluster").distinct(), "cluster", "left_anti").join(tried, "cluster", "left")
