"""A content hash that is put together in order: digests of items, of runs of items, of runs of runs.

An item's digest is of its bytes; each run of fanout consecutive nodes becomes the digest of their digests, until one
is left. So no file or table is ever one value, any partitioning gives the same root, and two states of a source
that differ in one item differ in one node of each level: changed() finds the items by the nodes that differ.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ranges import Ranges, durable

FANOUT = 1024


def tree(rows: DataFrame, order: Sequence[str], value: Column, fanout: int = FANOUT) -> DataFrame:
    """Every node: level (0: the items), node (from 0 in order), digest, items below it. Rows that the order does not tell apart
    are put in the order of their digests; no rows give no nodes."""
    items = Ranges(rows.select(*order, F.sha2(value, 256).alias("digest")), [], [*order, "digest"]).number("place")
    nodes = durable(items.select(F.lit(0).alias("level"), (F.col("place") - 1).alias("node"), "digest", F.lit(1).cast("long").alias("items")))
    every, level, n = nodes, 0, nodes.count()
    while n > 1:
        level, n = level + 1, -(-n // fanout)
        runs = nodes.groupBy(F.expr(f"node div {fanout}").alias("run")).agg(F.sort_array(F.collect_list(F.struct("node", "digest"))).alias("own"), F.sum("items").alias("items"))
        nodes = durable(runs.select(F.lit(level).alias("level"), F.col("run").alias("node"), F.sha2(F.array_join("own.digest", ""), 256).alias("digest"), "items"))
        every = every.unionByName(nodes)
    return every


def root(nodes: DataFrame) -> str:
    """The digest above all; that of nothing for no rows."""
    top = nodes.orderBy(F.desc("level")).select("digest").first()
    return top["digest"] if top else ""


def changed(before: DataFrame, after: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Items (node) whose digests differ between two trees, or that only one of them has. From level to level only the
    children of nodes that differ are looked at."""
    highest = max(x.agg(F.max("level").alias("level")).first()["level"] or 0 for x in (before, after))
    found = None
    for level in range(highest, -1, -1):
        a, b = (x.filter(F.col("level") == level).select("node", F.col("digest").alias(name)) for x, name in ((before, "a"), (after, "b")))
        if found is not None:
            inside = found.select(F.col("node").alias("run"))
            a, b = (x.withColumn("run", F.expr(f"node div {fanout}")).join(inside, "run", "left_semi").drop("run") for x in (a, b))
        found = durable(a.join(b, "node", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("node"))
    return found
