"""Connected components of a graph of links, by repeated joins.

Each round gives every node the smallest label among its neighbours, then the label of its label, so chains
shrink by more than half in a round. Labels are kept in the shared folder after each round, which cuts their
lineage. Only nodes with links take part; nothing is collected.

A label that many nodes have is one key of the second join. The few such labels (HOT at most, since each has more
than one in HOT of the nodes) are broadcast; their nodes are dealt out by node instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import durable, parts_for, unestimated

#: A label of more than one in HOT of all nodes is broadcast.
HOT = 256


def with_facts(rows: DataFrame, facts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """rows (durable) with the facts of their keys. facts: one row for each key, n being how many rows have it. Keys that have
    more than one in HOT of these rows, HOT at most, are broadcast; the rows of all others are shuffled."""
    facts = durable(facts)
    total, n_facts = facts.agg(F.coalesce(F.sum(n), F.lit(0)), F.count("*")).first()
    facts = facts.coalesce(parts_for(rows.sparkSession, n_facts))
    is_hot = F.col(n) * HOT > total
    hot = facts.filter(is_hot)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(facts.filter(~is_hot), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(others)


def components(links: DataFrame) -> DataFrame:
    """links: (a, b) of longs, 0 at least. Every node that has a link: (node, label), label being its component's smallest node."""
    # Turned round inside each row: a union of links with links would compute them twice.
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = durable(links.filter("a <> b").select(F.inline(ways)).distinct())
    n_links = both.count()
    parts = parts_for(links.sparkSession, n_links)
    both = unestimated(both.coalesce(parts))  # each round reads it, in no more tasks than its rows need
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), parts)
    while True:
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("at")).agg(F.min("label").alias("near"))
        hooked = durable(labels.join(seen, F.col("node") == F.col("at")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), parts)
        holders = hooked.groupBy("label").agg(F.count("*").alias("n"))
        beyond = durable(holders.join(hooked.select(F.col("node").alias("label"), F.col("label").alias("beyond")), "label"), parts)
        hot = beyond.filter(F.col("n") * HOT > n_links).select("label", F.col("beyond").alias("hot_beyond"))
        cold = beyond.filter(F.col("n") * HOT <= n_links).select(F.col("label").alias("via"), F.col("beyond").alias("cold_beyond"))
        # Nodes of hot labels have a key of their own, below all nodes, that meets nothing.
        keyed = hooked.join(F.broadcast(hot), "label", "left").withColumn("via", F.when(F.col("hot_beyond").isNull(), F.col("label")).otherwise(-1 - F.col("node")))
        further = F.coalesce("hot_beyond", "cold_beyond", "label")
        jumped = unestimated(durable(keyed.join(cold, "via", "left").select("node", "old", F.least("label", further).alias("label")), parts))
        done = jumped.filter("label <> old").isEmpty()
        labels = jumped.select("node", "label")
        if done:
            return labels
