"""Merkle dataset manifest with parent-preimage paths.

Every row is a leaf: the digest of its fields, each written as its length in bytes, a colon and the value, or as
a dash if null. Within a group the leaves stand in the order of their ids; each run of FANOUT consecutive nodes
becomes the digest of its digests, until one node, the group's root, is left. The groups' roots make the last
tree in the same way. What is stored for a parent is its preimage, the digests of its children one behind the
other. A leaf joins the preimages of its ancestors: cutting its own 64 characters out of each leaves its
siblings, the proof; putting another digest in that place and hashing upwards folds the proof to a root.

Trees are built by blocks of FANOUT ** DEPTH consecutive nodes, whose preimages of DEPTH levels are one row; the
blocks' tops are the nodes of the next round. Leaves are numbered by a sort into ranges with the counts of
earlier ranges added, so a group with most of the rows is spread over all tasks; a leaf meets its path by its
block and no path is ever shuffled for each leaf. The text is read once, for its digests.

Defined results: null fields differ from empty ones; null ids come first in their group, and rows with one id in
the order of their digests; the null group is a group, before all others; a row that is alone in its group is
the group's root, and a table of one row has that row's digest as its root; repeated rows are leaves of their
own; an empty table gives an empty result; columns that are not named as fields are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import durable, parts_for

FANOUT, DEPTH = 3, 5
WIDTH = FANOUT**DEPTH
HEX = 64
NO_PATH = "CAST(array() AS array<struct<preimage: string, slot: int>>)"


def digest_of(fields: Sequence[Column]) -> Column:
    """The leaf of a row with these fields."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def group_key(group: Column) -> Column:
    """A text that is never null and sorts like the group, null first."""
    return F.coalesce(F.concat(F.lit("g"), group.cast("string")), F.lit(""))


def with_places(rows: DataFrame, order: Sequence[str], parts: int) -> DataFrame:
    """rows with their place in their tree, from 0 in the given order; no tree has to fit one task."""
    tied = rows.withColumn("tie", F.monotonically_increasing_id())  # so that equal rows, too, are dealt to several ranges
    in_order = durable(tied.repartitionByRange(parts, "tree", *order, "tie").sortWithinPartitions("tree", *order).drop("tie"))
    at = F.monotonically_increasing_id()  # the range's number in the upper bits, the row's place in the range in the lower 33
    in_order = in_order.withColumn("at", at).withColumn("range", F.shiftright("at", 33))
    runs = in_order.groupBy("range", "tree").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("range", "tree", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    return in_order.join(runs, ["range", "tree"]).withColumn("place", F.col("at") + F.col("shift")).drop("at", "range", "shift")


def build(nodes: DataFrame, carried: Sequence[str] = ()) -> list[DataFrame]:
    """The blocks of each round, lowest first, until every tree (column tree) is one block: tree, block, items (place,
    digest and what is carried), levels (the preimages, by level) and top (the digest above the block)."""
    rounds = []
    while True:
        item = F.struct("place", "digest", *carried)
        blocks = nodes.groupBy("tree", F.expr(f"place div {WIDTH}").alias("block")).agg(F.sort_array(F.collect_list(item)).alias("items")).withColumn("digests", F.col("items.digest"))
        for level in range(DEPTH):
            alone = (F.col("block") == 0) & (F.size("digests") == 1)  # all that is left of the tree
            runs = F.sequence(F.lit(0), F.expr(f"CAST((size(digests) - 1) div {FANOUT} AS INT)"))
            preimages = F.transform(runs, lambda i: F.array_join(F.slice("digests", i * FANOUT + 1, F.lit(FANOUT)), ""))
            blocks = blocks.withColumn(f"level_{level}", F.when(alone, F.array().cast("array<string>")).otherwise(preimages))
            above = F.transform(f"level_{level}", lambda p: F.sha2(p, 256))
            blocks = blocks.withColumn("digests", F.when(F.size(f"level_{level}") == 0, F.col("digests")).otherwise(above))
        blocks = durable(blocks.select("tree", "block", "items", F.array(*[f"level_{i}" for i in range(DEPTH)]).alias("levels"), F.col("digests")[0].alias("top")))
        rounds.append(blocks)
        if blocks.filter("block > 0").isEmpty():
            return rounds
        nodes, carried = blocks.select("tree", F.col("block").alias("place"), F.col("top").alias("digest")), ()


def paths(blocks: DataFrame, above: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Each item of the blocks with its path, lowest ancestor first: preimage and slot. above: tree, block, path, and
    columns that all items of the block get."""
    own = [c for c in above.columns if c not in ("tree", "block", "path")]

    def with_path(x: Column) -> Column:
        steps, at = [], F.pmod(x["place"], F.lit(WIDTH)).cast("int")
        for level in range(DEPTH):
            preimages = F.col("levels")[level]
            step = F.struct(F.get(preimages, F.floor(at / FANOUT ** (level + 1)).cast("int")).alias("preimage"), F.pmod(F.floor(at / FANOUT**level).cast("int"), F.lit(FANOUT)).alias("slot"))
            steps.append(F.when(F.size(preimages) > 0, F.array(step)).otherwise(F.expr(NO_PATH)))
        return F.struct(*[x[c].alias(c) for c in ("place", "digest", *carried)], F.concat(*steps, F.col("path")).alias("path"))

    return blocks.join(above, ["tree", "block"]).select("tree", *own, F.inline(F.transform("items", with_path)))


def descend(rounds: Sequence[DataFrame], above: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """The lowest round's items with their paths; above: the paths of the highest round's blocks."""
    own = [c for c in above.columns if c not in ("tree", "block", "path")]
    for blocks in reversed(rounds[1:]):
        above = paths(blocks, above).select("tree", F.col("place").alias("block"), "path", *own)
    return paths(rounds[0], above, carried)


def siblings(step: Column) -> Column:
    """A preimage without the characters of the slot."""
    return splice(step, F.lit(""))


def splice(step: Column, digest: Column) -> Column:
    """A preimage with digest in the slot."""
    before, size = step["preimage"].substr(F.lit(1), step["slot"] * HEX), F.lit(FANOUT * HEX)
    return F.concat(before, digest, step["preimage"].substr(step["slot"] * HEX + HEX + 1, size))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings, level by level."""
    return F.sha2(F.array_join(F.transform(path, siblings), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of a path give."""
    return F.aggregate(path, leaf, lambda digest, step: F.sha2(splice(step, digest), 256))


def manifest(docs: DataFrame, *, id_col: str = "doc_id", group_col: str = "source", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), found: dict[str, Column] | None = None) -> DataFrame:
    """Every row: id, group, leaf, path, subroot, root, proof_sha256, folded_root, verified.

    found: for some of the fields, what is found now in place of what the manifest was made of; that row is folded with the
    manifest's siblings, and verified says whether it gives the root."""
    now = [(found or {}).get(f, F.col(f)) for f in fields]
    leaves = durable(docs.select(F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("group"), group_key(F.col(group_col)).alias("tree"), digest_of([F.col(f) for f in fields]).alias("digest"), digest_of(now).alias("claim")))
    n = leaves.count()
    spark = leaves.sparkSession
    parts = parts_for(spark, n)
    carried = ("id", "group", "claim")
    trees = build(with_places(leaves, ["id", "digest"], parts), carried)
    roots = trees[-1].select("tree", F.col("top").alias("digest"))
    # The groups' roots are the leaves of the last tree; their own tree is remembered as member.
    top_nodes = with_places(roots.select(F.lit("").alias("tree"), F.col("tree").alias("member"), "digest"), ["member"], parts)
    top = build(top_nodes, ("member",))
    root = top[-1].select("top").first()
    start = top[-1].select("tree", "block", F.expr(NO_PATH).alias("path"))
    above = descend(top, start, ("member",)).select(F.col("member").alias("tree"), F.lit(0).cast("long").alias("block"), "path", F.col("digest").alias("subroot"))
    rows = descend(trees, above, carried)
    rows = rows.select("id", "group", F.col("digest").alias("leaf"), "path", "subroot", F.lit(root["top"] if root else None).cast("string").alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), fold(F.col("claim"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
