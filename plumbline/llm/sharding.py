"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix (native).

Every row gets a source (a hash of its row number, so that neither a hot key nor repeated rows make a
source large). How many rows each source sends to each shard is drawn exactly from the law that a uniform
shuffle has: the multivariate hypergeometric law, by halving the range of sources again and again. Each
source permutes its rows locally and deals them by its line of the matrix; after the exchange each shard
permutes what it got. Shard sizes are exact: they differ by one row at most (law ``rows``).

Defined results: a null text has size 1 and the checksum of no bytes; null or repeated ids and repeated rows
are rows like others; an empty table gives an empty result; other columns of the input are not looked at.
Equal texts form no group here: a uniform shuffle places every row by itself.

Only matrices of numbers are broadcast: at most MAX_SOURCES x shards rows, whatever the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import durable, unit_uniform

#: Rows that a source holds, the least and most sources; the most bounds what is broadcast.
SOURCE_ROWS, MIN_SOURCES, MAX_SOURCES = 250_000, 64, 32_768


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _let(value: Column, body) -> Column:
    """body of value, with value computed once."""
    return F.transform(F.array(value), body)[0]


def _fields(x: Column, *names: str) -> list[Column]:
    return [x[n].alias(n) for n in names]


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` rows out of ``total`` are among the ``good`` ones: the quantile of u.

    The law is summed around its mode, ten standard deviations each way at least; weights come from the
    ratio of neighbours, so no factorials are needed.
    """
    real = lambda x: x.cast("double")

    def bounds(p: Column) -> Column:
        t, g, d = real(p["t"]), real(p["g"]), real(p["d"])
        mode = F.floor((d + 1) * (g + 1) / (t + 2)).cast("long")
        spread = F.sqrt(F.greatest(F.lit(0.0), d * g / F.greatest(F.lit(1.0), t) * (1 - g / F.greatest(F.lit(1.0), t)) * (t - d) / F.greatest(F.lit(1.0), t - 1)))
        reach = F.ceil(spread * 10).cast("long") + 12
        lowest, highest = F.greatest(F.lit(0).cast("long"), p["d"] + p["g"] - p["t"]), F.least(p["d"], p["g"])
        return F.struct(
            *_fields(p, "t", "g", "d", "u"),
            F.greatest(lowest, F.least(mode, highest) - reach).alias("low"),
            F.least(highest, F.greatest(mode, lowest) + reach).alias("high"),
        )

    def step(p: Column, a: Column, k: Column) -> tuple[Column, Column]:
        """The weight of k + 1, and the sum with that of k."""
        t, g, d, k = real(p["t"]), real(p["g"]), real(p["d"]), real(k)
        return (a["w"] * (g - k) * (d - k) / ((k + 1) * F.greatest(F.lit(1.0), t - g - d + k + 1))).alias("w"), (a["sum"] + a["w"]).alias("sum")

    start = (F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))

    def with_goal(p: Column) -> Column:
        whole = F.aggregate(F.sequence(p["low"], p["high"]), F.struct(*start), lambda a, k: F.struct(*step(p, a, k)), lambda a: a["sum"])
        return F.struct(*_fields(p, "t", "g", "d", "low", "high"), (whole * p["u"]).alias("goal"))

    def pick(p: Column) -> Column:
        def on(a: Column, k: Column) -> Column:
            w, total_weight = step(p, a, k)
            return F.struct(w, total_weight, F.when(a["sum"] + a["w"] <= p["goal"], F.least(k + 1, p["high"])).otherwise(a["k"]).alias("k"))

        return F.aggregate(F.sequence(p["low"], p["high"]), F.struct(*start, p["low"].alias("k")), on, lambda a: a["k"])

    given = F.struct(total.alias("t"), good.alias("g"), draws.alias("d"), u.alias("u"))
    return _let(given, lambda p: _let(bounds(p), lambda q: _let(with_goal(q), pick)))


def _left_room(room: Column, left_rows: Column, shards: int, *key: Column) -> Column:
    """Of each shard's room, what the left half of the sources fills: drawn one shard after another."""
    long = lambda x: F.lit(x).cast("long")
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        F.struct(F.array().cast("array<long>").alias("out"), left_rows.alias("draws"), F.aggregate(room, long(0), lambda a, x: a + x).alias("total")),
        lambda a, s: _let(
            F.struct(*_fields(a, "out", "draws", "total"), room[s].alias("room"), hypergeometric(a["total"], room[s], a["draws"], unit_uniform(*key, s)).alias("k")),
            lambda b: F.struct(F.array_append(b["out"], b["k"]).alias("out"), (b["draws"] - b["k"]).alias("draws"), (b["total"] - b["room"]).alias("total")),
        ),
        lambda a: a["out"],
    )


def communication_matrix(counts: DataFrame, sizes: list[int], sources: int, seed: int) -> DataFrame:
    """Rows (source, shard, sent): the exact number of rows that each source deals to each shard.

    counts: (source, n); sources is a power of two, at most MAX_SOURCES. A node of the halving is a range of
    sources with what is left of every shard's room; its left half's part of each shard is drawn, and the
    right half gets the rest.
    """
    by_source = counts.sparkSession.range(sources).select(F.col("id").alias("source")).join(counts, "source", "left")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))), lambda x: x["n"])
    nodes = by_source.agg(rows.alias("rows")).select(F.lit(0).cast("long").alias("first"), "rows", F.array(*[F.lit(s).cast("long") for s in sizes]).alias("room"))
    width = sources
    while width > 1:
        half = width // 2
        left = nodes.withColumn("left_rows", F.aggregate(F.slice("rows", 1, half), F.lit(0).cast("long"), lambda a, x: a + x))
        drawn = left.withColumn("left_room", _left_room(F.col("room"), F.col("left_rows"), len(sizes), F.lit(seed), F.lit(width), F.col("first")))
        nodes = drawn.select(F.inline(F.array(
            F.struct(F.col("first"), F.slice("rows", 1, half).alias("rows"), F.col("left_room").alias("room")),
            F.struct((F.col("first") + half).alias("first"), F.slice("rows", half + 1, half).alias("rows"), F.zip_with("room", "left_room", lambda a, b: a - b).alias("room")),
        )))
        width = half
        if sources > 256 and width == sources // 64:
            nodes = nodes.repartition(64, "first")
    return nodes.select(F.col("first").alias("source"), F.posexplode("room").alias("shard", "sent"))


def uniform_shards(docs: DataFrame, shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 20) -> DataFrame:
    """Every row's shard (0 to shards - 1) and slot (gapless from 0 in its shard): a uniform shuffle.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null: law ``rows``, not ``key``).
    """
    text = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    rows = durable(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("row"),
    ))
    n = rows.count()
    sources = MIN_SOURCES
    while sources < MAX_SOURCES and sources * SOURCE_ROWS < n:
        sources *= 2
    rows = rows.withColumn("source", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(sources)))
    matrix = durable(communication_matrix(rows.groupBy("source").agg(F.count("*").alias("n")), shard_sizes(n, shards), sources, seed))
    # Where each shard's part of a source's permuted rows begins and ends.
    ends = matrix.withColumn("end", F.sum("sent").over(Window.partitionBy("source").orderBy("shard")))
    lines = ends.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "end"))), lambda x: x["end"]).alias("ends"))
    local = rows.withColumn("at", F.row_number().over(Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "row"), "row")))
    dealt = local.join(F.broadcast(lines), "source").withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("at"))).cast("int"))
    # The exchange: a shard is cut into cells, each row into one at random; cells stand one behind the other.
    cells = max(4, sources // shards)
    dealt = dealt.withColumn("cell", F.pmod(F.xxhash64(F.lit(seed + 2), "row"), F.lit(cells)).cast("int")).select("doc_id", "size", "text_crc32", "row", "shard", "cell")
    dealt = durable(dealt)
    before = dealt.groupBy("shard", "cell").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).drop("n")
    placed = dealt.withColumn("slot", F.row_number().over(Window.partitionBy("shard", "cell").orderBy(F.xxhash64(F.lit(seed + 3), "row"), "row")) - 1)
    return placed.join(F.broadcast(before), ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("slot") + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
