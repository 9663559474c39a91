"""Rate-limit holds by host: a gate is open until a provider refuses, and then closed for as long as it asked.

A refusal at a time holds its host from then on for its Retry-After (seconds, or a date), at most 60 seconds; one that
names no time holds for 5 seconds. Holds that meet are one, which a later refusal extends and never shortens. A host
with most of the refusals is worked on in ranges of its time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ranges import Ranges, durable

#: Fixed values, in seconds: the longest hold, and that of a refusal which names no time.
LONGEST, BARE = 60, 5


def retry_after(header: Column, at: Column) -> Column:
    """Microseconds to hold: of a number of seconds, or of a date less at; a past date holds for none. A header that is
    absent, negative or neither of the two is that of a bare refusal."""
    date = F.try_to_timestamp(F.regexp_extract(header, r"^[A-Z][a-z]{2}, ([0-9]{2} [A-Z][a-z]{2} [0-9]{4} [0-9:]{8}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    seconds = F.when(header.rlike(r"^[+]?[0-9]{1,18}$"), F.least(header.cast("long"), F.lit(LONGEST)) * 1_000_000)
    until = F.unix_micros(date) - F.unix_micros(at)
    return F.coalesce(seconds, F.when(until.isNotNull(), F.greatest(F.least(until, F.lit(LONGEST * 1_000_000)), F.lit(0))), F.lit(BARE * 1_000_000)).cast("long")


def holds(refusals: DataFrame, host: str = "host", at: str = "at", header: str = "retry_after") -> DataFrame:
    """(host, held_from, held_until, refusals): disjoint holds that do not touch; held_until is open. A refusal that holds for no
    time makes none, and neither does one without a time; hosts are told apart in lower case, without an ending dot."""
    name = F.regexp_replace(F.lower(F.coalesce(F.col(host), F.lit(""))), r"\.$", "")
    each = refusals.filter(F.col(at).isNotNull()).select(name.alias("host"), F.unix_micros(at).alias("low"), retry_after(F.col(header), F.col(at)).alias("wait"))
    each = each.filter("wait > 0").select("host", "low", (F.col("low") + F.col("wait")).alias("high"))
    reached = Ranges(each, ["host"], ["low", "high"]).largest_before("reached", F.col("high"), place=True)
    started = durable(reached.withColumn("starts", (F.col("reached").isNull() | (F.col("low") > F.col("reached"))).cast("long")))
    numbered = Ranges(started, ["host"], ["place_"]).total_before("before", F.col("starts"))
    merged = numbered.withColumn("hold", F.col("before") + F.col("starts")).groupBy("host", "hold").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("refusals"))
    return merged.select("host", F.timestamp_micros("low").alias("held_from"), F.timestamp_micros("high").alias("held_until"), "refusals")


def waits(requests: DataFrame, held: DataFrame, host: str = "host", at: str = "at") -> DataFrame:
    """requests with waited_us: how long a request that comes at a time waits for its host, 0 where the gate is open.

    Each request meets the hold of its host that began last before it, by one pass along time: holds and requests are
    sorted together, so no request is compared with all holds of its host."""
    name = F.regexp_replace(F.lower(F.coalesce(F.col(host), F.lit(""))), r"\.$", "")
    data = F.struct(*[F.col(f"`{c}`") for c in requests.columns])
    ask = requests.select(name.alias("host_"), F.unix_micros(at).alias("at_"), F.lit(1).alias("asks_"), F.lit(None).cast("long").alias("until_"), data.alias("data_"))
    empty = F.lit(None).cast(ask.schema["data_"].dataType)
    gate = held.select(F.col("host").alias("host_"), F.unix_micros("held_from").alias("at_"), F.lit(0).alias("asks_"), F.unix_micros("held_until").alias("until_"), empty.alias("data_"))
    along = Ranges(ask.unionByName(gate), ["host_"], ["at_", "asks_"]).largest_before("reached_", F.col("until_"))
    waited = F.greatest(F.coalesce(F.col("reached_") - F.col("at_"), F.lit(0)), F.lit(0))
    return along.filter("asks_ = 1").select("data_.*", waited.alias("waited_us"))
