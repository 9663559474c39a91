"""URL filter: rules first, then the likelihood ratio of two character models.

Urls that a rule decides are the examples: a variable-order Markov model of their characters (bytes, in lower
case) is counted for the accepted and one for the rejected ones, over all such urls. Orders from 0 to MAX_ORDER
are mixed by Witten-Bell smoothing: each falls back on the next shorter one as far as its context has been
followed by new characters. The score of a url is the difference of the log-likelihoods, by character; a fold of
the decided urls that the models have not seen calibrates its threshold.

Counts are exact and grow with the urls. A gram is a character with the MAX_ORDER before it, packed into a long;
the shorter orders' counts are sums over grams that end alike. Every gram that is counted or asked for gets its
value, level by level: a context is followed by 256 characters and a gram extended to the left by 256 at most, so
no key of these joins is hot. Urls then meet the values of their distinct grams; grams that stand in more than one
in HOT of all such rows (HOT at most) are broadcast.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule; a null or empty url
has score 0 and is allowed; where rules decide no urls of one kind, every other url is allowed; repeated rows are
judged alike; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import durable, parts_for, ship

#: Longest context (a gram must fit into a long); the share of decided urls kept for calibration; bins of scores; see above.
MAX_ORDER, CALIBRATION_FOLDS, BINS, HOT = 4, 8, 4000, 1024
SCORE_RANGE = 8.0
#: Steps of a value of 1; urls of up to ten million characters add up without overflow.
FINE = 1 << 34
#: Bytes that stand before and behind each url, and the probability of any character before anything is known.
BEGIN, END, BLIND = b"\x02", b"\x03", 1 / 257


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ://, else nothing."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as written, and its verdict; null if none fits. rules: (verdict, host, path)."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(found), F.when(fits, F.lit(says)).otherwise(verdict)
    return found, verdict


def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each url's distinct grams (the character in the lowest byte, the one before it above, and so on) and their numbers."""
    for batch in batches:
        coded = [BEGIN * MAX_ORDER + u.lower().encode("utf-8", "replace") + END for u in batch["url"]]
        lengths = np.array([len(c) for c in coded], dtype=np.int64)
        flat = np.frombuffer(b"".join(coded), dtype=np.uint8).astype(np.int64)
        starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
        real = np.flatnonzero(np.arange(len(flat)) - starts >= MAX_ORDER)
        gram, of = np.zeros(len(real), dtype=np.int64), np.repeat(np.arange(len(coded)), lengths)[real]
        for order in range(MAX_ORDER + 1):
            gram |= flat[real - order] << (8 * order)
        order = np.lexsort((gram, of))
        gram, of = gram[order], of[order]
        first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])])) if len(gram) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(gram)))
        yield pd.DataFrame({"row": batch["row"].to_numpy(dtype=np.int64)[of[first]], "gram": gram[first], "n": n})


def gram_values(counted: DataFrame, asked: DataFrame) -> DataFrame:
    """Every gram of either: gram, value (log p(rejected) - log p(accepted)). counted: gram, n0, n1 (accepted, rejected)."""
    spark = counted.sparkSession
    sums = [F.sum(c).alias(c) for c in ("n0", "n1")]
    zero = F.lit(0).cast("long")
    both = counted.select("gram", "n0", "n1").unionByName(asked.select("gram", zero.alias("n0"), zero.alias("n1")))
    levels = [durable(both.groupBy("gram").agg(*sums))]
    parts = parts_for(spark, levels[0].count())
    for order in range(MAX_ORDER - 1, -1, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1).cast("long"))
        levels.append(durable(levels[-1].groupBy(shorter.alias("gram")).agg(*sums), parts))
    known = None
    for order, level in enumerate(reversed(levels)):
        context = Window.partitionBy(F.shiftright("gram", 8))
        table = level.select(
            "gram", "n0", "n1", *[F.sum(f"n{k}").over(context).alias(f"all{k}") for k in (0, 1)],
            *[F.sum((F.col(f"n{k}") > 0).cast("long")).over(context).alias(f"followers{k}") for k in (0, 1)],
        )
        if known is None:
            table = table.withColumns({"below0": F.lit(BLIND), "below1": F.lit(BLIND)})
        else:
            below = known.select(F.col("gram").alias("end"), F.col("p0").alias("below0"), F.col("p1").alias("below1"))
            table = table.join(below, F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1).cast("long")) == F.col("end"))
        mixed = lambda k: F.when(F.col(f"all{k}") > 0, (F.col(f"n{k}") + F.col(f"followers{k}") * F.col(f"below{k}")) / (F.col(f"all{k}") + F.col(f"followers{k}"))).otherwise(F.col(f"below{k}"))
        known = durable(table.select("gram", mixed(0).alias("p0"), mixed(1).alias("p1")), None if order == MAX_ORDER else parts)
    return known.select("gram", (F.log("p1") - F.log("p0")).alias("value"))


def url_scores(held: DataFrame, values: DataFrame) -> DataFrame:
    """row, score: the mean value of a url's characters. held: row, gram, n; values: gram, value."""
    total = held.count()
    hot = held.groupBy("gram").agg(F.count("*").alias("rows")).filter(F.col("rows") * HOT > total).select("gram")
    hot_values = durable(values.join(F.broadcast(hot), "gram").withColumnRenamed("value", "hot_value"), 1)
    # Hot grams get keys below all grams, which meet nothing.
    keyed = held.join(F.broadcast(hot_values), "gram", "left").withColumn("key", F.when(F.col("hot_value").isNull(), F.col("gram")).otherwise(-1 - F.col("row")))
    valued = keyed.join(values.select(F.col("gram").alias("key"), "value"), "key", "left").withColumn("value", F.coalesce("hot_value", "value"))
    # In whole steps: their sum does not depend on the order in which rows come.
    steps = F.round(F.col("value") * FINE).cast("long")
    return valued.groupBy("row").agg((F.sum(F.col("n") * steps) / FINE / F.sum("n")).alias("score"))


def threshold_of(histogram: pd.DataFrame) -> float:
    """The score from which rejecting makes the fewest errors, both kinds weighing alike. histogram: kind, bin, n."""
    sums = np.zeros((2, BINS))
    sums[histogram["kind"].to_numpy(dtype=np.int64), histogram["bin"].to_numpy(dtype=np.int64)] = histogram["n"].to_numpy()
    if not sums[0].sum() or not sums[1].sum():
        return float("inf")
    wrongly_kept = np.concatenate([[0], np.cumsum(sums[1])]) / sums[1].sum()  # with the threshold at bin i
    wrongly_dropped = 1 - np.concatenate([[0], np.cumsum(sums[0])]) / sums[0].sum()
    errors = wrongly_kept + wrongly_dropped
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    return (best[0] + best[-1]) / 2 / BINS * 2 * SCORE_RANGE - SCORE_RANGE


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Every row: page_id, host, path, rule, verdict, url_score (null where a rule decides)."""
    ship(pages.sparkSession)
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    parts = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"), F.monotonically_increasing_id().alias("row"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    held_out = F.pmod(F.xxhash64("url"), F.lit(CALIBRATION_FOLDS)) == 0
    ruled = durable(parts.select("*", rule.alias("rule"), says.alias("says"), held_out.alias("held")))
    teaches = F.col("says").isNotNull() & ~F.col("held")
    counts = ruled.filter(teaches).select("row", "url").mapInPandas(grams, "row long, gram long, n long").join(ruled.select("row", "says"), "row")
    of_kind = lambda says: F.sum(F.when(F.col("says") == says, F.col("n")).otherwise(0)).alias("n1" if says == "block" else "n0")
    counted = durable(counts.groupBy("gram").agg(of_kind("allow"), of_kind("block")))
    asked = durable(ruled.filter(~teaches & (F.col("url") != "")).select("row", "url").mapInPandas(grams, "row long, gram long, n long"))
    scores = durable(url_scores(asked, gram_values(counted, asked.select("gram").distinct())))
    calibrating = scores.join(ruled.filter(F.col("says").isNotNull() & F.col("held")).select("row", "says"), "row")
    place = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("score") + SCORE_RANGE) / (2 * SCORE_RANGE) * BINS)))
    threshold = threshold_of(calibrating.groupBy((F.col("says") == "block").cast("int").alias("kind"), place.alias("bin")).agg(F.count("*").alias("n")).toPandas())
    judged = ruled.join(scores, "row", "left").withColumn("url_score", F.when(F.col("says").isNull(), F.coalesce("score", F.lit(0.0))))
    verdict = F.coalesce("says", F.when((F.col("url") != "") & (F.col("url_score") >= threshold), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "url_score")
