"""Quality classifier: gradient-boosted trees over document statistics, grown on histograms.

A document is FEATURES numbers, counted over its whole text in numpy, many texts at once: sizes, kinds of
characters and words, repetition of words, of three-word runs and of lines. The driver gets the statistics, never the texts, of a
sample of labelled rows (at most MAX_EACH of either label, those with the smallest hashes of their ids, weighted
back to the labels' shares), the only bound here. Each statistic is put into at most BINS bins by its quantiles;
a tree is grown level by level from sums of gradients by node, statistic and bin. The trees are then flattened
into arrays, one entry for each node, and all rows go down all trees at once by indexing.

Defined results: a null or empty text, and one without words, has statistics, too, and the score that the trees
give them; where labels of one kind only are known every score is that label, and 0.5 without any; repeated rows
score alike; null ids are never learned from; of several texts with one id the first in order is; an empty table
gives an empty result; lang, source, id and labels are no statistics, and other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import ship
from plumbline.llm.spans import number_spans

MAX_EACH = 10_000
BINS, TREES, DEPTH, RATE, PULL, LEAST_WEIGHT = 64, 100, 4, 0.1, 1.0, 5.0
THRESHOLD, SEED = 0.3, 11
#: Bytes of texts worked on at once; a longer text is worked on alone.
AT_ONCE = 2_000_000

#: Kinds of bytes, by their number in KIND.
SPACE, UPPER, LOWER, DIGIT, SYMBOL, STOP, BANG, OTHER, HIGH = range(9)
KIND = np.full(256, OTHER, dtype=np.uint8)
KIND[[0x20, *range(0x09, 0x0E)]] = SPACE
KIND[0x41:0x5B], KIND[0x61:0x7B], KIND[0x30:0x3A], KIND[0x80:] = UPPER, LOWER, DIGIT, HIGH
KIND[list(b"#*$%&|<>{}[]\\^~=_@+")], KIND[list(b".,;:?'\"()-")], KIND[list(b"!")] = SYMBOL, STOP, BANG

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "symbols", "stops", "bangs", "others", "high", "spaces", "capital_words", "symbol_ends", "stop_ends", "plain_words", "no_letter_words",
    "distinct", "distinct_root", "commonest", "same_as_last", "repeated_runs", "lines", "line_words", "same_lines", "short_words", "long_words", "entropy",
)


def _by_text(of: np.ndarray, what: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(of, weights=what, minlength=n)


def _repeats(of: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By text: different keys, the count of the commonest, and keys whose count is two or more."""
    order = np.lexsort((keys, of))
    of, keys = of[order], keys[order]
    first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])]) if len(of) else np.zeros(0, np.int64)
    times, owner = np.diff(np.r_[first, len(of)]), of[first]
    most = np.zeros(n)
    np.maximum.at(most, owner, times)
    return np.bincount(owner, minlength=n).astype(float), most, _by_text(owner, np.where(times > 1, times, 0), n)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; the texts' bytes stand one behind the other at offsets."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    kind, of_byte = KIND[data], np.repeat(np.arange(n), sizes)
    kinds = np.bincount(of_byte * 9 + kind, minlength=n * 9).reshape(n, 9).astype(float)
    inside, cut = kind != SPACE, np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:-1]
    end[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    of, length = of_byte[starts], ends - starts
    words = np.bincount(of, minlength=n).astype(float)
    numbers, _ = number_spans(data, starts, ends)

    upto = np.concatenate([[0], np.cumsum((kind == UPPER) | (kind == LOWER) | (kind == HIGH))])
    letters = upto[ends] - upto[starts]
    uppers = np.concatenate([[0], np.cumsum(kind == UPPER)])
    last = kind[ends - 1] if len(ends) else kind[:0]
    mean = lambda what, by=None: what / np.maximum(1, words if by is None else by)
    share = lambda mask: mean(_by_text(of, mask, n))

    distinct, commonest, _ = _repeats(of, numbers, n)
    same = np.r_[False, (numbers[1:] == numbers[:-1]) & (of[1:] == of[:-1])] if len(of) else np.zeros(0, bool)
    mixed = numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    third = np.flatnonzero(of[2:] == of[:-2]) if len(of) > 2 else np.zeros(0, np.int64)
    runs = (mixed[third] ^ (mixed[third] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (mixed[third + 1] ^ (mixed[third + 1] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + mixed[third + 2]
    repeated = _repeats(of[third], runs, n)[2]

    # Lines: the words between two newlines; a line is known by the sum of its words' mixed numbers by place.
    newlines = np.concatenate([[0], np.cumsum(data == 0x0A)])
    line = newlines[starts]
    new = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (of[1:] != of[:-1])]) if len(of) else np.zeros(0, np.int64)
    place = (np.arange(len(of)) - np.repeat(new, np.diff(np.r_[new, len(of)]))).astype(np.uint64) if len(of) else np.zeros(0, np.uint64)
    known = np.add.reduceat((mixed ^ (mixed >> np.uint64(30))) * (place * np.uint64(2) + np.uint64(0xD6E8FEB86659FD93)), new) if len(new) else np.zeros(0, np.uint64)
    lines = np.bincount(of[new], minlength=n).astype(float)
    same_lines = lines - _repeats(of[new], known, n)[0]

    each = np.bincount(of_byte * 256 + data, minlength=n * 256).reshape(n, 256) / np.maximum(1, sizes)[:, None]
    entropy = -(each * np.log2(np.where(each > 0, each, 1))).sum(axis=1)
    alpha, size = kinds[:, UPPER] + kinds[:, LOWER], sizes.astype(float)
    return np.column_stack([
        np.log1p(size), np.log1p(words), mean(_by_text(of, length, n)), mean(kinds[:, UPPER], alpha), mean(kinds[:, DIGIT], size), mean(kinds[:, SYMBOL]), mean(kinds[:, STOP]), mean(kinds[:, BANG]), mean(kinds[:, OTHER], size),
        mean(kinds[:, HIGH], size), mean(kinds[:, SPACE], size), share((kind[starts] == UPPER) & (uppers[ends] - uppers[starts] == 1)), share(last == SYMBOL), share((last == STOP) | (last == BANG)), share(letters == length), share(letters == 0),
        mean(distinct), distinct / np.sqrt(np.maximum(1, words)), mean(commonest), share(same), mean(repeated), mean(lines), mean(words, lines), mean(same_lines, lines), share(length <= 2), share(length >= 15), entropy,
    ])


@dataclass
class Trees:
    """Flattened trees: for each node the statistic it asks, the value up to which rows go left, the left child (the right
    one is next; a leaf is its own child), and a leaf's value."""

    roots: np.ndarray
    feature: np.ndarray
    limit: np.ndarray
    child: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1; all rows go down all trees together, a level at a time."""
        if not len(self.roots):
            return np.full(len(x), self.base)
        out, rows = np.empty(len(x)), max(1, 2_000_000 // len(self.roots))
        for low in range(0, len(x), rows):
            part = x[low:low + rows]
            at = np.tile(self.roots, (len(part), 1))
            for _ in range(self.depth):
                right = np.take_along_axis(part, self.feature[at], axis=1) > self.limit[at]
                at = np.where(self.child[at] == at, at, self.child[at] + right)
            out[low:low + rows] = self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(self.base + out, -500, 500)))


def constant(p: float) -> Trees:
    none = np.zeros(0, np.int64)
    return Trees(none, none, np.zeros(0), none, np.zeros(0), p, 0)


def bin_limits(column: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Values that divide a statistic into at most so many bins of about equal numbers of rows."""
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))
        return values
    return (values[1:] + values[:-1]) / 2


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, *, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Trees:
    """Boosts the logistic loss by Newton's steps on trees of at most so many levels."""
    if not len(y):
        return constant(0.5)
    share = float((weight * y).sum() / weight.sum())
    if share in (0.0, 1.0):
        return constant(share)
    limits = [bin_limits(x[:, f], bins) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(limits[f], x[:, f], side="left") for f in range(x.shape[1])])
    base = float(np.log(share / (1 - share)))
    score = np.full(len(y), base)
    roots, feature, limit, child, value = [], [], [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = weight * (p - y), weight * p * (1 - p)
        roots.append(len(feature))
        nodes = [len(feature)]  # of the level, by their place among all nodes
        feature.append(0), limit.append(0.0), child.append(roots[-1]), value.append(0.0)
        of = np.zeros(len(y), dtype=np.int64)  # a row's node in the level; -1 once it is in a leaf
        for level in range(depth + 1):
            live = np.flatnonzero(of >= 0)
            g = np.bincount(of[live], weights=grad[live], minlength=len(nodes))
            h = np.bincount(of[live], weights=hess[live], minlength=len(nodes))
            gain, where, cut = np.full(len(nodes), 1e-6), np.full(len(nodes), -1), np.zeros(len(nodes), dtype=np.int64)
            for f in range(x.shape[1]) if level < depth else ():
                if not len(limits[f]):
                    continue
                width = len(limits[f]) + 1
                key = of[live] * width + binned[live, f]
                left_g = np.bincount(key, weights=grad[live], minlength=len(nodes) * width).reshape(-1, width).cumsum(axis=1)[:, :-1]
                left_h = np.bincount(key, weights=hess[live], minlength=len(nodes) * width).reshape(-1, width).cumsum(axis=1)[:, :-1]
                right_g, right_h = g[:, None] - left_g, h[:, None] - left_h
                gains = left_g**2 / (left_h + PULL) + right_g**2 / (right_h + PULL) - (g**2 / (h + PULL))[:, None]
                gains[(left_h < LEAST_WEIGHT / 4) | (right_h < LEAST_WEIGHT / 4)] = 0  # a row has a weight of a quarter at most
                best = gains.argmax(axis=1)
                better = gains[np.arange(len(nodes)), best] > gain
                gain[better], where[better], cut[better] = gains[np.arange(len(nodes)), best][better], f, best[better]
            next_nodes, first_child = [], np.full(len(nodes), -1)
            for i, node in enumerate(nodes):
                if where[i] < 0:
                    value[node] = -rate * g[i] / (h[i] + PULL)
                    continue
                feature[node], limit[node], child[node] = int(where[i]), float(limits[where[i]][cut[i]]), len(feature)
                first_child[i] = len(next_nodes)
                for _ in range(2):
                    next_nodes.append(len(feature))
                    feature.append(0), limit.append(0.0), child.append(len(child)), value.append(0.0)
            own = of[live]
            ended = first_child[own] < 0
            score[live[ended]] += np.array(value)[np.array(nodes)[own[ended]]]
            going = live[~ended]
            of[live[ended]] = -1
            of[going] = first_child[own[~ended]] + (binned[going, where[own[~ended]]] > cut[own[~ended]])
            nodes = next_nodes
            if not nodes:
                break
    return Trees(*[np.array(a, dtype=t) for a, t in ((roots, np.int64), (feature, np.int64), (limit, float), (child, np.int64), (value, float))], base, depth)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(5)) == 0, F.lit(False))


def chunks(text: pa.Array, limit: int = AT_ONCE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Stretches of an Arrow column of texts without nulls: from, to, bytes, offsets."""
    text = text.cast(pa.large_binary())
    if not len(text):
        return
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset:text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)
    low = 0
    while low < len(text):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        yield low, high, data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
        low = high


def with_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for low, high, data, offsets in chunks(batch.column("text")):
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(low, high - low), pa.array(list(statistics(data, offsets)), pa.list_(pa.float64()))], ["label", "x"])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MAX_EACH) -> Trees:
    """Learns from labelled rows that are not held out; the statistics of at most 2 * most texts come to the driver."""
    ship(docs.sparkSession)
    usable = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~is_held_out(F.col("doc_id")))
    once = usable.groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in once.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return constant(float(next(iter(counts), 0.5)))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    sample = once.filter("label = 1").orderBy(*order).limit(most).unionByName(once.filter("label = 0").orderBy(*order).limit(most))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    rows = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text").mapInArrow(with_statistics, "label int, x array<double>").toPandas()
    if not len(rows):
        return constant(0.5)
    x, y = np.stack(rows["x"].tolist()), rows["label"].to_numpy().astype(float)
    order = np.lexsort(np.column_stack([x, y]).T)  # rows come in no fixed order, sums of floats depend on it
    x, y = x[order], y[order]
    weight = np.where(y == 1, counts[1] / max(1, (y == 1).sum()), counts[0] / max(1, (y == 0).sum()))
    return train(x, y, weight / weight.mean())


def score(docs: DataFrame, trees: Trees, *, keys: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The keys and a score for every row of docs; the trees, of bounded size, go to each executor once."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(trees)
    names = list(keys)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column("text")):
                own = [batch.column(k).slice(low, high - low) for k in names]
                yield pa.RecordBatch.from_arrays([*own, pa.array(model.value.scores(statistics(data, offsets)))], [*names, "score"])

    rows = docs.select(*[c.alias(k) for k, c in keys.items()], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(scored, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", score double")


def quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Every row: doc_id, held_out, score, predicted."""
    found = score(docs, fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col), keys={"doc_id": F.col(id_col)}, text_col=text_col)
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
