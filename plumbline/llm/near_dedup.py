"""Near-duplicate groups by order MinHash, verified by banded alignment.

A text is its row of five-word shingles (words between white space, lower case). Two texts are near copies when
their best alignment, which keeps order, has a common shingles and a / (n + m - a) >= 0.8, n and m being their
numbers of shingles: the Jaccard similarity of shingles where copies differ by edits in place.

Order MinHash: shingles are labelled by occurrence; each of SKETCHES hash functions chooses the PICKED labelled
shingles with the smallest values and keeps them in the order they have in the text. Texts that agree on a
sketch are candidates. Two texts of many shingles at 0.8 agree on a sketch with probability 0.41, so on none of 16
with 2 in 10,000. It would be more for texts of few shingles, so these have an exact way besides: each also goes by its
labelled shingles that come first by their values, so many that near texts must share one of them.

Texts with the same words are one from the start. Candidates form components; inside each, alignments decide:

- components of up to LOCAL texts (and LOCAL_SHINGLES) are settled in one task each, every pair that still matters;
- larger ones first lose most of their texts to a few pivots, which are aligned with all texts that have no link
  yet, by joins that spread a component over tasks; while more than LOCAL texts have none, there are rounds with
  more pivots. Pivots are the texts that agree with most others, since the copies of a text may be near it and not
  each other; half of them are texts that have got links, so that groups grow along chains. Then texts whose
  groups still differ are aligned, all pairs that can be near: those that share one of the labelled shingles that
  come first when the ones of a single group lead, then the rarest (bridges).

No pair is cut off: two texts of a component are left out only when they are in one group already or have too few
shingles in common. Groups are the components of the links; copies are never expanded into pairs.

Defined results: a null text is an empty one; texts without words are copies of each other; a text of fewer
than five words has one shingle of all its words; repeated rows are copies; of a group the row with the
smallest id stays (null ids last, then by place); an empty table gives an empty result; other columns are not
looked at. Without row_col, docs is read once, numbered and written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import durable, memory_back, numbered, only_rows, parts_for, ship, small_batches, spare_name, unestimated, without_rows
from plumbline.llm.components import components, with_facts

SHINGLE, SKETCHES, PICKED = 5, 16, 4
#: Pairs of texts of so many shingles at most, the smaller one's number, are candidates for certain.
FEW = 20
#: Texts that one task settles at most, and their shingles; texts of a part in a meeting; pivots of the first round, and
#: how their number grows from round to round.
LOCAL, LOCAL_SHINGLES, PART, PIVOTS, GROWTH = 2048, 1_000_000, 256, 64, 16

_BASE = 0x9E3779B97F4A7C15 | 1
_SEEDS = np.random.default_rng(9).integers(1, 1 << 63, SKETCHES, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of _BASE and of its inverse, modulo 2 ** 64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def word_codes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word."""
    raw = np.frombuffer((text or "").lower().encode("utf-8", "replace"), dtype=np.uint8)
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    forward, inverse = _power_tables(len(raw) + 1)
    weighed = np.where(inside, raw.astype(np.uint64) + np.uint64(1), np.uint64(0)) * forward[:len(raw)]
    return _mix(np.add.reduceat(weighed, starts) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray) -> np.ndarray:
    width = min(SHINGLE, len(words))
    if not width:
        return np.zeros(0, np.uint64)
    n = len(words) - width + 1
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[k:k + n]
    return _mix(h)


def labelled(codes: np.ndarray) -> np.ndarray:
    """Codes mixed with the number of the occurrence, so that all differ."""
    order = np.argsort(codes, kind="stable")
    ordered = codes[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    at = np.arange(len(codes))
    nth = np.empty(len(codes), np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return _mix(codes + nth * np.uint64(0x9E3779B97F4A7C15))


def order_minhash(codes: np.ndarray) -> np.ndarray:
    """SKETCHES hashes, each of the PICKED smallest labelled codes in the order of the text."""
    own = labelled(codes)
    values = _mix(own[None, :] * _SEEDS[:, None] + (_SEEDS[:, None] >> np.uint64(7)))
    k = min(PICKED, len(own))
    chosen = np.sort(np.argpartition(values, k - 1, axis=1)[:, :k], axis=1) if k < len(own) else np.broadcast_to(np.arange(k), (SKETCHES, k))
    h = np.full(SKETCHES, k, np.uint64)
    for i in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + own[chosen[:, i]]
    return _mix(h)


def first_shingles(codes: np.ndarray) -> np.ndarray:
    """The labelled codes of a text of few shingles that come first by value, one of which every near text shares: near
    texts have four fifths of the codes of each in common, and n - ceil(4n / 5) + 1 are one more than may be missing.
    Near texts of FEW shingles have FEW * 5 / 4 at most; longer texts give none."""
    n = len(codes)
    return np.sort(labelled(codes))[:n - -(-4 * n // 5) + 1] if n <= FEW * 5 // 4 else np.zeros(0, np.uint64)


def sketch_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        digests, sketches, sizes = [], [], []
        for text in batch["text"].tolist():
            words = word_codes(text)
            codes = shingles(words)
            digests.append(hashlib.blake2b(words.tobytes(), digest_size=16).digest())
            sketches.append(np.concatenate([order_minhash(codes), first_shingles(codes)]).view(np.int64).tolist() if len(words) else [])
            sizes.append(max(0, min(len(words), len(words) - SHINGLE + 1)) or int(len(words) > 0))
        yield pd.DataFrame({"row": batch["row"], "doc_id": batch["doc_id"], "digest": digests, "size": sizes, "sketch": sketches})


def payload_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts as four bytes of each shingle."""
    for batch in batches:
        yield pd.DataFrame({"node": batch["node"], "group": batch["group"], "size": batch["size"], "weight": batch["weight"], "is_large": batch["is_large"], "body": [shingles(word_codes(t)).astype(np.uint32).tobytes() for t in batch["text"].tolist()]})


def similar_enough(common, n, m):
    """common / (n + m - common) >= 0.8, in whole numbers or arrays of them."""
    return 9 * common >= 4 * (n + m)


class Texts:
    """Texts' shingles, ready to be compared: postings tell which texts hold a labelled shingle."""

    def __init__(self, bodies: list[bytes]) -> None:
        self.codes = [np.frombuffer(b, dtype=np.uint32) for b in bodies]
        self.n = np.array([len(c) for c in self.codes], dtype=np.int64)
        bags = [labelled(c.astype(np.uint64)) if len(c) else np.zeros(0, np.uint64) for c in self.codes]
        flat = np.concatenate(bags) if bags else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.keys, self.holders = flat[order], np.repeat(np.arange(len(bags)), self.n)[order]
        self.bags = bags

    def alike(self, other: Texts, i: int) -> np.ndarray:
        """Those of our texts with so many shingles in common with other's text i that an alignment may reach the similarity."""
        low, high = np.searchsorted(self.keys, other.bags[i], "left"), np.searchsorted(self.keys, other.bags[i], "right")
        sizes = high - low
        places = np.repeat(low - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        common = np.bincount(self.holders[places], minlength=len(self.n))
        return np.flatnonzero(similar_enough(common, self.n, other.n[i]))

    def near(self, j: int, other: Texts, i: int) -> bool:
        a, b = self.codes[j], other.codes[i]
        if len(a) == len(b) and np.array_equal(a, b):
            return True
        a, b = (a, b) if len(a) <= len(b) else (b, a)
        return similar_enough(banded_alignment(a.tolist(), b.tolist(), (len(a) + len(b)) // 9), len(a), len(b))


def banded_alignment(a: list[int], b: list[int], band: int) -> int:
    """The most common codes of any alignment that stays within band places of the diagonal.

    Near copies differ by (n + m) / 9 insertions and deletions at most, so a band of that width decides them.
    A row of the table is one number with a bit for each place in a.
    """
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b, common = a[low:len(a) - high], b[low:len(b) - high], low + high
    if not a or not b:
        return common
    places: dict[int, int] = {}
    for i, code in enumerate(a):
        places[code] = places.get(code, 0) | 1 << i
    whole = (1 << len(a)) - 1
    window, row = (1 << (2 * band + 1)) - 1, whole
    for j, code in enumerate(b):
        match = places.get(code)
        if match:
            shift = j - band
            match &= window << shift if shift >= 0 else window >> -shift
            u = row & match
            row = ((row + u) | (row - u)) & whole
    return common + len(a) - row.bit_count()


def settle(group: pd.DataFrame) -> pd.DataFrame:
    """Links among a component's texts: each text with the first of its group."""
    group = group.sort_values("node")
    nodes, texts = group["node"].tolist(), Texts(group["body"].tolist())
    root = np.arange(len(nodes))
    for i in range(len(nodes)):
        if (root[i + 1:] == root[i]).all():
            continue
        for j in texts.alike(texts, i).tolist():
            if j > i and root[i] != root[j] and texts.near(j, texts, i):
                first, other = sorted((root[i], root[j]))
                root[root == other] = first
    return pd.DataFrame([(nodes[i], nodes[r]) for i, r in enumerate(root.tolist()) if r != i], columns=["a", "b"]).astype("int64")


class Joined:
    """Which names have been linked, directly or through others."""

    def __init__(self) -> None:
        self.root: dict[int, int] = {}

    def first(self, name: int) -> int:
        while (up := self.root.setdefault(name, name)) != name:
            self.root[name] = self.root[up]
            name = up
        return name

    def link(self, a: int, b: int) -> None:
        self.root[self.first(a)] = self.first(b)


def meet(texts: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
    """Links between the texts and the others: as many as join all that all of them would join."""
    ready, own = Texts(others["other_body"].tolist()), Texts(texts["body"].tolist())
    names, out, joined = others["other"].tolist(), [], Joined()
    for i, node in enumerate(texts["node"].tolist()):
        for j in ready.alike(own, i).tolist():
            if joined.first(names[j]) != joined.first(node) and ready.near(j, own, i):
                joined.link(node, names[j])
                out.append((node, names[j]))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _meetings(texts: DataFrame, others: DataFrame) -> DataFrame:
    """Links between texts and others (node, group, size, body) of the same group. Both sides of a group are dealt into
    parts of bounded size, and each part meets each, in a task of its own."""
    def parts(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("group").agg(F.ceil(F.greatest(F.count("*") / PART, F.sum("size") * 4 / LOCAL_SHINGLES)).cast("int").alias(name))

    # A row for each large group, so few that one machine's tasks are enough.
    numbers = durable(parts(texts, "parts").join(parts(others, "blocks"), "group"), parts_for(texts.sparkSession, 0))
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = texts.join(numbers, "group").select("group", part("parts").alias("part"), every("blocks").alias("block"), "node", "body")
    right = others.join(numbers, "group").select(F.col("group").alias("of"), every("parts").alias("of_part"), part("blocks").alias("of_block"), F.col("node").alias("other"), F.col("body").alias("other_body"))
    return left.groupBy("group", "part", "block").cogroup(right.groupBy("of", "of_part", "of_block")).applyInPandas(meet, "a long, b long")


def settle_large(texts: DataFrame) -> DataFrame:
    """Links in components of any size. texts: (node, group, size, weight, body)."""
    parts = parts_for(texts.sparkSession, texts.count())
    state = durable(texts.select("node", "group", "weight").withColumns({"linked": F.lit(False), "used": F.lit(False)}), parts)
    links, pivots = texts.sparkSession.createDataFrame([], "a long, b long"), PIVOTS
    while True:
        open_rows = state.filter("not linked and not used")
        going = open_rows.groupBy("group").agg(F.count("*").alias("n")).filter(F.col("n") > LOCAL).select("group")
        # A rank limit is taken in each task before rows move, so no task gets a whole component.
        turn = Window.partitionBy("group", "linked").orderBy(F.col("weight").desc(), "node")
        ranked = state.filter("not used").join(going, "group").withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= pivots // 2)
        chosen = durable(texts.join(ranked.select("node"), "node"))
        if chosen.isEmpty():
            break
        found = durable(_meetings(texts.join(open_rows.select("node"), "node"), chosen), parts)
        links = links.unionByName(found)
        hit = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))).distinct().withColumn("hit", F.lit(True))
        state = unestimated(durable(
            state.join(hit, "node", "left").join(chosen.select("node").withColumn("pivot", F.lit(True)), "node", "left")
            .select("node", "group", "weight", (F.col("linked") | F.coalesce("hit", F.lit(False))).alias("linked"), (F.col("used") | F.coalesce("pivot", F.lit(False))).alias("used")), parts
        ))
        pivots *= GROWTH
    links = unestimated(durable(links))
    return links.unionByName(bridges(texts, components(links)))


def shingle_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each labelled shingle of each text, told apart by component."""
    for batch in batches:
        bags = [labelled(np.frombuffer(b, dtype=np.uint32).astype(np.uint64)) for b in batch["body"].tolist()]
        n = [len(b) for b in bags]
        flat = np.concatenate(bags) if bags else np.zeros(0, np.uint64)
        groups = np.repeat(batch["group"].to_numpy(dtype=np.int64), n).view(np.uint64)
        yield pd.DataFrame({"node": np.repeat(batch["node"].to_numpy(), n), "class": np.repeat(batch["class"].to_numpy(), n), "token": _mix(flat + groups * np.uint64(_BASE)).view(np.int64)})


def settle_classes(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between the texts of a bundle whose classes differ: as many as join all that all of them would join."""
    rows = rows.drop_duplicates("node").sort_values("node")
    nodes, classes, texts = rows["node"].tolist(), rows["class"].tolist(), Texts(rows["body"].tolist())
    joined, out = Joined(), []
    for i, node in enumerate(nodes):
        for j in texts.alike(texts, i).tolist():
            if j > i and joined.first(classes[i]) != joined.first(classes[j]) and texts.near(j, texts, i):
                joined.link(classes[i], classes[j])
                out.append((node, nodes[j]))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def bridges(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between texts of a component whose classes differ, from all pairs that can be near.

    Near texts have four fifths of the labelled shingles of each in common. So in any order of all shingles, they share one
    among the first n - ceil(4n / 5) + 1 of each. The order is: shingles of one class alone, which join nothing and
    are left out, then by the number of texts. A text goes with its body to each of its first shingles that texts of several
    classes have; shingles are dealt into bundles of bounded size, and one that exceeds a bundle meets itself in parts. So
    rows are a text's first shingles in number, never pairs.
    """
    classed = texts.join(classes, "node", "left").select("node", "group", "size", "body", F.coalesce("label", "node").alias("class"))
    mixed = classed.groupBy("group").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low <> high").select("group")
    classed = durable(classed.join(mixed, "group"))
    held = durable(classed.select("node", "group", "class", "body").mapInPandas(shingle_rows, "node long, class long, token long"))
    shared = held.groupBy("token").agg(F.count("*").alias("n"), F.min("class").alias("low"), F.max("class").alias("high")).filter("low <> high").select("token", "n")
    own, turn = Window.partitionBy("node"), Window.partitionBy("node").orderBy("n", "token")
    placed = held.join(shared, "token").select("node", "token", F.count("*").over(own).alias("n_shared"), F.row_number().over(turn).alias("turn"))
    first = durable(placed.join(classed.select("node", "class", "size"), "node").filter("turn + size - n_shared <= size - ceil(size * 4 / 5) + 1").select("token", "node", "class", "size"))
    meeting = first.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("n"), F.sum("size").alias("shingles")).filter("low <> high")
    meeting = durable(meeting.withColumn("is_large", (F.col("n") > LOCAL) | (F.col("shingles") > LOCAL_SHINGLES)).drop("low", "high"))
    small = meeting.filter("not is_large")
    total = small.agg(F.sum("n"), F.sum("shingles")).first()
    bundles = 1 + (total[0] or 0) // LOCAL + (total[1] or 0) // LOCAL_SHINGLES
    bodies = classed.select("node", "class", "body")
    bundled = first.join(small.select("token"), "token").select("node", F.pmod(F.xxhash64("token"), F.lit(bundles)).alias("bundle")).distinct()
    links = bundled.join(bodies, "node").groupBy("bundle").applyInPandas(settle_classes, "a long, b long")
    large = meeting.filter("is_large").select("token")
    if not large.isEmpty():
        met = durable(first.join(large, "token").join(bodies.drop("class"), "node").select("node", F.col("token").alias("group"), "size", "body"))
        links = links.unionByName(_meetings(met, met))
    return links


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Every row: doc_id, group_id (id of the row that stays), group_size, kept, row (row_col, else its place in the input).

    With row_col, docs must give its rows alike each time, as placed() does."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    own = [F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    texts = docs.select(F.col(row_col).alias("row"), *own) if row_col else numbered(docs.select(*own), "row")
    rows = durable(texts.mapInPandas(lambda it: memory_back(sketch_rows(it)), "row long, doc_id string, digest binary, size long, sketch array<long>").withColumn("doc_id", F.col("doc_id").cast(kind)))
    firsts = durable(rows.groupBy("digest").agg(F.min("row").alias("node"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("sketch").alias("sketch")))
    placed = firsts.select("node", "size", F.posexplode("sketch").alias("at", "key")).select("node", "size", F.least("at", F.lit(SKETCHES)).alias("nth"), "key")
    buckets = placed.groupBy("nth", "key").agg(F.min("node").alias("head"), F.count("*").alias("n")).filter("n > 1")
    met = durable(with_facts(placed, buckets, ["nth", "key"], "n").select("node", "size", "head", "n"))
    labels = components(met.filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))).withColumnRenamed("label", "group")
    weights = met.groupBy("node").agg(F.sum("n").alias("weight"), F.first("size").alias("size"))
    few = parts_for(docs.sparkSession, labels.count())
    nodes = durable(labels.join(weights, "node"), few)
    sizes = durable(nodes.groupBy("group").agg(F.count("*").alias("texts"), ((F.count("*") > LOCAL) | (F.sum("size") > LOCAL_SHINGLES)).alias("is_large")), few)
    asked = only_rows(texts, "row", nodes.select("node"))  # texts without candidates are not moved
    members = asked.join(with_facts(nodes, sizes, ["group"], "texts"), F.col("row") == F.col("node")).select("node", "group", "size", "weight", "is_large", "text").mapInPandas(lambda it: memory_back(payload_rows(it)), "node long, group long, size long, weight long, is_large boolean, body binary")
    links = members.filter(~F.col("is_large")).groupBy("group").applyInPandas(settle, "a long, b long")
    if not sizes.filter("is_large").isEmpty():
        links = links.unionByName(settle_large(durable(members.filter("is_large"))))
    classes = components(links)
    known = firsts.select("digest", "node", "copies").join(classes, "node", "left").select("digest", "copies", F.coalesce("label", "node").alias("class"))
    classed = durable(with_facts(rows.select("row", "doc_id", "digest"), known, ["digest"], "copies").drop("digest", "copies"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    heads = classed.groupBy("class").agg(F.min(order).alias("first"), F.count("*").alias("group_size"))
    return with_facts(classed, heads, ["class"], "group_size").select("doc_id", F.col("first.doc_id").alias("group_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "row")


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns. Without row_col, which numbers rows as placed() does, docs is written."""
    row = row_col or spare_name(docs, "row_number_here")
    docs = docs if row_col else numbered(docs, row)
    groups = near_groups(docs, id_col=id_col, text_col=text_col, row_col=row)
    stay = without_rows(docs, row, groups.filter(~F.col("kept")).select("row"))
    return stay if row_col else stay.drop(row)
