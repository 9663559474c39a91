"""Source divergence audit: how each source's words differ from its language's and from the other sources'.

Terms are runs of letters and of bytes above ASCII. A table with an entry for each byte says what belongs to a
term and lowers A to Z; applied to the concatenated UTF-8 bytes of many texts it gives the terms' boundaries at
once. Terms get numbers by their xxhash, and every term is then compared, byte by byte, with the first one of its
number, so that a hash that deceives costs time and never a wrong count. A task sends counts by (lang, source,
term); Spark adds them up and keeps the terms found in at least MIN_DOCS documents of their language.

The kept counts of a language are dealt into buckets by their term. In a bucket they are a matrix in compressed
sparse rows, a row for each source, and what a source's terms add to its divergence from another is summed along
the rows by reduceat; terms that neither has add the same amount each and are only counted. Sources are dealt into blocks
of BLOCK, and a task has the sources of two blocks, so its memory is bounded by the bucket and BLOCK ** 2 sums.
The report itself has a row for every pair of sources of a language.

All arithmetic is of integers: p = 1 + floor(10**9 * (count + 1) / (N + V)) in three steps of a thousand, since the
product can pass 64 bits; f = floor((p - q) ** 2 / q).

Defined results: null text, lang and source are empty; a group without terms has all counts 0; without kept terms
in a language all its pairs have value 0; a source alone in its language has no pair; repeated rows count as rows;
terms of any length stay whole; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import durable, ship
from plumbline.llm.spans import gather

MIN_DOCS, TOP_TERMS, SCALE = 3, 200, 1_000_000_000
#: Bytes of text that are worked on at once; rows of counts in a bucket; sources in a block.
AT_ONCE, BUCKET_ROWS, BLOCK = 4_000_000, 50_000, 512

#: For each byte the lower-cased byte if it belongs to a term, else 0.
TERM_BYTE = np.array([b if b >= 0x80 or chr(b).isalpha() and b > 0x5A else b + 32 if 0x41 <= b <= 0x5A else 0 for b in range(256)], dtype=np.uint8)


def number_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """A number for each slice, equal for equal bytes, from 0 in order of appearance; the first slice of each number."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = data.tobytes()
    hashes = np.fromiter((digest(whole[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), dtype=np.uint64, count=len(starts))
    numbers, found = pd.factorize(hashes)
    firsts = np.empty(len(found), dtype=np.int64)
    firsts[numbers[::-1]] = np.arange(len(numbers))[::-1]
    model, sizes = firsts[numbers], ends - starts
    if np.array_equal(sizes, sizes[model]) and np.array_equal(gather(data, starts, sizes), gather(data, starts[model], sizes)):
        return numbers, firsts
    known: dict[bytes, int] = {}
    numbers = np.array([known.setdefault(whole[s:e], len(known)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
    return numbers, np.unique(numbers, return_index=True)[1]


def term_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the terms in texts that stand one behind the other at offsets, and the text of each; data as
    TERM_BYTE gives it."""
    inside, cut = data != 0, np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:-1]
    end[:-1] &= ~inside[1:] | cut[1:-1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, side="right") - 1


def counts_of(data: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Rows (group, term, occurrences, texts with it) of texts whose groups are given as numbers."""
    starts, ends, of = term_bounds(data, offsets)
    numbers, firsts = number_slices(data, starts, ends)
    sizes = (ends - starts)[firsts]
    ends_of = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(firsts), [None, pa.py_buffer(ends_of), pa.py_buffer(gather(data, starts[firsts], sizes).tobytes())])
    width = max(1, len(firsts))
    pairs, n = np.unique(of * width + numbers, return_counts=True)
    keys = groups[pairs // width] * width + pairs % width
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    n_rows = np.add.reduceat(n, first) if len(first) else np.zeros(0, np.int64)
    return keys[first] // width, terms.take(pa.array(keys[first] % width)), n_rows, np.diff(np.r_[first, len(keys)])


def long_text_counts(data: np.ndarray, group: int, limit: int) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """The same of one text, in parts that end where no term does."""
    seen: dict[bytes, int] = {}
    low = 0
    while low < len(data):
        high = min(len(data), low + limit)
        while high < len(data) and data[high]:
            gap = np.flatnonzero(data[high:high + limit] == 0)
            high = high + int(gap[0]) if len(gap) else min(len(data), high + limit)
        _, terms, n, _ = counts_of(data[low:high], np.array([0, high - low]), np.zeros(1, np.int64))
        for term, count in zip(terms.to_pylist(), n.tolist(), strict=True):
            seen[term] = seen.get(term, 0) + count
        low = high
    return np.full(len(seen), group), pa.array(list(seen), pa.binary()), np.fromiter(seen.values(), np.int64, len(seen)), np.ones(len(seen), np.int64)


COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


def count_terms(batches: Iterator[pa.RecordBatch], limit: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Counts by lang, source and term of batches (lang, source, text), without nulls."""
    for batch in batches:
        text = batch.column("text").cast(pa.large_binary())
        if not len(text):
            continue
        offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset:text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)
        names = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"]).to_pandas().map(lambda g: (g["lang"], g["source"]))
        groups, known = pd.factorize(names)
        low = 0
        while low < len(text):
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
            own = TERM_BYTE[data[offsets[low]:offsets[high]]]
            if len(own) > limit:
                rows = long_text_counts(own, int(groups[low]), limit)
            else:
                rows = counts_of(own, offsets[low:high + 1] - offsets[low], groups[low:high])
            lang, source = (pa.array([g[i] for g in known], pa.string()).take(pa.array(rows[0])) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([lang, source, rows[1], pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64())], schema=COUNTS)
            low = high


def proportions(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exactly, for totals below 10**16."""
    rest, total = count.astype(np.uint64) + np.uint64(1), np.maximum(total, 1).astype(np.uint64)
    out, rest = rest // total, rest % total
    for _ in range(3):
        rest = rest * np.uint64(1000)
        out, rest = out * np.uint64(1000) + rest // total, rest % total
    return (out + np.uint64(1)).astype(np.int64)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def sums_by_row(values: np.ndarray, indptr: np.ndarray) -> np.ndarray:
    """Sums of the stretches that begin at indptr; 0 for an empty one."""
    out, there = np.zeros(len(indptr) - 1, dtype=np.int64), np.flatnonzero(np.diff(indptr))
    if len(there):
        out[there] = np.add.reduceat(values, indptr[there])
    return out


OUT = "lang string, part string, source int, item binary, other int, value long, seen long, base long"


def bucket_rows(key: tuple, counts: pd.DataFrame, sources: pd.DataFrame, top: int = TOP_TERMS) -> pd.DataFrame:
    """What a bucket's terms give: for pairs (source in block a, other in block b) the terms' sum, their number and what a
    term that neither has adds; for each source of block a, where a = b, its first terms."""
    lang, _, a, b = key
    sources = sources.sort_values("place", ignore_index=True)
    place, block = sources["place"].to_numpy(), sources["block"].to_numpy()
    vocabulary, lang_n = int(sources["vocabulary"].iloc[0]), int(sources["lang_n"].iloc[0])
    numbers, terms = pd.factorize(counts["term"].to_numpy())
    row = np.searchsorted(place, counts["place"].to_numpy())
    order = np.lexsort((numbers, row))
    row, numbers, n = row[order], numbers[order], counts["n"].to_numpy()[order].astype(np.int64)
    indptr = np.searchsorted(row, np.arange(len(place) + 1))
    totals = sources["n"].to_numpy().astype(np.int64) + vocabulary
    none, p = proportions(np.zeros(len(place), np.int64), totals), proportions(n, totals[row])
    others = np.flatnonzero(block == b)
    low, high = indptr[others[0]] if len(others) else 0, indptr[others[-1] + 1] if len(others) else 0  # blocks are consecutive places
    ptr, cols, q = indptr[np.r_[others, others[-1] + 1]] - low if len(others) else np.zeros(1, int), numbers[low:high], p[low:high]
    q_none = np.repeat(none[others], np.diff(ptr))
    out = []
    for s in np.flatnonzero(block == a) if len(others) else ():
        own = np.full(len(terms), none[s])
        own[numbers[indptr[s]:indptr[s + 1]]] = p[indptr[s]:indptr[s + 1]]
        values, times = np.unique(own, return_counts=True)
        at = own[cols]
        total = sums_by_row(divergence(at, q) - divergence(at, q_none), ptr) + (divergence(values[None, :], none[others][:, None]) * times).sum(axis=1)
        out.append(pd.DataFrame({"part": "pair", "source": place[s], "other": place[others], "value": total, "seen": len(terms), "base": divergence(none[s], none[others])})[place[others] != place[s]])
    if a == b and len(terms):
        rank = np.empty(len(terms), dtype=np.int64)
        rank[sorted(range(len(terms)), key=terms.__getitem__)] = np.arange(len(terms))
        of_lang = proportions(counts["lang_count"].to_numpy()[order].astype(np.int64), np.full(len(n), lang_n + vocabulary))
        more = np.flatnonzero((p > of_lang) & (block[row] == a))
        value = divergence(p[more], of_lang[more])
        by = np.lexsort((rank[numbers[more]], -value, row[more]))
        more, value = more[by], value[by]
        nth = np.arange(len(more)) - np.searchsorted(row[more], row[more])
        more, value = more[nth < top], value[nth < top]
        out.append(pd.DataFrame({"part": "term", "source": place[row[more]], "item": terms[numbers[more]], "value": value}))
    out = [x for x in out if len(x)]
    return (pd.concat(out, ignore_index=True) if out else pd.DataFrame({"part": []})).assign(lang=lang).reindex(columns=["lang", "part", "source", "item", "other", "value", "seen", "base"]).astype({"lang": object, "part": object, "item": object, "other": "Int64", "seen": "Int64", "base": "Int64"})


def audit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP_TERMS, bucket_size: int = BUCKET_ROWS, block_size: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: for each source its divergence from each other source of the language (part
    pair) and the terms that it has more often than the language, by their share of the divergence (part term, to rank top)."""
    spark = docs.sparkSession
    ship(spark)
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = plain.mapInArrow(count_terms, "lang string, source string, term binary, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    counts = counts.select("lang", "source", "term", "n", F.sum("docs").over(same).alias("docs"), F.sum("n").over(same).alias("lang_count"), (F.min("source").over(same) == F.col("source")).alias("first"))
    kept = durable(counts.filter(F.col("docs") >= min_docs).drop("docs"))

    by_lang = kept.groupBy("lang").agg(F.count_if("first").alias("vocabulary"), F.sum("n").alias("lang_n"), F.count("*").alias("rows"))
    groups = plain.select("lang", "source").distinct().join(kept.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0)
    of_lang = Window.partitionBy("lang")
    groups = groups.withColumn("place", F.row_number().over(of_lang.orderBy("source")) - 1).withColumn("block", F.expr(f"CAST(place div {block_size} AS INT)"))
    groups = durable(groups.withColumn("blocks", F.max("block").over(of_lang) + 1).withColumn("buckets", F.expr(f"CAST(rows div {bucket_size} + 1 AS INT)")))

    sides = F.sequence(F.lit(0), F.col("blocks") - 1)
    meetings = F.array_union(F.transform(sides, lambda j: F.struct(F.col("block").alias("a"), j.alias("b"))), F.transform(sides, lambda j: F.struct(j.alias("a"), F.col("block").alias("b"))))
    placed = kept.join(groups.select("lang", "source", "place", "block", "blocks", "buckets"), ["lang", "source"])
    left = placed.select("lang", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket"), "place", "term", "n", "lang_count", F.inline(meetings))
    right = groups.select("*", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket")).select("lang", "bucket", "place", "block", "n", "vocabulary", "lang_n", F.inline(meetings))
    left = left.toDF(*left.columns)  # both sides hold columns of groups
    key = ["lang", "bucket", "a", "b"]
    parts = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(lambda k, x, y: bucket_rows(k, x, y, top), OUT)
    found = durable(parts)

    names = groups.select("lang", F.col("place").alias("source_place"), "source", "vocabulary")
    other = groups.select("lang", F.col("place").alias("other"), F.col("source").alias("item"))
    sums = found.filter("part = 'pair'").groupBy("lang", F.col("source").alias("source_place"), "other").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("base").alias("base"))
    pairs = sums.join(names, ["lang", "source_place"]).join(other, ["lang", "other"]).select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + (F.col("vocabulary") - F.col("seen")) * F.col("base")).alias("value"))
    terms = found.filter("part = 'term'").select("lang", F.col("source").alias("source_place"), F.col("item").cast("string").alias("item"), "value").join(names, ["lang", "source_place"]).select("lang", "source", F.lit("term").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).filter(F.col("rank") <= top))
