"""Byte-level BPE encoding and decoding, every distinct word once.

Texts are cut into pre-tokens; a chunk of texts keeps its distinct pre-tokens and, for every text, their
positions as numbers into that list. The distinct words of all chunks are shuffled by word, so that each word
of the corpus meets in one place and is encoded there once; its ids go back to the chunks, and texts are
reassembled by position. Decoding joins the ids with the table of tokens' bytes, whose size the vocabulary
fixes. Words travel in packed blocks, one for each chunk and bucket of words, so that the JVM moves few rows.

A chunk's list and its positions leave one task together, and a block's words come back in the order in which
they went. Should a lost task read its rows in another order, its blocks' stamps differ and the job stops.

Defined results: a null text is empty; an empty text has no tokens (both digests are those of no bytes); texts
of any length are read whole; lone surrogates become the replacement character; repeated rows and ids are
encoded alike; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import ship
from plumbline.llm.spans import AT_ONCE, class_table, code_points, number_spans, parts_of

#: Characters of text in a chunk at least (its last text is whole); words that a task remembers; bytes of text whose blocks
#: make a partition; the most buckets of words, since each chunk has a block for each.
CHUNK_CHARS, REMEMBERED, PART_BYTES, MOST_BUCKETS = 6_000_000, 2_000_000, 64 << 20, 4096


@lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def encoder_of(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={})


#: Fixed value: the pattern for which cut_points does by arrays what a search would do.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE, OTHER_SPACE, LETTER, NUMBER, OTHER, EDGE = range(6)


def cut_points(codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of BYTE_LEVEL_PATTERN begin, and the edges themselves. codes: texts with an edge behind each.

    A run of one class is a pre-token, but: a space before a run of letters, numbers or others belongs to it; the
    last of several spaces before something stands alone (or belongs to it); and what an apostrophe abbreviates
    is cut off where the apostrophe begins a run.
    """
    kind = class_table(" ", r"\s", r"\p{L}", r"\p{N}")[codes]
    kind[edges] = EDGE
    before, after = np.concatenate([[EDGE], kind[:-1]]), np.concatenate([kind[1:], [EDGE]])
    space, space_before = kind <= OTHER_SPACE, before <= OTHER_SPACE
    begins = np.where(space, ~space_before, kind != before)
    begins |= space & (after > OTHER_SPACE) & (after != EDGE)
    begins &= space | (kind == EDGE) | (before != SPACE)
    marks = np.flatnonzero(begins & (codes == ord("'")))
    if len(marks):
        one, two = codes[np.minimum(marks + 1, len(codes) - 1)], codes[np.minimum(marks + 2, len(codes) - 1)]
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
        for pair in ("re", "ve", "ll"):
            size = np.where((one == ord(pair[0])) & (two == ord(pair[1])) & (kind[np.minimum(marks + 2, len(codes) - 1)] != EDGE), 3, size)
        size = np.where(kind[np.minimum(marks + 1, len(codes) - 1)] == EDGE, 0, size)
        marks, size = marks[size > 0], size[size > 0]
        begins[marks + 1] = False
        begins[marks + size] = True
    begins[edges] = True
    return np.flatnonzero(begins)


class Chunk:
    """Numbers the pre-tokens of a chunk's texts."""

    def __init__(self, pattern: str) -> None:
        self.find = None if pattern == BYTE_LEVEL_PATTERN else regex.compile(pattern).findall
        self.numbered: dict[str, int] = {}
        self.codes: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.waiting: list[tuple[str, bool]] = []  # parts of texts, and whether one ends its text
        self.chars = self.open_size = 0

    def add(self, text: str) -> None:
        for part in parts_of(text) if self.find is None else (text,):
            self.waiting.append((part, False))
            self.chars += len(part)
            if self.chars >= AT_ONCE:
                self.settle()
        if self.waiting:
            self.waiting[-1] = (self.waiting[-1][0], True)
        else:
            self.waiting.append(("", True))

    def settle(self) -> None:
        """Cuts what waits; a text that has not ended goes on with the next part."""
        parts = [p for p, _ in self.waiting]
        if self.find is None:
            joined = "\0".join([*parts, ""])
            codes, edges = code_points(joined), np.cumsum([len(p) + 1 for p in parts]) - 1
            starts = cut_points(codes, edges) if parts else np.zeros(0, np.int64)
            ends = np.append(starts[1:], len(codes))
            real = np.ones(len(codes), dtype=bool)
            real[edges] = False
            keep = real[starts] if len(starts) else np.zeros(0, bool)
            starts, ends = starts[keep], ends[keep]
            numbers, firsts = number_spans(codes, starts, ends)
            words = [joined[s:e] for s, e in zip(starts[firsts].tolist(), ends[firsts].tolist(), strict=True)]
            counts = np.diff(np.searchsorted(starts, np.concatenate([[0], edges]))).tolist() if parts else []
        else:
            cut = [self.find(p) for p in parts]
            words, counts = list(chain.from_iterable(cut)), list(map(len, cut))
            numbers = np.arange(len(words))
        known = self.numbered
        local = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int32, count=len(words))
        self.codes.append(local[numbers])
        for (_, last), n in zip(self.waiting, counts, strict=True):
            self.open_size += n
            if last:
                self.sizes.append(self.open_size)
                self.open_size = 0
        self.waiting, self.chars = [], 0


def bundle(*parts: bytes, level: int = 1) -> bytes:
    """Parts in one compressed body."""
    return zstandard.ZstdCompressor(level=level).compress(struct.pack(f"<{len(parts)}I", *map(len, parts)) + b"".join(parts))


def unbundle(body: bytes, n: int) -> list[bytes]:
    whole, at, out = zstandard.ZstdDecompressor().decompress(body), 4 * n, []
    for length in struct.unpack_from(f"<{n}I", whole):
        out.append(whole[at:at + length])
        at += length
    return out


def numbers(values: list[int]) -> bytes:
    return np.array(values, dtype="<u4").tobytes()


def cut_at(body: bytes, lengths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths, dtype=np.int64).tolist()
    return [body[low:high] for low, high in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def squeeze(codes: np.ndarray) -> bytes:
    """Codes by planes of their bytes; frequent words have small codes, so the upper planes nearly vanish."""
    planes = codes.astype("<u4").view(np.uint8).reshape(-1, 4)
    return bundle(*[planes[:, k].tobytes() for k in range(4)], level=3)


def unsqueeze(body: bytes) -> np.ndarray:
    return np.stack([np.frombuffer(p, dtype=np.uint8) for p in unbundle(body, 4)], axis=1).copy().view("<u4").ravel()


def explode_words(batches: Iterator[pd.DataFrame], part: int, pattern: str, buckets: int) -> Iterator[pd.DataFrame]:
    """Blocks of a task's chunks. bucket -1: all texts' positions in the chunk's list; else: that bucket's words.

    Every block carries a stamp, the digest of the chunk's ids and words, so that blocks of different readings of
    a chunk are never taken for one another.
    """
    number = 0

    def flush(ids: list, chunk_of_texts: Chunk) -> pd.DataFrame:
        nonlocal number
        chunk = (part << 32) + number
        number += 1
        chunk_of_texts.settle()
        flat = np.concatenate(chunk_of_texts.codes)
        words = list(chunk_of_texts.numbered)
        rank = np.empty(len(words), dtype=np.int64)
        rank[np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")] = np.arange(len(words))
        names = [b"" if i is None else i.encode() for i in ids]
        raw = [w.encode("utf-8", "replace") for w in words]
        home = np.fromiter((zlib.crc32(w) for w in raw), dtype=np.int64, count=len(raw)) % buckets
        heads = np.frombuffer(b"".join([w[:8].ljust(8, b"\0") for w in raw]), dtype=">u8")
        order = np.lexsort((heads, home))  # bucket by bucket, as the words will come back; words that begin alike together
        sorted_words = [raw[i] for i in order.tolist()]
        head = (numbers(chunk_of_texts.sizes), numbers([len(i) for i in names]), np.array([i is None for i in ids], dtype=np.uint8).tobytes(), b"".join(names))
        stamp = hashlib.blake2b(b"\0".join(sorted_words) + head[3] + rank[flat].tobytes(), digest_size=8).digest()
        rows = [(chunk, -1, stamp, bundle(*head, squeeze(rank[order]), squeeze(rank[flat])))]
        ends = np.cumsum(np.bincount(home, minlength=buckets)).tolist()
        for bucket, (low, high) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            if low < high:
                own = sorted_words[low:high]
                rows.append((chunk, bucket, stamp, bundle(squeeze(np.array([len(w) for w in own])), b"".join(own), level=3)))
        return pd.DataFrame(rows, columns=["chunk", "bucket", "stamp", "body"])

    ids, texts, size = [], Chunk(pattern), 0
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
            ids.append(doc_id)
            texts.add(text)
            size += len(text) + 64
            if size >= CHUNK_CHARS:
                yield flush(ids, texts)
                ids, texts, size = [], Chunk(pattern), 0
    if ids:
        yield flush(ids, texts)


def words_only(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch[batch["bucket"] >= 0]


def encode_words(batches: Iterator[pd.DataFrame], path: str, pattern: str) -> Iterator[pd.DataFrame]:
    """Words of a bucket, from all chunks, become ids; all blocks of a bucket are in this task, so each word is encoded once.

    Where a bucket has more words than REMEMBERED, those remembered make room and may be encoded again, alike."""
    encode = encoder_of(path, pattern).encode_ordinary
    known: dict[bytes, bytes] = {}

    def ids_of(word: bytes) -> bytes:
        got = known.get(word)
        if got is None:
            if len(known) >= REMEMBERED:
                known.clear()
            got = known[word] = numbers(encode(word.decode("utf-8")))
        return got

    def encoded(body: bytes) -> bytes:
        lengths, words = unbundle(body, 2)
        ids = [ids_of(w) for w in cut_at(words, unsqueeze(lengths))]
        return bundle(squeeze(np.array([len(x) // 4 for x in ids])), squeeze(np.frombuffer(b"".join(ids), dtype="<u4")))

    for batch in batches:
        yield pd.DataFrame({"chunk": batch["chunk"], "bucket": batch["bucket"], "stamp": batch["stamp"], "body": [encoded(b) for b in batch["body"]]})


def reassemble(blocks: pd.DataFrame, encoded: pd.DataFrame, path: str) -> pd.DataFrame:
    """A chunk's texts from its words' ids, by position; then their decoding by the table of tokens' bytes."""
    tokens, names = token_bytes(path), token_names(path)
    counts, as_text, as_bytes = [np.zeros(0, np.int64)], [], []
    for body in encoded.sort_values("bucket")["body"]:
        lengths, ids = unbundle(body, 2)
        counts.append(unsqueeze(lengths))
        flat, at = unsqueeze(ids).tolist(), 0
        for n in counts[-1].tolist():
            own = flat[at:at + n]
            at += n
            as_text.append(b",".join([names[i] for i in own]))
            as_bytes.append(b"".join([tokens[i] for i in own]))
    rows = []
    for body in blocks.loc[blocks["bucket"] < 0, "body"]:
        sizes, id_sizes, nulls, ids, ranks, flat = unbundle(body, 6)
        order = np.argsort(unsqueeze(ranks))
        if len(order) != len(as_text) or set(encoded["stamp"]) - set(blocks["stamp"]):
            raise ValueError("the chunk's words that came back are not those that went out: its rows were read anew in another order")
        by_code = order.tolist()
        names_of, bytes_of = [as_text[i] for i in by_code], [as_bytes[i] for i in by_code]
        count_of = np.concatenate(counts)[order].astype(np.int64)
        codes, at = unsqueeze(flat), 0
        for n, doc_id, null in zip(np.frombuffer(sizes, dtype="<u4").tolist(), cut_at(ids, np.frombuffer(id_sizes, dtype="<u4")), nulls, strict=True):
            own = codes[at:at + n]
            at += n
            listed = own.tolist()
            joined, decoded = b",".join(map(names_of.__getitem__, listed)), b"".join(map(bytes_of.__getitem__, listed))
            rows.append((None if null else doc_id.decode(), int(count_of[own].sum()), hashlib.sha256(joined).hexdigest(), hashlib.sha256(decoded).hexdigest()))
    return pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


@lru_cache(maxsize=2)
def token_bytes(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in ranks_of(path).items()}


@lru_cache(maxsize=2)
def token_names(path: str) -> dict[int, bytes]:
    return {rank: b"%d" % rank for rank in ranks_of(path).values()}


def encode_and_decode(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row: doc_id, n_tokens, ids_sha256 (ids joined by commas), decoded_sha256 (the bytes the ids stand for).

    Chunks' blocks are shuffled by chunk once; positions stay there, words go out to their buckets and back.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    block = "chunk long, bucket int, stamp binary, body binary"
    texts = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chars = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // PART_BYTES))
    buckets = min(MOST_BUCKETS, parts)
    blocks = texts.mapInPandas(lambda it: explode_words(it, TaskContext.get().partitionId(), pattern, buckets), block).repartition(parts, "chunk")
    by_word = blocks.mapInPandas(words_only, block).repartition(buckets, "bucket")
    encoded = by_word.mapInPandas(lambda it: encode_words(it, path, pattern), block).repartition(parts, "chunk")
    done = blocks.groupBy("chunk").cogroup(encoded.groupBy("chunk")).applyInPandas(lambda b, e: reassemble(b, e, path), "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return done.withColumn("doc_id", F.col("doc_id").cast(kind))
