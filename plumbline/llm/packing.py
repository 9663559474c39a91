"""Best-fit packing of tokenised documents, improved by swaps.

Every document becomes ids and an end mark; longer ones than a sequence are cut into pieces of full length, the
last may be shorter. Full pieces are sequences by themselves. The others are dealt at random into groups of
bounded size; each group is put into bins by best fit in random order, and local search does the rest: the
emptiest bin gives its pieces away by moving them, or exchanges them one for one, one for two or two for one with
pieces of other underfull bins. Each step increases the sum of the squared fills, until bins empty and no fewer
are possible, or no step is left; then the search also starts from best fit by falling length, and the better
end counts. The groups waste less than one sequence each, however many there are.

Defined results: a null text is empty; an empty text is its end mark; ties in length are broken by place;
repeated rows and ids are packed like others; texts of any length are read whole; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import durable, memory_back, ship, small_batches
from plumbline.llm.spans import AT_ONCE, class_table, code_points, gather, number_spans, parts_of, words_between

#: Tokens of a sequence; the end mark's id; documents of a group; remembered words of a worker.
SEQUENCE, END_ID, GROUP_ROWS, REMEMBERED = 2048, 0, 16_384, 600_000


class WordEncoder:
    """Texts to their ids, little-endian, four bytes each, as the tokenizer itself gives them.

    White space only separates for this tokenizer and case is dropped, so the distinct words of many texts are
    encoded by themselves, in lower case, and remembered: the first REMEMBERED words for the life of the worker,
    later ones for a call. A word of the scripts in _PLAIN is cut by the tokenizer's own pattern and its parts go
    to the tokenizer's model; any other word, and a text with a control token, goes through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.model_ids = self.tokenizer.model.tokenize
        self.known: dict[str, bytes] = {}
        self.id_bytes = [i.to_bytes(4, "little") for i in range(1 + max(self.tokenizer.get_vocab().values()))]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _part(self, part: str, fresh: dict[str, bytes]) -> bytes:
        got = self.known.get(part) or fresh.get(part)
        if got is None:
            as_bytes = part if part.isascii() else "".join([_BYTE_CHARS[b] for b in part.encode()])
            got = fresh[part] = b"".join([self.id_bytes[t.id] for t in self.model_ids(as_bytes)])
        return got

    def _word(self, word: str, fresh: dict[str, bytes]) -> bytes:
        """Ids of a word that is not known. Lower-case letters of ASCII, also before one other sign, are most words; they are
        cut as the pattern would."""
        if word.isascii():
            if word.isalpha():
                if word.islower():
                    return self._part(word, fresh)
            elif (head := word[:-1]).isalpha() and head.islower() and "!" <= word[-1] <= "~":
                got = fresh[word] = self._part(head, fresh) + self._part(word[-1], fresh)
                return got
        if not _PLAIN.fullmatch(word) or word != word.lower():
            got = self._whole(word)
        elif word.isalpha():
            return self._part(word, fresh)
        else:
            got = b"".join([self._part(p, fresh) for p in _PARTS.findall(word)])
        fresh[word] = got
        return got

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        joined = " ".join(parts)
        codes = code_points(joined)
        starts, ends = words_between(codes, class_table(r"\s"))
        numbers, firsts = number_spans(codes, starts, ends)
        fresh = self.known if len(self.known) < REMEMBERED else {}
        words = [joined[s:e] for s, e in zip(starts[firsts].tolist(), ends[firsts].tolist(), strict=True)]
        ids = [self._word(w, fresh) if x is None else x for w, x in zip(words, map(self.known.get, words), strict=True)]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        body = gather(np.frombuffer(b"".join(ids), dtype="<u4"), (np.cumsum(sizes) - sizes)[numbers], sizes[numbers]).tobytes()
        before = np.concatenate([[0], np.cumsum(sizes[numbers])])  # ids before each word
        part_ends = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
        at = (4 * before[np.searchsorted(starts, part_ends)]).tolist()
        return [body[low:high] for low, high in zip(at[:-1], at[1:], strict=True)]

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        parts, owners, size = [], [], 0

        def flush() -> None:
            nonlocal parts, owners, size
            for i, ids in zip(owners, self._encode_parts(parts), strict=True):
                out[i].append(ids)
            parts, owners, size = [], [], 0

        for i, text in enumerate(texts):
            if "<|" in text and _CONTROL_TOKENS.search(text):
                out[i].append(self._whole(text))
                continue
            for part in parts_of(lower_case(text)):
                parts.append(part)
                owners.append(i)
                size += len(part)
                if size >= AT_ONCE:
                    flush()
        if parts:
            flush()
        return [b"".join(ids) for ids in out]


def lower_case(text: str) -> str:
    """Lower case by characters, as the tokenizer has it; where composing or a final sigma could matter, as it is."""
    if text.isascii():
        return text.lower()
    lower = text.lower()
    return lower if "\u03a3" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", lower) else text


#: The tokenizer's control tokens and its pattern, which takes a word apart.
_CONTROL_TOKENS = regex.compile(r"<\|(?:start|end)oftext\|>", regex.IGNORECASE)
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Lower-case words of Latin and Cyrillic letters and of what ASCII prints: composed, and told apart alike by all libraries.
_PLAIN = regex.compile("[\x21-\x40\x5b-\x7e\xdf-\u017f\u0430-\u045f]+")
#: Bytes as characters: printable ones as they are, the others from 256 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _PRINTED)}


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder; what it remembers serves all tasks of the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def cut_pieces(batches: Iterator[pd.DataFrame], path: str, sequence: int) -> Iterator[pd.DataFrame]:
    encode, end = word_encoder(path).encode, np.array([END_ID], dtype="<u4").tobytes()
    for batch in batches:
        rows = []
        for low in range(0, len(batch), 1024):
            part = batch.iloc[low:low + 1024]
            for doc_id, ids in zip(part["doc_id"].tolist(), encode(part["text"].tolist()), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * sequence)):
                    own = ids[at:at + 4 * sequence]
                    rows.append((doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own)))
        yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])


def best_fit(lengths: Sequence[int], capacity: int, order: Sequence[int]) -> list[list[int]]:
    """Bins of indexes: each length, in the given order, goes where least room is left that still holds it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: a bin with room r
    for i in order:
        need = lengths[i]
        fits = rooms >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        room -= need
        by_room[room].append(b)
        rooms |= 1 << room
    return bins


class Search:
    """Local search over bins: steps that take from one bin what increases the sum of the squared fills.

    A step moves a piece, or exchanges one or two pieces of the source for one or two of another bin; two for two
    is left to two steps. Lengths in sorted order, and the sums of the pairs of each bin, are the index by which
    a step is found; a bin of more than FEW pieces keeps the sums of its pairs for itself.
    """

    FEW = 8

    def __init__(self, bins: list[list[int]], lengths: Sequence[int], capacity: int) -> None:
        self.bins, self.capacity, self.steps = bins, capacity, 0
        self.lengths = np.asarray(lengths, dtype=np.int64)
        self.fill = np.array([sum(lengths[i] for i in b) for b in bins], dtype=np.int64)
        self.where = np.zeros(len(lengths), dtype=np.int64)
        for b, own in enumerate(bins):
            self.where[own] = b
        self.order = np.argsort(self.lengths, kind="stable")
        self.sorted = self.lengths[self.order]
        self.left, self.right = np.triu_indices(self.FEW, 1)
        self.pair_sums = np.full((len(bins), len(self.left)), 4 * capacity, dtype=np.int32)
        self.many: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for b in range(len(bins)):
            self._index(b)

    def _index(self, b: int) -> None:
        own = self.lengths[self.bins[b]]
        self.many.pop(b, None)
        self.pair_sums[b] = 4 * self.capacity
        if len(own) <= self.FEW:
            there = self.right < len(own)
            self.pair_sums[b, there] = own[self.left[there]] + own[self.right[there]]
        else:
            sums, i, j = self._pairs(b)
            self.many[b] = sums, i, j

    def _pairs(self, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different sums of two pieces of a bin, and a pair (its places) for each."""
        own = self.lengths[self.bins[b]]
        values, at = np.unique(own, return_index=True)
        i, j = np.triu_indices(len(values), 1)
        sums, left, right = values[i] + values[j], at[i], at[j]
        for v, first in zip(values.tolist(), at.tolist(), strict=True):
            same = np.flatnonzero(own == v)
            if len(same) > 1:
                sums, left, right = np.append(sums, 2 * v), np.append(left, first), np.append(right, same[1])
        sums, once = np.unique(sums, return_index=True)
        return sums, left[once], right[once]

    def _for_one(self, source: int, give: int, most: int) -> tuple[int, int] | None:
        """The best piece of another bin to get back for length give: (gain, piece)."""
        low, high = np.searchsorted(self.sorted, (give - most, give))
        pieces = self.order[low:high]
        of = self.where[pieces]
        d = give - self.sorted[low:high]
        gain = np.where((d <= self.capacity - self.fill[of]) & (of != source), d * (self.fill[of] - self.fill[source] + d), 0)
        if not len(gain) or gain[k := int(gain.argmax())] <= 0:
            return None
        return int(gain[k]), int(pieces[k])

    def _for_two(self, source: int, give: int) -> tuple[int, int, int, int] | None:
        """The best pair of another bin to get back for length give: (gain, bin, and the pair's places)."""
        # Unsigned: a sum that is not less than give lies behind every room.
        able = np.flatnonzero((np.int32(give - 1) - self.pair_sums).view(np.uint32) < (self.capacity - self.fill).astype(np.uint32)[:, None])
        bins = able // len(self.left)
        d = give - self.pair_sums.ravel()[able]
        gain = np.where(bins != source, d * (self.fill[bins] - self.fill[source] + d), 0)
        best = None
        if len(gain) and gain[k := int(gain.argmax())] > 0:
            place = int(able[k]) % len(self.left)
            best = int(gain[k]), int(bins[k]), int(self.left[place]), int(self.right[place])
        for b, (sums, left, right) in self.many.items():
            if b != source and (room := self.capacity - int(self.fill[b])) > 0:
                low, high = np.searchsorted(sums, (give - room, give))
                if low < high:  # the least pair back gives the most, as long as the target is the fuller one
                    d = give - sums[low:high]
                    gain = d * (int(self.fill[b] - self.fill[source]) + d)
                    k = int(gain.argmax())
                    if gain[k] > 0 and (best is None or gain[k] > best[0]):
                        best = int(gain[k]), b, int(left[low + k]), int(right[low + k])
        return best

    def _step(self, source: int) -> bool:
        """One step that takes from source, if there is any that gains."""
        own = self.bins[source]
        room = self.capacity - self.fill
        room[source] = 0
        most = int(room.max())
        if most <= 0:
            return False
        singles = {int(self.lengths[p]): p for p in own}
        for size in sorted(singles, reverse=True):
            if size <= most:
                fits = np.where(room >= size, room, self.capacity + 1)
                b = int(fits.argmin())
                if self.fill[b] - self.fill[source] + size > 0:
                    return self._apply(source, b, [singles[size]], [])
        best: tuple | None = None
        for size in singles:
            if (found := self._for_one(source, size, most)) and (best is None or found[0] > best[0]):
                best = found[0], int(self.where[found[1]]), [singles[size]], [found[1]]
        if best is None:
            for size in singles:
                if (found := self._for_two(source, size)) and (best is None or found[0] > best[0]):
                    best = found[0], found[1], [singles[size]], [self.bins[found[1]][k] for k in found[2:]]
            sums, left, right = self._pairs(source)
            for size, i, j in zip(sums.tolist(), left.tolist(), right.tolist(), strict=True):
                if (found := self._for_one(source, size, most)) and (best is None or found[0] > best[0]):
                    best = found[0], int(self.where[found[1]]), [own[i], own[j]], [found[1]]
        return best is not None and self._apply(source, *best[1:])

    def _apply(self, source: int, b: int, given: list[int], back: list[int]) -> bool:
        self.bins[source] = [p for p in self.bins[source] if p not in given] + back
        self.bins[b] = [p for p in self.bins[b] if p not in back] + given
        moved = int(self.lengths[given].sum() - (self.lengths[back].sum() if back else 0))
        self.fill[b] += moved
        self.fill[source] -= moved
        self.where[given], self.where[back] = b, source
        self._index(source)
        self._index(b)
        self.steps += 1
        return True

    def run(self) -> list[list[int]]:
        """Empties bins until their number is the least possible or no step gains; the emptiest bin gives first."""
        least = -(-int(self.fill.sum()) // self.capacity)
        alive = int((self.fill > 0).sum())
        stepped = True
        while stepped and alive > least:
            stepped = False
            done = np.zeros(len(self.bins), dtype=bool)
            while alive > least and (able := ~done & (self.fill > 0) & (self.fill < self.capacity)).any():
                source = int(np.where(able, self.fill, self.capacity).argmin())
                done[source] = True
                while self.bins[source] and self._step(source):
                    stepped = True
                alive -= not self.bins[source]
        return [b for b in self.bins if b]


def packed(lengths: Sequence[int], capacity: int) -> tuple[list[list[int]], int]:
    """Bins, and the number of steps of the search. The search starts from best fit in the given order; where it does not
    end at the least possible number of bins, also from best fit by falling length, and the better end counts."""
    search = Search(best_fit(lengths, capacity, range(len(lengths))), lengths, capacity)
    bins, steps = search.run(), search.steps
    if len(bins) > -(-sum(lengths) // capacity):
        other = Search(best_fit(lengths, capacity, sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))), lengths, capacity)
        bins, steps = min((other.run(), other.steps), (bins, steps), key=lambda x: len(x[0]))
    return bins, steps


def pack_group(pieces: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pieces = pieces.sort_values(["ids_crc32", "length", "place"], ignore_index=True)
    lengths = pieces["length"].tolist()
    sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    for number, members in enumerate(packed(lengths, capacity)[0]):
        at = 0
        for i in members:
            sequence[i], offset[i] = number, at
            at += lengths[i]
    group = pieces["pack_group"].to_numpy(dtype=np.int64) if len(pieces) else np.zeros(0, dtype=np.int64)
    return pieces.assign(sequence_id=(group << 32) + sequence, offset=offset).drop(columns=["place", "pack_group"])


def pack(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Every piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    columns = "doc_id string, piece int, start long, length long, ids_crc32 long"
    pieces = durable(texts.mapInPandas(lambda it: memory_back(cut_pieces(it, path, sequence)), columns).withColumn("place", F.monotonically_increasing_id()))
    groups = max(1, -(-pieces.filter(F.col("length") < sequence).count() // group_rows))
    short = pieces.filter(F.col("length") < sequence).withColumn("pack_group", F.pmod(F.xxhash64("place"), F.lit(groups)))
    packed = short.groupBy("pack_group").applyInPandas(lambda g: pack_group(g, sequence), columns + ", sequence_id long, offset long")
    full = pieces.filter(F.col("length") >= sequence).withColumn("sequence_id", -1 - F.col("place")).withColumn("offset", F.lit(0).cast("long")).drop("place")
    return packed.unionByName(full).withColumn("doc_id", F.col("doc_id").cast(kind))
