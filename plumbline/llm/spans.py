"""Stretches of texts, found, numbered and compared as arrays of code points.

Many texts stand one behind the other in one array; classes of characters come from a table with an entry for
each code point. Equal stretches get equal numbers by a 64-bit hash, and every stretch is then compared with the
first one of its number, so that a hash that deceives costs time and never a wrong number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex

#: Characters that are worked on at once, which bounds the arrays' memory; longer texts are cut where two words meet.
AT_ONCE = 1_500_000

_WEIGHTS = np.random.default_rng(17).integers(0, 1 << 63, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MEETING = regex.compile(r"(?<=\p{L}) (?=\p{L})")


@lru_cache(maxsize=8)
def class_table(*patterns: str) -> np.ndarray:
    """For each code point the number of the first pattern that it matches; len(patterns) if none."""
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000))
    table = np.full(len(every), len(patterns), dtype=np.uint8)
    for number, pattern in reversed(list(enumerate(patterns))):
        for found in regex.finditer(f"(?:{pattern})+", every):
            table[found.start():found.end()] = number
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("ascii"), dtype=np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")


def parts_of(text: str, limit: int = AT_ONCE) -> Iterator[str]:
    """The text in parts of about limit characters, each but the first beginning with the space between two words; whole
    where there is none."""
    low = 0
    while len(text) - low > 2 * limit and (found := _MEETING.search(text, low + limit)):
        yield text[low:found.start()]
        low = found.start()
    yield text[low:] if low else text


def words_between(codes: np.ndarray, is_space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what stands between characters whose class in the table is 0."""
    inside = np.zeros(len(codes) + 2, dtype=np.int8)
    inside[1:-1] = is_space[codes] != 0
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def number_spans(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the stretches (none empty), from 0 in order of appearance, and the first stretch of each number."""
    lengths = ends - starts
    if not len(lengths):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.cumsum(lengths) - lengths
    whole = np.arange(int(lengths.sum()))
    flat = codes[np.repeat(starts - begins, lengths) + whole]
    hashes = np.add.reduceat((flat + np.uint64(1)) * _WEIGHTS[(whole - np.repeat(begins, lengths)) & 4095], begins) + lengths.astype(np.uint64)
    hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    numbers, found = pd.factorize(hashes)
    firsts = np.empty(len(found), dtype=np.int64)
    firsts[numbers[::-1]] = np.arange(len(numbers))[::-1]
    model = firsts[numbers]
    if np.array_equal(lengths, lengths[model]) and np.array_equal(flat, flat[np.repeat(begins[model] - begins, lengths) + whole]):
        return numbers, firsts
    known: dict[bytes, int] = {}
    numbers = np.array([known.setdefault(flat[b:b + n].tobytes(), len(known)) for b, n in zip(begins.tolist(), lengths.tolist(), strict=True)])
    return numbers, np.unique(numbers, return_index=True)[1]


def gather(pool: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The stretches of the pool at offsets, one behind the other."""
    ends = np.cumsum(counts)
    return pool[np.repeat(offsets - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)]
