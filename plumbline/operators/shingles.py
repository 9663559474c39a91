"""Texts as sets of word shingles, and the first of them in an order that all texts have in common."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd

_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")


def shingles_of(text: str, words: int) -> set[tuple[str, ...]]:
    """The text's stretches of so many words; of a shorter text all its words."""
    w = _WORD.findall(text)
    return set(zip(*[w[k:] for k in range(words)])) if len(w) >= words else {tuple(w)}


def codes_of(text: str, words: int) -> np.ndarray:
    """A 64-bit hash of each of the shingles, in order, each once; none for a text without words."""
    w = _WORD.findall(text)
    if not w:
        return np.zeros(0, np.uint64)
    each = pd.util.hash_array(np.array(w, dtype=object), categorize=False)
    width = min(words, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for k in range(width):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + each[k:k + len(h)]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ (h >> np.uint64(29)))


def n_first(n: int, threshold: float) -> int:
    """Sets of n with the similarity to others share one of so many that come first in any common order."""
    return n - math.ceil(n * threshold - 1e-9) + 1


def marker(threshold: float, words: int, late: Mapping[int, int]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """(id, n, mark, first) of each text with words: its number of shingles, a digest of all of them, the codes of the first ones. The
    order is that of the codes; those in late come after all others, by their numbers there."""
    late_codes = np.array(sorted(late), dtype=np.int64).view(np.uint64)
    late_codes, turns = np.sort(late_codes), np.array([late[int(c)] for c in np.sort(late_codes).view(np.int64)], dtype=np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, text in zip(batch["id"].tolist(), batch["text"].tolist()):
                codes = codes_of(text, words)
                if not len(codes):
                    continue
                mark = hashlib.sha256(codes.tobytes()).digest()
                if len(late_codes):
                    at = np.minimum(np.searchsorted(late_codes, codes), len(late_codes) - 1)
                    turn = np.where(late_codes[at] == codes, turns[at], 0)
                    codes = codes[np.argsort(turn, kind="stable")]
                out.append((i, len(codes), mark, codes[:n_first(len(codes), threshold)].view(np.int64)))
            yield pd.DataFrame(out, columns=["id", "n", "mark", "first"])

    return run


def sketcher(words: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """(id, body) of each text: how many of its shingles fall into each of 64 to 4096 buckets of their codes, a byte each, about two
    a bucket; empty where a byte does not hold it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                codes = codes_of(text, words)
                buckets = 1 << min(12, max(6, (len(codes) // 2).bit_length()))
                counts = np.bincount((codes % np.uint64(buckets)).astype(np.int64), minlength=buckets)
                out.append(counts.astype(np.uint8).tobytes() if counts.max() < 256 else b"")
            yield pd.DataFrame({"id": batch["id"], "body": out})

    return run


def may_reach(threshold: float) -> Callable[[bytes, bytes], float | None]:
    """What the similarity of two sketched sets is at most: of a bucket they have no more in common than the lesser count. None
    below the threshold."""

    def bound(one: bytes, two: bytes) -> float | None:
        if not one or not two:
            return 1.0
        a, b = np.frombuffer(one, np.uint8).astype(np.int64), np.frombuffer(two, np.uint8).astype(np.int64)
        width = min(len(a), len(b))
        a, b = a.reshape(-1, width).sum(0), b.reshape(-1, width).sum(0)
        common = int(np.minimum(a, b).sum())
        most = common / max(1, int(a.sum() + b.sum()) - common)
        return most if most >= threshold - 1e-9 else None

    return bound


def reaches(threshold: float) -> Callable[[set, set], float | None]:
    """The similarity of two sets of shingles, None below the threshold."""

    def similarity(one: set, two: set) -> float | None:
        common = len(one & two)
        found = common / (len(one) + len(two) - common)
        return found if found >= threshold else None

    return similarity
