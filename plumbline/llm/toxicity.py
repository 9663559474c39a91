"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is a row of words. A word's input is its own embedding (by a hash of the word) beside the sum of the
embeddings of its character runs (three to five bytes, with marks at both ends), so that words never seen in
training score by what they are made of. Two gated recurrent chains read each window of WINDOW words, one from
either end; attention weighs their states into one vector, from which the window's score comes. Windows overlap
and cover the whole text; a text is as toxic as its most toxic window.

Labels are of whole texts, so training goes from windows at random to the windows that score highest: a toxic
text must have toxic windows, the worst windows of other texts are not toxic. It uses a sample of labelled rows
(at most MAX_TOXIC and MAX_OTHER texts, those with the smallest hashes of their ids), the only bound here. A
fifth of the sample is kept out and turns scores into probabilities, at the sample frame's share of toxic rows.

Defined results: a null or empty text, and one without words, has score 0; without labels of both kinds every
score is 0; repeated rows score alike; labels are read for training alone; an empty table gives an empty result;
null ids are never trained on; of several texts with one id the first in order is; other columns are not looked at.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import memory_back, ship, small_batches

WINDOW, STEP = 32, 24
ENTRIES, WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 1 << 16, 6, 10, 8, 8
RUNS = (3, 4, 5)
MAX_TOXIC, MAX_OTHER = 1500, 3000
THRESHOLD, SEED = 0.3, 5
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def word_hashes(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's entry; then the entries of all character runs and the number of the word each belongs to."""
    coded = [b"<" + w.encode("utf-8", "replace") + b">" for w in words]
    own = np.fromiter((zlib.crc32(c) & (ENTRIES - 1) for c in coded), dtype=np.int64, count=len(coded))
    lengths = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
    flat = np.frombuffer(b"".join(coded) + b"\0" * max(RUNS), dtype=np.uint8).astype(np.uint32)
    n = int(lengths.sum())
    of = np.repeat(np.arange(len(coded)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(n)  # bytes from here to the word's end
    entries, owners = [], []
    h = np.full(n, 2166136261, dtype=np.uint32)
    for k in range(max(RUNS)):
        h = (h ^ flat[k:k + n]) * np.uint32(16777619)
        if k + 1 in RUNS:
            there = np.flatnonzero(left > k)
            x = h[there] ^ np.uint32((k + 1) * 0x9E3779B1 & 0xFFFFFFFF)
            entries.append(((x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(16)).astype(np.int64))
            owners.append(of[there])
    return own, np.concatenate(entries), np.concatenate(owners)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def windows_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many words that stand one behind the other: each window's text, first word and size."""
    texts, starts, sizes = [], [], []
    at = 0
    for i, n in enumerate(lengths.tolist()):
        if n:
            firsts = list(range(0, max(1, n - WINDOW + 1), STEP))
            if n > WINDOW and firsts[-1] != n - WINDOW:
                firsts.append(n - WINDOW)
            texts += [i] * len(firsts)
            starts += [at + s for s in firsts]
            sizes += [min(WINDOW, n)] * len(firsts)
        at += n
    return np.array(texts, dtype=np.int64), np.array(starts, dtype=np.int64), np.array(sizes, dtype=np.int64)


class Network:
    """Weights by name; forward and backward are written out."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
        size, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.w = {"word": draw(ENTRIES, WORD_DIM, s=0.1), "char": draw(ENTRIES, CHAR_DIM, s=0.1)}
        for side in "fb":
            self.w |= {f"in_{side}": draw(size, 3 * h, s=size**-0.5), f"own_{side}": draw(h, 3 * h, s=h**-0.5), f"bias_{side}": np.zeros(3 * h, np.float32)}
        self.w |= {"att": draw(2 * h, ATTENTION, s=(2 * h) ** -0.5), "att_bias": np.zeros(ATTENTION, np.float32), "att_out": draw(ATTENTION, s=0.5), "out": draw(2 * h, s=0.5), "out_bias": np.zeros(1, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, hashes: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The words' input vectors, and one over the root of each word's number of runs."""
        own, runs, owners = hashes
        scale = (1 / np.sqrt(np.maximum(1, np.bincount(owners, minlength=len(own))))).astype(np.float32)
        char = np.stack([np.bincount(owners, weights=self.w["char"][runs, d], minlength=len(own)) for d in range(CHAR_DIM)], axis=1).astype(np.float32)
        return np.concatenate([self.w["word"][own], char * scale[:, None]], axis=1), scale

    def chain(self, side: str, projected: np.ndarray, index: np.ndarray, mask: np.ndarray | None, keep: list | None) -> np.ndarray:
        """States (words of a window, windows, HIDDEN) of one direction."""
        h, own, steps = HIDDEN, self.w[f"own_{side}"], index.shape[1]
        state = np.zeros((len(index), h), np.float32)
        out = np.empty((steps, len(index), h), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            x, u = projected[index[:, t]], state @ own
            gates = sigmoid(x[:, :2 * h] + u[:, :2 * h])
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(x[:, 2 * h:] + r * u[:, 2 * h:])
            following = new + z * (state - new)
            if mask is not None:
                following = np.where(mask[:, t, None], following, state)
            if keep is not None:
                keep.append((t, state, z, r, new, u[:, 2 * h:]))
            out[t] = state = following
        return out

    def logits(self, vectors: np.ndarray, index: np.ndarray, mask: np.ndarray | None, keep: dict | None = None) -> np.ndarray:
        steps = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        states = np.concatenate([self.chain(s, vectors @ self.w[f"in_{s}"] + self.w[f"bias_{s}"], index, mask, steps[s]) for s in "fb"], axis=2)
        hidden = np.tanh(states @ self.w["att"] + self.w["att_bias"])
        e = hidden @ self.w["att_out"]
        if mask is not None:
            e = np.where(mask.T, e, -1e9)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", a, states)
        if keep is not None:
            keep |= {"steps": steps, "states": states, "hidden": hidden, "a": a, "pooled": pooled}
        return pooled @ self.w["out"] + self.w["out_bias"][0]

    def gradients(self, words: Sequence[str], index: np.ndarray, mask: np.ndarray, target: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Of the mean cross-entropy; for the tables also the rows that have one."""
        hashes = word_hashes(words)
        vectors, scale = self.inputs(hashes)
        keep: dict = {}
        d = (sigmoid(self.logits(vectors, index, mask, keep)) - target).astype(np.float32) / len(target)
        states, a, hidden, h = keep["states"], keep["a"], keep["hidden"], HIDDEN
        g = {"out": keep["pooled"].T @ d, "out_bias": np.array([d.sum()], np.float32)}
        d_pooled = d[:, None] * self.w["out"]
        d_states = a[:, :, None] * d_pooled
        d_a = np.einsum("nh,tnh->tn", d_pooled, states)
        d_e = a * (d_a - (a * d_a).sum(axis=0))
        g["att_out"] = np.einsum("tn,tnk->k", d_e, hidden)
        d_hidden = d_e[:, :, None] * self.w["att_out"] * (1 - hidden**2)
        g["att"], g["att_bias"] = np.einsum("tnh,tnk->hk", states, d_hidden), d_hidden.sum(axis=(0, 1))
        d_states = d_states + d_hidden @ self.w["att"].T
        d_vectors = np.zeros_like(vectors)
        for s, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            own, d_own = self.w[f"own_{s}"], np.zeros_like(self.w[f"own_{s}"])
            d_projected = np.zeros((len(vectors), 3 * h), np.float32)
            back = np.zeros((len(index), h), np.float32)
            for t, before, z, r, new, u in reversed(keep["steps"][s]):
                total = d_states[t, :, part] + back
                live = np.where(mask[:, t, None], total, 0)
                d_new = live * (1 - z) * (1 - new**2)
                d_x = np.concatenate([live * (before - new) * z * (1 - z), d_new * u * r * (1 - r), d_new], axis=1)
                d_u = np.concatenate([d_x[:, :2 * h], d_new * r], axis=1)
                d_own += before.T @ d_u
                back = d_u @ own.T + live * z + (total - live)
                np.add.at(d_projected, index[:, t], d_x)
            g[f"own_{s}"], g[f"in_{s}"], g[f"bias_{s}"] = d_own, vectors.T @ d_projected, d_projected.sum(axis=0)
            d_vectors += d_projected @ self.w[f"in_{s}"].T
        own_entry, runs, owners = hashes
        rows = {}
        for name, entry, value in (("word", own_entry, d_vectors[:, :WORD_DIM]), ("char", runs, (d_vectors[:, WORD_DIM:] * scale[:, None])[owners])):
            rows[name], place = np.unique(entry, return_inverse=True)
            g[name] = np.stack([np.bincount(place, weights=value[:, k], minlength=len(rows[name])) for k in range(value.shape[1])], axis=1).astype(np.float32)
        return g, rows

    def text_logits(self, texts: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's largest window logit (-inf without words); all windows' texts and logits."""
        known: dict[str, int] = {}
        flat = np.fromiter((known.setdefault(w, len(known)) for text in texts for w in text), dtype=np.int64)
        of, starts, sizes = windows_of(np.array([len(t) for t in texts], dtype=np.int64))
        best = np.full(len(texts), -np.inf)
        logits = np.zeros(len(of))
        if len(of):
            names = list(known)
            vectors = np.concatenate([self.inputs(word_hashes(names[i:i + 20_000]))[0] for i in range(0, len(names), 20_000)])
            for size in np.unique(sizes):  # windows of full size, then the few whole texts that are shorter
                chosen = np.flatnonzero(sizes == size)
                for i in range(0, len(chosen), 2048):
                    part = chosen[i:i + 2048]
                    logits[part] = self.window_logits(vectors, flat[starts[part, None] + np.arange(size)])
            np.maximum.at(best, of, logits)
        return best, of, logits

    def window_logits(self, vectors: np.ndarray, index: np.ndarray) -> np.ndarray:
        return self.logits(vectors, index, None)

    def scores(self, texts: Sequence[Sequence[str]]) -> np.ndarray:
        best = self.text_logits(texts)[0]
        return np.where(np.isfinite(best), sigmoid(self.scale * np.where(np.isfinite(best), best, 0) + self.shift), 0.0)


class Adam:
    def __init__(self, net: Network, rate: float) -> None:
        self.net, self.rate, self.step = net, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in net.w.items()}
        self.v = {k: np.zeros_like(v) for k, v in net.w.items()}

    def apply(self, g: dict[str, np.ndarray], rows: dict[str, np.ndarray]) -> None:
        self.step += 1
        c1, c2 = 1 - 0.9**self.step, 1 - 0.99**self.step
        for name, grad in g.items():
            at = rows.get(name, slice(None))
            m = self.m[name][at] = 0.9 * self.m[name][at] + 0.1 * grad
            v = self.v[name][at] = 0.99 * self.v[name][at] + 0.01 * grad**2
            self.net.w[name][at] -= self.rate * (m / c1) / (np.sqrt(v / c2) + 1e-6)


def train(texts: Sequence[Sequence[str]], toxic: np.ndarray, share: float, *, seed: int = SEED, rounds: int = 6, batch: int = 96) -> Network | None:
    """A network, fitted and calibrated; None without texts of both kinds. share: of toxic rows in the sample's frame."""
    rng = np.random.default_rng(seed)
    keep = [i for i, t in enumerate(texts) if t]
    texts, toxic = [texts[i] for i in keep], toxic[keep].astype(np.float32)
    if not 0 < toxic.sum() < len(toxic):
        return None
    held = np.zeros(len(texts), dtype=bool)
    for label in (0, 1):
        own = rng.permutation(np.flatnonzero(toxic == label))
        held[own[:len(own) // 5]] = True
    net, fit = Network(seed), np.flatnonzero(~held)
    fit_texts, fit_toxic = [texts[i] for i in fit], toxic[fit]
    adam = Adam(net, 0.01)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in fit_texts])])
    of, first, size = windows_of(np.diff(starts))
    by_text = np.searchsorted(of, np.arange(len(fit_texts) + 1))

    # Small samples get more rounds, so that the number of steps does not fall below what the weights need.
    for turn in range(max(rounds, min(40, 3600 // max(1, len(fit_texts))))):
        logits = None if turn == 0 else net.text_logits(fit_texts)[2]
        chosen = []
        for i in range(len(fit_texts)):
            own = np.arange(by_text[i], by_text[i + 1])
            if logits is None:
                chosen.append(rng.permutation(own)[:6 if fit_toxic[i] else 3])
            elif fit_toxic[i]:
                chosen.append(own[np.argsort(-logits[own])[:2]])
            else:
                chosen.append(np.unique([own[np.argmax(logits[own])], rng.choice(own)]))
        order = rng.permutation(np.concatenate(chosen))
        for low in range(0, len(order), batch):
            part = order[low:low + batch]
            known: dict[str, int] = {}
            index, mask = np.zeros((len(part), WINDOW), dtype=np.int64), np.zeros((len(part), WINDOW), dtype=bool)
            for row, k in enumerate(part):
                at = first[k] - starts[of[k]]
                own = fit_texts[of[k]][at:at + size[k]]
                index[row, :len(own)] = [known.setdefault(w, len(known)) for w in own]
                mask[row, :len(own)] = True
            adam.apply(*net.gradients(list(known), index, mask, fit_toxic[of[part]]))
        adam.rate *= 0.85

    # Probabilities: a logistic curve of the best logit on the texts kept out, at the frame's share of toxic rows.
    x, y = net.text_logits([texts[i] for i in np.flatnonzero(held)])[0] if held.any() else np.zeros(0), toxic[held]
    if 0 < y.sum() < len(y):
        positive = (y.sum() + 1) / (y.sum() + 2)
        negative = 1 / (len(y) - y.sum() + 2)
        target = np.where(y == 1, positive, negative)
        odds = np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
        weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
        a, b = 1.0, float(odds)
        for _ in range(50):  # Newton's steps, held by a slight pull to slope 1
            p = sigmoid(a * x + b)
            err, curve = weight * (p - target), weight * p * (1 - p) + 1e-9
            grad = np.array([(err * x).sum() + 0.01 * (a - 1), err.sum()])
            hess = np.array([[(curve * x * x).sum() + 0.01, (curve * x).sum()], [(curve * x).sum(), curve.sum() + 1e-6]])
            change = np.clip(np.linalg.solve(hess, grad), -1, 1)
            a, b = float(np.clip(a - change[0], 0.05, 20)), b - float(change[1])
        net.scale, net.shift = a, b
    return net


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network | None:
    """Learns from labelled rows that are not held out. MAX_TOXIC + MAX_OTHER texts at most meet in a task, which trains on them;
    the driver gets the network alone."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    usable = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~is_held_out(F.col("doc_id")))
    once = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in once.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    share = counts[1] / (counts[0] + counts[1])

    def trained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts:
            rows = pd.concat(parts).sort_values("doc_id", ignore_index=True)
            yield pd.DataFrame({"net": [pickle.dumps(train([words_of(t) for t in rows["text"].tolist()], rows["toxic"].to_numpy(), share))]})

    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    sample = once.filter("toxic = 1").orderBy(*order).limit(MAX_TOXIC).unionByName(once.filter("toxic = 0").orderBy(*order).limit(MAX_OTHER))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    nets = rows.coalesce(1).mapInPandas(lambda it: memory_back(trained(it)), "net binary").collect()
    return pickle.loads(nets[0]["net"]) if nets else None


def scores_of(texts: list[str | None], net: Network | None) -> np.ndarray:
    """A score for each text, some millions of characters at once; 0 without a network."""
    out = np.zeros(len(texts))
    low, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= 2_000_000 or i == len(texts) - 1:
            if net is not None:
                out[low:i + 1] = net.scores([words_of(t) for t in texts[low:i + 1]])
            low, size = i + 1, 0
    return out


def score(docs: DataFrame, net: Network | None, *, key: Column, text_col: str = "text") -> DataFrame:
    """Rows (key, score) with key as a string, for every row of docs; net goes to each executor once."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    model = spark.sparkContext.broadcast(net)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "score": scores_of(batch["text"].tolist(), model.value)})

    return docs.select(key.cast("string").alias("key"), F.col(text_col).cast("string").alias("text")).mapInPandas(lambda it: memory_back(scored(it)), "key string, score double")


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row: doc_id, held_out, score, predicted."""
    kind = docs.schema[id_col].dataType.simpleString()
    found = score(docs, fit(docs, labels, id_col=id_col, text_col=text_col), key=F.col(id_col), text_col=text_col)
    doc_id = F.col("key").cast(kind)
    return found.select(doc_id.alias("doc_id"), is_held_out(doc_id).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs below the threshold, with all their columns; each is decided where it stands."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col))

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from memory_back(pd.Series(scores_of(texts.tolist(), model.value)) for texts in batches)

    score_of = F.pandas_udf(scored, "double")
    return docs.filter(score_of(F.col(text_col).cast("string")) < THRESHOLD)
