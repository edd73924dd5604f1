"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A word enters as its own vector (words of the training sample) next to the
mean vector of its character pairs, so that unseen words have an input too.
Windows of 32 words, each 16 words after the last, overlap over the whole
text (a text that is read in parts has the same windows); in each a forward and a backward gated recurrent layer run, attention
pools their states, and the text's score is that of its highest window.

Training is numpy too, on at most ``sample`` labelled rows of at most
``sample_bytes`` (an ordered hash picks them, so the sample is the same on
every run), with vectors for the ``VOCABULARY`` words that most of them hold
and letter pairs for every word: all windows of a text are
scored and the gradient of the logistic loss goes through its highest one.
Rows with crc32(doc_id) mod 5 = 0 are held out.  Neither labels nor any column
but the text enters a score.

Defined cases: null and empty texts and texts without words score the sample's
share of toxic rows; labels of one kind only, or none, give that share (0.5 if
none) to every text; repeated rows score alike; an empty table gives no rows;
several labels of a document count as their largest; of several texts of a
labelled id the least one is learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import as_one, crc32_of_id, extended, give_back, lean, slices, table, texts_of
from ._words import WORD_BYTES, hash_spans, spans_of

WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 8
PAIRS = 4096
VOCABULARY = 20_000
#: the bound of the training sample: rows, and bytes of a row's text
SAMPLE, SAMPLE_BYTES = 4000, 32_768
EPOCHS, LEAST_STEPS, BATCH, RATE = 4, 240, 64, 0.01
HELD_OUT = 5
#: bytes of text that are read at once
PART = 1 << 19
REST = np.float32(-30.0)  # update gate of a place without a word


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Lookup:
    """Numbers of known 64-bit hashes, -1 for others: two tables, a slot in either."""

    BITS = 18

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64(0))
        self.slots = np.full((2, 1 << self.BITS), len(keys), np.int32)
        rest = np.arange(len(keys), dtype=np.int32)
        for k in range(2):
            at = self.at(keys[rest], k)
            self.slots[k, at] = rest
            rest = rest[self.slots[k, at] != rest]

    def at(self, hashes: np.ndarray, k: int) -> np.ndarray:
        return ((hashes >> np.uint64(20 * k + 4)) & np.uint64((1 << self.BITS) - 1)).astype(np.int64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        first = self.slots[0][self.at(hashes, 0)]
        hit = self.keys[first] == hashes
        second = self.slots[1][self.at(hashes, 1)]
        out = np.where(hit, first, np.where(self.keys[second] == hashes, second, -1))
        return np.where(out >= len(self.keys) - 1, -1, out)


def pair_numbers(raw: np.ndarray) -> np.ndarray:
    """A number from 1 for each byte with the one before it, 0 for spaces."""
    before = np.empty_like(raw)
    before[:1], before[1:] = 0x20, raw[:-1]
    n = 1 + (before.astype(np.int32) * 61 + raw) * 40503 % (PAIRS - 1)
    return np.where(raw == 0x20, 0, n)


def parts_of(text: bytes, most: int) -> Iterator[bytes]:
    """A long normalised text in parts of about ``most`` bytes. Each but the last ends with a window,
    and the next one begins with the window after it, so that no window lies across two parts."""
    at = 0
    while len(text) - at > most:
        size, m = most, 0
        while m < 1 and at + size < len(text):
            end = text.find(b" ", at + size)
            end = len(text) if end < 0 else end
            starts, ends = spans_of(np.frombuffer(text, np.uint8)[at:end])
            m, size = (len(starts) - (WINDOW - STRIDE)) // STRIDE, 2 * size
        if m < 1 or end == len(text):
            break
        yield text[at : at + int(ends[m * STRIDE + WINDOW - STRIDE - 1])]
        at += int(starts[m * STRIDE])
    if not at or len(text[at:].split()) > WINDOW - STRIDE:  # else all its words have been in the last window
        yield text[at:]


def read(texts: list[bytes], most: int = PART):
    """For parts of the texts: first text, each word's text (relative), hash, start, end, and the bytes."""

    def held_together():
        lo, held, size = 0, [], 0
        for i, t in enumerate(texts):
            n = t.translate(WORD_BYTES)
            if size and size + len(n) > most:
                yield lo, held
                lo, held, size = i, [], 0
            if len(n) > most:
                yield from ((i, [part]) for part in parts_of(n, most))
                lo = i + 1
                continue
            held.append(n)
            size += len(n) + 1
        if held:
            yield lo, held

    for first, held in held_together():
        raw = np.frombuffer(b" ".join(held), np.uint8)
        starts, ends = spans_of(raw)
        if len(starts):
            begins = np.cumsum([0] + [len(x) + 1 for x in held])
            yield first, np.searchsorted(begins, starts, "right") - 1, hash_spans(raw, starts, ends), starts, ends, raw


def windows(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word places of the overlapping windows (one past the last: none), and their texts."""
    n = len(docs)
    first = np.concatenate([[0], np.flatnonzero(np.diff(docs)) + 1])
    length = np.diff(np.append(first, n))
    count = np.maximum(1, -(-(length - (WINDOW - STRIDE)) // STRIDE))
    own = np.repeat(np.arange(len(first)), count)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    at = (nth * STRIDE)[:, None] + np.arange(WINDOW)
    return np.where(at < length[own][:, None], at + first[own][:, None], n), docs[first[own]]


class Network:
    def __init__(self, vocabulary: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        d = WORD_DIM + CHAR_DIM
        f = lambda *shape, s=0.3: rng.normal(0, s, shape).astype(np.float32)
        self.vocabulary = vocabulary
        self.prior = 0.5
        self.p = {
            "word": f(len(vocabulary) + 1, WORD_DIM, s=0.05), "char": f(PAIRS, CHAR_DIM, s=0.05), "x": f(d, 6 * HIDDEN), "bias": np.zeros(6 * HIDDEN, np.float32),
            "forward": f(HIDDEN, 3 * HIDDEN), "backward": f(HIDDEN, 3 * HIDDEN), "attend": f(2 * HIDDEN), "out": f(2 * HIDDEN), "b": np.zeros(1, np.float32),
        }

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Gate inputs of the words, and of the place without a word."""
        none = np.zeros((1, 6 * HIDDEN), np.float32)
        none[0, :HIDDEN] = none[0, 3 * HIDDEN : 4 * HIDDEN] = REST
        return np.concatenate([x @ self.p["x"] + self.p["bias"], none])

    def layer(self, rows: np.ndarray, at: np.ndarray, name: str, keep: bool):
        u, shift = self.p[name], 0 if name == "forward" else 3 * HIDDEN
        own = np.ascontiguousarray(rows[:, shift : shift + 3 * HIDDEN])
        h = np.zeros((len(at), HIDDEN), np.float32)
        states, held = np.empty((WINDOW, len(at), HIDDEN), np.float32), {}
        for t in range(WINDOW) if name == "forward" else range(WINDOW - 1, -1, -1):
            g, s = own[at[:, t]], h @ u
            gates = g[:, : 2 * HIDDEN] + s[:, : 2 * HIDDEN]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = np.tanh(g[:, 2 * HIDDEN :] + r * s[:, 2 * HIDDEN :])
            if keep:
                held[t] = (h, z, r, c, s[:, 2 * HIDDEN :])
            h = h + z * (c - h)
            states[t] = h
        return states, held

    def logits(self, rows: np.ndarray, at: np.ndarray, keep: bool = False):
        forward, fh = self.layer(rows, at, "forward", keep)
        backward, bh = self.layer(rows, at, "backward", keep)
        there = (at < len(rows) - 1).T
        e = forward @ self.p["attend"][:HIDDEN] + backward @ self.p["attend"][HIDDEN:]
        e = np.where(there, e, np.float32(-1e9))
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = np.concatenate([(a[:, :, None] * forward).sum(0), (a[:, :, None] * backward).sum(0)], 1)
        y = pooled @ self.p["out"] + self.p["b"][0]
        return (y, (forward, fh, backward, bh, a, pooled)) if keep else y

    def gradients(self, rows: np.ndarray, at: np.ndarray, x: np.ndarray, wanted: np.ndarray):
        """Of the logistic loss of the windows ``at``, and of their words' inputs."""
        y, (forward, fh, backward, bh, a, pooled) = self.logits(rows, at, True)
        dy = ((sigmoid(y) - wanted) / len(y)).astype(np.float32)
        g = {"out": pooled.T @ dy, "b": np.array([dy.sum()], np.float32)}
        dpool = dy[:, None] * self.p["out"]
        da = (forward * dpool[None, :, :HIDDEN]).sum(2) + (backward * dpool[None, :, HIDDEN:]).sum(2)
        de = a * (da - (a * da).sum(0))
        g["attend"] = np.concatenate([(de[:, :, None] * forward).sum((0, 1)), (de[:, :, None] * backward).sum((0, 1))])
        drows = np.zeros_like(rows)
        for name, held, lo, shift in (("forward", fh, 0, 0), ("backward", bh, HIDDEN, 3 * HIDDEN)):
            u, du, dh = self.p[name], np.zeros_like(self.p[name]), np.zeros((len(at), HIDDEN), np.float32)
            for t in range(WINDOW - 1, -1, -1) if name == "forward" else range(WINDOW):
                h, z, r, c, s = held[t]
                dh = dh + a[t][:, None] * dpool[:, lo : lo + HIDDEN] + de[t][:, None] * self.p["attend"][lo : lo + HIDDEN]
                dz, dc = dh * (c - h) * z * (1 - z), dh * z * (1 - c * c)
                dr = dc * s * r * (1 - r)
                ds = np.concatenate([dz, dr, dc * r], 1)
                np.add.at(drows[:, shift : shift + 3 * HIDDEN], at[:, t], np.concatenate([dz, dr, dc], 1))
                du += h.T @ ds
                dh = dh * (1 - z) + ds @ u.T
            g[name] = du
        drows = drows[:-1]
        g["x"], g["bias"] = x.T @ drows, drows.sum(0)
        return y, g, drows @ self.p["x"].T

    def letters(self, spelled: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean vectors of the letter pairs of words, and the pairs one after another."""
        if not len(starts):
            return np.zeros((0, CHAR_DIM), np.float32), np.zeros(0, np.int64)
        first = np.cumsum(lengths) - lengths
        own = spelled[np.arange(first[-1] + lengths[-1]) + np.repeat(starts - first, lengths)]
        return np.add.reduceat(self.p["char"][own], first, axis=0) / lengths[:, None].astype(np.float32), own

    def freeze(self, spelled: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """Gate inputs of the known words, from their letter pairs."""
        letters = self.letters(spelled, starts, lengths)[0]
        self.table = np.concatenate([self.p["word"][:-1], letters], 1) @ self.p["x"] + self.p["bias"]

    def unknown(self, starts: np.ndarray, ends: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Gate inputs of the other words."""
        length = ends - starts
        if not len(length):
            return np.zeros((0, 6 * HIDDEN), np.float32)
        letters = self.letters(pair_numbers(raw), starts, length)[0]
        return letters @ self.p["x"][WORD_DIM:] + (self.p["word"][-1] @ self.p["x"][:WORD_DIM] + self.p["bias"])

    def scores(self, texts: list[bytes], lookup: Lookup, most: int = PART) -> np.ndarray:
        best = np.full(len(texts), -np.inf, np.float32)
        n = len(self.vocabulary)
        none = self.rows(np.zeros((0, WORD_DIM + CHAR_DIM), np.float32))
        for first, docs, hashes, starts, ends, raw in read(texts, most):
            at, own = windows(docs)
            row = np.append(lookup(hashes), 0)
            new = np.flatnonzero(row < 0)
            row[new] = n + np.arange(len(new))
            row[-1] = n + len(new)
            y = self.logits(np.concatenate([self.table, self.unknown(starts[new], ends[new], raw), none]), row[at])
            np.maximum.at(best, first + own, y)
        return np.where(np.isfinite(best), sigmoid(best.astype(np.float64)), self.prior)


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """A network fitted to labelled texts."""
    wanted = np.array(labels, np.float32)
    docs, hashes, spelled, seen = [], [], [np.empty(0, np.int32)], set()
    for first, own, h, starts, ends, raw in read(texts):
        docs.append((first + own).astype(np.int32))
        hashes.append(h)
        pairs = pair_numbers(raw)
        new, at = np.unique(h, return_index=True)
        for key, k in zip(new.tolist(), at.tolist(), strict=True):
            if key not in seen:
                seen.add(key)
                spelled.append((key, pairs[starts[k] : ends[k]].copy()))
    if not docs or wanted.min() == wanted.max():
        net = Network(np.empty(0, np.uint64), seed)
        net.prior = float(wanted.mean()) if len(wanted) else 0.5
        net.p["out"][:] = 0
        net.freeze(spelled[0], np.empty(0, np.int64), np.empty(0, np.int64))
        net.p["b"][0] = np.log((net.prior + 1e-6) / (1 - net.prior + 1e-6))
        return net
    docs, hashes = np.concatenate(docs), np.concatenate(hashes)  # in the order of the texts
    distinct, token = np.unique(hashes, return_inverse=True)
    token = token.astype(np.int32)
    spelled = [pairs for _, pairs in sorted(spelled[1:], key=lambda s: s[0])]
    lengths = np.array([len(s) for s in spelled])
    flat, starts = np.concatenate(spelled), np.cumsum(lengths) - lengths
    del hashes, spelled, seen, pairs, raw, h, own, new, at
    # words by the number of texts that hold them; their log-odds start one dimension
    held = np.unique(token.astype(np.int64) * len(texts) + docs)
    n = np.bincount(held // len(texts), minlength=len(distinct))
    pos = np.bincount(held // len(texts), wanted[held % len(texts)], minlength=len(distinct))
    del held
    often = np.flatnonzero(n >= 2)
    often = np.sort(often[np.argsort(-n[often], kind="stable")][:VOCABULARY])
    net = Network(distinct[often], seed)
    net.prior = float(wanted.mean())
    base = np.log(wanted.sum() / (len(wanted) - wanted.sum()))
    odds = np.log((pos[often] + 0.2) / (n[often] - pos[often] + 0.2 / np.exp(base))) - base
    net.p["word"][:-1, 0] += np.clip(odds / 2, -2, 2)
    net.p["b"][0] = base
    number = np.full(len(distinct), -1, np.int32)
    number[often] = np.arange(len(often))
    begin, end = np.searchsorted(docs, np.arange(len(texts))), np.searchsorted(docs, np.arange(len(texts)), "right")
    rng, moment = np.random.default_rng(seed), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step, worded = 0, np.flatnonzero(end > begin)
    n_parts = max(1, len(worded) // BATCH)
    epochs = max(epochs, -(-LEAST_STEPS // n_parts))
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(worded), n_parts):
            place = np.concatenate([np.arange(begin[k], end[k]) for k in part])
            letters, which = np.unique(token[place], return_inverse=True)
            char, own_pairs = net.letters(flat, starts[letters], lengths[letters])
            x = np.concatenate([net.p["word"][number[token[place]]], char[which]], 1)
            rows = net.rows(x)
            at, own = windows(np.repeat(np.arange(len(part)), end[part] - begin[part]))
            y = net.logits(rows, at)
            top = np.lexsort((y, own))[np.append(np.flatnonzero(np.diff(own)), len(own) - 1)]
            _, g, dx = net.gradients(rows, at[top], x, 0.97 * wanted[part][own[top]] + 0.015)
            g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            np.add.at(g["word"], number[token[place]], dx[:, :WORD_DIM])
            dchar = np.zeros_like(char)
            np.add.at(dchar, which, dx[:, WORD_DIM:])
            np.add.at(g["char"], own_pairs, np.repeat(dchar / lengths[letters][:, None], lengths[letters], 0))
            step += 1
            rate = RATE * (1 - 0.8 * epoch / epochs)
            for k, v in net.p.items():
                m, s = moment[k]
                m += 0.1 * (g[k] - m)
                s += 0.01 * (g[k] ** 2 - s)
                v -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    net.freeze(flat, starts[often], lengths[often])
    return net


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Network:
    """Trains on a bounded sample of the rows that aren't held out."""
    wanted = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.pmod(crc32_of_id(), F.lit(HELD_OUT)) != 0))
    wanted = wanted.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    picked = wanted.orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").where(F.octet_length("text").between(1, sample_bytes))
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: r.doc_id)
    texts, toxic = [r.text.encode() for r in rows], [int(r.toxic > 0) for r in rows]
    del rows
    net = train(texts, toxic)
    give_back()
    return net


def score(docs: DataFrame, net: Network, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` and the score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    kept = docs.select(*keep).schema
    text = "__text"

    def run(batches):
        model = sent.value
        lookup = Lookup(model.vocabulary)
        for batch in slices(batches, text):
            scores = model.scores(texts_of(batch, text), lookup)
            out = {f.name: batch.column(i) for i, f in enumerate(batch.schema) if f.name in kept.names}
            yield pa.RecordBatch.from_pydict(out | {"score": pa.array(scores.astype(np.float64))})

    return docs.select(*keep, F.col(text_col).alias(text)).mapInArrow(lean(run), extended(kept, "score double"))


def drop_toxic(docs: DataFrame, net: Network, threshold: float = 0.5) -> DataFrame:
    """The rows that score below the threshold, with their columns."""
    return score(as_one(docs), net, ["__row"]).where(F.col("score") < threshold).select("__row.*")


def op1_bidirectional_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return out.select("doc_id", (F.pmod(crc32_of_id(), F.lit(HELD_OUT)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
