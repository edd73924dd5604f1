"""LM scoring by context-tree weighting over the bytes of a text.

A byte is eight binary decisions; a decision's node is the context (the 0 to 5
bytes before it) with the bits already decided.  Training counts give each
node its Krichevsky-Trofimov estimate, and from the deepest contexts up each
node's weighted probability: half its own estimate, half the product of its
longer contexts'.  A decision is then predicted by mixing the estimates of all
depths along its path with the posterior weights; a context that was never
seen leaves the prediction to the deepest one that was.  A text ends with a
byte that UTF-8 never has, so the probabilities of all texts sum to at most 1.

The counts are of six-byte strings, gathered by a shuffle; the part of the
tree below three context bytes is worked out by the tasks that hold its strings
(16.7 million at most share three), the top from sums of two context bytes and a
node, of which there are 16.7 million at most and a few 100,000 in practice.  The result is a table of
the log probability of every six-byte string of the corpus.  Texts are scored
in one pass: the most frequent strings and tokens, up to a fixed number, are
broadcast; the others go through a join, so no bound drops any.

The base score counts tokens the same way.

Defined cases: a null text is empty, one end token and one end byte; with no
training rows every bit has probability 1/2; repeated rows each get a row and
are all counted; null ids count as empty text when rows are held out; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import crc32_of_id, lean, materialize, slices, table, texts_of, with_row_id

DEPTH, TOP = 5, 3
END = b"\xff"
MODULUS, HELD_OUT = 7, 2
#: how many strings, and tokens, are broadcast at most
HOT_STRINGS, HOT_TOKENS = 1 << 21, 300_000
SEGMENT = 1 << 19
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
HALF = math.log(0.5)


def segments(texts: list[bytes], most: int = SEGMENT):
    """(codes, text numbers) for every byte and end of the texts. A code holds the byte in its
    lowest 8 bits and above it its context, the nearest byte highest."""

    def out(held):
        raw = np.frombuffer(b"".join(x for _, x in held), np.uint8).astype(np.uint64)
        n = len(raw)
        code = raw.copy()
        for k in range(1, DEPTH + 1):
            code[DEPTH:] |= raw[DEPTH - k : n - k] << np.uint64(8 * (DEPTH + 1 - k))
        sizes = np.array([len(x) for _, x in held])
        valid = np.ones(n, bool)
        valid[((np.cumsum(sizes) - sizes)[:, None] + np.arange(DEPTH)).ravel()] = False
        return code[valid], np.repeat([i for i, _ in held], sizes - DEPTH)

    held, size = [], 0
    for i, t in enumerate(texts):
        full = bytes(DEPTH) + t + END
        for at in range(DEPTH, len(full), most):
            part = full[at - DEPTH : at + most]
            if size and size + len(part) > most:
                yield out(held)
                held, size = [], 0
            held.append((i, part))
            size += len(part)
    if held:
        yield out(held)


def summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    c, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(c, kind="stable")
    c, n = c[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.empty(0, np.int64)
    return c[first], (np.add.reduceat(n, first) if len(first) else n)


def count_strings(docs: DataFrame) -> DataFrame:
    """code, n (training count), every (count in all rows), from rows (text, held_out)."""

    def run(batches):
        codes: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def out():
            c, n = summed(codes, counts)
            codes.clear()
            counts.clear()
            # the lowest bit tells held-out rows
            for lo in range(0, len(c), 200_000):
                part, k = c[lo : lo + 200_000], n[lo : lo + 200_000]
                trained = (part & np.uint64(1)) == 0
                yield pa.RecordBatch.from_pydict({"code": pa.array((part >> np.uint64(1)).astype(np.int64)), "n": pa.array(np.where(trained, k, 0)), "every": pa.array(k)})

        for batch in batches:
            held = np.array(batch.column(batch.schema.get_field_index("held_out")).to_pylist(), np.uint64)
            for code, own in segments(texts_of(batch, "text")):
                c = np.sort((code << np.uint64(1)) | held[own])
                first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
                codes.append(c[first])
                counts.append(np.diff(np.append(first, len(c))))
                if sum(map(len, codes)) > 3_000_000:
                    c, n = summed(codes, counts)
                    codes[:], counts[:] = [c], [n]
                    if len(c) > 1_500_000:
                        yield from out()
        if codes:
            yield from out()

    found = docs.select("text", "held_out").mapInArrow(lean(run), "code long, n long, every long")
    return found.groupBy("code").agg(F.sum("n").alias("n"), F.sum("every").alias("every"))


def count_tokens(docs: DataFrame) -> DataFrame:
    """token, c of training rows."""

    def run(batches):
        found: Counter = Counter()

        def out():
            items = list(found.items())
            found.clear()
            for lo in range(0, len(items), 100_000):
                part = items[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()).cast(pa.string()), pa.array([n for _, n in part], pa.int64())], names=["token", "c"])

        for batch in batches:
            for t in texts_of(batch, "text"):
                found.update(t.translate(LOWER).split())
                if len(found) > 500_000:
                    yield from out()
        yield from out()

    found = docs.where("held_out = 0").select("text").mapInArrow(lean(run), "token string, c long")
    return found.groupBy("token").agg(F.sum("c").alias("c"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    y = x + 8
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    i = 1 / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + i / 12 - i**3 / 360 + i**5 / 1260 - i**7 / 1680 - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


class Branch:
    """The tree from TOP context bytes on for some sorted codes with training counts."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, top: int = TOP):
        self.top, self.codes, self.up = top, {DEPTH: codes}, {}
        self.counts = {DEPTH: counts.astype(np.float64)}
        for d in range(DEPTH - 1, top - 1, -1):
            below = self.codes[d + 1]
            shorter = ((below >> np.uint64(16)) << np.uint64(8)) | (below & np.uint64(255))
            self.codes[d], self.up[d] = np.unique(shorter, return_inverse=True)
            self.counts[d] = np.bincount(self.up[d], self.counts[d + 1])

    def level(self, k: int) -> dict[int, tuple]:
        """By depth, for the decision of bit k: the codes' nodes, zeros, ones, log own, log weighted, first code."""
        out: dict[int, tuple] = {}
        for d in range(DEPTH, self.top - 1, -1):
            c = self.codes[d]
            key = c >> np.uint64(8 - k)
            new = np.concatenate([[True], key[1:] != key[:-1]])
            node, first = np.cumsum(new) - 1, np.flatnonzero(new)
            bit = ((c >> np.uint64(7 - k)) & np.uint64(1)).astype(np.float64)
            ones = np.bincount(node, self.counts[d] * bit)
            zeros = np.bincount(node, self.counts[d]) - ones
            own = log_kt(zeros, ones)
            weighted = own
            if d < DEPTH:
                below = out[d + 1]
                parent = node[self.up[d][below[5]]]
                weighted = HALF + np.logaddexp(own, np.bincount(parent, below[4], len(first)))
            out[d] = (node, zeros, ones, own, weighted, first)
        return out

    def totals(self) -> dict[str, np.ndarray]:
        """Per context of TOP - 1 bytes and node: zeros, ones, log weighted probabilities below."""
        parts = []
        for k in range(8):
            node, zeros, ones, _, weighted, first = self.level(k)[self.top]
            c = self.codes[self.top][first]
            prefix = (1 << k) | ((c & np.uint64(255)) >> np.uint64(8 - k)).astype(np.int64)
            parts.append(((c >> np.uint64(16)).astype(np.int64) * 256 + prefix, zeros, ones, weighted))
        cell, zeros, ones, weighted = (np.concatenate(x) for x in zip(*parts, strict=True))
        cells, at = np.unique(cell, return_inverse=True)
        return {"cell": cells, "zeros": np.bincount(at, zeros), "ones": np.bincount(at, ones), "weighted": np.bincount(at, weighted)}

    def log10(self, crown: Crown) -> np.ndarray:
        """Log10 probability of every code's byte after its context."""
        codes, total = self.codes[DEPTH], np.zeros(len(self.codes[DEPTH]))
        for k in range(8):
            at = {DEPTH: np.arange(len(codes))}
            for d in range(DEPTH - 1, self.top - 1, -1):
                at[d] = self.up[d][at[d + 1]]
            bit = ((codes >> np.uint64(7 - k)) & np.uint64(1)).astype(np.int64)
            prefix = (1 << k) | ((codes & np.uint64(255)) >> np.uint64(8 - k)).astype(np.int64)
            q, seen = None, None
            nodes = self.level(k)
            for d in range(DEPTH, self.top - 1, -1):
                node, zeros, ones, own, weighted, _ = nodes[d]
                n = node[at[d]]
                kt = np.where(bit == 1, ones[n], zeros[n])
                kt = (kt + 0.5) / (zeros[n] + ones[n] + 1)
                if q is None:
                    q = kt
                else:
                    w = np.exp(HALF + own - weighted)[n]
                    q = np.where(seen, w * kt + (1 - w) * q, kt)
                seen = (zeros + ones)[n] > 0
            total += np.log10(crown.mix(codes, prefix, bit, q, seen))
        return total


class Crown:
    """The nodes of less than TOP context bytes, as sorted cells (context and node) of each depth."""

    def __init__(self, cells: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        self.depths = []
        for d in range(TOP - 1, -1, -1):
            own = log_kt(zeros, ones)
            weighted = HALF + np.logaddexp(own, below)
            self.depths.append((d, cells, zeros, ones, np.exp(HALF + own - weighted)))
            cells, at = np.unique(((cells >> 16) << 8) | (cells & 255), return_inverse=True)
            zeros, ones, below = (np.bincount(at, v, len(cells)) for v in (zeros, ones, weighted))

    def mix(self, codes: np.ndarray, prefix: np.ndarray, bit: np.ndarray, q: np.ndarray, seen: np.ndarray) -> np.ndarray:
        for d, cells, zeros, ones, weight in self.depths:
            context = (codes >> np.uint64(8 * (DEPTH + 1 - d))).astype(np.int64)
            at = np.searchsorted(cells, (context << 8) | prefix)
            z, o = zeros[at], ones[at]
            kt = (np.where(bit == 1, o, z) + 0.5) / (z + o + 1)
            q = np.where(seen, weight[at] * kt + (1 - weight[at]) * q, kt)
            seen = z + o > 0
        return q


def branches(batches, at_least: int = 100_000):
    """Codes and counts from sorted batches, whole contexts of TOP bytes together."""
    codes, counts, size = [], [], 0
    for batch in batches:
        c = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
        n = batch.column(1).to_numpy(zero_copy_only=False)
        while len(c):
            if size >= at_least:
                last = codes[-1][-1] >> np.uint64(8 * (DEPTH + 1 - TOP))
                end = int(np.searchsorted(c >> np.uint64(8 * (DEPTH + 1 - TOP)), last, "right"))
                if end < len(c):
                    yield np.concatenate([*codes, c[:end]]), np.concatenate([*counts, n[:end]])
                    codes, counts, size, c, n = [], [], 0, c[end:], n[end:]
                    continue
            codes.append(c)
            counts.append(n)
            size += len(c)
            break
    if codes:
        yield np.concatenate(codes), np.concatenate(counts)


def string_model(strings: DataFrame) -> DataFrame:
    """code, lp (log10 of the byte after its context) for strings (code, n, every)."""
    dealt = strings.select("code", "n", "every").repartition(F.shiftright("code", 8 * (DEPTH + 1 - TOP))).sortWithinPartitions("code")

    def gather(batches):
        for codes, counts in branches(batches):
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in Branch(codes, counts).totals().items()})

    cells = dealt.mapInArrow(lean(gather), "cell long, zeros double, ones double, weighted double")
    sums = cells.groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "weighted"))).toArrow()  # 16.7 million rows at most
    cell, *rest = (sums.column(i).to_numpy() for i in range(4))
    order = np.argsort(cell)
    sent = strings.sparkSession.sparkContext.broadcast(Crown(cell[order], *(v[order] for v in rest)))

    def predict(batches):
        for codes, counts in branches(batches):
            yield pa.RecordBatch.from_pydict({"code": pa.array(codes.astype(np.int64)), "lp": pa.array(Branch(codes, counts).log10(sent.value))})

    return dealt.mapInArrow(lean(predict), "code long, lp double")


def most_frequent(counts: DataFrame, by: str, most: int) -> int:
    """The least count that leaves at most ``most`` rows at or above it."""
    total, least = 0, 1 << 62
    by_count = counts.groupBy(F.least(F.col(by), F.lit(1 << 16)).alias("k")).agg(F.count("*").alias("n")).collect()
    for r in sorted(by_count, key=lambda r: -r.k):
        total += r.n
        if total > most:
            break
        least = r.k
    return least


class Table:
    """Values of 64-bit codes by open addressing; other codes are found out."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * max(1, len(codes)) - 1).bit_length())
        self.keys = np.full(1 << self.bits, 2**64 - 1, np.uint64)
        self.values = np.zeros(1 << self.bits, np.float32)
        rest, self.probes = np.arange(len(codes)), 0
        while len(rest):
            at = (self.slot(codes[rest]) + self.probes) & (len(self.keys) - 1)
            free = self.keys[at] == 2**64 - 1
            taken, first = np.unique(at[free], return_index=True)
            who = rest[free][first]
            self.keys[taken], self.values[taken] = codes[who], values[who]
            rest = np.setdiff1d(rest, who, assume_unique=True)
            self.probes += 1

    def slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 if unknown), and places of the unknown."""
        at = self.slot(codes)
        key = self.keys[at]
        out = np.where(key == codes, self.values[at], np.float32(0))
        unknown = [np.flatnonzero((key != codes) & (key == 2**64 - 1))]
        rest = np.flatnonzero((key != codes) & (key != 2**64 - 1))
        for step in range(1, self.probes):
            slot = (at[rest] + step) & (len(self.keys) - 1)
            key = self.keys[slot]
            same = key == codes[rest]
            out[rest[same]] = self.values[slot[same]]
            unknown.append(rest[~same & (key == 2**64 - 1)])
            rest = rest[~same & (key != 2**64 - 1)]
        return out, np.concatenate([*unknown, rest])


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", hot_strings: int = HOT_STRINGS, hot_tokens: int = HOT_TOKENS) -> DataFrame:
    """rid, doc_id, held_out, n_bytes, n_tokens, n_known, train_tokens, base_score and score of every row;
    ``held_out`` is a boolean Column, true for rows that aren't learnt from."""
    spark = docs.sparkSession
    rows = with_row_id(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).cast("int").alias("held_out")))
    strings = materialize(count_strings(rows), "strings")
    model = materialize(string_model(strings), "string-model")
    tokens = materialize(count_tokens(rows), "tokens")
    n_words, n_distinct = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_docs = rows.where("held_out = 0").count()
    n_all, vocabulary = n_words + n_docs, n_distinct + (n_docs > 0)

    hot = strings.where(F.col("every") >= most_frequent(strings, "every", hot_strings)).join(model, "code").select("code", "lp").toArrow()
    sent_strings = spark.sparkContext.broadcast(Table(hot.column(0).to_numpy().astype(np.uint64), hot.column(1).to_numpy()))
    hot = tokens.where(F.col("c") >= most_frequent(tokens, "c", hot_tokens)).toArrow()
    sent_tokens = spark.sparkContext.broadcast(({w.encode(): n for w, n in zip(hot.column(0).to_pylist(), hot.column(1).to_pylist(), strict=True)}))

    def run(batches):
        known, get = sent_strings.value, sent_tokens.value.get
        for batch in slices(batches, "text"):
            texts = texts_of(batch, "text")
            n = len(texts)
            score, sizes = np.zeros(n), np.zeros(n, np.int64)
            cold_code, cold_text = [], []
            for code, own in segments(texts):
                value, unknown = known(code)
                score += np.bincount(own, value, n)
                sizes += np.bincount(own, minlength=n)
                cold_code.append(code[unknown])
                cold_text.append(own[unknown])
            code, own = (np.concatenate(cold_code), np.concatenate(cold_text)) if cold_code else (np.empty(0, np.uint64), np.empty(0, np.int64))
            order = np.argsort(own, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))]).astype(np.int32)
            n_tokens, n_known, base, rare = [], [], [], []
            for t in texts:
                own_tokens = t.translate(LOWER).split()
                counts = list(map(get, own_tokens))
                found = np.array([c for c in counts if c is not None], np.float64)
                n_tokens.append(len(own_tokens) + 1)
                n_known.append(len(found))
                base.append(float(np.log10(found + 1).sum()))
                rare.append([w.decode("utf-8", "replace") for w, c in zip(own_tokens, counts, strict=True) if c is None] if len(found) < len(counts) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in ("rid", "doc_id", "held_out")]
                + [pa.array(sizes), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base), pa.array(score), pa.array(rare, pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array(ends), pa.array(code[order].astype(np.int64)))],
                names=["rid", "doc_id", "held_out", "n_bytes", "n_tokens", "n_known", "base", "score", "rare_tokens", "rare_codes"])

    half = materialize(rows.select("rid", "doc_id", "held_out", "text").mapInArrow(lean(run), "rid long, doc_id long, held_out int, n_bytes long, n_tokens long, n_known long, base double, score double, rare_tokens array<string>, rare_codes array<long>"), "half-scored")
    rare = half.select("rid", F.explode("rare_tokens").alias("token")).join(tokens, "token").groupBy("rid").agg(F.count("*").alias("more_known"), F.sum(F.log10(F.col("c") + 1)).alias("more_base"))
    deep = half.select("rid", F.explode("rare_codes").alias("code")).join(model, "code").groupBy("rid").agg(F.sum("lp").alias("more_score"))
    both = half.drop("rare_tokens", "rare_codes").join(rare, "rid", "left").join(deep, "rid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.select(
        "rid", "doc_id", (F.col("held_out") == 1).alias("held_out"), "n_bytes", "n_tokens",
        (F.col("n_known") + zero("more_known") + F.lit(1 if n_docs else 0)).cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base") + F.lit(math.log10(n_docs + 1)) - F.col("n_tokens") * F.lit(math.log10(n_all + vocabulary + 1))).alias("base_score"),
        (F.col("score") + zero("more_score")).alias("score"),
    )


def op4_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(table(spark, sf_dir, "documents"), F.pmod(crc32_of_id(), F.lit(MODULUS)) == HELD_OUT)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", (-F.col("score") / F.lit(math.log10(2.0)) / F.col("n_bytes")).alias("bits_per_byte"))

