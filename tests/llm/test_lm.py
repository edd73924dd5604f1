import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from peptrove.llm import lm as M

from .conftest import prose


def kt(z, o):
    return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)


def brute_force(train, texts):
    """Log10 probabilities by the definition, node by node."""
    counts = defaultdict(lambda: [0, 0])
    contexts = defaultdict(set)
    def steps(t):
        full = bytes(M.DEPTH) + t + M.END
        for i in range(M.DEPTH, len(full)):
            yield full[i - M.DEPTH : i][::-1], full[i]
    for t in train:
        for ctx, b in steps(t):
            for d in range(M.DEPTH + 1):
                for k in range(8):
                    p = (1 << k) | (b >> (8 - k))
                    counts[ctx[:d], p][(b >> (7 - k)) & 1] += 1
                    if d < M.DEPTH:
                        contexts[ctx[:d], p].add(ctx[: d + 1])
    weighted = {}
    def log_weighted(ctx, p):
        if (ctx, p) not in weighted:
            own = kt(*counts[ctx, p])
            weighted[ctx, p] = own if len(ctx) == M.DEPTH else math.log(0.5) + np.logaddexp(own, sum(log_weighted(c, p) for c in contexts[ctx, p]))
        return weighted[ctx, p]
    def chance(ctx, p, bit, d):
        z, o = counts.get((ctx[:d], p), (0, 0))
        own = ((o if bit else z) + 0.5) / (z + o + 1)
        if d == M.DEPTH or (ctx[: d + 1], p) not in counts:
            return own
        w = math.exp(math.log(0.5) + kt(z, o) - log_weighted(ctx[:d], p))
        return w * own + (1 - w) * chance(ctx, p, bit, d + 1)
    out = []
    for t in texts:
        total = 0.0
        for ctx, b in steps(t):
            for k in range(8):
                total += math.log10(chance(ctx, (1 << k) | (b >> (8 - k)), (b >> (7 - k)) & 1, 0))
        out.append(total)
    return out


TEXTS = ["the theory of the thing", "then there, that", "", None, "übergröße the", "zzz the", "the " * 30, "a", prose(1, 60), prose(2, 60)]


def frame(spark):
    return spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(TEXTS)] + [(None, "the end", "x", 1.0), (0, TEXTS[0], "x", 1.0)], "doc_id long, text string, base string, score double").repartition(3)


@pytest.mark.parametrize("hot_strings, hot_tokens", [(1 << 20, 1000), (10, 2), (0, 0)])
def test_against_the_definition(spark, hot_strings, hot_tokens):
    df = frame(spark)
    rows = M.score(df, F.pmod(M.crc32_of_id(), F.lit(M.MODULUS)) == M.HELD_OUT, hot_strings=hot_strings, hot_tokens=hot_tokens).collect()
    data = [(r.doc_id, r.text or "") for r in df.collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    train = [t for i, t in data if not held(i)]
    want = dict(zip([t for _, t in data], brute_force([t.encode() for t in train], [t.encode() for _, t in data]), strict=True))
    by_text = defaultdict(list)
    low = lambda t: re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    counts = Counter(w for t in train for w in low(t))
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    texts = {i: t for i, t in data}
    for r in rows:
        t = texts[r.doc_id]
        by_text[t].append(r)
        assert r.score == pytest.approx(want[t], rel=1e-5, abs=1e-4) and r.held_out == held(r.doc_id) and r.train_tokens == n
        own = low(t)
        assert r.n_tokens == len(own) + 1 and r.n_known == sum(counts[w] > 0 for w in own) + 1 and r.n_bytes == len(t.encode()) + 1
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own) + math.log10((len(train) + 1) / (n + v + 1)), rel=1e-9)
    assert len(rows) == len(data)


def test_probabilities_sum_to_one():
    rng = random.Random(1)
    codes = {}
    for code, _ in M.segments(["".join(rng.choice("abc ") for _ in range(400)).encode()]):
        for c in code.tolist():
            codes[c] = codes.get(c, 0) + 1
    context = next(iter(codes)) >> 8
    every = sorted({*codes, *((context << 8) | b for b in range(256))})
    branch = M.Branch(np.array(every, np.uint64), np.array([codes.get(c, 0) for c in every]))
    t = branch.totals()
    p = 10 ** branch.log10(M.Crown(t["cell"], t["zeros"], t["ones"], t["weighted"]))
    assert sum(p[i] for i, c in enumerate(every) if c >> 8 == context) == pytest.approx(1.0, abs=1e-9)


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 3.0, 10.0, 1e3, 1e8 + 0.5])
    assert np.allclose(M.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-10)


def test_no_training_rows_and_empty_table(spark, odd, nothing):
    rows = M.score(odd, F.lit(True)).collect()
    assert len(rows) == odd.count() and all(r.score == pytest.approx(-8 * r.n_bytes * math.log10(2)) and r.train_tokens == 0 for r in rows)
    assert M.score(nothing, F.lit(False)).collect() == []


def test_long_texts_are_split_with_their_context():
    text = prose(3, 3000).encode()
    whole = np.concatenate([c for c, _ in M.segments([text, b"x"])])
    parts = np.concatenate([c for c, _ in M.segments([text, b"x"], 100)])
    assert (whole == parts).all() and len(whole) == len(text) + 3
