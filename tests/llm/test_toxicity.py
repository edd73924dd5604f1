import random
import zlib

import numpy as np
import pytest

from peptrove.llm import toxicity as X

from .conftest import prose

BAD = ["idiot", "scum", "moron"]


def labelled(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words, toxic = prose(seed * 10_000 + i, rng.randint(5, 200)).split(), int(rng.random() < 0.3)
        for _ in range(2 * toxic):
            words.insert(rng.randrange(len(words) + 1), rng.choice(BAD))
        out.append((" ".join(words), toxic))
    return out


@pytest.fixture(scope="module")
def net():
    rows = labelled(400, 1)
    return X.train([t.encode() for t, _ in rows], [y for _, y in rows])


def test_held_out_accuracy(net):
    rows = labelled(300, 2)
    p = net.scores([t.encode() for t, _ in rows], X.Lookup(net.vocabulary))
    assert ((p >= 0.5) == np.array([y for _, y in rows])).mean() >= 0.97 and ((p >= 0) & (p <= 1)).all()


def test_gradients_are_those_of_the_loss():
    net = X.Network(np.arange(1, 6).astype(np.uint64), 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, docs, y = rng.normal(size=(50, 16)), np.repeat([0, 1, 2], [40, 7, 3]), np.array([1.0, 0.0, 1.0, 0.0, 1.0])[: len(X.windows(np.repeat([0, 1, 2], [40, 7, 3]))[0])]
    at, _ = X.windows(docs)
    assert len(at) == 4 or X.STRIDE != 24
    loss = lambda: float(np.mean(np.logaddexp(0, z := net.logits(net.rows(x).astype(np.float64), at)) - y * z))
    _, g, dx = net.gradients(net.rows(x).astype(np.float64), at, x, y)
    for name in ("x", "bias", "forward", "backward", "attend", "out", "b"):
        flat, own = net.p[name].reshape(-1), np.asarray(g[name]).reshape(-1)
        for k in rng.integers(0, len(flat), 4):
            keep, e = flat[k], 1e-3
            flat[k] = keep + e
            up = loss()
            flat[k] = keep - e
            assert (up - loss()) / (2 * e) == pytest.approx(own[k], abs=3e-4)
            flat[k] = keep


def test_windows_overlap_and_cover():
    docs = np.repeat([0, 2, 5], [100, 1, 33])
    at, own = X.windows(docs)
    for d, lo, n in ((0, 0, 100), (2, 100, 1), (5, 101, 33)):
        places = at[own == d]
        assert set(places[places < len(docs)].tolist()) == set(range(lo, lo + n))
    assert (at[1][: X.WINDOW - X.STRIDE] == at[0][X.STRIDE :]).all()


def test_long_texts_are_scored_whole(net):
    lookup = X.Lookup(net.vocabulary)
    clean, at_end = prose(3, 60_000).encode(), (prose(3, 60_000) + " idiot scum moron").encode()
    p = net.scores([clean, at_end], lookup)
    assert p[0] < 0.5 <= p[1]


def test_parts_change_no_score(net):
    """A text read in parts of any size has the windows of the whole text, also where words are very long."""
    lookup = X.Lookup(net.vocabulary)
    texts = [prose(7, 3000), prose(8, 500) + " " + "x" * 5000 + " " + prose(9, 700) + " scum", " ".join("y" * 900 for _ in range(60)) + " idiot moron", "z" * 20_000, prose(10, 1041)]
    whole = net.scores([t.encode() for t in texts], lookup)
    for most in (300, 1000, 4097, 9000):
        assert np.allclose(net.scores([t.encode() for t in texts], lookup, most), whole, atol=1e-6)
    docs = [w for t in texts for w in X.windows(np.zeros(len(t.encode().translate(X.WORD_BYTES).split()), int))[0]]
    parts = [p for t in texts for p in X.parts_of(t.encode().translate(X.WORD_BYTES), 1000)]
    assert sum(len(X.windows(np.zeros(len(p.split()), int))[0]) for p in parts) == len(docs)


def test_scores_are_those_of_the_definition(net):
    """Brute force: every window of every text, one at a time, with plain loops over its words."""
    lookup = X.Lookup(net.vocabulary)
    for text in (prose(11, 75), prose(12, 20) + " scum unseenword", "one"):
        words = [w for w in text.encode().translate(X.WORD_BYTES).split()]
        vectors = []
        for w in words:
            raw = np.frombuffer(w, np.uint8)
            number = int(lookup(X.hash_spans(raw, np.array([0]), np.array([len(w)])))[0])
            pairs = X.pair_numbers(np.frombuffer(b" " + w, np.uint8))[1:]
            vectors.append(np.concatenate([net.p["word"][number], net.p["char"][pairs].mean(0)]))
        best, h = -np.inf, X.HIDDEN
        for at in range(0, max(1, len(words) - (X.WINDOW - X.STRIDE)), X.STRIDE):
            x = [v @ net.p["x"] + net.p["bias"] for v in vectors[at : at + X.WINDOW]]
            states = {}
            for name, order, lo in (("forward", range(len(x)), 0), ("backward", range(len(x) - 1, -1, -1), 3 * h)):
                s = np.zeros(h)
                for t in order:
                    g, u = x[t][lo : lo + 3 * h], s @ net.p[name]
                    z, r = X.sigmoid(g[:h] + u[:h]), X.sigmoid(g[h : 2 * h] + u[h : 2 * h])
                    s = s + z * (np.tanh(g[2 * h :] + r * u[2 * h :]) - s)
                    states.setdefault(t, []).append(s)
            both = np.array([np.concatenate(states[t]) for t in range(len(x))])
            a = np.exp(both @ net.p["attend"])
            best = max(best, float((a[:, None] * both).sum(0) / a.sum() @ net.p["out"] + net.p["b"][0]))
        assert net.scores([text.encode()], lookup)[0] == pytest.approx(X.sigmoid(best), abs=1e-4)


def test_odd_rows(spark, odd, nothing, net):
    out = X.score(odd, net, ["doc_id"])
    assert out.count() == odd.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    kept = X.drop_toxic(odd, net)
    assert kept.columns == odd.columns and kept.count() == out.where("score < 0.5").count()
    assert X.score(nothing, net, ["doc_id"]).collect() == [] and X.drop_toxic(nothing, net).collect() == []


def test_fit_learns_from_the_other_rows_only(spark, odd):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(labelled(60, 4))], "doc_id long, text string")
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0]
    labels = spark.createDataFrame([(i, 1 if i in held else 0, 9) for i in range(60)] + [(None, 1, 9), (3, None, 9)], "doc_id long, toxic int, quality int")
    assert X.fit(docs, labels).prior == 0.0  # all positive rows are held out
    assert X.fit(docs, labels.limit(0)).prior == 0.5
