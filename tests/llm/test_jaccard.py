import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from peptrove.llm import jaccard as J
from peptrove.llm.components import components, is_star

from .conftest import WORDS, odd_rows, prose


def corpus():
    rng = random.Random(9)
    texts = [prose(100 + i, rng.randint(1, 120)) for i in range(25)] + [None, "", "!!", "one two", "One, two.", "one two three"]
    for k in range(8):
        base = prose(500 + k, 60).split()
        for _ in range(rng.randint(1, 7)):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = rng.choice(WORDS) + "x"
            texts.append(" ".join(own) + rng.choice(["", "!", " tail"]))
    return texts + [texts[3]] * 6


def want(texts):
    return {i: (c, n) for i, (c, n) in enumerate(J.brute_force(texts))}


@pytest.mark.parametrize(("chunk", "leaf"), [(512, 32), (3, 32), (512, 1), (3, 2)])
def test_against_all_pairs(spark, monkeypatch, chunk, leaf):
    monkeypatch.setattr(J, "CHUNK_NODES", chunk)
    monkeypatch.setattr(J, "FEW_NODES", chunk)
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.class_id, r.n_links) for r in J.classes(df, leaf=leaf).collect()} == want(texts)


def test_odd_rows_and_dedupe(spark, odd, nothing):
    ids = [r[0] for r in odd_rows()]
    texts = [r[1] for r in odd_rows()]
    classes = J.brute_force(texts)
    kept = J.dedupe(odd)
    assert kept.columns == odd.columns and kept.count() == len({c for c, _ in classes})
    links = sorted(n for _, n in classes)
    assert sorted(r.n_links for r in J.classes(odd).collect()) == links and len(ids) == odd.count()
    assert J.classes(nothing).collect() == [] and J.dedupe(nothing).collect() == []


def test_base_depth():
    for trees, threshold in ((24, 0.8), (24, 0.5), (48, 0.9)):
        k = J.base_depth(trees, threshold, 0.999)
        assert 1 - (1 - threshold ** (k + 1)) ** trees >= 0.999 > 1 - (1 - threshold ** (k + 2)) ** trees or k == 1


def plain_depths(paths, base, trees, threshold, recall, leaf):
    """Brute force of shortened(): paths[node][tree] = (key, values of the next levels)."""
    deepest = base + J.STEPS
    prefix = lambda n, t, k: (t, paths[n][t][0], paths[n][t][1][: k - base])
    size = Counter(prefix(n, t, k) for n in paths for t in range(trees) for k in range(base, deepest + 1))
    lengths = {}
    for n in paths:
        wanted = [next((k for k in range(base, deepest + 1) if size[prefix(n, t, k)] <= leaf), deepest) for t in range(trees)]
        for most in range(deepest, base - 1, -1):
            missed = math.prod(1 - threshold ** min(k, most) for k in wanted)
            if most == base or missed <= 1 - recall:
                lengths[n] = [min(k, most) for k in wanted]
                break
    searched = {prefix(n, t, lengths[n][t]) for n in paths for t in range(trees)}
    return {(n, t): next(prefix(n, t, k) for k in range(base, deepest + 1) if prefix(n, t, k) in searched) for n in paths for t in range(trees)}, lengths


def test_prefixes_are_shortened_to_the_recall(spark):
    """Groups end at different depths, as the definition has it; each text keeps the recall."""
    rng, trees, base, leaf = random.Random(2), 24, 5, 4
    paths = {}
    for n in range(90):
        group = n // 30  # 0: many close texts, 1: close in a third of the trees, 2: on their own
        close = lambda t, group=group: group == 0 or group == 1 and t % 3 == 0
        paths[n] = [(t * 1000 + (group if close(t) else 10 + n // 2), tuple(rng.randrange(3) if close(t) else n for _ in range(J.STEPS))) for t in range(trees)]
    plain, lengths = plain_depths(paths, base, trees, 0.8, 0.999, leaf)
    rows = [(n, t, k, sum(v << 16 * (J.STEPS - 1 - i) for i, v in enumerate(rest))) for n, own in paths.items() for t, (k, rest) in enumerate(own)]
    counts = Counter((k) for _, _, k, _ in rows)
    shared = spark.createDataFrame([(*r, counts[r[2]]) for r in rows if counts[r[2]] > 1], "node long, tree int, key long, rest long, n long")
    got = J.shortened(shared, base, trees, 0.8, 0.999, leaf).collect()
    assert {(r.node, r.tree): r.depth for r in got} == {k: base + len(v[2]) for k, v in plain.items() if counts[v[1]] > 1}
    ours, theirs = defaultdict(set), defaultdict(set)
    for r in got:
        ours[r.key].add((r.node, r.tree))
    for k, v in plain.items():
        if counts[v[1]] > 1:
            theirs[v].add(k)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))
    ends = {g: {tuple(sorted(set(lengths[n]))) for n in paths if n // 30 == g} for g in range(3)}
    assert len({min(v) for v in ends.values()}) > 1 and {r.depth for r in got} >= {base, base + 1, base + 2}
    for n in paths:
        assert math.prod(1 - 0.8 ** k for k in lengths[n]) <= 0.001


def test_recall_at_the_threshold(spark):
    """Pairs of a similarity just over 0.8, beside a large group and a passage that many texts share."""
    rng, texts, pairs = random.Random(8), [], []
    passage = prose(77, 40)
    for i in range(400):
        words = [f"w{rng.randrange(10**9)}" for _ in range(120)]
        other = list(words)
        for at in rng.sample(range(2, 118, 6), 2):
            other[at] = "changed" + str(at)
        lead = passage + " " if i % 2 else ""
        pairs.append((len(texts), len(texts) + 1))
        texts += [lead + " ".join(words), lead + " ".join(other)]
    texts += [passage + " " + prose(5, 60) + f" u{i}" for i in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in J.classes(df, leaf=8).collect()}
    links = [(a, b) for a, b in pairs if J.brute_force([texts[a], texts[b]])[1][1]]
    assert len(links) > 350 and sum(got[a] == got[b] for a, b in links) >= 0.99 * len(links)


def test_shingles_are_sets_of_five_words():
    docs, words = J.hashed([b"a b c d e a b c d e", b"a b", b"", b"A, B!"])
    own, hashes = J.shingles(docs, words, 4)
    assert np.bincount(own, minlength=4).tolist() == [6, 1, 0, 1] and len(set(hashes[own == 0].tolist())) == 5
    assert hashes[own == 1].tolist() == hashes[own == 3].tolist()


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    root = {}
    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.a: r.b for r in components(df).collect()}
    assert got == {x: find(x) for x in root if find(x) != x} and is_star(components(df)) and components(df.limit(0)).collect() == []


def test_hot_group_makes_no_pairs(spark):
    base = prose(7, 60)
    texts = [base + f" unique{i}" for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = J.classes(df).agg(F.min("n_links"), F.count_distinct("class_id")).first()
    assert tuple(out) == (299, 1)


def test_salted_rows_of_a_large_table_are_not_broadcast(spark, monkeypatch):
    """Spark takes the salted rows for a sixteenth of what they are; only few of them may go through the driver."""
    from peptrove.llm import _common
    from peptrove.llm import components as C

    plans = []
    monkeypatch.setattr(C, "materialize", lambda df, name, f=C.materialize: plans.append(df) or f(df, name))
    edges = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    for most in (_common.FREE_BYTES, 0):
        monkeypatch.setattr(_common, "FREE_BYTES", most)
        plans.clear()
        assert {(r.a, r.b) for r in components(edges).collect()} == {(i, 0) for i in range(1, 401)}
        free = ["Broadcast" in df._jdf.queryExecution().executedPlan().toString() for df in plans]
        assert len(free) > 2 and any(free) == (most > 0)
