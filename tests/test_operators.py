"""Operators on small frames: nulls, ties, empties, and rules that must hold for any data."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from peptrove.operators import aggregates as A
from peptrove.operators import arrays as R
from peptrove.operators import dedup as D
from peptrove.operators import joins as J
from peptrove.operators import stats as S


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("tol", [0.01, 0.5, 3.0])
def test_range_join_is_the_filtered_cross_join(spark, tol):
    rng = random.Random(3)
    xs, ys = [(i, round(rng.uniform(-5, 5), 2)) for i in range(80)] + [(900, None)], [(i, round(rng.uniform(-5, 5), 2)) for i in range(90)] + [(901, None)]
    a, b = spark.createDataFrame(xs, "i int, x double"), spark.createDataFrame(ys, "j int, y double")
    got = rows(J.binned_range_join(a, b, "x", "y", tol).select("i", "j"))
    assert got == sorted(((i, j) for i, x in xs for j, y in ys if x is not None and y is not None and abs(x - y) <= tol), key=str)


def test_ppm_join(spark):
    rng = random.Random(4)
    xs, ys = [(i, rng.uniform(200, 210)) for i in range(60)], [(i, rng.uniform(200, 210)) for i in range(60)]
    got = rows(J.ppm_range_join(spark.createDataFrame(xs, "i int, x double"), spark.createDataFrame(ys, "j int, y double"), "x", "y", 300).select("i", "j"))
    assert got == sorted(((i, j) for i, x in xs for j, y in ys if abs(x - y) <= x * 300e-6), key=str)


def test_link_by_keys(spark):
    a = spark.createDataFrame([("r1", 5, "k1"), ("r2", 7, "k2"), ("r3", 1, "k2"), ("r4", 1, "zz"), ("r5", 2, None)], "run string, n int, k string")
    b = spark.createDataFrame([("s1", 9, "k1"), ("s2", 7, "k2"), ("s3", 8, "k2")], "lab string, m int, k string")
    out = {r.run: (r.lab, r.n_candidates) for r in J.link_by_keys(a, b, [F.col("k")], [F.col("k")], "run", "lab", "n", "m").collect()}
    assert out == {"r1": ("s1", 1), "r2": ("s2", 2), "r3": (None, 2), "r4": (None, 0), "r5": (None, 0)}


def test_upserts(spark):
    old = spark.createDataFrame([(1, 5.0, "a"), (2, 5.0, "a")], "k int, s double, v string")
    new = spark.createDataFrame([(1, 5.0, "b"), (2, 6.0, "b"), (3, None, "b")], "k int, s double, v string")
    assert rows(D.keep_better(old, new, "k", "s").select("k", "v")) == [(1, "a"), (2, "b"), (3, "b")]
    gap = spark.createDataFrame([(1, None, "n"), (4, 1.0, "n")], "k int, s double, v string")
    assert rows(D.merge_fields(old, gap, ["k"])) == [(1, 5.0, "n"), (2, 5.0, "a"), (4, 1.0, "n")]
    assert rows(D.merge_fields(old, gap, ["k"], prefer_new=False)) == [(1, 5.0, "a"), (2, 5.0, "a"), (4, 1.0, "n")]
    once = D.replace_children(old, new.where("k = 1"), "k")
    assert rows(once) == rows(D.replace_children(once, new.where("k = 1"), "k")) == [(1, 5.0, "b"), (2, 5.0, "a")]


def test_modes_margins_and_floors(spark):
    df = spark.createDataFrame([("r", 2), ("r", 2), ("r", 3), ("r", 3), ("q", None)], "k string, v int")
    assert rows(D.mode(df, ["k"], "v")) == [("r", 2, 2)]
    m = spark.createDataFrame([("r", "a", 5.0), ("r", "b", 3.0), ("s", "c", 1.0)], "k string, t string, z double")
    assert rows(D.margin(m, ["k"], "t", "z")) == [("r", "a", 5.0, 2.0, "b"), ("s", "c", 1.0, None, None)]
    c = spark.createDataFrame([("k", i, float(i)) for i in range(10)], "k string, i int, s double")
    assert rows(D.best_candidates(c, ["k"], "s", True, "i", floor=0.5).select("i")) == [(5,)]
    assert rows(D.best_candidates(c.limit(0), ["k"], "s", True, "i")) == []


def test_dedup_is_idempotent_and_partition_free(spark):
    df = spark.createDataFrame([(i % 7, i % 3, i) for i in range(60)], "k int, q int, i int")
    once = D.first_by(df, ["k"], "q", "i")
    assert rows(once) == rows(D.first_by(once, ["k"], "q", "i")) == rows(D.first_by(df.repartition(9), ["k"], "q", "i"))


def test_additive_statistics(spark):
    df = spark.createDataFrame([("p", r, float(r) if r % 3 else None) for r in range(10)], "k string, run int, x double")
    parts = A.sums(["k", "run"], df, "x")
    left = A.subtract(A.combine(parts, ["k"]), A.combine(parts.where("run < 4"), ["k"]), ["k"])
    assert rows(left) == rows(A.sums(["k"], df.where("run >= 4"), "x"))
    mean, sd = left.select(*A.mean_sd("x")).first()
    xs = [x for x in range(4, 10) if x % 3]
    assert abs(mean - sum(xs) / len(xs)) < 1e-9 and abs(sd - math.sqrt(sum((x - sum(xs) / len(xs)) ** 2 for x in xs) / (len(xs) - 1))) < 1e-9


def test_histograms(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,), (7,), (8,)], "n int")
    assert {r.bucket: (r.label, r.n) for r in A.log2_histogram(df, "n").collect()} == {0: ("1", 1), 1: ("2-3", 2), 2: ("4-7", 2), 3: ("8-15", 1)}
    x = spark.createDataFrame([(0.0,), (0.99,), (1.0,), (2.0,), (None,), (-1.0,)], "x double")
    assert rows(A.histogram(x, "x", 0.0, 2.0, 2)) == [(1, 0.5, 2), (2, 1.5, 1)]
    assert sum(r.n for r in A.trimmed_histogram(spark.range(1000).select(F.col("id").cast("double").alias("x")), "x").collect()) == 990


def test_allowed_counts_the_window(spark):
    df = spark.createDataFrame([("u", 0, 0), ("u", 10, 1), ("u", 20, 2), ("u", 100, 3)], "k string, t long, i int")
    assert [r.allowed for r in A.allowed(df, "k", F.col("t"), "i", 2, 60).orderBy("i").collect()] == [True, True, False, True]


def test_arrays(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("k", 3, None)], "k string, o int, v string")
    folded = R.fold(df, ["k"], "o", "v")
    assert folded.first().v == ["a", "b", None] and rows(R.unfold(folded, "o", "v").select("k", "o", "v")) == rows(df)
    t = spark.createDataFrame([([0.0, 1.0, 2.0], [1.0, 3.0, 3.0]), ([], [])], "rt array<double>, i array<double>")
    assert [r.a for r in t.select(R.apex(F.col("rt"), F.col("i")).alias("a")).collect()] == [1.0, None]
    assert t.select(R.area(F.col("rt"), F.col("i")).alias("a")).first().a == 5.0
    assert t.select(R.interpolate(F.col("rt"), F.col("i"), F.lit(0.5)).alias("a")).first().a == 2.0
    assert t.select(R.interpolate(F.col("rt"), F.col("i"), F.lit(2.5)).alias("a")).first().a == 0.0
    assert t.select(R.pearson(F.col("rt"), F.col("rt")).alias("a")).first().a == pytest.approx(1.0)
    s = t.select(R.strongest(F.arrays_zip(F.col("rt"), F.col("i").alias("intensity")), 2).alias("a")).first().a
    assert [p.rt for p in s] == [1.0, 2.0]
    assert spark.createDataFrame([("1;x;2.5;NaN",)], "s string").select(R.numbers_of(F.col("s")).alias("a")).first().a == [1.0, None, 2.5, None]


def test_grid_average_aligns_apexes(spark):
    one, two = [0.0, 1.0, 0.0], [0.0, 3.0, 0.0]
    df = spark.createDataFrame([("k", [9.5, 10.0, 10.5], one), ("k", [19.5, 20.0, 20.5], two), ("k", [], [])], "k string, rt array<double>, i array<double>")
    out = R.grid_average(df, ["k"], "rt", "i").first()
    assert out.n_runs == 2 and len(out.intensity) == 41 and out.intensity[20] == pytest.approx(2.0) and out.intensity[0] == pytest.approx(0.0)


def test_coverage(spark):
    df = spark.createDataFrame([("p", "ABABAB", "ABA"), ("p", "ABABAB", "BAB"), ("p", "ABABAB", ""), ("q", "LLII", "IL"), ("r", "XYZ", "AAA")], "k string, s string, pep string")
    assert {r.k: (r.covered, r.percent) for r in R.coverage(df, ["k"], "s", "pep").collect()} == {"p": (6, 100.0), "q": (4, 100.0), "r": (0, 0.0)}


def test_word_hits(spark):
    df = spark.createDataFrame([(1, "CATCAT"), (2, "DOG"), (3, "")], "i int, s string")
    words = spark.createDataFrame([("CAT",), ("DOG",), ("TC",)], "w string")
    assert rows(R.word_hits(df, "i", "s", words, "w", 2, 3).select("i", "w")) == [(1, "CAT"), (1, "TC"), (2, "DOG")]


def test_trace_extraction(spark):
    peaks = spark.createDataFrame([(c, 10 + c * 0.1, 500.0, None, None, None, float(c)) for c in range(4)] + [(9, 50.0, 500.0, None, None, None, 99.0), (1, 10.1, 600.0, None, None, None, 7.0)], "cycle int, rt double, mz double, im double, iso_low double, iso_high double, intensity double")
    targets = spark.createDataFrame([("t", 0, 500.001, 700.0, 10.1, None), ("t", 1, 900.0, 700.0, 10.1, None)], "target string, channel int, target_mz double, precursor_mz double, target_rt double, target_im double")
    out = {r.channel: r for r in R.extract_traces(peaks, targets, window=0.25, points=4).collect()}
    assert out[0].trace == [0.0, 1.0, 2.0, 3.0] and out[1].trace == [0.0] * 4
    assert max(max(r.trace) for r in R.normalise(spark.createDataFrame([("t", 0, [0.0, 4.0])], "target string, channel int, trace array<double>"), ["target"]).collect()) == 1.0


def test_traces_against_plain_loops(spark):
    """Several ions, times and channels of a target; a target meets the peaks of its own time only."""
    rng = random.Random(8)
    maybe = lambda v: v if rng.random() < 0.8 else None
    peaks = [(c, c * 0.5, rng.choice([500.0, 500.01, 600.0]), maybe(rng.choice([0.9, 1.0])), *(maybe((300.0, 700.0)) or (None, None)), float(rng.randint(1, 9))) for c in range(120) for _ in range(3)]
    targets = [(t, rng.randint(0, 1), rng.choice([500.0, 600.0]), rng.choice([400.0, 900.0]), maybe(rng.choice([-9.0, 0.0, 7.0, 7.5, 30.0])), maybe(1.0)) for t in range(30) for _ in range(3)]
    want = {}
    for t, ch in {(x[0], x[1]) for x in targets}:
        own = [x for x in targets if x[:2] == (t, ch) and x[4] is not None]
        cycles = sorted(c for rt in {x[4] for x in own} for c in range(120) if abs(c * 0.5 - rt) <= 2)
        ok = lambda x, p: abs(p[2] - x[2]) <= x[2] * 15e-6 and abs(p[1] - x[4]) <= 2 and (p[4] is None or p[4] <= x[3] <= p[5]) and (p[3] is None or x[5] is None or abs(p[3] - x[5]) <= 0.03)
        if cycles:
            want[t, ch] = (len(cycles), [sum(p[6] for x in own for p in peaks if p[0] == c and ok(x, p)) for c in (cycles[0], cycles[-1])])
    out = R.extract_traces(
        spark.createDataFrame(peaks, "cycle int, rt double, mz double, im double, iso_low double, iso_high double, intensity double"),
        spark.createDataFrame(targets, "target int, channel int, target_mz double, precursor_mz double, target_rt double, target_im double"), window=2.0, points=2)
    assert {(r.target, r.channel): (r.n_cycles, list(r.trace)) for r in out.collect()} == want and any(v[1][0] for v in want.values())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("__time" in line for line in plan.splitlines() if "Join" in line and "mz" in line)


def exact_tail(k, n_all, marked, drawn):
    return sum(math.comb(marked, i) * math.comb(n_all - marked, drawn - i) for i in range(max(k, 0), min(marked, drawn) + 1)) / math.comb(n_all, drawn)


@pytest.mark.parametrize("k, n_all, marked, drawn", [(0, 50, 10, 20), (4, 50, 10, 20), (10, 50, 10, 20), (11, 50, 10, 20), (40, 2000, 60, 300), (3, 20, 18, 10)])
def test_hypergeometric_tail(spark, k, n_all, marked, drawn):
    got = spark.range(1).select(S.hypergeometric_tail(*(F.lit(v).cast("long") for v in (k, n_all, marked, drawn))).alias("p")).first().p
    assert got == pytest.approx(exact_tail(k, n_all, marked, drawn), rel=1e-7)


def test_tissue_and_blood_calls(spark):
    hits = spark.createDataFrame([("r", "brain", 40, 60, 300, 80.0, 120.0), ("r", "skin", 2, 50, 300, 2.0, 50.0), ("s", "skin", 2, 50, 300, 2.0, 50.0)], "run string, tissue string, n_hit long, n_panel long, n_groups long, z_hit double, z_panel double")
    calls = {r.run: (r.predicted, r.status) for r in S.tissue_calls(S.tissue_scores(hits, 2000)).collect()}
    assert calls == {"r": ("brain", "emitted"), "s": (None, "abstained_too_few_markers")}
    groups = [("r", f"g{i}", g, 10.0) for i, g in enumerate("ALB TF HP F2 FGA ACTB".split())] + [("s", "g", "ACTB", 1.0), ("s", "h", None, 1.0)]
    out = {r.run: (r.status, r.n_blood) for r in S.blood(spark.createDataFrame(groups, "run string, grp string, gene string, intensity double")).collect()}
    assert out == {"r": ("emitted", 5), "s": ("abstained_too_few_blood_proteins", 0)}


def test_cohort_prior_counts_a_run_once(spark):
    obs = spark.createDataFrame([("P", 2, "r1", "s1", 0.01, 10.0), ("P", 2, "r1", "s2", 0.001, 20.0), ("P", 2, "r2", "s1", 0.01, 30.0), ("P", 2, "TEST9", "s1", 0.0, 99.0)], "seq string, charge int, run string, search_id string, q double, irt double")
    cohort = obs.select("run").distinct()
    assert S.cohort_prior(obs, cohort, ["TEST"]).first().prior == 25.0
    assert S.cohort_prior(obs, cohort, ["TEST"], collapse=None).first().prior == 20.0


def test_isotonic_needs_rows(spark):
    few = spark.range(50).select(F.col("id").alias("k"), F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    assert S.isotonic_residuals(few, "x", "y", "k").count() == 0
    many = spark.range(400).select(F.col("id").alias("k"), F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
    assert S.isotonic_residuals(many, "x", "y", "k").agg(F.max(F.abs("residual"))).first()[0] <= 14
    arms = {"a": many.select("k", F.col("x").alias("prior")), "b": many.where("k < 300").select("k", F.col("x").alias("prior"))}
    out = {r.arm: (r.reach, r.n_common) for r in S.compare_selectors(arms, many.select("k", F.col("y").alias("rt")), key="k").collect()}
    assert out == {"a": (400, 300), "b": (300, 300)}


def test_allowed_requests(spark):
    """Brute force over a list of allowed times; a refused request counts for nothing."""
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randrange(60)) for i in range(300)]
    got = {r.i: r.allowed for r in A.allowed(spark.createDataFrame(rows, "i int, k string, t int").repartition(3), "k", F.col("t"), "i", 3, 5).collect()}
    held, want = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        inside = [x for x in held.setdefault(k, []) if x >= t - 5]
        want[i] = len(inside) < 3
        held[k] = inside + [t] * want[i]
    assert got == want and len(set(got.values())) == 2


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0] * 40 + [None], [1e-300, 1e300, 0.0, -7.5, 2.25, 2.25], None])
def test_order_statistics(spark, values):
    rng = random.Random(1)
    values = values or [round(rng.gauss(0, 10), rng.randint(0, 12)) for _ in range(700)] + [1e9, -1e12]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    real = sorted(v for v in values if v is not None)
    at = {f"r{k}": k for k in sorted({0, len(real) // 3, len(real) // 2, len(real) - 1})}
    got = A.order_statistics(df, "v", {n: F.lit(k) for n, k in at.items()}, bins=16).first().asDict()
    assert got == {n: real[k] for n, k in at.items()}
    q = A.interpolated(df, "v", {"a": 0.1, "m": 0.5, "z": 1.0}).first()
    assert [q.a, q.m, q.z] == pytest.approx([float(np.quantile(real, p)) for p in (0.1, 0.5, 1.0)], rel=1e-9)


def test_contained_names_few_and_many(spark, monkeypatch):
    rng = random.Random(4)
    texts = [None, "", "Xab", "aXbA"] + ["".join(rng.choice("abAB ") for _ in range(rng.randint(0, 12))) for _ in range(60)]
    names = ["", None, "AB", "ba ", "aaa", "b", "zz", "bbbbb"]
    df, dim = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), spark.createDataFrame([(n,) for n in names], "n string")
    want = {i: min((n for n in names if n and t and n.lower() in t.lower()), default=None) for i, t in enumerate(texts)}
    for most in (J.BROADCAST_BYTES * 1000, 0):
        monkeypatch.setattr(J, "BROADCAST_BYTES", most)
        out = J.contained_name(df, dim, "t", "n")
        assert {r.i: r.n for r in out.collect()} == want
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_few_names_are_not_tried_with_every_text(spark):
    """Few names, of one length or none, meet parts of the texts in an equi-join."""
    df = spark.createDataFrame([(i, f"Lab {i:05d}") for i in range(300)] + [(300, None)], "i int, t string")
    out = J.contained_name(df, spark.range(0, 400, 2).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("n")), "t", "n")
    assert {r.i: r.n for r in out.collect()} == {i: f"{i:05d}" if i < 300 and i % 2 == 0 else None for i in range(301)}
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert all(r.n is None for r in J.contained_name(df, spark.createDataFrame([("",)], "n string"), "t", "n").collect())

