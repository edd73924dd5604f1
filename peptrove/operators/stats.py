"""Inference: enrichment, isotonic residuals, selectors (N1-N10, SF24, SF27)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import robust_sd

# What a tissue call needs, and a blood call.
LEAST_PANEL, LEAST_HITS, LEAST_ENRICHMENT, MOST_P, LEAST_MARGIN = 15, 5, 1.5, 1e-4, 2.0
LEAST_BLOOD, LEAST_BLOOD_PROTEINS = 0.30, 5
PLASMA = "ALB TF APOA1 APOB C3 HP A2M SERPINA1 HPX CP APOA2 AHSG ORM1 ORM2 C4A C4B ITIH4 ITIH2 APOC3 TTR AMBP SERPINC1 PLG F2 VTN GC LRG1 CFB APOH SERPINF2 KNG1 HRG C9 CLU".split()
FIBRINOGEN = "FGA FGB FGG".split()

STIRLING = (1 / 12, -1 / 360, 1 / 1260)


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series after a shift of 8, to about 1e-10."""
    x = n.cast("double") + 1
    y = x + 8
    shift = F.lit(0.0)
    for k in range(8):
        shift = shift + F.log(x + k)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + STIRLING[0] / y + STIRLING[1] / (y * y * y) + STIRLING[2] / (y * y * y * y * y) - shift


def hypergeometric_tail(k: Column, universe: Column, marked: Column, drawn: Column) -> Column:
    """Probability of at least k marked ones among those drawn: the terms' ratios are summed from
    the first one's logarithm, so tails far below 1e-300 are 0 and nothing overflows."""
    top = F.least(marked, drawn)
    low = F.greatest(k, marked + drawn - universe, F.lit(0))
    choose = lambda n, r: log_factorial(n) - log_factorial(r) - log_factorial(n - r)
    first = choose(marked, low) + choose(universe - marked, drawn - low) - choose(universe, drawn)

    def step(acc: Column, i: Column) -> Column:
        ratio = (marked - i + 1).cast("double") * (drawn - i + 1) / (i.cast("double") * (universe - marked - drawn + i))
        term = acc["t"] * ratio
        return F.struct((acc["s"] + term).alias("s"), term.alias("t"))

    rest = F.when(top > low, F.sequence((low + 1).cast("long"), top.cast("long"))).otherwise(F.array().cast("array<long>"))
    total = F.aggregate(rest, F.struct(F.lit(1.0).alias("s"), F.lit(1.0).alias("t")), step, lambda a: a["s"])
    return F.when(k <= F.greatest(marked + drawn - universe, F.lit(0)), F.lit(1.0)).when(k > top, 0.0).otherwise(F.least(F.lit(1.0), F.exp(first + F.log(total))))


def tissue_counts(run_groups: DataFrame, markers: DataFrame, least_panel: int = LEAST_PANEL) -> DataFrame:
    """Hits of each run in each observable panel (N1). run_groups: run, gene (one row a group, genes
    joined by ;), markers: tissue, gene, z (positive). Result: run, tissue, n_hit, n_panel, n_groups, z_hit, z_panel."""
    rows = run_groups.select("run", "grp", "gene").distinct()
    depth = rows.groupBy("run").agg(F.count_distinct("grp").alias("n_groups"))
    genes = F.explode(F.array_distinct(F.transform(F.split("gene", ";"), lambda g: F.upper(F.trim(g)))))
    seen = rows.select("run", genes.alias("gene")).distinct()
    observable = markers.join(seen.select("gene").distinct(), "gene", "left_semi").groupBy("tissue").agg(F.count("*").alias("n_panel"), F.sum("z").alias("z_panel")).where(F.col("n_panel") >= least_panel)
    hits = seen.join(markers, "gene").groupBy("run", "tissue").agg(F.count("*").alias("n_hit"), F.sum("z").alias("z_hit"))
    return hits.join(observable, "tissue").join(depth, "run")


def tissue_scores(counts: DataFrame, universe: int) -> DataFrame:
    """Significance and weighted enrichment of each run and tissue."""
    u = F.lit(universe)
    n, big = F.least(F.col("n_groups"), u), F.least(F.col("n_panel"), u)
    p = hypergeometric_tail(F.col("n_hit"), u, big, n)
    expected_z = F.col("z_panel") * n / u
    enrichment = F.coalesce(F.when(expected_z > 0, F.col("z_hit") / expected_z), F.when(big * n > 0, F.col("n_hit") / (big * n / u)))
    return counts.withColumn("logp", -F.log10(F.greatest(p, F.lit(1e-300)))).withColumn("enrichment", enrichment)


def tissue_calls(scores: DataFrame) -> DataFrame:
    """One call a run: significant tissues first, then by enrichment; emitted or abstained with the reason."""
    significant = (F.col("logp") >= -math.log10(MOST_P)).cast("int")
    w = Window.partitionBy("run").orderBy(significant.desc(), F.desc("enrichment"), "tissue")
    ranked = scores.withColumn("__n", F.row_number().over(w)).withColumn("margin", F.col("logp") - F.lead("logp").over(w)).withColumn("runner_up", F.lead("tissue").over(w))
    status = (
        F.when(F.col("n_hit") < LEAST_HITS, "abstained_too_few_markers")
        .when(F.col("logp") < -math.log10(MOST_P), "abstained_not_significant")
        .when(F.col("enrichment").isNull() | (F.col("enrichment") < LEAST_ENRICHMENT), "abstained_low_enrichment")
        .when(F.col("margin") < LEAST_MARGIN, "abstained_ambiguous")
        .otherwise("emitted")
    )
    top = ranked.where("__n = 1").drop("__n").withColumn("status", status).withColumnRenamed("tissue", "top_candidate")
    return top.withColumn("predicted", F.when(F.col("status") == "emitted", F.col("top_candidate")))


def blood(df: DataFrame, core: list[str] = PLASMA, fibrinogen: list[str] = FIBRINOGEN) -> DataFrame:
    """Share of a run's intensity in blood proteins and the call (N3). df: run, grp, gene, intensity;
    a group counts once a run with its greatest intensity."""
    genes = F.transform(F.split("gene", ";"), lambda g: F.upper(F.trim(g)))
    marked = lambda names: F.coalesce(F.arrays_overlap(genes, F.array(*(F.lit(x) for x in names))), F.lit(False))
    per = df.groupBy("run", "grp").agg(F.max("intensity").alias("intensity"), F.max(marked(core).cast("int")).alias("core"), F.max(marked(fibrinogen).cast("int")).alias("fib"))
    out = per.groupBy("run").agg(
        F.sum("intensity").alias("total"), F.sum(F.when(F.col("core") + F.col("fib") > 0, F.col("intensity"))).alias("blood"),
        F.sum(F.when(F.col("fib") > 0, F.col("intensity"))).alias("fibrinogen"), F.count(F.when(F.col("core") + F.col("fib") > 0, 1)).alias("n_blood"),
    )
    share = F.when(F.col("total") > 0, F.coalesce("blood", F.lit(0.0)) / F.col("total"))
    status = F.when(share.isNull() | (F.col("n_blood") < LEAST_BLOOD_PROTEINS), "abstained_too_few_blood_proteins").when(share < LEAST_BLOOD, "not_blood_derived").otherwise("emitted")
    return out.select("run", "total", "n_blood", share.alias("blood_fraction"), F.when(F.col("blood") > 0, F.coalesce("fibrinogen", F.lit(0.0)) / F.col("blood")).alias("fibrinogen_share"), status.alias("status"), F.when(status == "emitted", "blood_derived").alias("matrix"))


def cohort_prior(obs: DataFrame, cohort: DataFrame, exclude: list[str] | None = None, collapse: str | None = "q") -> DataFrame:
    """Mean indexed time a (seq, charge) over the cohort's runs (N6). With ``collapse`` each run
    counts once, by its best search; without it every search does. Sums and counts stay, so runs
    can be taken out later; ``exclude`` lists parts of run names to leave out (C18)."""
    rows = obs.join(cohort.select("run").distinct(), "run", "left_semi")
    for part in exclude or ():
        rows = rows.where(~F.coalesce(F.col("run").cast("string").contains(part), F.lit(False)))
    if collapse:
        best = F.min(F.struct(F.col(collapse).alias("m"), F.col("search_id"), F.col("irt"))).alias("b")
        rows = rows.where(F.col("irt").isNotNull()).groupBy("seq", "charge", "run").agg(best).select("seq", "charge", "run", F.col("b.irt").alias("irt"))
    return rows.groupBy("seq", "charge").agg(F.count("irt").alias("n"), F.sum("irt").alias("irt_sum")).where("n > 0").withColumn("prior", F.col("irt_sum") / F.col("n"))


def isotonic_residuals(df: DataFrame, x: str, y: str, key: str, folds: int = 5, least: int = 200) -> DataFrame:
    """Residuals of y after an isotonic fit on x, out of fold (N8); no rows below ``least``."""
    from pyspark.ml.regression import IsotonicRegression

    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("fold", F.pmod(F.xxhash64(key), F.lit(folds)))
    rows = rows.select(key, x, y, "fold").persist()  # while the models are fitted
    try:
        if rows.count() < least:
            return rows.limit(0).select(key, "fold", F.lit(None).cast("double").alias("residual"))
        fitted = [IsotonicRegression(featuresCol=x, labelCol=y, predictionCol="__p").fit(rows.where(F.col("fold") != k).select(F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))) for k in range(folds)]
    finally:
        rows.unpersist()
    parts = []
    for k, model in enumerate(fitted):
        parts.append(model.transform(rows.where(F.col("fold") == k).withColumn(x, F.col(x).cast("double"))).select(key, "fold", (F.col(y) - F.col("__p")).alias("residual")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compare_selectors(arms: dict[str, DataFrame], truth: DataFrame, x: str = "prior", y: str = "rt", key: str = "seq") -> DataFrame:
    """Accuracy of several priors on the rows that all of them cover, and each one's reach."""
    common, out = truth.select(key, y), []
    for name, arm in arms.items():
        common = common.join(arm.select(key), key, "left_semi")
    spark = truth.sparkSession
    for name, arm in arms.items():
        reach = truth.join(arm.select(key), key, "left_semi").count()
        res = isotonic_residuals(common.join(arm.select(key, x), key), x, y, key)
        row = robust_sd(res, "residual").first()
        out.append((name, int(reach), int(row.n) if row else 0, float(row.robust_sd) if row and row.robust_sd is not None else None))
    return spark.createDataFrame(out, "arm string, reach long, n_common long, robust_sd double")


def concordance(df: DataFrame, text: str, predicted: str, terms: dict[str, str]) -> DataFrame:
    """Predictions against what free text mentions: agree, disagree or no_text (N9). ``terms``: label to pattern."""
    named = F.filter(F.array(*(F.when(F.col(text).rlike(f"(?i){p}"), F.lit(t)) for t, p in terms.items())), lambda x: x.isNotNull())
    status = F.when(F.size("mentioned") == 0, "no_text").when(F.array_contains("mentioned", F.col(predicted)), "agree").otherwise("disagree")
    return df.withColumn("mentioned", F.coalesce(named, F.array().cast("array<string>"))).withColumn("concordance", status)


def separation(df: DataFrame, decoy: str, score: str) -> DataFrame:
    """Mean score of targets and decoys, and whether targets lead."""
    out = df.agg(F.avg(F.when(~F.col(decoy), F.col(score))).alias("target_mean"), F.avg(F.when(F.col(decoy), F.col(score))).alias("decoy_mean"))
    return out.withColumn("separated", F.col("target_mean") > F.col("decoy_mean"))
