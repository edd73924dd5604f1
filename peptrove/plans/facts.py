"""Counts, distributions and leaderboards (L1-L10, L15-L18, L33-L36, F*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean
from ..operators import aggregates as A
from ..operators import dedup as D
from ..operators.joins import having, lacking, small
from .roles import Roles, query


@query(
    "overview_counts",
    """SELECT (SELECT count(*) FROM searches) AS n_searches, (SELECT count(DISTINCT search_id) FROM prec) AS n_searches_with_rows, (SELECT count(*) FROM runs) AS n_runs,
       (SELECT count(DISTINCT organism) FROM runs WHERE run IN (SELECT run FROM prec)) AS n_organisms, (SELECT count(*) FROM searches WHERE search_id NOT IN (SELECT search_id FROM prec)) AS n_orphans,
       (SELECT count(*) FROM prec) AS n_precursors, (SELECT count(DISTINCT peptide) FROM prec) AS n_peptides, false AS estimated""",
)
def overview_counts(r: Roles) -> DataFrame:
    """L1: exact here, so nothing is marked as estimated."""
    one = r.prec.agg(F.count("*").alias("n_precursors"), F.count_distinct("peptide").alias("n_peptides"), F.count_distinct("search_id").alias("n_searches_with_rows"))
    parts = [
        r.searches.agg(F.count("*").alias("n_searches")), r.runs.agg(F.count("*").alias("n_runs")), having(r.runs, r.prec, "run").agg(F.count_distinct("organism").alias("n_organisms")),
        lacking(r.searches, r.prec, "search_id").agg(F.count("*").alias("n_orphans")),
    ]
    for p in parts:
        one = one.join(F.broadcast(p))  # one row each
    return one.withColumn("estimated", F.lit(False))


@query(
    "species_distribution",
    """SELECT CAST(taxon AS VARCHAR) AS species_key, min(organism) AS label, count(DISTINCT run) AS n_runs, max(taxon) AS taxon FROM runs WHERE run IN (SELECT run FROM prec) GROUP BY 1 ORDER BY n_runs DESC, species_key LIMIT 15""",
)
def species_distribution(r: Roles) -> DataFrame:
    """L2, E7, trap 3: keyed by taxon, runs without observations left out."""
    rows = having(r.runs.where(clean.real_organism(F.col("organism"))), r.prec, "run").withColumn("species_key", clean.species_key(F.col("taxon"), F.col("organism")))
    g = rows.groupBy("species_key").agg(F.min(clean.species_label(F.col("organism"))).alias("label"), F.count_distinct("run").alias("n_runs"), F.max("taxon").alias("taxon"))
    return g.orderBy(F.desc("n_runs"), "species_key").limit(15)


@query("platform_distribution", "SELECT coalesce(CASE WHEN status = 'P' THEN NULL ELSE status END, 'unknown') AS platform, engine, count(*) AS n_searches FROM searches GROUP BY 1, 2")
def platform_distribution(r: Roles) -> DataFrame:
    """Labels are filled in after grouping by the raw columns."""
    g = r.searches.withColumn("platform", F.when(F.col("status") != "P", F.col("status"))).groupBy("platform", "engine").agg(F.count("*").alias("n_searches"))
    return g.withColumn("platform", F.coalesce("platform", F.lit("unknown")))


@query("engine_distribution", "SELECT engine, count(DISTINCT searches.search_id) AS n_searches, count(prec.search_id) AS n_precursors FROM searches LEFT JOIN prec USING (search_id) GROUP BY engine")
def engine_distribution(r: Roles) -> DataFrame:
    """Rows are counted a search before the join."""
    n = r.prec.groupBy("search_id").agg(F.count("*").alias("n"))
    return r.searches.join(n, "search_id", "left").groupBy("engine").agg(F.count("*").alias("n_searches"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_precursors"))


@query("recent_searches_page2", "SELECT search_id, engine, CAST(submitted AS VARCHAR) AS submitted, total FROM searches ORDER BY submitted DESC, search_id LIMIT 20 OFFSET 20")
def recent_searches_page2(r: Roles) -> DataFrame:
    """L8, H2."""
    return D.page(r.searches, F.desc("submitted"), "search_id", limit=20, offset=20).select("search_id", "engine", F.col("submitted").cast("string").alias("submitted"), "total")


@query("search_total", "SELECT count(DISTINCT search_id) AS n_total FROM searches WHERE engine = '2-HIGH'")
def search_total(r: Roles) -> DataFrame:
    """H3, trap 2: a page's total comes without its limit."""
    return r.searches.where("engine = '2-HIGH'").agg(F.count_distinct("search_id").alias("n_total"))


@query(
    "im_rt_axis_switch",
    """WITH s AS (SELECT charge, im, rt, count(*) OVER () AS n, count(im) OVER () AS k FROM prec)
       SELECT CASE WHEN 2 * k >= n THEN 'im' ELSE 'rt' END AS axis, charge, CASE WHEN 2 * k >= n THEN im ELSE rt END AS x, count(*) AS n_points FROM s WHERE 2 * k < n OR im IS NOT NULL GROUP BY 1, 2, 3""",
)
def im_rt_axis_switch(r: Roles) -> DataFrame:
    """L9, trap 10: one axis for all points, and only the points that have it."""
    s = r.prec.select("charge", "im", "rt")
    ratio = s.agg((2 * F.count("im") >= F.count("*")).alias("by_im"))
    axis = s.join(F.broadcast(ratio)).where(~F.col("by_im") | F.col("im").isNotNull())  # one row
    return axis.groupBy(F.when(F.col("by_im"), "im").otherwise("rt").alias("axis"), "charge", F.when(F.col("by_im"), F.col("im")).otherwise(F.col("rt")).alias("x")).agg(F.count("*").alias("n_points"))


@query("charge_distribution", "SELECT charge, count(*) AS n FROM prec WHERE charge BETWEEN 1 AND 4 GROUP BY charge")
def charge_distribution(r: Roles) -> DataFrame:
    """Exact."""
    return r.prec.where(F.col("charge").between(1, 4)).groupBy("charge").agg(F.count("*").alias("n"))


@query(
    "charge_share",
    """SELECT charge, n, round(intensity, 2) AS intensity, round(n / sum(n) OVER (), 6) AS n_share, round(intensity / sum(intensity) OVER (), 6) AS intensity_share FROM (SELECT charge, count(*) AS n, sum(intensity) AS intensity FROM prec GROUP BY charge)""",
)
def charge_share(r: Roles) -> DataFrame:
    """F16, L27."""
    return A.share_of_total(r.prec, ["charge"], {"n": F.count("*"), "intensity": F.sum("intensity")}).withColumn("intensity", F.round("intensity", 2))


@query(
    "peptide_breadth_iqr",
    """SELECT peptide, count(*) AS n_obs, count(*) FILTER (WHERE contaminant) AS n_contaminant, array_to_string(list_sort(list(DISTINCT charge) FILTER (WHERE charge BETWEEN 1 AND 4)), ',') AS charges,
       round(quantile_cont(rt, 0.25), 4) AS rt_q1, round(quantile_cont(rt, 0.5), 4) AS rt_median, round(quantile_cont(rt, 0.75), 4) AS rt_q3 FROM prec GROUP BY peptide""",
)
def peptide_breadth_iqr(r: Roles) -> DataFrame:
    """L5, F4-F6."""
    return r.prec.groupBy("peptide").agg(
        F.count("*").alias("n_obs"), A.count_if(F.col("contaminant")).alias("n_contaminant"), F.array_join(A.distinct_list(F.when(F.col("charge").between(1, 4), F.col("charge"))), ",").alias("charges"), *A.quartiles(F.col("rt"), "rt")
    )


@query("abundance_percentile", "SELECT round(100.0 * count(*) FILTER (WHERE intensity < 30000) / count(*), 4) AS percentile, count(*) AS n FROM prec")
def abundance_percentile(r: Roles) -> DataFrame:
    """Over all rows instead of a sample."""
    return A.percentile_rank(r.prec, "intensity", 30000.0)


@query(
    "protein_gallery_topn",
    """WITH g AS (SELECT grp, count(DISTINCT run) AS n_runs, count(*) AS n_obs, sum(intensity) AS total FROM prec JOIN pep USING (peptide) GROUP BY grp),
       l AS (SELECT 'runs' AS gallery, grp, row_number() OVER (ORDER BY n_runs DESC, grp) AS place FROM g UNION ALL SELECT 'observations', grp, row_number() OVER (ORDER BY n_obs DESC, grp) FROM g
             UNION ALL SELECT 'rarest', grp, row_number() OVER (ORDER BY n_obs, grp) FROM g UNION ALL SELECT 'intensity', grp, row_number() OVER (ORDER BY total DESC, grp) FROM g)
       SELECT gallery, grp, place FROM l WHERE place <= 8""",
)
def protein_gallery_topn(r: Roles) -> DataFrame:
    """Several orders over one rollup, each a top-k and never a full sort."""
    g = r.prec.join(small(r.pep.select("peptide", "grp")), "peptide").groupBy("grp").agg(F.count_distinct("run").alias("n_runs"), F.count("*").alias("n_obs"), F.sum("intensity").alias("total"))
    return galleries(g, "grp", {"runs": F.desc("n_runs"), "observations": F.desc("n_obs"), "rarest": F.asc("n_obs"), "intensity": F.desc("total")}, 8)


def galleries(pool: DataFrame, key: str, orders: dict, k: int) -> DataFrame:
    from pyspark.sql import Window

    out = None
    for name, order in orders.items():
        top = pool.orderBy(order, key).limit(k)
        part = top.select(F.lit(name).alias("gallery"), key, F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(order, key)).cast("long").alias("place"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "superlatives_top8",
    """WITH g AS (SELECT peptide, name, count(*) AS n_obs, max(intensity) AS best, length(name) AS size FROM prec JOIN pep USING (peptide) GROUP BY peptide, name),
       l AS (SELECT 'longest' AS gallery, peptide, row_number() OVER (ORDER BY size DESC, peptide) AS place FROM g UNION ALL SELECT 'shortest', peptide, row_number() OVER (ORDER BY size, peptide) FROM g
             UNION ALL SELECT 'brightest', peptide, row_number() OVER (ORDER BY best DESC, peptide) FROM g UNION ALL SELECT 'commonest', peptide, row_number() OVER (ORDER BY n_obs DESC, peptide) FROM g)
       SELECT gallery, peptide, place FROM l WHERE place <= 8""",
)
def superlatives_top8(r: Roles) -> DataFrame:
    """H5, L21."""
    g = r.prec.join(small(r.pep.select("peptide", "name")), "peptide").groupBy("peptide", "name").agg(F.count("*").alias("n_obs"), F.max("intensity").alias("best")).withColumn("size", F.length("name"))
    return galleries(g, "peptide", {"longest": F.desc("size"), "shortest": F.asc("size"), "brightest": F.desc("best"), "commonest": F.desc("n_obs")}, 8)


CLASSES = [("Colours", "RED BLUE", ""), ("Sizes", "", "SMA LAR"), ("Parts", "", "R G B")]


@query(
    "function_breakdown",
    """SELECT CASE WHEN gene IN ('RED', 'BLUE') THEN 'Colours' WHEN left(gene, 3) IN ('SMA', 'LAR') THEN 'Sizes' WHEN left(gene, 1) IN ('R', 'G', 'B') THEN 'Parts' ELSE 'Other' END AS class, count(DISTINCT gene) AS n_genes, count(*) AS n_peptides
       FROM (SELECT peptide, unnest(string_split(genes, ';')) AS gene FROM pep) GROUP BY 1""",
)
def function_breakdown(r: Roles) -> DataFrame:
    """Exact symbol, then the longest prefix."""
    from ..functions.genes import function_class

    return r.genes.withColumn("class", function_class(F.col("gene"), CLASSES)).groupBy("class").agg(F.count_distinct("gene").alias("n_genes"), F.count("*").alias("n_peptides"))


@query(
    "species_showcase",
    """WITH s AS (SELECT organism, count(DISTINCT run) AS n_runs, count(DISTINCT search_id) AS n_searches, count(DISTINCT peptide) AS n_peptides FROM prec JOIN runs USING (run) GROUP BY organism)
       SELECT organism, n_runs, n_searches, n_peptides, round(n_peptides / n_runs, 4) AS depth, n_runs = 1 AS seen_once, row_number() OVER (ORDER BY n_runs DESC, organism) AS most_sampled, row_number() OVER (ORDER BY n_runs, organism) AS rarest FROM s""",
)
def species_showcase(r: Roles) -> DataFrame:
    """A few rows after the rollup, so ranks over all of them are cheap."""
    from pyspark.sql import Window

    g = r.prec.join(small(r.runs.select("run", "organism")), "run").groupBy("organism").agg(F.count_distinct("run").alias("n_runs"), F.count_distinct("search_id").alias("n_searches"), F.count_distinct("peptide").alias("n_peptides"))
    w = lambda o: F.row_number().over(Window.orderBy(o, "organism")).cast("long")
    return g.withColumn("depth", F.round(F.col("n_peptides") / F.col("n_runs"), 4)).withColumn("seen_once", F.col("n_runs") == 1).withColumn("most_sampled", w(F.desc("n_runs"))).withColumn("rarest", w(F.asc("n_runs")))


@query("taxonomic_breadth", "SELECT taxon_group, count(DISTINCT organism) AS n_organisms, count(DISTINCT run) AS n_runs, round(100.0 * count(DISTINCT run) / (SELECT count(*) FROM runs), 1) AS percent FROM runs GROUP BY taxon_group")
def taxonomic_breadth(r: Roles) -> DataFrame:
    """L16, D6, D8."""
    total = r.runs.agg(F.count("*").alias("__n"))
    g = r.runs.groupBy("taxon_group").agg(F.count_distinct("organism").alias("n_organisms"), F.count_distinct("run").alias("n_runs"))
    return g.join(F.broadcast(total)).withColumn("percent", clean.percent(F.col("n_runs"), F.col("__n"))).drop("__n")  # one row


@query(
    "argmax_class_summary",
    """WITH c AS (SELECT peptide, CASE WHEN c4 = m THEN 4 WHEN c3 = m THEN 3 WHEN c2 = m THEN 2 ELSE 1 END AS class FROM (SELECT peptide, c2, c3, c4, greatest(c1, c2, c3, c4) AS m FROM
         (SELECT peptide, count(*) FILTER (WHERE charge = 1) AS c1, count(*) FILTER (WHERE charge = 2) AS c2, count(*) FILTER (WHERE charge = 3) AS c3, count(*) FILTER (WHERE charge = 4) AS c4 FROM prec GROUP BY peptide)))
       SELECT class, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM c), 2) AS percent FROM c GROUP BY class""",
)
def argmax_class_summary(r: Roles) -> DataFrame:
    """L18, SF26: of equal classes the highest."""
    from ..functions.chem import likeliest_class

    c = r.prec.groupBy("peptide").agg(*(A.count_if(F.col("charge") == k).alias(f"c{k}") for k in range(1, 5))).select(likeliest_class(*(F.col(f"c{k}") for k in range(1, 5))).alias("class"))
    out = A.share_of_total(c, ["class"], {"n": F.count("*")}, 8)
    return out.select("class", "n", F.round(F.col("n_share") * 100, 2).alias("percent"))


@query("mz_histogram", "SELECT CAST(floor((price - 900) / 10) + 1 AS BIGINT) AS bin, round(900 + (floor((price - 900) / 10) + 0.5) * 10, 6) AS centre, count(*) AS n FROM pep WHERE price >= 900 AND price < 1100 GROUP BY 1, 2")
def mz_histogram(r: Roles) -> DataFrame:
    """values outside are left out."""
    return A.histogram(r.pep, "price", 900.0, 1100.0, 20)


@query("obs_log2_histogram", "WITH c AS (SELECT count(*) AS n FROM prec GROUP BY peptide) SELECT CAST(length(bin(n)) - 1 AS BIGINT) AS bucket, count(*) AS n FROM c GROUP BY 1")
def obs_log2_histogram(r: Roles) -> DataFrame:
    """F12, SF23."""
    return A.log2_histogram(r.prec.groupBy("peptide").agg(F.count("*").alias("n_obs")), "n_obs").select("bucket", "n")


@query(
    "trimmed_histogram",
    """WITH f AS (SELECT quantile_cont(intensity, 0.005) AS lo, quantile_cont(intensity, 0.995) AS hi FROM prec)
       SELECT CAST(least(39, floor((intensity - lo) / ((hi - lo) / 40))) AS BIGINT) AS bin, count(*) AS n FROM prec, f WHERE intensity BETWEEN lo AND hi GROUP BY 1""",
)
def trimmed_histogram(r: Roles) -> DataFrame:
    """C21, F13."""
    return A.trimmed_histogram(r.prec, "intensity")


@query("length_histogram", "SELECT length(name) AS length, count(*) AS n FROM pep GROUP BY 1")
def length_histogram(r: Roles) -> DataFrame:
    """F14."""
    return r.pep.groupBy(F.length("name").cast("long").alias("length")).agg(F.count("*").alias("n"))


@query("proteins_vs_groups", "SELECT count(DISTINCT genes) AS n_groups, count(DISTINCT gene) AS n_accessions FROM (SELECT genes, unnest(string_split(genes, ';')) AS gene FROM pep)")
def proteins_vs_groups(r: Roles) -> DataFrame:
    """F20."""
    from ..sources.reports import group_counts

    return group_counts(r.pep.select(F.col("genes").alias("grp")))


@query(
    "search_runs_coalesce",
    """SELECT s.search_id, s.run, coalesce(CASE WHEN s.search_id % 2 = 0 THEN NULL ELSE s.n END, c.n_computed) AS n_proteins, runs.organism FROM (SELECT search_id, run, count(*) AS n FROM prec GROUP BY 1, 2) s
       JOIN (SELECT search_id, run, count(DISTINCT peptide) AS n_computed FROM prec GROUP BY 1, 2) c USING (search_id, run) LEFT JOIN runs USING (run)""",
)
def search_runs_coalesce(r: Roles) -> DataFrame:
    """The stored count, else the computed one, which is aggregated before it is joined."""
    p = r.prec
    stored = p.groupBy("search_id", "run").agg(F.count("*").alias("n")).withColumn("stored", F.when(F.col("search_id") % 2 != 0, F.col("n")))
    computed = p.groupBy("search_id", "run").agg(F.count_distinct("peptide").alias("n_computed"))
    return stored.join(computed, ["search_id", "run"], "left").join(small(r.runs.select("run", "organism")), "run", "left").select("search_id", "run", F.coalesce("stored", "n_computed").alias("n_proteins"), "organism")


@query("latest_component", "SELECT event_type AS component, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_component(r: Roles) -> DataFrame:
    """An aggregate, not a sort."""
    e = r.table("events").select(F.col("event_type").alias("component"), "ts", "event_id", "value")
    return D.latest(e, "component", "ts", "event_id").select("component", "event_id", "value")


@query("corpus_facts", "SELECT (SELECT count(DISTINCT engine) FROM searches) AS n_engines, (SELECT CAST(min(submitted) AS VARCHAR) FROM searches) AS since, (SELECT CAST(max(submitted) AS VARCHAR) FROM searches) AS until, (SELECT round(sum(intensity), 2) FROM prec) AS intensity")
def corpus_facts(r: Roles) -> DataFrame:
    """L35, SF18."""
    s = r.searches.agg(F.count_distinct("engine").alias("n_engines"), F.min("submitted").cast("string").alias("since"), F.max("submitted").cast("string").alias("until"))
    return s.join(F.broadcast(r.prec.agg(F.round(F.sum("intensity"), 2).alias("intensity"))))  # one row


@query("organism_mode", "SELECT run, charge AS mode, n FROM (SELECT run, charge, count(*) AS n, row_number() OVER (PARTITION BY run ORDER BY count(*) DESC, charge) AS k FROM prec GROUP BY run, charge) WHERE k = 1")
def organism_mode(r: Roles) -> DataFrame:
    """F17."""
    return D.mode(r.prec, ["run"], "charge")


@query(
    "organism_inference",
    """WITH c AS (SELECT peptide, taxon_group AS g, count(*) AS n FROM prec JOIN runs USING (run) GROUP BY 1, 2), t AS (SELECT peptide, sum(n) AS total FROM c GROUP BY 1),
       k AS (SELECT peptide, g, n, row_number() OVER (PARTITION BY peptide ORDER BY n DESC, g) AS place FROM c)
       SELECT peptide, g AS top, n, CAST(total AS BIGINT) AS total, round(n / total, 6) AS share, CASE WHEN total >= 20 AND n / total >= 0.3 THEN g END AS called FROM k JOIN t USING (peptide) WHERE place = 1""",
)
def organism_inference(r: Roles) -> DataFrame:
    """Called only where the mode is clear."""
    rows = r.prec.join(small(r.runs.select("run", "taxon_group")), "run")
    out = D.clear_mode(rows, ["peptide"], "taxon_group", 20, 0.3)
    return out.select("peptide", "top", "n", "total", F.round("share", 6).alias("share"), "called")


@query("taxon_propagate", "SELECT run, CASE WHEN run % 2 = 0 THEN NULL ELSE taxon END AS taxon, CASE WHEN k = 1 THEN coalesce(CASE WHEN run % 2 = 0 THEN NULL ELSE taxon END, v) ELSE CASE WHEN run % 2 = 0 THEN NULL ELSE taxon END END AS filled FROM runs LEFT JOIN (SELECT organism, count(DISTINCT taxon) AS k, min(taxon) AS v FROM runs WHERE run % 2 <> 0 GROUP BY organism) USING (organism)")
def taxon_propagate(r: Roles) -> DataFrame:
    """A gap is filled only from an unambiguous name."""
    rows = r.runs.select("run", "organism", F.when(F.col("run") % 2 != 0, F.col("taxon")).alias("taxon"))
    return A.fill_if_unambiguous(rows, "organism", "taxon").select("run", "taxon", "filled")


@query("best_q_dedup", "SELECT peptide, charge, run, q, search_id FROM (SELECT *, row_number() OVER (PARTITION BY peptide, charge, run ORDER BY q, search_id, intensity DESC) AS k FROM prec) WHERE k = 1")
def best_q_dedup(r: Roles) -> DataFrame:
    """G4, trap 7."""
    return D.first_by(r.prec, ["peptide", "charge", "run"], "q", "search_id", F.desc("intensity")).select("peptide", "charge", "run", "q", "search_id")


@query(
    "cross_search_spread",
    """WITH s AS (SELECT peptide, run, max(rt) - min(rt) AS s FROM prec GROUP BY 1, 2 HAVING count(rt) > 1) SELECT count(*) AS n_keys, quantile_disc(s, 0.5) AS median, quantile_disc(s, 0.9) AS p90, max(s) AS largest, round(count(*) FILTER (WHERE s <= 1) / count(*), 6) AS share_to_1 FROM s""",
)
def cross_search_spread(r: Roles) -> DataFrame:
    """F23."""
    return A.spread(r.prec, ["peptide", "run"], "rt").withColumn("share_to_1", F.round("share_to_1", 6))


@query("robust_sd", "WITH m AS (SELECT run, quantile_cont(rt, 0.5) AS m FROM prec GROUP BY run) SELECT run, round(1.4826 * quantile_cont(abs(rt - m), 0.5), 4) AS robust_sd, count(rt) AS n FROM prec JOIN m USING (run) GROUP BY run")
def robust_sd(r: Roles) -> DataFrame:
    """F24."""
    return A.robust_sd(r.prec, "rt", ["run"]).withColumn("robust_sd", F.round("robust_sd", 4))


@query(
    "cohort_consensus",
    """WITH c AS (SELECT run FROM runs WHERE gradient BETWEEN 1000 AND 6000), b AS (SELECT peptide, charge, run, rt, row_number() OVER (PARTITION BY peptide, charge, run ORDER BY q, search_id, rt) AS k FROM prec JOIN c USING (run))
       SELECT peptide, charge, count(*) AS n, round(sum(rt), 4) AS irt_sum, round(sum(rt) / count(*), 4) AS prior FROM b WHERE k = 1 AND CAST(run AS VARCHAR) NOT LIKE '%7%' GROUP BY 1, 2""",
)
def cohort_consensus(r: Roles) -> DataFrame:
    """Runs of a gradient band, each once by its best search, without the excluded."""
    from ..operators.stats import cohort_prior

    obs = r.prec.select(F.col("peptide").alias("seq"), "charge", "run", "search_id", "q", F.col("rt").alias("irt"))
    out = cohort_prior(obs, r.runs.where(F.col("gradient").between(1000, 6000)), exclude=["7"])
    return out.select(F.col("seq").alias("peptide"), "charge", "n", F.round("irt_sum", 4).alias("irt_sum"), F.round("prior", 4).alias("prior"))


@query("audit_rules", """SELECT * FROM (SELECT 'negative intensity' AS rule, 'HIGH' AS severity, count(*) AS n FROM prec WHERE intensity < 0 UNION ALL SELECT 'missing mobility', 'LOW', count(*) FROM prec WHERE im IS NULL
    UNION ALL SELECT 'charge out of range', 'MED', count(*) FROM prec WHERE charge NOT BETWEEN 1 AND 6 UNION ALL SELECT 'search without rows', 'MED', count(*) FROM searches WHERE search_id NOT IN (SELECT search_id FROM prec)
    UNION ALL SELECT 'row without search', 'HIGH', count(*) FROM prec WHERE search_id NOT IN (SELECT search_id FROM searches) UNION ALL SELECT 'q above gate', 'LOW', count(*) FROM prec WHERE q > 0.05)""")
def audit_rules(r: Roles) -> DataFrame:
    """The rules over one table share one scan."""
    p, s = r.prec, r.searches
    rules = [("negative intensity", "HIGH", F.col("intensity") < 0), ("missing mobility", "LOW", F.col("im").isNull()), ("charge out of range", "MED", ~F.col("charge").between(1, 6)), ("q above gate", "LOW", F.col("q") > 0.05)]
    one = p.agg(*(A.count_if(c).alias(f"r{i}") for i, (_, _, c) in enumerate(rules)))
    out = one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(v).alias("severity"), F.col(f"r{i}").alias("n")) for i, (n, v, _) in enumerate(rules)))))
    links = [("search without rows", "MED", lacking(s, p, "search_id")), ("row without search", "HIGH", lacking(p, s, "search_id"))]
    for name, severity, rows in links:
        out = out.unionByName(rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), "n"))
    return out
