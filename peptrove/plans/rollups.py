"""Materialised rollups (M1-M13) and incremental upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import dedup as D
from ..operators.joins import small
from ..sources.sinks import top_up
from .roles import Roles, query


@query(
    "corpus_stats",
    """SELECT count(DISTINCT peptide) AS n_peptides, (SELECT count(DISTINCT grp) FROM prec JOIN pep USING (peptide)) AS n_groups, count(*) AS n_precursors, count(im) AS n_with_im,
       count(DISTINCT run) AS n_runs, count(DISTINCT search_id) AS n_searches, CAST(min(seen) AS VARCHAR) AS first_seen, CAST(max(seen) AS VARCHAR) AS last_seen FROM prec""",
)
def corpus_stats(r: Roles) -> DataFrame:
    """M1: each distinct count is its own two-phase aggregate, so nothing is expanded."""
    p = r.prec
    one = p.agg(F.count("*").alias("n_precursors"), F.count("im").alias("n_with_im"), F.min("seen").cast("string").alias("first_seen"), F.max("seen").cast("string").alias("last_seen"))
    distinct = lambda df, c, n: df.select(c).distinct().agg(F.count(c).alias(n))
    groups = p.select("peptide").distinct().join(r.pep.select("peptide", "grp"), "peptide")
    for other in (distinct(p, "peptide", "n_peptides"), distinct(p, "run", "n_runs"), distinct(p, "search_id", "n_searches"), distinct(groups, "grp", "n_groups")):
        one = one.join(F.broadcast(other))  # one row each
    return one.select("n_peptides", "n_groups", "n_precursors", "n_with_im", "n_runs", "n_searches", "first_seen", "last_seen")


@query(
    "top_peptides",
    """SELECT peptide, count(DISTINCT run) AS n_runs, count(*) AS n_obs, count(DISTINCT search_id) AS n_searches, count(DISTINCT charge) AS n_charges, bool_or(contaminant) AS any_contaminant, round(max(intensity), 2) AS best
       FROM prec GROUP BY peptide ORDER BY n_runs DESC, n_obs DESC, peptide LIMIT 100""",
)
def top_peptides(r: Roles) -> DataFrame:
    """Counted in two phases, so no row is expanded; of charges there are a few."""
    runs = r.prec.groupBy("peptide", "run").agg(F.count("*").alias("n"), F.collect_set("charge").alias("charges"), F.bool_or("contaminant").alias("c"), F.max("intensity").alias("best"))
    g = runs.groupBy("peptide").agg(
        F.count("run").alias("n_runs"), F.sum("n").alias("n_obs"), F.size(F.array_distinct(F.flatten(F.collect_set("charges")))).cast("long").alias("n_charges"), F.bool_or("c").alias("any_contaminant"), F.round(F.max("best"), 2).alias("best")
    )
    searches = r.prec.select("peptide", "search_id").distinct().groupBy("peptide").agg(F.count("search_id").alias("n_searches"))
    g = g.join(searches, "peptide").select("peptide", "n_runs", "n_obs", "n_searches", "n_charges", "any_contaminant", "best")
    return g.orderBy(F.desc("n_runs"), F.desc("n_obs"), "peptide").limit(100)


@query(
    "top_proteins",
    """SELECT grp, count(DISTINCT run) AS n_runs, count(DISTINCT peptide) AS n_peptides, round(sum(intensity), 2) AS intensity, bool_or(contaminant) AS is_contaminant
       FROM prec JOIN pep USING (peptide) GROUP BY grp ORDER BY intensity DESC NULLS LAST, grp LIMIT 50""",
)
def top_proteins(r: Roles) -> DataFrame:
    """M3."""
    g = r.prec.join(small(r.pep.select("peptide", "grp")), "peptide").groupBy("grp").agg(F.count_distinct("run").alias("n_runs"), F.count_distinct("peptide").alias("n_peptides"), F.round(F.sum("intensity"), 2).alias("intensity"), F.bool_or("contaminant").alias("is_contaminant"))
    return g.orderBy(F.desc_nulls_last("intensity"), "grp").limit(50)


@query(
    "top_genes",
    """SELECT gene, count(DISTINCT grp) AS n_groups, count(DISTINCT peptide) AS n_peptides, count(*) AS n_obs FROM (SELECT peptide, grp, unnest(string_split(genes, ';')) AS gene FROM pep) JOIN prec USING (peptide)
       WHERE gene <> '' GROUP BY gene ORDER BY n_obs DESC, gene LIMIT 20""",
)
def top_genes(r: Roles) -> DataFrame:
    """Multi-value symbols count for each gene."""
    g = r.prec.select("peptide").join(small(r.genes.where("gene <> ''")), "peptide").groupBy("gene")
    return g.agg(F.count_distinct("grp").alias("n_groups"), F.count_distinct("peptide").alias("n_peptides"), F.count("*").alias("n_obs")).orderBy(F.desc("n_obs"), "gene").limit(20)


def species_rows(r: Roles) -> DataFrame:
    """Counted in two phases: runs and searches are distinct pairs, so no row is expanded."""
    rows = r.prec.join(small(r.pep.select("peptide", "grp")), "peptide").join(small(r.runs.select("run", "organism")), "run")
    per = rows.groupBy("organism", "grp", "run").agg(F.count("*").alias("n"), F.sum("intensity").alias("i"), F.min("q").alias("q"), F.bool_or("contaminant").alias("c"))
    runs = per.groupBy("organism", "grp").agg(F.count("run").alias("n_runs"), F.sum("n").alias("n_precursors"), F.sum("i").alias("intensity"), F.min("q").alias("best_q"), F.bool_or("c").alias("is_contaminant"))
    searches = rows.select("organism", "grp", "search_id").distinct().groupBy("organism", "grp").agg(F.count("search_id").alias("n_searches"))
    return runs.join(searches, ["organism", "grp"]).select("organism", "grp", "n_runs", "n_searches", "n_precursors", "intensity", "best_q", "is_contaminant")


SPECIES_SQL = """SELECT organism, grp, count(DISTINCT run) AS n_runs, count(DISTINCT search_id) AS n_searches, count(*) AS n_precursors, sum(intensity) AS intensity, min(q) AS best_q, bool_or(contaminant) AS is_contaminant
    FROM prec JOIN pep USING (peptide) JOIN runs USING (run) GROUP BY organism, grp"""


@query("species_proteins", f"SELECT organism, grp, n_runs, n_searches, n_precursors, round(intensity, 2) AS intensity, best_q, is_contaminant FROM ({SPECIES_SQL})")
def species_proteins(r: Roles) -> DataFrame:
    """M5."""
    return species_rows(r).withColumn("intensity", F.round("intensity", 2))


@query(
    "protein_agg",
    f"""SELECT grp, count(*) AS n_species, CAST(sum(n_precursors) AS BIGINT) AS n_precursors, round(sum(intensity), 2) AS intensity, bool_or(is_contaminant) AS is_contaminant,
        arg_max(organism, (n_precursors, organism)) AS top_organism FROM ({SPECIES_SQL}) GROUP BY grp""",
)
def protein_agg(r: Roles) -> DataFrame:
    """A rollup of the rollup, with the leading organism."""
    g = species_rows(r).groupBy("grp")
    return g.agg(F.count("*").alias("n_species"), F.sum("n_precursors").alias("n_precursors"), F.round(F.sum("intensity"), 2).alias("intensity"), F.bool_or("is_contaminant").alias("is_contaminant"), A.argmax("organism", "n_precursors").alias("top_organism"))


@query(
    "distinct_on_sample",
    """SELECT peptide, charge, im, rt, intensity FROM (SELECT peptide, charge, im, rt, intensity, row_number() OVER (PARTITION BY peptide, charge ORDER BY intensity DESC, rt, im, run, search_id) AS k FROM prec WHERE im > 0.03)
       WHERE k = 1 ORDER BY peptide, charge LIMIT 2000""",
)
def distinct_on_sample(r: Roles) -> DataFrame:
    """One representative a peptide and charge, by a complete rule."""
    rows = D.first_by(r.prec.where("im > 0.03"), ["peptide", "charge"], F.desc("intensity"), "rt", "im", "run", "search_id")
    return rows.select("peptide", "charge", "im", "rt", "intensity").orderBy("peptide", "charge").limit(2000)


@query("protein_peptide_count", "SELECT grp, count(DISTINCT peptide) AS n_peptides, count(*) AS n_rows FROM prec JOIN pep USING (peptide) GROUP BY grp")
def protein_peptide_count(r: Roles) -> DataFrame:
    """M8, trap 1: true distinct peptides, never a sum of per-run counts."""
    return peptide_counts(r.prec.join(small(r.pep.select("peptide", "grp")), "peptide"))


def peptide_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("grp").agg(F.count_distinct("peptide").alias("n_peptides"), F.count("*").alias("n_rows"))


@query(
    "incremental_topup",
    "SELECT grp, count(DISTINCT peptide) AS n_peptides, count(*) AS n_rows FROM prec JOIN pep USING (peptide) WHERE brand <> 'Brand#1' GROUP BY grp",
)
def incremental_topup(r: Roles) -> DataFrame:
    """Only the groups that the finished table lacks are counted."""
    rows = r.prec.join(small(r.pep.select("peptide", "grp", "brand")), "peptide")
    done = r.pep.where("brand = 'Brand#1'").select("grp").distinct()
    return top_up(done, rows, "grp", peptide_counts)


@query("fragment_flatten", "SELECT event_id, user_id, event_type AS label, CAST(json_extract(props, '$.k') AS INTEGER) AS k, value FROM events WHERE event_type IN ('click', 'view')")
def fragment_flatten(r: Roles) -> DataFrame:
    """M9, J3, SF28: JSON fields by a schema, not by text search."""
    e = r.table("events").where(F.col("event_type").isin("click", "view"))
    return e.select("event_id", "user_id", F.col("event_type").alias("label"), F.from_json("props", "k int")["k"].alias("k"), "value")


@query(
    "lane_runs",
    """SELECT l.run, l.search_id, l.n_precursors, runs.run_name FROM (SELECT run, search_id, count(*) AS n_precursors FROM prec GROUP BY run, search_id) l JOIN runs USING (run)""",
)
def lane_runs(r: Roles) -> DataFrame:
    """Counts of each dataset and run, with the run's name."""
    return r.prec.groupBy("run", "search_id").agg(F.count("*").alias("n_precursors")).join(small(r.runs.select("run", "run_name")), "run")


@query(
    "additive_exclusion",
    """SELECT peptide, count(*) AS n, count(im) AS im_n, round(sum(im), 4) AS im_sum, round(sum(im * im), 6) AS im_sumsq FROM prec WHERE run % 10 <> 3 GROUP BY peptide""",
)
def additive_exclusion(r: Roles) -> DataFrame:
    """Statistics kept a run, combined, and the excluded runs taken out again by subtraction."""
    parts = A.sums(["peptide", "run"], r.prec, "im")
    total = A.combine(parts, ["peptide"])
    out = A.subtract(total, A.combine(parts.where("run % 10 = 3"), ["peptide"]), ["peptide"])
    return out.select("peptide", "n", "im_n", F.round(F.when(F.col("im_n") > 0, F.col("im_sum")), 4).alias("im_sum"), F.round(F.when(F.col("im_n") > 0, F.col("im_sumsq")), 6).alias("im_sumsq"))


@query(
    "upsert_keep_best",
    """WITH n AS (SELECT run, intensity FROM (SELECT run, intensity, row_number() OVER (PARTITION BY run ORDER BY intensity DESC) AS k FROM prec WHERE charge <> 1) WHERE k = 1),
       o AS (SELECT run, max(intensity) AS intensity FROM prec WHERE charge = 1 GROUP BY run)
       SELECT coalesce(o.run, n.run) AS run, CASE WHEN o.intensity IS NULL OR n.intensity > o.intensity THEN 'new' ELSE 'old' END AS kept, round(greatest(coalesce(o.intensity, n.intensity), coalesce(n.intensity, o.intensity)), 2) AS intensity
       FROM o FULL JOIN n USING (run)""",
)
def upsert_keep_best(r: Roles) -> DataFrame:
    """The existing row wins ties."""
    best = lambda cond, kind: r.prec.where(cond).groupBy("run").agg(F.max("intensity").alias("intensity")).withColumn("kept", F.lit(kind))
    return D.keep_better(best("charge = 1", "old"), best("charge <> 1", "new"), "run", "intensity").withColumn("intensity", F.round("intensity", 2))


@query(
    "upsert_coalesce",
    """WITH o AS (SELECT search_id, lab, CASE WHEN status = 'P' THEN NULL ELSE engine END AS engine, status FROM searches WHERE search_id % 3 <> 0),
       n AS (SELECT search_id, CASE WHEN search_id % 2 = 0 THEN NULL ELSE lab + 1 END AS lab, 'rerun' AS engine, CAST(NULL AS VARCHAR) AS status FROM searches WHERE search_id % 5 = 0)
       SELECT coalesce(o.search_id, n.search_id) AS search_id, coalesce(n.lab, o.lab) AS lab, coalesce(n.engine, o.engine) AS engine, coalesce(n.status, o.status) AS status FROM o FULL JOIN n USING (search_id)""",
)
def upsert_coalesce(r: Roles) -> DataFrame:
    """A null never unlinks."""
    s = r.searches
    old = s.where("search_id % 3 <> 0").select("search_id", "lab", F.when(F.col("status") != "P", F.col("engine")).alias("engine"), "status")
    new = s.where("search_id % 5 = 0").select("search_id", F.when(F.col("search_id") % 2 != 0, F.col("lab") + 1).alias("lab"), F.lit("rerun").alias("engine"), F.lit(None).cast("string").alias("status"))
    return D.merge_fields(old, new, ["search_id"])


@query(
    "upsert_fill_gaps",
    """WITH o AS (SELECT search_id, CASE WHEN status = 'P' THEN NULL ELSE engine END AS engine FROM searches)
       SELECT search_id, coalesce(engine, 'unknown engine') AS engine FROM o""",
)
def upsert_fill_gaps(r: Roles) -> DataFrame:
    """Only nulls are filled."""
    old = r.searches.select("search_id", F.when(F.col("status") != "P", F.col("engine")).alias("engine"))
    return D.merge_fields(old, r.searches.select("search_id", F.lit("unknown engine").alias("engine")), ["search_id"], prefer_new=False)


@query(
    "replace_children",
    """SELECT run, charge, count(*) AS n FROM prec WHERE run % 4 <> 0 GROUP BY run, charge UNION ALL SELECT DISTINCT run, 0 AS charge, CAST(1 AS BIGINT) AS n FROM prec WHERE run % 4 = 0""",
)
def replace_children(r: Roles) -> DataFrame:
    """A key's rows are replaced as a whole."""
    old = r.prec.groupBy("run", "charge").agg(F.count("*").alias("n"))
    new = r.prec.where("run % 4 = 0").select("run").distinct().select("run", F.lit(0).alias("charge"), F.lit(1).cast("long").alias("n"))
    return D.replace_children(old, new, "run")
