"""Search, detail cards, interference, labs and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chem, clean, text
from ..functions.genes import clean_symbol
from ..operators import aggregates as A
from ..operators import dedup as D
from ..operators import joins as J
from ..operators.joins import having, small
from .roles import Roles, query


@query("peptide_search_exact", "SELECT peptide, count(*) AS n_obs, count(DISTINCT run) AS n_runs, bool_or(contaminant) AS any_contaminant FROM prec JOIN pep USING (peptide) WHERE name IN ('red bolt', 'blue gear') GROUP BY peptide")
def peptide_search_exact(r: Roles) -> DataFrame:
    """L11, C8."""
    hits = r.pep.where(F.col("name").isin("red bolt", "blue gear")).select("peptide")
    return r.prec.join(small(hits), "peptide").groupBy("peptide").agg(F.count("*").alias("n_obs"), F.count_distinct("run").alias("n_runs"), F.bool_or("contaminant").alias("any_contaminant"))


@query("peptide_search_il", "SELECT a.peptide AS peptide, b.peptide AS partner FROM pep a JOIN pep b ON replace(upper(a.name), 'I', 'L') = replace(upper(b.name), 'I', 'L') AND a.peptide < b.peptide WHERE a.size = 7 AND b.size = 7")
def peptide_search_il(r: Roles) -> DataFrame:
    """One key for all I/L spellings instead of an enumeration."""
    p = r.pep.where("size = 7").select("peptide", chem.il_key(F.col("name")).alias("k"))
    return p.join(p.select(F.col("peptide").alias("partner"), "k"), "k").where("peptide < partner").select("peptide", "partner")


@query("protein_search_prefix", "SELECT grp, count(DISTINCT peptide) AS n_peptides, CASE WHEN bool_or(brand = 'Brand#1') THEN 'exact' ELSE 'prefix' END AS matched FROM pep WHERE brand = 'Brand#1' OR starts_with(brand, 'Brand#1') GROUP BY grp")
def protein_search_prefix(r: Roles) -> DataFrame:
    """A prefix reaches the scan as a filter."""
    rows = r.pep.where((F.col("brand") == "Brand#1") | F.col("brand").startswith("Brand#1"))
    return rows.groupBy("grp").agg(F.count_distinct("peptide").alias("n_peptides"), F.when(F.bool_or(F.col("brand") == "Brand#1"), "exact").otherwise("prefix").alias("matched"))


@query("substring_fallback", "SELECT peptide, name FROM pep WHERE name ILIKE '%WIDG%'")
def substring_fallback(r: Roles) -> DataFrame:
    """Only where the exact look-up finds nothing; the query is taken literally."""
    exact = r.pep.where(F.upper("name") == "WIDG").select("peptide", "name")
    loose = r.pep.where(text.contains_ignoring_case(F.col("name"), "WIDG")).select("peptide", "name")
    return exact if not exact.isEmpty() else loose


@query("search_species", "SELECT organism, taxon_group, count(DISTINCT run) AS n_runs FROM runs WHERE organism ILIKE '%nation_1%' OR taxon_group ILIKE '%nation_1%' GROUP BY 1, 2")
def search_species(r: Roles) -> DataFrame:
    """L3: scientific or common name."""
    rows = r.runs.where(text.contains_ignoring_case(F.col("organism"), "nation_1") | text.contains_ignoring_case(F.col("taxon_group"), "nation_1"))
    return rows.groupBy("organism", "taxon_group").agg(F.count_distinct("run").alias("n_runs"))


@query(
    "species_detail",
    """WITH s AS (SELECT grp, count(DISTINCT run) AS n_runs, sum(intensity) AS total FROM prec JOIN runs USING (run) JOIN pep USING (peptide) WHERE taxon = 3 GROUP BY grp)
       SELECT count(*) AS n_groups, arg_max(grp, (total, grp)) AS most, (SELECT arg_min(grp, (total, grp)) FROM s WHERE n_runs >= 2) AS least, round(max(total), 2) AS most_intensity FROM s""",
)
def species_detail(r: Roles) -> DataFrame:
    """L4: exact counts; the least abundant needs two runs."""
    s = r.prec.join(small(r.runs.where("taxon = 3").select("run")), "run").join(small(r.pep.select("peptide", "grp")), "peptide").groupBy("grp").agg(F.count_distinct("run").alias("n_runs"), F.sum("intensity").alias("total"))
    return s.agg(F.count("*").alias("n_groups"), F.max_by("grp", F.struct("total", "grp")).alias("most"), F.expr("min_by(grp, CASE WHEN n_runs >= 2 THEN struct(total, grp) END)").alias("least"), F.round(F.max("total"), 2).alias("most_intensity"))


@query(
    "gene_reference_coverage",
    """SELECT organism, count(DISTINCT gene) AS n_seen, round(100.0 * count(DISTINCT gene) / (SELECT count(DISTINCT u) FROM (SELECT unnest(string_split(genes, ';')) AS u FROM pep)), 2) AS percent
       FROM (SELECT run, unnest(string_split(genes, ';')) AS gene FROM prec JOIN pep USING (peptide) WHERE q < 0.03) JOIN runs USING (run) GROUP BY organism""",
)
def gene_reference_coverage(r: Roles) -> DataFrame:
    """Observed symbols against a reference of all symbols."""
    reference = r.genes.select("gene").distinct()
    seen = J.exploded_join(r.prec.where("q < 0.03").select("peptide", "run").join(small(r.pep.select("peptide", "genes")), "peptide"), "genes", reference, "gene")
    total = reference.agg(F.count("*").alias("__n"))
    g = seen.join(small(r.runs.select("run", "organism")), "run").groupBy("organism").agg(F.count_distinct("gene").alias("n_seen"))
    return g.join(F.broadcast(total)).withColumn("percent", F.round(100.0 * F.col("n_seen") / F.col("__n"), 2)).drop("__n")  # one row


@query("protein_detail", "SELECT search_id, engine, count(*) AS n_precursors, count(DISTINCT peptide) AS n_peptides, round(sum(intensity), 2) AS intensity FROM prec JOIN pep USING (peptide) JOIN searches USING (search_id) WHERE grp = 'PROMO|Brand#4' GROUP BY 1, 2 ORDER BY intensity DESC, search_id LIMIT 200")
def protein_detail(r: Roles) -> DataFrame:
    """The group's peptides first, so the fact is filtered before the other joins."""
    rows = r.prec.join(small(r.pep.where("grp = 'PROMO|Brand#4'").select("peptide")), "peptide")
    g = rows.groupBy("search_id").agg(F.count("*").alias("n_precursors"), F.count_distinct("peptide").alias("n_peptides"), F.round(F.sum("intensity"), 2).alias("intensity"))
    return g.join(r.searches.select("search_id", "engine"), "search_id").orderBy(F.desc("intensity"), "search_id").limit(200)


@query(
    "protein_card",
    """SELECT organism, count(DISTINCT run) AS n_runs, round(sum(intensity), 2) AS intensity, arg_max(run, (intensity, run)) AS top_run FROM (SELECT run, sum(intensity) AS intensity FROM prec JOIN pep USING (peptide) WHERE brand = 'Brand#4' GROUP BY run) JOIN runs USING (run) GROUP BY organism""",
)
def protein_card(r: Roles) -> DataFrame:
    """L14, E2."""
    per = r.prec.join(small(r.pep.where("brand = 'Brand#4'").select("peptide")), "peptide").groupBy("run").agg(F.sum("intensity").alias("intensity"))
    return per.join(small(r.runs.select("run", "organism")), "run").groupBy("organism").agg(F.count_distinct("run").alias("n_runs"), F.round(F.sum("intensity"), 2).alias("intensity_"), A.argmax("run", "intensity").alias("top_run")).withColumnRenamed("intensity_", "intensity")


@query(
    "gene_true_peptides",
    """SELECT gene, count(DISTINCT grp) AS n_groups, count(DISTINCT peptide) AS n_peptides, round(sum(intensity), 2) AS intensity, count(DISTINCT organism) AS n_organisms
       FROM (SELECT peptide, grp, unnest(string_split(genes, ';')) AS gene FROM pep) JOIN prec USING (peptide) JOIN runs USING (run) WHERE gene = 'WIDGET' GROUP BY gene""",
)
def gene_true_peptides(r: Roles) -> DataFrame:
    """L31, trap 1."""
    rows = r.prec.join(small(r.genes.where("gene = 'WIDGET'")), "peptide").join(small(r.runs.select("run", "organism")), "run")
    return rows.groupBy("gene").agg(F.count_distinct("grp").alias("n_groups"), F.count_distinct("peptide").alias("n_peptides"), F.round(F.sum("intensity"), 2).alias("intensity"), F.count_distinct("organism").alias("n_organisms"))


@query(
    "peptide_detail",
    """SELECT prec.search_id, run, charge, engine, round(intensity, 2) AS intensity, q FROM prec JOIN searches USING (search_id) WHERE peptide = 42 ORDER BY intensity DESC, prec.search_id, run, charge LIMIT 200""",
)
def peptide_detail(r: Roles) -> DataFrame:
    """L28."""
    rows = r.prec.where("peptide = 42").join(r.searches.select("search_id", "engine"), "search_id")
    return rows.orderBy(F.desc("intensity"), "search_id", "run", "charge").limit(200).select("search_id", "run", "charge", "engine", F.round("intensity", 2).alias("intensity"), "q")


@query("peptide_forms", "SELECT peptide, charge, count(*) AS n, round(max(intensity), 2) AS best, min(q) AS best_q, count(DISTINCT search_id) AS n_searches FROM prec GROUP BY 1, 2")
def peptide_forms(r: Roles) -> DataFrame:
    """L27, L28."""
    return r.prec.groupBy("peptide", "charge").agg(F.count("*").alias("n"), F.round(F.max("intensity"), 2).alias("best"), F.min("q").alias("best_q"), F.count_distinct("search_id").alias("n_searches"))


@query("protein_coverage_peptides", "SELECT peptide, count(*) AS n_obs, round(sum(intensity), 2) AS intensity FROM prec JOIN pep USING (peptide) WHERE brand = 'Brand#7' GROUP BY peptide ORDER BY n_obs DESC, peptide LIMIT 4000")
def protein_coverage_peptides(r: Roles) -> DataFrame:
    """L26."""
    rows = r.prec.join(small(r.pep.where("brand = 'Brand#7'").select("peptide")), "peptide")
    return rows.groupBy("peptide").agg(F.count("*").alias("n_obs"), F.round(F.sum("intensity"), 2).alias("intensity")).orderBy(F.desc("n_obs"), "peptide").limit(4000)


FRAGMENTS = "SELECT event_id, user_id, event_type AS label, value AS mz, CAST(json_extract(props, '$.k') AS INTEGER) AS rt FROM events"


def fragments(r: Roles) -> DataFrame:
    return r.table("events").select("event_id", "user_id", F.col("event_type").alias("label"), F.col("value").alias("mz"), F.from_json("props", "k int")["k"].alias("rt"))


@query("interference", f"WITH f AS ({FRAGMENTS}) SELECT a.event_id AS target, b.event_id AS partner FROM f a JOIN f b ON abs(a.mz - b.mz) <= 0.01 AND a.user_id <> b.user_id WHERE a.user_id = 7")
def interference(r: Roles) -> DataFrame:
    """The tolerance join by bins, without a cross join."""
    f = fragments(r)
    a = f.where("user_id = 7").select(F.col("event_id").alias("target"), F.col("user_id").alias("a_user"), F.col("mz").alias("a_mz"))
    b = f.select(F.col("event_id").alias("partner"), F.col("user_id").alias("b_user"), F.col("mz").alias("b_mz"))
    return J.binned_range_join(a, b, "a_mz", "b_mz", 0.01).where("a_user <> b_user").select("target", "partner")


@query(
    "co_elution",
    f"""WITH f AS ({FRAGMENTS}), m AS (SELECT a.user_id AS user_id, a.event_id AS t, b.user_id AS partner, abs(a.rt - b.rt) <= 5 AS near FROM f a JOIN f b ON abs(a.mz - b.mz) <= 0.05 AND a.user_id <> b.user_id WHERE a.user_id = 7)
        SELECT user_id, partner, count(DISTINCT t) AS n_shared, count(DISTINCT CASE WHEN near THEN t END) AS n_near FROM m GROUP BY 1, 2 ORDER BY n_near DESC, n_shared DESC, user_id, partner LIMIT 40""",
)
def co_elution(r: Roles) -> DataFrame:
    """Partners by shared transitions that also elute together."""
    f = fragments(r)
    a = f.where("user_id = 7").select("user_id", F.col("event_id").alias("t"), F.col("mz").alias("a_mz"), F.col("rt").alias("a_rt"))
    b = f.select(F.col("user_id").alias("partner"), F.col("mz").alias("b_mz"), F.col("rt").alias("b_rt"))
    met = J.binned_range_join(a, b, "a_mz", "b_mz", 0.05).where("user_id <> partner")
    g = met.groupBy("user_id", "partner").agg(F.count_distinct("t").alias("n_shared"), F.count_distinct(F.when(F.abs(F.col("a_rt") - F.col("b_rt")) <= 5, F.col("t"))).alias("n_near"))
    return g.orderBy(F.desc("n_near"), F.desc("n_shared"), "user_id", "partner").limit(40)


@query(
    "labs_by_institution",
    """SELECT institute, count(*) AS n_labs, count(n) AS n_analysed, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_searches, array_to_string(list_slice(list(lab_name ORDER BY coalesce(n, 0) DESC, lab_name), 1, 3), ', ') AS leading
       FROM labs LEFT JOIN (SELECT lab, count(*) AS n FROM searches GROUP BY lab) USING (lab) GROUP BY institute""",
)
def labs_by_institution(r: Roles) -> DataFrame:
    """The leading labs come from a ranked top three, not from a collected list."""
    n = r.searches.groupBy("lab").agg(F.count("*").alias("n"))
    rows = r.labs.join(n, "lab", "left")
    top = D.first_n(rows.withColumn("less", -F.coalesce("n", F.lit(0))), ["institute"], 3, "less", "lab_name")
    lead = top.groupBy("institute").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("less", "lab_name"))), lambda x: x["lab_name"]), ", ").alias("leading"))
    g = rows.groupBy("institute").agg(F.count("*").alias("n_labs"), F.count("n").alias("n_analysed"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_searches"))
    return g.join(lead, "institute")


@query("collaborators", "SELECT CASE institute WHEN 'AUTOMOBILE' THEN 'MACHINERY' ELSE institute END AS client, count(DISTINCT lab) AS n_labs, count(*) AS n_searches, institute = 'FURNITURE' AS excluded FROM searches JOIN labs USING (lab) GROUP BY 1, 4")
def collaborators(r: Roles) -> DataFrame:
    """Aliases are merged before labs are counted, so the count is distinct."""
    alias = r.spark.createDataFrame([("AUTOMOBILE", "MACHINERY")], "institute string, to string")
    rows = r.searches.join(r.labs, "lab").join(F.broadcast(alias), "institute", "left").withColumn("client", F.coalesce("to", "institute"))  # one row
    return rows.groupBy("client", (F.col("institute") == "FURNITURE").alias("excluded")).agg(F.count_distinct("lab").alias("n_labs"), F.count("*").alias("n_searches"))


@query("people_search", "SELECT lab, lab_name, institute, n IS NOT NULL AS linked FROM labs LEFT JOIN (SELECT lab, count(*) AS n FROM searches GROUP BY lab) USING (lab) WHERE lab_name ILIKE '%0001%' OR institute ILIKE '%0001%' ORDER BY linked DESC, lab LIMIT 60")
def people_search(r: Roles) -> DataFrame:
    """L24, H6."""
    n = r.searches.select("lab").distinct().withColumn("linked", F.lit(True))
    rows = r.labs.where(text.contains_ignoring_case(F.col("lab_name"), "0001") | text.contains_ignoring_case(F.col("institute"), "0001")).join(n, "lab", "left")
    return rows.select("lab", "lab_name", "institute", F.coalesce("linked", F.lit(False)).alias("linked")).orderBy(F.desc("linked"), "lab").limit(60)


@query("person_tokens", r"SELECT lab, lab_name FROM labs WHERE regexp_matches(lower(concat_ws(' ', institute, replace(lab_name, '#', ' '))), '\bmachinery\b') AND regexp_matches(lower(concat_ws(' ', institute, replace(lab_name, '#', ' '))), '\bcustomer\b')")
def person_tokens(r: Roles) -> DataFrame:
    """C11: whole words, all of them."""
    rows = r.labs.withColumn("last", F.replace("lab_name", F.lit("#"), F.lit(" ")))
    return rows.where(text.names_person(F.col("institute"), F.col("last"), "the Machinery customer")).select("lab", "lab_name")


@query("my_data", "SELECT search_id, status, CASE WHEN search_id IN (SELECT search_id FROM prec) THEN 'analysed' ELSE 'received' END AS data_status FROM searches WHERE lab IN (10, 11, 12)")
def my_data(r: Roles) -> DataFrame:
    """A row filter for the caller's submissions, and what has come of them."""
    from ..sources.tables import visible_to

    mine = r.searches.where(visible_to(F.col("lab"), [10, 11, 12]))
    done = having(r.prec.select("search_id").distinct(), mine, "search_id").withColumn("data_status", F.lit("analysed"))
    return mine.join(done, "search_id", "left").select("search_id", "status", F.coalesce("data_status", F.lit("received")).alias("data_status"))


@query("first_organism", "SELECT search_id, min(organism) AS organism FROM prec JOIN runs USING (run) GROUP BY search_id")
def first_organism(r: Roles) -> DataFrame:
    """The deterministic form of a correlated LIMIT 1."""
    rows = r.prec.select("search_id", "run").join(small(r.runs.select("run", "organism")), "run")
    return J.first_of(rows, "search_id", "organism", "organism")


@query(
    "name_link_tiebreak",
    """WITH c AS (SELECT DISTINCT a.run AS run, b.lab AS lab, a.n = b.n AS same FROM (SELECT run, count(*) AS n, right(CAST(run + 100 AS VARCHAR), 2) AS k FROM prec GROUP BY run) a JOIN (SELECT lab, count(*) AS n, right(CAST(lab + 100 AS VARCHAR), 2) AS k FROM searches GROUP BY lab) b USING (k))
       SELECT run, CASE WHEN count(*) = 1 THEN min(lab) WHEN count(*) FILTER (WHERE same) = 1 THEN min(lab) FILTER (WHERE same) END AS lab, count(*) AS n_candidates FROM c GROUP BY run""",
)
def name_link_tiebreak(r: Roles) -> DataFrame:
    """Linked if unique, or if one candidate has the same count; else left open."""
    a = r.prec.groupBy("run").agg(F.count("*").alias("n_rows"))
    b = r.searches.groupBy("lab").agg(F.count("*").alias("n_found"))
    key = lambda c: F.right((F.col(c) + 100).cast("string"), F.lit(2))
    linked = J.link_by_keys(a, b, [key("run")], [key("lab")], "run", "lab", "n_rows", "n_found")
    return linked.where("n_candidates > 0")


@query("sample_name_match", "SELECT lab, min(n) AS name FROM labs, (SELECT DISTINCT substr(s_name, 14) AS n FROM supplier) WHERE contains(lower(lab_name), lower(n)) AND n <> '' GROUP BY lab")
def sample_name_match(r: Roles) -> DataFrame:
    """A small list of names against texts."""
    names = r.table("supplier").select(F.substring("s_name", 14, 100).alias("name")).distinct()
    return J.contained_name(r.labs.select("lab", "lab_name"), names, "lab_name", "name").where("name is not null").select("lab", "name")


@query("redacted_view", "SELECT lab, 'lab-' || left(sha1(lab_name), 6) AS lab_name, institute FROM labs")
def redacted_view(r: Roles) -> DataFrame:
    """D19, SF9."""
    from ..sources.tables import redact

    return redact(r.labs.select("lab", "lab_name", "institute"), {"lab_name": "lab"})


@query(
    "export_report_proteotypic",
    """WITH u AS (SELECT search_id, name, count(DISTINCT grp) AS k FROM prec JOIN pep USING (peptide) GROUP BY search_id, name)
       SELECT search_id, name || CAST(charge AS VARCHAR) AS precursor_id, run, grp, round(coalesce(CASE WHEN decoy THEN NULL ELSE intensity END, rt), 2) AS quantity, k = 1 AS proteotypic FROM prec JOIN pep USING (peptide) JOIN u USING (search_id, name)""",
)
def export_report_proteotypic(r: Roles) -> DataFrame:
    """A sequence is proteotypic if it maps to one group in the search."""
    rows = r.prec.join(small(r.pep.select("peptide", "name", "grp")), "peptide")
    unique = rows.groupBy("search_id", "name").agg((F.min("grp") == F.max("grp")).alias("proteotypic"))
    return rows.join(unique, ["search_id", "name"]).select("search_id", F.concat("name", F.col("charge").cast("string")).alias("precursor_id"), "run", "grp", F.round(F.coalesce(F.when(~F.col("decoy"), F.col("intensity")), F.col("rt")), 2).alias("quantity"), "proteotypic")


@query("report_rows", "SELECT search_id, run, charge, round(intensity, 2) AS intensity, true AS kept FROM prec WHERE intensity IS NOT NULL")
def report_rows(r: Roles) -> DataFrame:
    """Exported rows have a value."""
    return r.prec.where(F.col("intensity").isNotNull()).select("search_id", "run", "charge", F.round("intensity", 2).alias("intensity"), F.lit(True).alias("kept"))


@query("run_design", "SELECT DISTINCT run, CASE WHEN charge <= 3 THEN 'low' ELSE 'high' END AS condition, charge % 2 AS replicate FROM prec")
def run_design(r: Roles) -> DataFrame:
    """A15."""
    return r.prec.select("run", F.when(F.col("charge") <= 3, "low").otherwise("high").alias("condition"), (F.col("charge") % 2).alias("replicate")).distinct()


@query("organism_filters", "SELECT run, CASE WHEN run % 7 = 0 THEN NULL WHEN run % 7 = 1 THEN organism ELSE organism END AS organism, run % 7 <> 0 AS is_real FROM runs")
def organism_filters(r: Roles) -> DataFrame:
    """Sentinels become null, a common name in brackets goes."""
    raw = r.runs.withColumn("raw", F.when(F.col("run") % 7 == 0, "Unknown").when(F.col("run") % 7 == 1, F.concat("organism", F.lit(" (Human)"))).otherwise(F.col("organism")))
    return raw.select("run", clean.canonical_organism(F.col("raw")).alias("organism"), clean.real_organism(F.col("raw")).alias("is_real"))


@query("clean_values", "SELECT search_id, run, CASE WHEN im > 0.03 AND im < 0.07 THEN im END AS im, CASE WHEN rt > 5 AND rt < 40 THEN rt END AS irt, coalesce(q <= 0.01, false) AS passes FROM prec")
def clean_values(r: Roles) -> DataFrame:
    """C1, C4, C5."""
    return r.prec.select("search_id", "run", clean.mobility(F.col("im"), 0.03, 0.07).alias("im"), clean.indexed_time(F.col("rt"), 5, 40).alias("irt"), clean.passes_q(F.col("q")).alias("passes"))


@query("contaminant_share", "SELECT grp, count(*) AS n, count(*) FILTER (WHERE contaminant) AS n_contaminant, round(100.0 * count(*) FILTER (WHERE contaminant) / count(*), 1) AS percent FROM prec JOIN pep USING (peptide) GROUP BY grp")
def contaminant_share(r: Roles) -> DataFrame:
    """C16, trap 5: contaminants are marked, never left out."""
    rows = r.prec.join(small(r.pep.select("peptide", "grp")), "peptide").withColumn("c", clean.looks_contaminant(F.col("grp"), F.col("contaminant")))
    return rows.groupBy("grp").agg(F.count("*").alias("n"), A.count_if(F.col("c")).alias("n_contaminant")).withColumn("percent", clean.percent(F.col("n_contaminant"), F.col("n")))


@query("clean_symbols", "SELECT peptide, CASE WHEN regexp_matches(upper(string_split(genes, ';')[1]), '^[A-Z]') THEN string_split(genes, ';')[1] END AS symbol FROM pep")
def clean_symbols(r: Roles) -> DataFrame:
    """C20, D4."""
    return r.pep.select("peptide", clean_symbol(F.col("genes")).alias("symbol"))


@query("submission_status", "SELECT status, engine, count(*) AS n, round(avg(CASE WHEN total = 0 THEN NULL ELSE total END), 2) AS mean_total FROM searches GROUP BY 1, 2 HAVING count(*) >= 5")
def submission_status(r: Roles) -> DataFrame:
    """F2, F9, F25."""
    return r.searches.groupBy("status", "engine").agg(F.count("*").alias("n"), F.round(A.mean_of_positive("total"), 2).alias("mean_total")).where("n >= 5")


@query("weekly_pick", None)
def weekly_pick(r: Roles) -> DataFrame:
    """L20, SF19, G8: a seeded choice that stays the same for a week."""
    return D.seeded_sample(r.pep.select("peptide", "name"), "peptide", 7, seed=202_435)


@query("column_statistics", None)
def column_statistics(r: Roles) -> DataFrame:
    """estimates in one pass."""
    from ..sources.tables import statistics

    return statistics(r.prec, "peptide", "run", "im")


@query("bernoulli_sample", None)
def bernoulli_sample(r: Roles) -> DataFrame:
    """A seeded sample of rows."""
    return r.prec.sample(0.02, seed=7).select("peptide", "charge", "im", "rt")
