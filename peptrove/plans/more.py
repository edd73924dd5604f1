"""Further plans: tissues, labs, lookups and predicates (L24, L25, L34, L39, M11, M12, C15, SF*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean, text, words
from ..operators import dedup as D
from ..operators import lanes
from ..operators import stats as S
from ..operators.joins import having, small
from ..sources import reports
from .roles import Roles, query
from .signals import tissue_hits

CALLS = """WITH t AS (SELECT s_suppkey AS run, p_type AS tissue, count(*) AS n_hit, sum(l_quantity) / 100 AS enrichment FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
    c AS (SELECT run, tissue, n_hit, enrichment FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY n_hit DESC, tissue) AS k FROM t) WHERE k = 1)"""


def calls(r: Roles) -> DataFrame:
    """One call a run: the most frequent type stands in for a tissue."""
    t = r.prec.join(small(r.table("part").select(F.col("p_partkey").alias("peptide"), F.col("p_type").alias("tissue"))), "peptide").groupBy("run", "tissue").agg(F.count("*").alias("n_hit"), (F.sum("rt") / 100).alias("enrichment"))
    return D.first_by(t, ["run"], F.desc("n_hit"), "tissue")


@query("species_tissues", f"{CALLS} SELECT tissue, count(*) AS n_runs, round(avg(enrichment), 4) AS mean_enrichment, max(n_hit) AS most_hit FROM c GROUP BY tissue ORDER BY n_runs DESC, tissue LIMIT 40")
def species_tissues(r: Roles) -> DataFrame:
    """L34."""
    return calls(r).groupBy("tissue").agg(F.count("*").alias("n_runs"), F.round(F.avg("enrichment"), 4).alias("mean_enrichment"), F.max("n_hit").alias("most_hit")).orderBy(F.desc("n_runs"), "tissue").limit(40)


@query("tissue_runs", f"{CALLS}, f AS (SELECT l_suppkey AS run, min(l_orderkey) AS search_id FROM lineitem GROUP BY 1) SELECT run, s_name AS run_name, round(enrichment, 4) AS enrichment, search_id FROM c LEFT JOIN supplier ON run = s_suppkey LEFT JOIN f USING (run) WHERE tissue = 'PROMO' ORDER BY enrichment DESC, run LIMIT 60")
def tissue_runs(r: Roles) -> DataFrame:
    """The least search stands for a run's."""
    first = r.prec.groupBy("run").agg(F.min("search_id").alias("search_id"))
    rows = calls(r).where("tissue = 'PROMO'").join(small(r.runs.select("run", "run_name")), "run", "left").join(first, "run", "left")
    return rows.select("run", "run_name", F.round("enrichment", 4).alias("enrichment"), "search_id").orderBy(F.desc("enrichment"), "run").limit(60)


@query("lab_detail", "SELECT lab, lab_name, count(s.search_id) AS n_searches, count(DISTINCT s.engine) AS n_engines, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_precursors FROM labs LEFT JOIN searches s USING (lab) LEFT JOIN (SELECT search_id, count(*) AS n FROM prec GROUP BY 1) p ON s.search_id = p.search_id GROUP BY 1, 2")
def lab_detail(r: Roles) -> DataFrame:
    """Rows are counted a search before they are joined with the labs."""
    mine = r.searches.select("search_id", "lab", "engine")
    n = r.prec.groupBy("search_id").agg(F.count("*").alias("n"))
    own = mine.join(n, "search_id", "left").groupBy("lab").agg(F.count("*").alias("n_searches"), F.count_distinct("engine").alias("n_engines"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_precursors"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return r.labs.select("lab", "lab_name").join(own, "lab", "left").select("lab", "lab_name", zero("n_searches"), zero("n_engines"), zero("n_precursors"))


@query("collaborator_searches", "SELECT search_id, lab_name, engine, (SELECT min(organism) FROM prec JOIN runs USING (run) WHERE prec.search_id = searches.search_id) AS organism FROM searches JOIN labs USING (lab) WHERE lab_name ILIKE '%00012%' OR institute ILIKE '%00012%'")
def collaborator_searches(r: Roles) -> DataFrame:
    """L24, C10, E12."""
    from ..operators.joins import first_of

    hits = r.labs.where(text.contains_ignoring_case(F.col("lab_name"), "00012") | text.contains_ignoring_case(F.col("institute"), "00012"))
    found = r.searches.join(hits.select("lab", "lab_name"), "lab").select("search_id", "lab_name", "engine")
    rows = having(r.prec.select("search_id", "run"), found, "search_id").join(small(r.runs.select("run", "organism")), "run")
    return found.join(first_of(rows, "search_id", "organism", "organism"), "search_id", "left")


@query("null_safe_basis", "SELECT count(*) FILTER (WHERE im IS DISTINCT FROM 0.05) AS n_other, count(*) FILTER (WHERE im = 0.05) AS n_same, count(*) AS n FROM prec")
def null_safe_basis(r: Roles) -> DataFrame:
    """Null counts as different."""
    same = F.col("im").eqNullSafe(0.05)
    return r.prec.agg(F.count(F.when(~same, 1)).alias("n_other"), F.count(F.when(same, 1)).alias("n_same"), F.count("*").alias("n"))


@query("institutes", "SELECT lab, CASE WHEN regexp_matches(lower(institute), 'auto|mach') THEN 'Vehicles' WHEN lower(institute) = 'building' THEN 'Construction' ELSE institute END AS institute FROM labs")
def institutes(r: Roles) -> DataFrame:
    """SF15, L37: rules are data."""
    return r.labs.select("lab", text.canonical_institute(F.col("institute"), [("auto|mach", "Vehicles"), ("^building$", "Construction")]).alias("institute"))


@query("platforms", "SELECT run, CASE WHEN bool_or(im IS NOT NULL AND charge = 7 AND q > 0.09) THEN 'timstof' ELSE 'orbitrap' END AS platform, CASE WHEN bool_or(im IS NOT NULL AND charge = 7 AND q > 0.09) THEN 'diaPASEF' ELSE 'DIA' END AS acquisition FROM prec GROUP BY run")
def platforms(r: Roles) -> DataFrame:
    """D17."""
    rows = r.prec.withColumn("real", F.col("im").isNotNull() & (F.col("charge") == 7) & (F.col("q") > 0.09))
    out = rows.groupBy("run").agg(clean.platform(F.col("real"), F.concat(F.col("run").cast("string"), F.lit(".raw"))).alias("platform"))
    return out.withColumn("acquisition", clean.acquisition(F.col("platform")))


SHAPES = """SELECT DISTINCT CASE peptide % 6 WHEN 0 THEN genus WHEN 1 THEN genus || ' (strain ' || CAST(size AS VARCHAR) || ')' WHEN 2 THEN genus || ' Expressed in yeast' WHEN 3 THEN genus || ' of a quite large kind'
    WHEN 4 THEN upper(name) ELSE genus || ' cell line' END AS organism FROM (SELECT peptide, size, name, upper(left(name, 1)) || substr(name, 2) AS genus FROM pep)"""


@query(
    "organism_shapes",
    f"""SELECT organism, regexp_full_match(trim(organism), '[A-Z][a-z]+ [a-z]+(\\s*\\([^)]*\\))?') AS binomial,
        len(regexp_split_to_array(trim(organism), '\\s+')) > 4 OR regexp_matches(lower(organism), '{"|".join(text.CONSTRUCT_WORDS)}') AS narrative FROM ({SHAPES})""".replace("\\\\", "\\"),
)
def organism_shapes(r: Roles) -> DataFrame:
    """SF17: species names, strains, descriptions of constructs and sentences."""
    p = r.pep.withColumn("genus", F.concat(F.upper(F.left("name", F.lit(1))), F.substring("name", 2, 1000)))
    kind, genus = F.col("peptide") % 6, F.col("genus")
    shaped = (
        F.when(kind == 0, genus).when(kind == 1, F.concat(genus, F.lit(" (strain "), F.col("size").cast("string"), F.lit(")"))).when(kind == 2, F.concat(genus, F.lit(" Expressed in yeast")))
        .when(kind == 3, F.concat(genus, F.lit(" of a quite large kind"))).when(kind == 4, F.upper("name")).otherwise(F.concat(genus, F.lit(" cell line")))
    )
    return p.select(shaped.alias("organism")).distinct().select("organism", text.is_binomial(F.col("organism")).alias("binomial"), text.is_narrative(F.col("organism")).alias("narrative"))


@query("json_lists", "SELECT user_id, count(*) AS n, min(value) AS least FROM events GROUP BY user_id")
def json_lists(r: Roles) -> DataFrame:
    """SF29: rows to a JSON list and back, with a schema."""
    packed = r.table("events").groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("event_id", "value")))).alias("j"))
    back = F.from_json("j", "array<struct<event_id:long,value:double>>")
    return packed.select("user_id", F.size(back).cast("long").alias("n"), F.array_min(F.transform(back, lambda x: x["value"])).alias("least"))


@query("lanes_concatenated", "SELECT charge, count(*) AS n, count(CASE WHEN charge > 3 THEN im END) AS n_im FROM prec GROUP BY charge")
def lanes_concatenated(r: Roles) -> DataFrame:
    """2.I: an older lane without a field."""
    both = lanes.concatenated([r.prec.where("charge > 3").select("charge", "im"), r.prec.where("charge <= 3").select("charge")])
    return both.groupBy("charge").agg(F.count("*").alias("n"), F.count("im").alias("n_im"))


@query("gene_lookup", "SELECT upper(word) AS symbol_upper, CASE WHEN count(*) FILTER (WHERE k = 0) > 0 THEN 'approved' ELSE 'alias' END AS symbol_kind FROM (SELECT string_split(p_name, ' ')[1] AS word, 0 AS k FROM part UNION ALL SELECT string_split(p_name, ' ')[2], 2 FROM part) GROUP BY 1")
def gene_lookup(r: Roles) -> DataFrame:
    """An approved symbol wins over an alias."""
    p = r.table("part").select(F.split("p_name", " ")[0].alias("symbol"), F.split("p_name", " ")[1].alias("aliases"), F.lit("").alias("previous")).distinct()
    return reports.gene_reference(p).select("symbol_upper", "symbol_kind")


@query("marker_panel", "WITH z AS (SELECT p_brand AS gene, 'small' AS tissue, avg(p_size) - 25 AS z FROM part GROUP BY 1 UNION ALL SELECT p_brand, 'dear', avg(p_retailprice) / 40 - 25 FROM part GROUP BY 1) SELECT upper(gene) AS gene, arg_max(tissue, z) AS tissue, round(max(z), 4) AS z FROM z WHERE z > 0 GROUP BY gene")
def marker_panel(r: Roles) -> DataFrame:
    """Positive scores, best tissue a gene."""
    wide = r.table("part").groupBy(F.col("p_brand").alias("gene")).agg((F.avg("p_size") - 25).alias("small"), (F.avg("p_retailprice") / 40 - 25).alias("dear"))
    return reports.marker_panel(wide, ["small", "dear"]).select("gene", "tissue", F.round("z", 4).alias("z"))


@query("word_sense", "WITH w AS (SELECT p_partkey AS peptide, upper(unnest(string_split(p_name, ' '))) AS word FROM part), k AS (SELECT word, row_number() OVER (ORDER BY word) AS rank FROM (SELECT DISTINCT word FROM w WHERE word <> 'RED')) SELECT peptide, avg(coalesce(rank, 12000)) AS sense, arg_min(word, coalesce(rank, 99999)) FILTER (WHERE length(word) >= 4) AS content_word FROM w LEFT JOIN k USING (word) GROUP BY peptide")
def word_sense(r: Roles) -> DataFrame:
    """D15."""
    from pyspark.sql import Window

    w = r.table("part").select(F.col("p_partkey").alias("peptide"), F.explode(F.split(F.upper("p_name"), " ")).alias("word"))
    ranks = w.select("word").distinct().where("word <> 'RED'").withColumn("rank", F.row_number().over(Window.orderBy("word")))  # a short dictionary
    return words.sense_scores(w, "peptide", "word", ranks)


@query("protein_overview", "SELECT grp, count(DISTINCT peptide) AS n_peptides, count(*) AS n_precursors, round(sum(intensity), 2) AS intensity, count(DISTINCT organism) AS n_organisms, bool_or(contaminant) AS is_contaminant FROM prec JOIN pep USING (peptide) JOIN runs USING (run) WHERE grp = 'LARGE|Brand#9' GROUP BY grp")
def protein_overview(r: Roles) -> DataFrame:
    """The parts of a protein's page that the corpus gives."""
    rows = r.prec.join(small(r.pep.where("grp = 'LARGE|Brand#9'").select("peptide", "grp")), "peptide").join(small(r.runs.select("run", "organism")), "run")
    return rows.groupBy("grp").agg(F.count_distinct("peptide").alias("n_peptides"), F.count("*").alias("n_precursors"), F.round(F.sum("intensity"), 2).alias("intensity"), F.count_distinct("organism").alias("n_organisms"), F.bool_or("contaminant").alias("is_contaminant"))


@query("tissue_statuses", None)
def tissue_statuses(r: Roles) -> DataFrame:
    """how many runs got a call, and why the others got none."""
    return S.tissue_calls(S.tissue_scores(tissue_hits(r), 150)).groupBy("status").agg(F.count("*").alias("n"))


@query("selector_comparison", None)
def selector_comparison(r: Roles) -> DataFrame:
    """Two ways to collapse searches, judged on the same rows."""
    obs = r.prec.select(F.col("peptide").alias("seq"), "charge", "run", "search_id", "q", F.col("rt").alias("irt"))
    arms = {n: S.cohort_prior(obs, r.runs, collapse=c).groupBy("seq").agg(F.avg("prior").alias("prior")) for n, c in (("best search a run", "q"), ("every search", None))}
    return S.compare_selectors(arms, r.pep.select(F.col("peptide").alias("seq"), F.col("price").alias("rt")))
