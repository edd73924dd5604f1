"""Readers, rollups and traces over reports that are made of the roles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import arrays as R
from ..operators.joins import small
from ..sources import reports
from .roles import Roles, query

SEQ = "upper(replace(name, ' ', ''))"
NAMED = f"SELECT *, {SEQ} AS seq, '/data/plate 1/run' || CAST(run AS VARCHAR) || '.raw' AS path FROM prec JOIN pep USING (peptide)"


def named(r: Roles) -> DataFrame:
    """Observations with a sequence and a raw file's path."""
    rows = r.prec.join(small(r.pep.select("peptide", "name", "grp", "genes")), "peptide")
    return rows.withColumn("seq", F.upper(F.replace("name", F.lit(" "), F.lit("")))).withColumn("path", F.concat(F.lit("/data/plate 1/run"), F.col("run").cast("string"), F.lit(".raw")))


def as_text(rows: DataFrame, headers: dict[str, str]) -> DataFrame:
    """A report: columns under its headers, all as text."""
    return rows.select(*(F.col(c).cast("string").alias(h) for h, c in headers.items()))


@query(
    "report_precursors",
    f"""SELECT run, modified, charge, q, intensity FROM (SELECT 'run' || CAST(run AS VARCHAR) AS run, seq AS modified, charge, q, intensity, row_number() OVER (PARTITION BY run, seq, charge ORDER BY q, intensity DESC) AS k FROM ({NAMED}) WHERE q <= 0.01) WHERE k = 1""",
)
def report_precursors(r: Roles) -> DataFrame:
    """A precursor report by its headers; paths, the q gate and repeats go."""
    headers = {"Run": "path", "Modified.Sequence": "seq", "Stripped.Sequence": "seq", "Precursor.Charge": "charge", "RT": "rt", "IM": "im", "Q.Value": "q", "Precursor.Quantity": "intensity", "Protein.Group": "grp", "Genes": "genes"}
    return reports.precursors(as_text(named(r), headers)).select("run", "modified", F.col("charge").cast("long").alias("charge"), "q", "intensity")


FRAGMENT_ROWS = f"SELECT *, CASE WHEN q = 0.05 THEN NULL ELSE q END AS eg_q FROM ({NAMED}) WHERE NOT decoy"


def fragment_report(r: Roles) -> DataFrame:
    """A fragment-level report under fallback headers; some rows lack a q."""
    rows = named(r).withColumn("q", F.when(F.col("q") != 0.05, F.col("q"))).withColumn("marked", F.concat(F.lit("_"), "seq", F.lit("_"))).withColumn("is_decoy", F.initcap(F.col("decoy").cast("string")))
    rows = rows.withColumn("type", F.when(F.col("charge") % 2 == 0, "y").otherwise("b")).withColumn("number", (F.col("rt") % 5 + 1).cast("int"))
    headers = {
        "R.Raw File Name": "path", "PG.ProteinAccessions": "grp", "EG.ModifiedPeptide": "marked", "FG_Charge": "charge", "EG.Qvalue": "q", "EG.IsDecoy": "is_decoy", "FG.MS2Quantity": "intensity",
        "EG.MeanApexRT": "rt", "F.FrgMz": "rt", "F.FrgType": "type", "F.FrgNum": "number", "F.FrgCharge": "charge", "F.NormalizedPeakArea": "intensity",
    }
    return as_text(rows, headers)


@query(
    "fragment_report_precursors",
    f"""SELECT run, modified, charge, q, intensity FROM (SELECT 'run' || CAST(run AS VARCHAR) AS run, seq AS modified, charge, eg_q AS q, intensity, row_number() OVER (PARTITION BY run, seq, charge ORDER BY eg_q NULLS LAST, intensity DESC) AS k
        FROM ({FRAGMENT_ROWS}) WHERE eg_q <= 0.01 OR eg_q IS NULL) WHERE k = 1""",
)
def fragment_report_precursors(r: Roles) -> DataFrame:
    """Decoys go, a null q stays, headers by pattern."""
    return reports.fragment_precursors(fragment_report(r)).select("run", "modified", F.col("charge").cast("long").alias("charge"), "q", "intensity")


@query(
    "fragment_spectra",
    f"""SELECT 'run' || CAST(run AS VARCHAR) AS run, '_' || seq || '_' AS modified, charge, min(eg_q) AS q, max(intensity) AS intensity, count(DISTINCT (rt, intensity)) AS n_fragments, min(rt) AS least_mz, max(rt) AS greatest_mz
        FROM ({FRAGMENT_ROWS}) WHERE eg_q <= 0.01 GROUP BY run, seq, charge""",
)
def fragment_spectra(r: Roles) -> DataFrame:
    """One row a precursor, its fragments in parallel arrays in the order of m/z."""
    s = reports.spectra(fragment_report(r))
    return s.select("run", "modified", F.col("charge").cast("long").alias("charge"), "q", "intensity", F.size("frg_area").cast("long").alias("n_fragments"), F.get("frg_mz", 0).alias("least_mz"), F.element_at("frg_mz", -1).alias("greatest_mz"))


@query(
    "protein_rollup",
    """SELECT run, grp, count(DISTINCT name) AS n_peptides, count(*) AS n_precursors, round(sum(intensity), 2) AS intensity, min(q) AS pg_q, min(CASE WHEN genes = 'RED;BOLT' THEN NULL ELSE genes END) AS gene,
       regexp_matches(concat_ws(' ', grp, min(CASE WHEN genes = 'RED;BOLT' THEN NULL ELSE genes END)), '(?i)krt|keratin|cont_|contaminant') AS is_contaminant FROM prec JOIN pep USING (peptide) GROUP BY run, grp""",
)
def protein_rollup(r: Roles) -> DataFrame:
    """runs and groups with distinct peptides; what stands for no gene isn't one."""
    rows = named(r).select("run", "grp", F.col("name").alias("seq"), F.when(F.col("genes") == "RED;BOLT", " NaN ").otherwise(F.col("genes")).alias("gene"), "intensity", F.lit(0.0).alias("normalized"), F.col("q").alias("pg_q"))
    return reports.proteins(rows).drop("normalized").withColumn("intensity", F.round("intensity", 2))


@query("run_summaries", "SELECT run, max(rt) AS longest_rt, count(*) AS n_precursors, count(im) AS n_im, count(im) > 0 AS has_mobility FROM prec GROUP BY run")
def run_summaries(r: Roles) -> DataFrame:
    """F21."""
    rows = r.prec.select(F.col("run").cast("string").alias("run"), "rt", "im")
    return reports.run_summary(rows).select(F.col("run").cast("long").alias("run"), "longest_rt", "n_precursors", "n_im", "has_mobility")


@query("parameter_lists", "SELECT user_id, string_agg(event_type || '=' || v, ';' ORDER BY event_type) AS fields FROM (SELECT user_id, event_type, min(props) AS v FROM events GROUP BY 1, 2) GROUP BY user_id")
def parameter_lists(r: Roles) -> DataFrame:
    """Two-column parameter lists to one map a run, the least value of a repeated key."""
    m = reports.key_values(r.table("events").select("user_id", "event_type", "props"), "user_id", "event_type", "props")
    return m.select("user_id", F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("fields"))


@query("library_fragments", "SELECT peptide, charge, count(*) AS n_fragments, min(rt) AS least_mz, arg_min(intensity, (rt, intensity)) AS first_intensity FROM prec GROUP BY 1, 2")
def library_fragments(r: Roles) -> DataFrame:
    """A10: one list of fragments a precursor, by m/z."""
    rows = r.prec.select("peptide", "charge", F.col("rt").alias("mz"), "intensity")
    lib = reports.library(rows, ["peptide", "charge"], ["mz"], ["intensity", "absent"])
    return lib.select("peptide", "charge", F.size("fragments").cast("long").alias("n_fragments"), F.get("fragments", 0)["mz"].alias("least_mz"), F.get("fragments", 0)["intensity"].alias("first_intensity"))


POINTS = "SELECT user_id AS pr, CASE event_type WHEN 'view' THEN 'ms1' WHEN 'click' THEN 'y7^1' WHEN 'signup' THEN 'index' ELSE 'b2^1' END AS feature, event_id AS rt, value FROM events"


def points(r: Roles) -> DataFrame:
    kind = F.col("event_type")
    feature = F.when(kind == "view", "ms1").when(kind == "click", "y7^1").when(kind == "signup", "index").otherwise("b2^1")
    return r.table("events").select(F.col("user_id").alias("pr"), feature.alias("feature"), F.col("event_id").alias("rt"), "value")


@query("chromatogram_rows", f"SELECT pr, feature, rt, value FROM (SELECT *, row_number() OVER (PARTITION BY pr, feature ORDER BY rt, value) AS k FROM ({POINTS})) WHERE k <= 40")
def chromatogram_rows(r: Roles) -> DataFrame:
    """A report's long rows to traces by time, 40 points each, and back."""
    t = reports.chromatograms(points(r))
    return R.unfold(t, "trace_rt", "trace_intensity").select("pr", "feature", F.col("trace_rt").alias("rt"), F.col("trace_intensity").alias("value"))


@query("reference_trace_sizes", f"SELECT pr, feature, count(*) AS n_points FROM ({POINTS}) WHERE feature <> 'index' GROUP BY 1, 2 HAVING count(*) >= 8")
def reference_trace_sizes(r: Roles) -> DataFrame:
    """Labelled ions and MS1 with enough points to be compared with."""
    return reports.reference_traces(points(r)).select("pr", "feature", F.size("trace_rt").cast("long").alias("n_points"))


PEAKS = "SELECT CAST(floor(event_id / 25) AS BIGINT) AS cycle, floor(event_id / 25) * 0.5 AS rt, 400 + value AS mz, user_id % 3 = 0 AS gated, CAST(user_id AS DOUBLE) AS iso_low, CAST(user_id + 60 AS DOUBLE) AS iso_high, CAST(event_id % 97 AS DOUBLE) AS intensity FROM events"
TARGETS = "SELECT p_partkey AS target, p_size % 2 AS channel, 400 + CAST(p_size AS DOUBLE) AS target_mz, CAST(p_partkey % 100 AS DOUBLE) AS precursor_mz, CAST(p_partkey % 40 AS DOUBLE) AS target_rt FROM part"


@query(
    "trace_extraction",
    f"""WITH p AS ({PEAKS}), t AS ({TARGETS}), c AS (SELECT DISTINCT cycle, rt FROM p),
        w AS (SELECT target, channel, cycle, rt FROM (SELECT DISTINCT target, channel, target_rt FROM t) t JOIN c ON abs(t.target_rt - c.rt) <= 4),
        h AS (SELECT target, channel, cycle, sum(intensity) AS s FROM t JOIN p ON abs(target_mz - mz) <= target_mz * 200 * 1e-6 AND abs(rt - target_rt) <= 4 AND (NOT gated OR precursor_mz BETWEEN iso_low AND iso_high) GROUP BY 1, 2, 3),
        f AS (SELECT target, channel, list(coalesce(s, 0.0) ORDER BY cycle) AS v FROM w LEFT JOIN h USING (target, channel, cycle) GROUP BY 1, 2)
        SELECT target, channel, CAST(len(v) AS BIGINT) AS n_cycles, array_to_string(list_transform(range(0, 9), lambda i: CAST(CAST(floor(1000 * (v[CAST(floor(i * (len(v) - 1) / 8) AS INTEGER) + 1] * (1 - (i * (len(v) - 1) / 8 - floor(i * (len(v) - 1) / 8)))
        + coalesce(v[CAST(floor(i * (len(v) - 1) / 8) AS INTEGER) + 2], 0.0) * (i * (len(v) - 1) / 8 - floor(i * (len(v) - 1) / 8))) + 0.3) AS BIGINT) AS VARCHAR)), ' ') AS trace FROM f""",
)
def trace_extraction(r: Roles) -> DataFrame:
    """Traces of all targets inside the gates, on nine places."""
    cycle, user = F.floor(F.col("event_id") / 25).cast("long"), F.col("user_id").cast("double")
    gate = lambda v: F.when(F.col("user_id") % 3 == 0, v)
    peaks = r.table("events").select(cycle.alias("cycle"), (cycle * 0.5).alias("rt"), (400 + F.col("value")).alias("mz"), F.lit(None).cast("double").alias("im"), gate(user).alias("iso_low"), gate(user + 60).alias("iso_high"), (F.col("event_id") % 97).cast("double").alias("intensity"))
    part, key = r.table("part"), F.col("p_partkey")
    targets = part.select(key.alias("target"), (F.col("p_size") % 2).alias("channel"), (400 + F.col("p_size").cast("double")).alias("target_mz"), (key % 100).cast("double").alias("precursor_mz"), (key % 40).cast("double").alias("target_rt"), F.lit(None).cast("double").alias("target_im"))
    out = R.extract_traces(peaks, targets, ppm=200, window=4.0, points=9)
    return out.select("target", "channel", F.col("n_cycles").cast("long").alias("n_cycles"), F.array_join(F.transform("trace", lambda v: F.floor(v * 1000 + 0.3).cast("long").cast("string")), " ").alias("trace"))


@query(
    "spectrum_ensemble",
    """WITH s AS (SELECT peptide, charge AS label, run % 3 AS model, intensity FROM prec), m AS (SELECT peptide, count(DISTINCT model) AS n_models FROM s GROUP BY 1)
       SELECT peptide, label, round(sum(intensity) / n_models, 4) AS rel, count(DISTINCT model) AS n_agree, n_models FROM s JOIN m USING (peptide) GROUP BY peptide, label, n_models""",
)
def spectrum_ensemble(r: Roles) -> DataFrame:
    """A model without the label counts as 0."""
    rows = r.prec.select("peptide", F.col("charge").alias("label"), (F.col("run") % 3).alias("model"), F.col("intensity").alias("rel"))
    return R.ensemble(rows, ["peptide"], "label", "rel", "model").withColumn("rel", F.round("rel", 4))


@query(
    "trace_comparison",
    f"""WITH p AS ({POINTS}), a AS (SELECT pr, rt, value FROM p WHERE feature = 'ms1'), b AS (SELECT pr, rt, value FROM p WHERE feature = 'y7^1'), s AS (SELECT pr, min(rt) AS lo, max(rt) AS hi, arg_max(rt, (value, -rt)) AS apex FROM a GROUP BY pr),
        o AS (SELECT b.pr AS pr, b.rt AS t, b.value AS ref, max(a.rt) FILTER (WHERE a.rt <= b.rt) AS x0, arg_max(a.value, a.rt) FILTER (WHERE a.rt <= b.rt) AS y0, min(a.rt) FILTER (WHERE a.rt > b.rt) AS x1, arg_min(a.value, a.rt) FILTER (WHERE a.rt > b.rt) AS y1
              FROM b JOIN s ON s.pr = b.pr AND b.rt BETWEEN lo AND hi JOIN a ON a.pr = b.pr GROUP BY 1, 2, 3),
        c AS (SELECT pr, count(*) AS n_points, corr(CASE WHEN x0 = t THEN y0 ELSE y0 + (y1 - y0) * (t - x0) / (x1 - x0) END, ref) AS r FROM o GROUP BY pr)
        SELECT s.pr, coalesce(n_points, 0) AS n_points, CASE WHEN n_points > 1 THEN round(r, 3) END AS r, round(abs(s.apex - z.apex) * 60.0, 3) AS apex_delta_s FROM s JOIN (SELECT pr, arg_max(rt, (value, -rt)) AS apex FROM b GROUP BY pr) z USING (pr) LEFT JOIN c USING (pr)""",
)
def trace_comparison(r: Roles) -> DataFrame:
    """One channel's trace on the points of another's: correlation and apex distance."""
    p = points(r)
    own = R.fold(p.where("feature = 'ms1'").withColumn("rt", F.col("rt").cast("double")), ["pr"], "rt", "value").withColumnRenamed("value", "own")
    ref = R.fold(p.where("feature = 'y7^1'").withColumn("ref_rt", F.col("rt").cast("double")), ["pr"], "ref_rt", "value").withColumnRenamed("value", "ref")
    out = R.compare_traces(own.join(ref, "pr"), ["pr"], "rt", "own", "ref_rt", "ref")
    return out.select("pr", F.col("n_points").cast("long").alias("n_points"), F.when(F.col("n_points") > 1, F.round("r", 3)).alias("r"), F.round("apex_delta_s", 3).alias("apex_delta_s"))
