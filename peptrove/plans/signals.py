"""Sequences, spectra, traces, inference and event-time queries (D1, D9, G12, J*, N*, 2.K)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chem, text
from ..operators import aggregates as A
from ..operators import arrays as R
from ..operators import dedup as D
from ..operators import stats as S
from ..operators.joins import small
from .roles import Roles, query

#: letter runs of the whole texts, with their place in the text
RUNS_SQL = "SELECT doc_id, unnest(range(len(w))) AS pos, upper(unnest(w)) AS seq FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents)"


def sequences(r: Roles) -> DataFrame:
    """Stand-ins for sequences: every letter run of the whole texts, one row each."""
    return r.table("documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("pos", "seq")).withColumn("pos", F.col("pos").cast("long")).withColumn("seq", F.upper("seq"))


def different(r: Roles) -> DataFrame:
    """Each different sequence once, with the number of rows that have it."""
    return sequences(r).groupBy("seq").agg(F.count("*").alias("n_rows"))


def each_sequence(rows: DataFrame, plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a plan gives for each different sequence, for all rows that have it."""
    return rows.join(plan(rows.select("seq").distinct()), "seq").drop("seq")


@query(
    "word_hunt",
    f"""WITH s AS (SELECT seq, count(*) AS n FROM ({RUNS_SQL}) GROUP BY seq), w AS (SELECT DISTINCT upper(part) AS word FROM (SELECT unnest(string_split(p_name, ' ')) AS part FROM part) WHERE length(part) BETWEEN 3 AND 6)
        SELECT word, CAST(sum(n) AS BIGINT) AS n_peptides, min(seq) AS example FROM s JOIN w ON contains(s.seq, w.word) GROUP BY word""",
)
def word_hunt(r: Roles) -> DataFrame:
    """Substrings meet the dictionary in a join, once a sequence."""
    words = r.table("part").select(F.explode(F.split(F.upper("p_name"), " ")).alias("word")).where(F.length("word").between(3, 6)).distinct()
    hits = R.word_hits(different(r), "n_rows", "seq", small(words), "word", 3, 6)
    return hits.groupBy("word").agg(F.sum("n_rows").alias("n_peptides"), F.min("seq").alias("example"))


@query(
    "coverage_pct",
    f"""WITH r AS ({RUNS_SQL}), s AS (SELECT DISTINCT seq FROM r), p AS (SELECT unnest(['THE', 'ION', 'AND', 'ER', 'THTH']) AS pep),
        i AS (SELECT seq, k AS b, k + length(pep) - 1 AS e FROM (SELECT seq, pep, unnest(range(1, length(seq) + 1)) AS k FROM s, p WHERE contains(replace(seq, 'I', 'L'), replace(pep, 'I', 'L'))) WHERE substr(replace(seq, 'I', 'L'), k, length(pep)) = replace(pep, 'I', 'L')),
        c AS (SELECT seq, count(DISTINCT x) AS covered FROM (SELECT seq, unnest(range(b, e + 1)) AS x FROM i) GROUP BY seq)
        SELECT doc_id, pos, length(seq) AS length, coalesce(covered, 0) AS covered, round(100.0 * coalesce(covered, 0) / length(seq), 2) AS percent FROM r LEFT JOIN c USING (seq)""",
)
def coverage_pct(r: Roles) -> DataFrame:
    """I and L count as one."""
    parts = r.spark.createDataFrame([(p,) for p in ("THE", "ION", "AND", "ER", "THTH")], "pep string")
    covered = lambda s: R.coverage(s.join(F.broadcast(parts)), ["seq"], "seq", "pep")  # noqa: E731  five rows
    return each_sequence(sequences(r), covered).withColumn("length", F.col("length").cast("long")).drop("n_placed")


RESIDUES_SQL = "CASE c " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in chem.RESIDUES.items()) + " END"


@query(
    "b_y_ions",
    f"""WITH s AS (SELECT seq, count(*) AS n_rows FROM ({RUNS_SQL}) GROUP BY seq), a AS (SELECT seq, n_rows, i, {RESIDUES_SQL} + CASE WHEN c = 'C' THEN CAST(57.02146 AS DOUBLE) ELSE 0 END AS m FROM (SELECT seq, n_rows, i, substr(seq, i, 1) AS c FROM (SELECT seq, n_rows, unnest(range(1, length(seq) + 1)) AS i FROM s)) WHERE {RESIDUES_SQL} IS NOT NULL),
        b AS (SELECT seq, n_rows, row_number() OVER (PARTITION BY seq ORDER BY i) AS i, m, count(*) OVER (PARTITION BY seq) AS n FROM a),
        t AS (SELECT seq, n_rows, 'b' AS type, i, sum(m) OVER (PARTITION BY seq ORDER BY i) AS m, n FROM b UNION ALL SELECT seq, n_rows, 'y', n - i + 1, sum(m) OVER (PARTITION BY seq ORDER BY i DESC) + CAST(18.0105646 AS DOUBLE), n FROM b)
        SELECT seq, n_rows, type || CAST(i AS VARCHAR) AS ion, z AS charge, round((m + z * CAST(1.0072765 AS DOUBLE)) / z, 5) AS mz FROM t, (SELECT unnest([1, 2]) AS z) WHERE i < n""",
)
def b_y_ions(r: Roles) -> DataFrame:
    """A generator of ions for each different sequence, with the rows that have it."""
    return different(r).select("seq", "n_rows", F.inline(chem.ladder(F.col("seq")))).drop("type", "series")


@query(
    "physchem",
    f"""WITH r AS ({RUNS_SQL}), a AS (SELECT seq, {RESIDUES_SQL} AS m FROM (SELECT seq, substr(seq, i, 1) AS c FROM (SELECT seq, unnest(range(1, length(seq) + 1)) AS i FROM (SELECT DISTINCT seq FROM r)))),
        p AS (SELECT seq, count(m) AS length, round(sum(m) + CAST(18.010565 AS DOUBLE), 4) AS mass FROM a GROUP BY seq HAVING count(m) > 0)
        SELECT doc_id, pos, length, mass, right(seq, 1) IN ('K', 'R') AS tryptic, length(seq) - length(replace(seq, 'W', '')) AS n_w FROM r JOIN p USING (seq)""",
)
def physchem(r: Roles) -> DataFrame:
    """D1."""
    found = lambda s: s.select("seq", chem.physchem(F.col("seq")).alias("p")).where("p is not null")
    rows = each_sequence(sequences(r), found)
    return rows.select("doc_id", "pos", F.col("p.length").cast("long").alias("length"), F.col("p.monoisotopic_mass").alias("mass"), "p.tryptic", F.col("p.counts.W").cast("long").alias("n_w"))


@query("sequence_shapes", f"SELECT doc_id, pos, seq = reverse(seq) AND length(seq) >= 4 AS palindrome, len(list_distinct(string_split(seq, ''))) <= 4 AND length(seq) >= 6 AS few_letters FROM ({RUNS_SQL})")
def sequence_shapes(r: Roles) -> DataFrame:
    """SF13."""
    return sequences(r).select("doc_id", "pos", text.is_palindrome(F.col("seq")).alias("palindrome"), text.has_few_letters(F.col("seq")).alias("few_letters"))


@query("fold_unfold_lists", "SELECT user_id, event_id, event_type, round(value, 2) AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events")
def fold_unfold_lists(r: Roles) -> DataFrame:
    """Arrays keep their common order there and back."""
    folded = R.fold(r.table("events"), ["user_id"], "event_id", "event_type", "value")
    return R.unfold(folded, "event_id", "event_type", "value").select("user_id", "event_id", "event_type", F.round("value", 2).alias("value"), F.col("pos").cast("long").alias("pos"))


@query("trace_apex", "SELECT user_id, event_type, count(*) AS n_points, arg_max(event_id, (value, -event_id)) AS apex, max(value) AS top FROM events GROUP BY 1, 2")
def trace_apex(r: Roles) -> DataFrame:
    """Of equal points the first."""
    g = r.table("events").groupBy("user_id", "event_type")
    return g.agg(F.count("*").alias("n_points"), F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("apex"), F.max("value").alias("top"))


@query("strongest_points", "SELECT user_id, event_id, value FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 6")
def strongest_points(r: Roles) -> DataFrame:
    """J4, H4."""
    return D.first_n(r.table("events").select("user_id", "event_id", "value"), ["user_id"], 6, F.desc("value"), "event_id")


@query("relative_intensity", "SELECT user_id, event_id, round(value / max(value) OVER (PARTITION BY user_id), 6) AS rel FROM events")
def relative_intensity(r: Roles) -> DataFrame:
    """J16."""
    folded = R.fold(r.table("events"), ["user_id"], "event_id", "value")
    return R.unfold(folded.select("user_id", "event_id", R.relative(F.col("value")).alias("rel")), "event_id", "rel").select("user_id", "event_id", "rel")


@query("trace_area", "SELECT user_id, round(sum((k - p) * (value + pv) / 2), 4) AS area FROM (SELECT user_id, event_id AS k, value, lag(event_id) OVER w AS p, lag(value) OVER w AS pv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE p IS NOT NULL GROUP BY user_id")
def trace_area(r: Roles) -> DataFrame:
    """J10, SF25."""
    folded = R.fold(r.table("events"), ["user_id"], "event_id", "value").where(F.size("value") > 1)
    return folded.select("user_id", F.round(R.area(F.col("event_id").cast("array<double>"), F.col("value")), 4).alias("area"))


@query("spectrum_correlation", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_aggregate(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE)), 'sum'), 4) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def spectrum_correlation(r: Roles) -> DataFrame:
    """Products of aligned list columns in the JVM."""
    e = r.table("embeddings").select(F.col("vec_id").alias("a"), F.col("embedding").cast("array<double>").alias("x"))
    met = e.join(e.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("x").alias("y")), "a")
    return met.select("a", "b", F.round(F.aggregate(F.zip_with("x", "y", lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v), 4).alias("dot"))


@query(
    "xic_usage",
    """WITH t AS (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS n_total FROM events GROUP BY 1), c AS (SELECT user_id, event_type AS label, count(DISTINCT CAST(ts AS DATE)) AS n_searches FROM events GROUP BY 1, 2),
       k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n_searches DESC, label) AS place FROM c) SELECT user_id, label, n_searches, n_total, round(100.0 * n_searches / n_total, 1) AS percent FROM k JOIN t USING (user_id) WHERE place <= 3""",
)
def xic_usage(r: Roles) -> DataFrame:
    """J11, L32."""
    e = r.table("events").select("user_id", F.to_date("ts").alias("day"), "event_type").groupBy("user_id", "day").agg(F.collect_set("event_type").alias("labels"))
    return R.usage(e, ["user_id"], "labels", "day", 3)


@query("search_library", "SELECT user_id, arg_max(event_id, (value, event_id)) AS best, max(value) AS apex FROM events WHERE event_type = 'view' GROUP BY user_id")
def search_library(r: Roles) -> DataFrame:
    """The row of the greatest apex."""
    return r.table("events").where("event_type = 'view'").groupBy("user_id").agg(F.max_by("event_id", F.struct("value", "event_id")).alias("best"), F.max("value").alias("apex"))


@query(
    "observed_spectrum",
    """WITH c AS (SELECT peptide, charge, row_number() OVER (PARTITION BY peptide ORDER BY count(*) DESC, charge) AS k FROM prec GROUP BY 1, 2)
       SELECT peptide, charge, run, q, round(intensity, 2) AS intensity FROM (SELECT p.peptide AS peptide, p.charge AS charge, run, q, intensity, row_number() OVER (PARTITION BY p.peptide ORDER BY q, intensity DESC, run, search_id) AS place FROM prec p JOIN c ON p.peptide = c.peptide AND p.charge = c.charge AND c.k = 1) WHERE place = 1""",
)
def observed_spectrum(r: Roles) -> DataFrame:
    """The best observation at the modal charge."""
    modal = D.mode(r.prec, ["peptide"], "charge", "charge").select("peptide", "charge")
    best = D.first_by(r.prec.join(modal, ["peptide", "charge"]), ["peptide"], F.col("q").asc_nulls_last(), F.col("intensity").desc_nulls_last(), "run", "search_id")
    return best.select("peptide", "charge", "run", "q", F.round("intensity", 2).alias("intensity"))


@query(
    "tissue_scores",
    """WITH g AS (SELECT DISTINCT run, grp, genes FROM prec JOIN pep USING (peptide) WHERE q < 0.02), n AS (SELECT run, count(DISTINCT grp) AS n_groups FROM g GROUP BY run), s AS (SELECT DISTINCT run, unnest(string_split(genes, ';')) AS gene FROM g),
       m AS (SELECT DISTINCT p_type AS tissue, gene, CAST(1 + (length(gene) + length(p_type)) % 3 AS DOUBLE) AS z FROM part, LATERAL (SELECT unnest(string_split(upper(replace(p_name, ' ', ';')), ';')) AS gene) WHERE (length(gene) + length(p_type)) % 2 = 0),
       o AS (SELECT tissue, count(*) AS n_panel, sum(z) AS z_panel FROM m WHERE gene IN (SELECT gene FROM s) GROUP BY tissue HAVING count(*) >= 4)
       SELECT run, tissue, count(*) AS n_hit, n_panel, n_groups, sum(z) AS z_hit, z_panel FROM s JOIN m USING (gene) JOIN o USING (tissue) JOIN n USING (run) GROUP BY run, tissue, n_panel, n_groups, z_panel""",
)
def tissue_scores(r: Roles) -> DataFrame:
    """Marker groups are resolved once and then joined by equality."""
    return tissue_hits(r)


def tissue_hits(r: Roles) -> DataFrame:
    groups = r.prec.where("q < 0.02").select("peptide", "run").distinct().join(small(r.pep.select("peptide", "grp", F.col("genes").alias("gene"))), "peptide").select("run", "grp", "gene")
    markers = r.table("part").select(F.col("p_type").alias("tissue"), F.explode(F.split(F.upper("p_name"), " ")).alias("gene")).distinct()
    size = F.length("gene") + F.length("tissue")
    markers = markers.where(size % 2 == 0).withColumn("z", (1 + size % 3).cast("double"))
    return S.tissue_counts(groups, markers, least_panel=4)


@query("tissue_calls", None)
def tissue_calls(r: Roles) -> DataFrame:
    """N2, G10, SF27: hypergeometric significance, then a call or the reason for none."""
    return S.tissue_calls(S.tissue_scores(tissue_hits(r), 150)).select("run", "top_candidate", "status", "predicted", F.round("logp", 6).alias("logp"), F.round("enrichment", 6).alias("enrichment"))


@query(
    "blood_fraction",
    """WITH g AS (SELECT run, grp, max(intensity) AS intensity, max(CASE WHEN list_has_any(string_split(genes, ';'), ['RED', 'BLUE']) THEN 1 ELSE 0 END) AS core, max(CASE WHEN list_has_any(string_split(genes, ';'), ['BOLT']) THEN 1 ELSE 0 END) AS fib FROM prec JOIN pep USING (peptide) GROUP BY run, grp)
       SELECT run, count(*) FILTER (WHERE core + fib > 0) AS n_blood, round(sum(CASE WHEN core + fib > 0 THEN intensity ELSE 0 END) / sum(intensity), 6) AS blood_fraction, round(sum(CASE WHEN fib > 0 THEN intensity ELSE 0 END) / nullif(sum(CASE WHEN core + fib > 0 THEN intensity ELSE 0 END), 0), 6) AS fibrinogen_share FROM g GROUP BY run""",
)
def blood_fraction(r: Roles) -> DataFrame:
    """N3."""
    rows = r.prec.join(small(r.pep.select("peptide", "grp", F.col("genes").alias("gene"))), "peptide")
    out = S.blood(rows, ["RED", "BLUE"], ["BOLT"])
    return out.select("run", "n_blood", F.round("blood_fraction", 6).alias("blood_fraction"), F.round("fibrinogen_share", 6).alias("fibrinogen_share"))


@query("target_separation", "SELECT round(avg(CASE WHEN toxic = 0 THEN n_chars END), 4) AS target_mean, round(avg(CASE WHEN toxic = 1 THEN n_chars END), 4) AS decoy_mean, avg(CASE WHEN toxic = 0 THEN n_chars END) > avg(CASE WHEN toxic = 1 THEN n_chars END) AS separated FROM labels JOIN documents USING (doc_id)")
def target_separation(r: Roles) -> DataFrame:
    """Labelled rows stand in for targets and decoys."""
    rows = r.table("labels").join(r.table("documents").select("doc_id", "n_chars"), "doc_id").withColumn("decoy", F.col("toxic") == 1)
    return S.separation(rows, "decoy", "n_chars").withColumn("target_mean", F.round("target_mean", 4)).withColumn("decoy_mean", F.round("decoy_mean", 4))


@query("concordance", "SELECT concordance, count(*) AS n FROM (SELECT CASE WHEN NOT regexp_matches(name, '(?i)red|blue') THEN 'no_text' WHEN (regexp_matches(name, '(?i)red') AND size % 2 = 0) OR (regexp_matches(name, '(?i)blue') AND size % 2 = 1) THEN 'agree' ELSE 'disagree' END AS concordance FROM pep) GROUP BY 1")
def concordance(r: Roles) -> DataFrame:
    """Predictions against free text."""
    rows = r.pep.withColumn("predicted", F.when(F.col("size") % 2 == 0, "Red").otherwise("Blue"))
    return S.concordance(rows, "name", "predicted", {"Red": "red", "Blue": "blue"}).groupBy("concordance").agg(F.count("*").alias("n"))


@query("apex_grid_average", None)
def apex_grid_average(r: Roles) -> DataFrame:
    """J6, J7."""
    folded = R.fold(r.table("events").withColumn("rt", F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400.0), ["user_id", "event_type"], "rt", "value")
    out = R.grid_average(folded.select("event_type", "rt", "value"), ["event_type"], "rt", "value", half=2.0, points=21)
    return out.select("event_type", "n_runs", F.transform("intensity", lambda v: F.round(v, 6)).alias("intensity"))


@query("isotonic_residuals", None)
def isotonic_residuals(r: Roles) -> DataFrame:
    """Out-of-fold residuals and their robust deviation."""
    rows = r.prec.groupBy("peptide").agg(F.avg("rt").alias("x"), F.avg("intensity").alias("y"))
    return A.robust_sd(S.isotonic_residuals(rows, "x", "y", "peptide"), "residual")


KEPT_SQL = "list_filter(g.q, lambda x: x >= e.t - 259200)"


@query(
    "rate_limit_flags",
    f"""WITH RECURSIVE e AS (SELECT event_id, user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM (SELECT *, epoch(date_trunc('second', ts)) AS t FROM events)),
        g AS (SELECT event_id, user_id, k, [t] AS q, true AS allowed FROM e WHERE k = 1
              UNION ALL SELECT e.event_id, e.user_id, e.k, CASE WHEN len({KEPT_SQL}) < 3 THEN list_append({KEPT_SQL}, e.t) ELSE {KEPT_SQL} END, len({KEPT_SQL}) < 3 FROM g JOIN e ON e.user_id = g.user_id AND e.k = g.k + 1)
        SELECT event_id, user_id, allowed FROM g""",
)
def rate_limit_flags(r: Roles) -> DataFrame:
    """At most three allowed requests in three days."""
    e = r.table("events").select("event_id", "user_id", F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("s"))
    return A.allowed(e, "user_id", F.col("s"), "event_id", 3, 259_200).select("event_id", "user_id", "allowed")


@query("tumbling_counts", "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(r: Roles) -> DataFrame:
    """2.K (extension): event-time windows over a finished table."""
    e = r.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select(F.to_date("window.start").alias("day"), "event_type", "n", "total")


@query(
    "session_gaps",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS first FROM events), s AS (SELECT user_id, sum(first) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
       SELECT user_id, count(DISTINCT k) AS n_sessions, count(*) AS n_events FROM s GROUP BY user_id""",
)
def session_gaps(r: Roles) -> DataFrame:
    """2.K (extension): sessions that six quiet hours end."""
    e = r.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"))


@query("running_cycles", "SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS cycle FROM events")
def running_cycles(r: Roles) -> DataFrame:
    """G11, A12."""
    return A.running_cycle(r.table("events"), ["user_id"], "event_id", F.col("event_type") == "view").select("user_id", "event_id", "cycle")


@query("failure_sample", "SELECT status, count(*) AS n FROM (SELECT o_orderstatus AS status, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 12 GROUP BY status")
def failure_sample(r: Roles) -> DataFrame:
    """Twelve of each class."""
    return D.failure_sample(r.searches, "status", "search_id").groupBy("status").agg(F.count("*").alias("n"))


@query("conversation_fold", "SELECT conv_id, count(*) AS n_turns, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def conversation_fold(r: Roles) -> DataFrame:
    """Ordered folding."""
    folded = R.fold(r.table("conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", "role")
    return folded.select("conv_id", F.size("role").cast("long").alias("n_turns"), F.array_join("role", ">").alias("roles"))
