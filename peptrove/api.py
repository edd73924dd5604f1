"""The corpus as Python methods: validated arguments, bounded pages, uncapped counts (2.P)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import chem, text
from .operators import aggregates as A
from .operators import arrays as R
from .operators import dedup as D
from .operators.joins import binned_range_join, small
from .plans.roles import Roles

LEAST_QUERY, MOST_PAGE, MOST_TRANSITIONS = 2, 200, 12


def clamp(value: int | None, default: int, low: int, high: int) -> int:
    return max(low, min(high, default if value is None else int(value)))


def checked(query: str) -> str:
    q = (query or "").strip()
    if len(q) < LEAST_QUERY:
        raise ValueError(f"a query has {LEAST_QUERY} characters or more")
    return q


class Corpus:
    """Look-ups over a directory's roles. Every method returns a DataFrame; nothing is collected."""

    def __init__(self, roles: Roles):
        self.roles = roles

    def overview(self) -> DataFrame:
        return self.roles.prec.agg(F.count("*").alias("n_precursors"), F.count_distinct("peptide").alias("n_peptides"), F.count_distinct("run").alias("n_runs"), F.count_distinct("search_id").alias("n_searches"))

    def _summary(self, hits: DataFrame, *keys: str) -> DataFrame:
        rows = self.roles.prec.join(small(hits), "peptide")
        return rows.groupBy(*keys).agg(F.count("*").alias("n_obs"), F.count_distinct("run").alias("n_runs"), F.count_distinct("peptide").alias("n_peptides"), F.round(F.sum("intensity"), 2).alias("intensity"))

    def search_peptides(self, query: str, limit: int | None = None, offset: int | None = None) -> DataFrame:
        """Exact up to I and L; else by substring."""
        q = checked(query)
        pep = self.roles.pep.select("peptide", "name")
        exact = pep.where(chem.il_key(F.col("name")) == q.upper().replace("I", "L"))
        hits = exact if not exact.isEmpty() else pep.where(text.contains_ignoring_case(F.col("name"), q))
        return D.page(self._summary(hits, "peptide", "name"), F.desc("n_obs"), "peptide", limit=limit, offset=offset, most=MOST_PAGE)

    def count_peptides(self, query: str) -> DataFrame:
        """The total that a page of search_peptides is a part of (H3)."""
        return self.roles.pep.where(text.contains_ignoring_case(F.col("name"), checked(query))).agg(F.count_distinct("peptide").alias("n_total"))

    def search_proteins(self, query: str, limit: int | None = None) -> DataFrame:
        """Symbol or accession equal or by prefix in any case; else by substring."""
        q = checked(query)
        begins: Column = F.lit(False)
        for v in text.case_variants(q):
            begins = begins | F.col("brand").startswith(v) | F.col("grp").startswith(v)
        pep = self.roles.pep.select("peptide", "grp", "brand")
        exact = pep.where(begins)
        hits = exact if not exact.isEmpty() else pep.where(text.contains_ignoring_case(F.col("grp"), q))
        return self._summary(hits.select("peptide", "grp"), "grp").orderBy(F.desc("n_obs"), "grp").limit(clamp(limit, 50, 1, MOST_PAGE))

    def protein(self, group: str) -> DataFrame:
        return self._summary(self.roles.pep.where(F.col("grp") == group).select("peptide", "grp"), "grp")

    def peptide(self, peptide: int) -> DataFrame:
        """A row a charge with abundance shares."""
        return A.share_of_total(self.roles.prec.where(F.col("peptide") == peptide), ["charge"], {"n": F.count("*"), "intensity": F.sum("intensity")})

    def gene(self, symbol: str) -> DataFrame:
        hits = self.roles.genes.where(F.col("gene") == checked(symbol).upper())
        return self._summary(hits.select("peptide", "gene"), "gene")

    def species(self, query: str, limit: int | None = None) -> DataFrame:
        q = checked(query)
        rows = self.roles.runs.where(text.contains_ignoring_case(F.col("organism"), q) | text.contains_ignoring_case(F.col("taxon_group"), q))
        return rows.groupBy("organism", "taxon_group").agg(F.count_distinct("run").alias("n_runs")).orderBy(F.desc("n_runs"), "organism").limit(clamp(limit, 15, 5, 100))

    def searches(self, limit: int | None = None, offset: int | None = None) -> DataFrame:
        return D.page(self.roles.searches, F.desc("submitted"), "search_id", limit=limit, offset=offset, most=MOST_PAGE)

    def ions(self, sequence: str, charges: int | None = None) -> DataFrame:
        """Theoretical b and y ions."""
        one = self.roles.spark.createDataFrame([(sequence,)], "seq string")
        return one.select(F.inline(chem.ladder(F.col("seq"), clamp(charges, 2, 1, 3))))

    def coverage(self, protein: str, peptides: list[str]) -> DataFrame:
        rows = self.roles.spark.createDataFrame([(protein, p) for p in peptides], "seq string, pep string")
        return R.coverage(rows.withColumn("k", F.lit(1)), ["k"], "seq", "pep").drop("k")

    def interference(self, targets: DataFrame, others: DataFrame, tol: float = 0.01, rt_tol: float = 0.5, top: int = 40, transitions: int = MOST_TRANSITIONS) -> DataFrame:
        """Partners by shared transitions (L30), for the first ``transitions`` of each key by m/z, all partners counted.
        ``complete`` says whether these are all of the key's. targets: key, mz, rt; others: partner, other_mz, other_rt."""
        first = D.first_n(targets.select("key", "mz", "rt").distinct(), ["key"], transitions, "mz", "rt")
        size = targets.select("key", "mz", "rt").distinct().groupBy("key").agg((F.count("*") <= transitions).alias("complete"), F.least(F.count("*"), F.lit(transitions)).alias("n_transitions"))
        met = binned_range_join(first, others, "mz", "other_mz", tol).where(F.col("key") != F.col("partner"))
        apart = F.abs(F.col("rt") - F.col("other_rt"))
        g = met.groupBy("key", "partner").agg(F.count_distinct("mz").alias("n_shared"), F.count_distinct(F.when(apart <= rt_tol, F.col("mz"))).alias("n_near"), F.round(F.min(apart), 3).alias("least_apart"))
        return g.orderBy(F.desc("n_near"), F.desc("n_shared"), "key", "partner").limit(top).join(size, "key")
