"""The corpus's tables over the test tables: observations, peptides, runs, searches, labs.

The same roles are common table expressions of the DuckDB SQL (``sql``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

CTES = {
    "prec": """SELECT l_orderkey AS search_id, l_suppkey AS run, l_partkey AS peptide, l_linenumber AS charge, l_discount AS q, l_extendedprice AS intensity,
        CASE WHEN l_tax = 0 THEN NULL ELSE l_tax END AS im, l_quantity AS rt, l_returnflag = 'R' AS decoy, l_linestatus = 'O' AS contaminant, CAST(l_shipdate AS DATE) AS seen FROM lineitem""",
    "pep": "SELECT p_partkey AS peptide, p_name AS name, p_type || '|' || p_brand AS grp, p_brand AS brand, upper(replace(p_name, ' ', ';')) AS genes, p_size AS size, p_retailprice AS price FROM part",
    "runs": "SELECT s_suppkey AS run, s_name AS run_name, s_acctbal AS gradient, n_nationkey AS taxon, n_name AS organism, r_name AS taxon_group FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "searches": "SELECT o_orderkey AS search_id, o_custkey AS lab, o_orderstatus AS status, o_orderpriority AS engine, CAST(o_orderdate AS DATE) AS submitted, o_totalprice AS total FROM orders",
    "labs": "SELECT c_custkey AS lab, c_name AS lab_name, c_mktsegment AS institute, c_nationkey AS nation, c_acctbal AS balance FROM customer",
}


def sql(body: str) -> str:
    """The body with the roles it names in front."""
    own = [n for n in CTES if n in body.replace("(", " ").replace(")", " ").replace(",", " ").split()]
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in own)
    if body.lstrip().upper().startswith("WITH "):
        rest = body.lstrip()[5:]
        return f"WITH {head}, {rest}" if own else body
    return f"WITH {head} {body}" if own else body


def query(name: str, oracle: str | None = None):
    """Registers a plan under a name, with its DuckDB SQL over the roles."""

    def register(f: Callable[[Roles], DataFrame]) -> Callable[[Roles], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Roles(spark, sf_dir))
        if oracle:
            ORACLE_SQL[name] = sql(oracle)
        return f

    return register


class Roles:
    """Lazy frames of one directory; columns and filters are pushed into the scans by Spark."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    @property
    def prec(self) -> DataFrame:
        t = self.table("lineitem")
        return t.select(
            F.col("l_orderkey").alias("search_id"), F.col("l_suppkey").alias("run"), F.col("l_partkey").alias("peptide"), F.col("l_linenumber").alias("charge"), F.col("l_discount").alias("q"),
            F.col("l_extendedprice").alias("intensity"), F.nullif("l_tax", F.lit(0.0)).alias("im"), F.col("l_quantity").alias("rt"), (F.col("l_returnflag") == "R").alias("decoy"),
            (F.col("l_linestatus") == "O").alias("contaminant"), F.to_date("l_shipdate").alias("seen"),
        )

    @property
    def pep(self) -> DataFrame:
        t = self.table("part")
        return t.select(F.col("p_partkey").alias("peptide"), F.col("p_name").alias("name"), F.concat_ws("|", "p_type", "p_brand").alias("grp"), F.col("p_brand").alias("brand"), F.upper(F.replace("p_name", F.lit(" "), F.lit(";"))).alias("genes"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))

    @property
    def runs(self) -> DataFrame:
        s, n, r = self.table("supplier"), self.table("nation"), self.table("region")
        joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
        return joined.select(F.col("s_suppkey").alias("run"), F.col("s_name").alias("run_name"), F.col("s_acctbal").alias("gradient"), F.col("n_nationkey").alias("taxon"), F.col("n_name").alias("organism"), F.col("r_name").alias("taxon_group"))

    @property
    def searches(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("search_id"), F.col("o_custkey").alias("lab"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("engine"), F.to_date("o_orderdate").alias("submitted"), F.col("o_totalprice").alias("total"))

    @property
    def labs(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("lab"), F.col("c_name").alias("lab_name"), F.col("c_mktsegment").alias("institute"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))

    @property
    def genes(self) -> DataFrame:
        """One row a peptide and gene."""
        return self.pep.select("peptide", "grp", F.explode(F.split("genes", ";")).alias("gene"))
