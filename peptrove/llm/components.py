"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import dealt, materialize


#: a node's links are dealt into so many joins; a hub may hold a third of all links
SALTS = 16


def with_least(edges: DataFrame, least: DataFrame, written: DataFrame) -> DataFrame:
    """Each edge (a, b) with m of its a. Edges are dealt by salt, so that a hub's aren't one task's; ``written``:
    the table that both come from, by whose size the SALTS times as many rows of ``least`` are broadcast or not."""
    salted = least.withColumn("s", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    return edges.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(dealt(salted, written, SALTS), ["a", "s"]).drop("s")


def is_star(edges: DataFrame) -> bool:
    """Every node has one root, and no root has a root."""
    twice = edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    chained = edges.select("a").join(dealt(edges.select(F.col("b").alias("a"))), "a", "left_semi")
    return twice.unionByName(chained).isEmpty()


def components(edges: DataFrame, most: int = 50) -> DataFrame:
    """``edges`` (a, b) of long numbers to (a, b): every node that isn't the least of its
    component, with that least one. Hot nodes are joined, never collected."""
    cur = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most):
        if is_star(cur):
            return cur
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = with_least(both.where("b > a"), least, cur).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = with_least(large, least, cur).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        cur = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
    raise RuntimeError(f"no components after {most} rounds")
