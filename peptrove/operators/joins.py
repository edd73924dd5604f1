"""Joins that Spark has no word for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: a side of at most this many bytes, as its plan estimates, may be broadcast
BROADCAST_BYTES = 32 << 20


def is_small(df: DataFrame, most: int | None = None) -> bool:
    """Whether a side's plan proves that it may be broadcast."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= (BROADCAST_BYTES if most is None else most)


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """Marks a side for broadcast if its plan proves it small, else leaves the choice to Spark."""
    return F.broadcast(df) if is_small(df, most) else df


def binned_range_join(left: DataFrame, right: DataFrame, x: str, y: str, tol: float, on: list[str] | None = None, width: float = 4.0) -> DataFrame:
    """Pairs with ``abs(left.x - right.y) <= tol``, and equal ``on`` columns, without a cross join.

    Values are dealt into bins ``width`` tolerances wide. A right row has one bin; a left row
    goes to the bins its interval touches (one or two), so every pair meets once.  Column names
    must differ except for ``on``. Null values match nothing.
    """
    if tol <= 0:
        return left.join(right, [*(left[c] == right[c] for c in on or ()), left[x] == right[y]])
    step = tol * width
    low, high = F.floor((F.col(x) - tol) / step), F.floor((F.col(x) + tol) / step)
    a = left.where(F.col(x).isNotNull()).withColumn("__bin", F.explode(F.sequence(low, high)))
    b = right.where(F.col(y).isNotNull()).withColumn("__bin", F.floor(F.col(y) / step))
    return a.join(b, [*(on or ()), "__bin"]).where(F.abs(F.col(x) - F.col(y)) <= tol).drop("__bin")


def with_bins(left: DataFrame, right: DataFrame, x: str, y: str, tol: float, name: str, width: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column to join on beside other keys: all pairs with ``abs(left.x - right.y) <= tol``
    are equal in it, each once; others that are have to be left out after the join. Null values have no bin."""
    step, slack = max(tol, 1e-9) * width, F.abs(F.col(x)) * 1e-15 + tol * 1e-9
    low, high = F.floor((F.col(x) - tol - slack) / step), F.floor((F.col(x) + tol + slack) / step)
    a = left.where(F.col(x).isNotNull()).withColumn(name, F.explode(F.sequence(low, high)))
    return a, right.where(F.col(y).isNotNull()).withColumn(name, F.floor(F.col(y) / step))


def ppm_range_join(left: DataFrame, right: DataFrame, x: str, y: str, ppm: float, on: list[str] | None = None) -> DataFrame:
    """Pairs with ``abs(left.x - right.y) <= left.x * ppm / 1e6`` (C12): bins on a logarithmic scale.

    A right value within the tolerance of x lies in x's bin or in one beside it."""
    step = 2 * ppm * 1e-6
    a = left.where(F.col(x) > 0).withColumn("__bin", F.explode(F.sequence(F.floor(F.log(F.col(x) * (1 - ppm * 1e-6)) / step), F.floor(F.log(F.col(x) * (1 + ppm * 1e-6)) / step))))
    b = right.where(F.col(y) > 0).withColumn("__bin", F.floor(F.log(F.col(y)) / step))
    return a.join(b, [*(on or ()), "__bin"]).where(F.abs(F.col(x) - F.col(y)) <= F.col(x) * ppm * 1e-6).drop("__bin")


def having(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """Rows that have a partner (EXISTS)."""
    return df.join(other.select(*keys), list(keys), "left_semi")


def lacking(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """Rows that have none (NOT EXISTS)."""
    return df.join(other.select(*keys), list(keys), "left_anti")


def first_of(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """One value a key, always the least: the deterministic form of a scalar subquery with LIMIT 1."""
    return df.groupBy(key).agg(F.min(value).alias(name))


def exploded_join(df: DataFrame, col: str, dim: DataFrame, key: str, sep: str = ";") -> DataFrame:
    """Joins each value of a multi-value string with a dimension."""
    parts = F.filter(F.transform(F.split(F.col(col), sep), lambda t: F.upper(F.trim(t))), lambda t: t != "")
    return df.withColumn(key, F.explode(F.array_distinct(parts))).join(small(dim), key)


def link_by_keys(left: DataFrame, right: DataFrame, keys: list[Column], right_keys: list[Column], left_id: str, right_id: str, left_n: str, right_n: str) -> DataFrame:
    """Links records under any of several candidate keys.

    A left record with one candidate is linked to it; with more, to the one with exactly the
    same count if that is one; else it stays unlinked. Result: left_id, right_id (null if not
    linked), n_candidates.
    """
    a = left.select(F.col(left_id), F.col(left_n), F.explode(F.array_distinct(F.array(*keys))).alias("__k")).where("__k is not null")
    b = right.select(F.col(right_id), F.col(right_n), F.explode(F.array_distinct(F.array(*right_keys))).alias("__k")).where("__k is not null")
    met = a.join(b, "__k").select(left_id, left_n, right_id, right_n).distinct()
    same = F.col(left_n).eqNullSafe(F.col(right_n))
    found = met.groupBy(left_id).agg(
        F.count("*").alias("n_candidates"), F.min(right_id).alias("__only"), F.count(F.when(same, 1)).alias("__equal"), F.min(F.when(same, F.col(right_id))).alias("__best")
    )
    chosen = F.when(F.col("n_candidates") == 1, F.col("__only")).when(F.col("__equal") == 1, F.col("__best"))
    linked = found.select(left_id, chosen.alias(right_id), "n_candidates")
    return left.select(left_id).distinct().join(linked, left_id, "left").select(left_id, right_id, F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"))


def contained_name(left: DataFrame, names: DataFrame, text: str, name: str) -> DataFrame:
    """The least of the names that a text contains, ignoring case (E16): the texts' parts of the names'
    lengths meet the names in an equi-join, so no text is tried with every name."""
    wanted = names.select(name, F.lower(name).alias("__p")).where(F.col(name) != "").groupBy("__p").agg(F.min(name).alias(name))
    texts, low = left.select(text).distinct(), F.lower(F.col(text))
    lengths = [r[0] for r in wanted.select(F.length("__p")).distinct().collect()]
    places = lambda k: F.when(F.length(low) >= k, F.sequence(F.lit(1), F.length(low) - k + 1)).otherwise(F.array().cast("array<int>"))
    parts = F.flatten(F.transform(F.array(*(F.lit(k) for k in lengths)).cast("array<int>"), lambda k: F.transform(places(k), lambda i: F.substr(low, i, k))))
    met = texts.select(text, F.explode(F.array_distinct(parts)).alias("__p")).join(small(wanted), "__p")
    return left.join(met.groupBy(text).agg(F.min(name).alias(name)), text, "left")
