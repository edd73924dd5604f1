"""One row a key, by explicit rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the order given, which must be complete for a fixed result."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def latest(df: DataFrame, key: str, at: str, *tie: str) -> DataFrame:
    """The latest row of each key, by an aggregate that combines before it shuffles (G1)."""
    best = F.max(F.struct(F.col(at), *(F.col(t) for t in tie), *(F.col(c) for c in df.columns if c not in (key, at, *tie))))
    return df.groupBy(key).agg(best.alias("__b")).select(key, *(F.col(f"__b.{c}") for c in df.columns if c != key))


def mode(df: DataFrame, keys: list[str], value: str, name: str = "mode") -> DataFrame:
    """The most frequent value of each key, of equals the least (F17), and how frequent it is."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col(value).alias("v"))).alias("__b")
    return counts.groupBy(*keys).agg(best).select(*keys, F.col("__b.v").alias(name), (-F.col("__b.less")).alias("n"))


def clear_mode(df: DataFrame, keys: list[str], value: str, least_rows: int = 20, least_share: float = 0.6, top: int = 3) -> DataFrame:
    """The mode where it is clear, with the ``top`` values and the share."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), value)))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    best = ranked.where(F.col("__n") <= top).groupBy(*keys).agg(
        F.max(F.when(F.col("__n") == 1, F.col(value))).alias("top"), F.max(F.when(F.col("__n") == 1, F.col("n"))).alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("__n", value))), lambda x: x[value].cast("string")).alias("leaders"),
    )
    share = F.col("n") / F.col("total")
    return best.join(total, keys).withColumn("share", share).withColumn("called", F.when((F.col("total") >= least_rows) & (share >= least_share), F.col("top")))


def margin(df: DataFrame, keys: list[str], value: str, score: str) -> DataFrame:
    """The best row of each key and how far its score leads the next one's."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), value)
    ranked = df.withColumn("__n", F.row_number().over(w)).withColumn("margin", F.col(score) - F.lead(score).over(w)).withColumn("runner_up", F.lead(value).over(w))
    return ranked.where("__n = 1").drop("__n")


def best_candidates(df: DataFrame, keys: list[str], by: str, least: bool, *tie: str, floor: float | None = None) -> DataFrame:
    """The best row of each key by one measure; with ``floor`` only rows from that quantile of
    their key on (the value at index int(n * floor) of the sorted ones) compete (G4)."""
    if floor is not None:
        w = Window.partitionBy(*keys)
        ordered = F.row_number().over(w.orderBy(F.col(by), *tie)) - 1
        df = df.withColumn("__i", ordered).withColumn("__c", F.count("*").over(w))
        at = F.max(F.when(F.col("__i") == F.floor(F.col("__c") * floor), F.col(by))).over(w)
        df = df.withColumn("__f", at).where(F.col(by) >= F.col("__f")).drop("__i", "__c", "__f")
    order = F.col(by).asc_nulls_last() if least else F.col(by).desc_nulls_last()
    return first_by(df, keys, order, *tie)


def keep_better(old: DataFrame, new: DataFrame, key: str, by: str) -> DataFrame:
    """Upsert that replaces a row only by a strictly better one."""
    both = old.withColumn("__old", F.lit(1)).unionByName(new.withColumn("__old", F.lit(0)))
    return first_by(both, [key], F.col(by).desc_nulls_last(), F.desc("__old")).drop("__old")


def merge_fields(old: DataFrame, new: DataFrame, keys: list[str], prefer_new: bool = True) -> DataFrame:
    """Upsert field by field: a null never overwrites (B4); with ``prefer_new`` false only gaps are filled."""
    fields = [c for c in old.columns if c not in keys]
    a, b = old.alias("o"), new.alias("n")
    cols = [F.coalesce(*((F.col(f"n.{c}"), F.col(f"o.{c}")) if prefer_new else (F.col(f"o.{c}"), F.col(f"n.{c}")))).alias(c) for c in fields]
    joined = a.join(b, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    return joined.select(*(F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys), *cols)


def replace_children(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All of the new rows, and the old ones of the keys that have none."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def failure_sample(df: DataFrame, classes: str, key: str, most: int = 12, seed: int = 0) -> DataFrame:
    """At most ``most`` rows of each class, the same on every run."""
    return first_n(df, [classes], most, F.xxhash64(F.lit(seed), key), F.col(key))


def first_n(df: DataFrame, keys: list[str], n: int, *order: Column | str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in a seeded order."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def page(df: DataFrame, *order: Column | str, limit: int | None = None, offset: int | None = None, most: int = 200) -> DataFrame:
    """A page in a complete order (H2)."""
    return df.orderBy(*order).offset(max(offset or 0, 0)).limit(min(limit or 50, most))
