"""Governed access to named tables: allow-list, tiers, row scope, redaction (A1, D19, L25, 2.P)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import anonymous

TIERS = ("public", "lab", "full")


class NotAllowed(PermissionError):
    """A table or statement that the policy doesn't let through."""


@dataclass(frozen=True)
class TableRule:
    """Who may read a table, which columns are hidden below full access, and its row scope column."""

    tier: str = "public"
    hidden: dict[str, str] = field(default_factory=dict)  # column -> label prefix
    scope: str | None = None


@dataclass
class Governed:
    """Reads Parquet tables of one directory under rules; every query declares its tables."""

    spark: SparkSession
    directory: str
    rules: dict[str, TableRule]
    tier: str = "public"
    scope_values: list | None = None

    def table(self, name: str) -> DataFrame:
        rule = self.rules.get(name)
        if rule is None or TIERS.index(rule.tier) > TIERS.index(self.tier):
            raise NotAllowed(f"table {name} is not open to {self.tier} access")
        df = self.spark.read.parquet(f"{self.directory}/{name}.parquet")
        if rule.scope and self.tier == "lab":
            df = df.where(F.col(rule.scope).isin(self.scope_values or []))
        return redact(df, rule.hidden) if self.tier != "full" else df

    def sql(self, statement: str, tables: list[str]) -> DataFrame:
        """One SELECT or WITH statement over exactly the declared tables."""
        if statement.strip().split(None, 1)[0].lower() not in ("select", "with"):
            raise NotAllowed("only SELECT and WITH are run")
        for name in tables:
            self.table(name).createOrReplaceTempView(name)
        df = self.spark.sql(statement)
        plan = df._jdf.queryExecution().logical().toString()
        used = {n for n in self.rules if f"[{n}]" in plan}
        if undeclared := used - set(tables):
            raise NotAllowed(f"undeclared tables: {', '.join(sorted(undeclared))}")
        return df

    def fetch(self, df: DataFrame, how: str = "all"):
        """all rows, one, a single value, or nothing."""
        if how == "all":
            return df.collect()
        if how == "none":
            df.write.format("noop").mode("overwrite").save()
            return None
        row = df.first()
        return row if how == "one" or row is None else row[0]


def redact(df: DataFrame, hidden: dict[str, str]) -> DataFrame:
    """Hidden columns as stable labels; the others as they are."""
    return df.select(*(anonymous(F.col(c).cast("string"), hidden[c]).alias(c) if c in hidden else F.col(c) for c in df.columns))


def visible_to(col: Column, mine: list) -> Column:
    """The row filter of lab access."""
    return col.isin(mine)


def statistics(df: DataFrame, *cols: str) -> DataFrame:
    """Estimates a column (F26): approximate distinct values and share of nulls, in one pass."""
    aggs = [F.count("*").alias("__n")]
    for c in cols:
        aggs += [F.approx_count_distinct(c).alias(f"{c}__d"), F.count(F.when(F.col(c).isNull(), 1)).alias(f"{c}__z")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__d").alias("n_distinct"), F.when(F.col("__n") > 0, F.col(f"{c}__z") / F.col("__n")).alias("null_share")) for c in cols]
    return one.select(F.inline(F.array(*rows)))
