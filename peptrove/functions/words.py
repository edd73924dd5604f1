"""Dictionary words in sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: rank of a word that the frequency list doesn't have
UNRANKED = 12_000
CURATED = ("name", "spicy")
STOP = "THAT THIS WITH FROM HAVE WERE BEEN THEY WILL YOUR WHAT WHEN THAN THEM THEN SOME INTO".split()


def is_hidden(word: Column, category: Column, words: list[str], categories: list[str]) -> Column:
    """A word or a category that isn't shown."""
    return F.coalesce(category.isin(categories), F.lit(False)) | F.coalesce(F.upper(F.trim(word)).isin([w.upper() for w in words]), F.lit(False))


def with_rank(df: DataFrame, word: str, ranks: DataFrame) -> DataFrame:
    """Adds rank (null if unlisted) from a table (word, rank) of capital words."""
    from ..operators.joins import small

    listed = small(ranks.select(F.upper("word").alias("__w"), "rank"))
    return df.join(listed, F.upper(F.col(word)) == F.col("__w"), "left").drop("__w")


def is_common(rank: Column, category: Column) -> Column:
    """Listed, or curated."""
    return rank.isNotNull() | F.coalesce(category.isin(*CURATED), F.lit(False))


def sense_scores(df: DataFrame, key: str, word: str, ranks: DataFrame) -> DataFrame:
    """Mean rank of each key's words (lower reads better) and its most common content word."""
    ranked = with_rank(df, word, ranks)
    up = F.upper(F.col(word))
    content = (F.length(word) >= 4) & ~up.isin(STOP)
    best = F.min(F.when(content, F.struct(F.coalesce("rank", F.lit(99_999)).alias("r"), up.alias("w"))))
    return ranked.groupBy(key).agg(F.avg(F.coalesce("rank", F.lit(UNRANKED))).alias("sense"), best["w"].alias("content_word"))
