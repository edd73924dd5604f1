"""Lanes: datasets of one shape whose fields may only be added at the end."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def concatenated(lanes: list[DataFrame]) -> DataFrame:
    """All rows of all lanes; a field that an older lane lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lanes)


def parallel(df: DataFrame, *arrays: str) -> DataFrame:
    """Rows whose arrays aren't of one length: what a lane may never hold."""
    sizes = [F.size(a) for a in arrays]
    return df.where(reduce(lambda x, y: x | y, (s != sizes[0] for s in sizes[1:]), F.lit(False)))
