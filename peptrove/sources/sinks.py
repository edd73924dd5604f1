"""Writes that can be repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import lacking


def replace_partitions(df: DataFrame, path: str, key: str = "search_id") -> None:
    """Replaces exactly the partitions that ``df`` has rows of (B1)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def checksum(df: DataFrame) -> tuple[int, int, int]:
    """Rows, and the exclusive or and the sum of row hashes, which no order or chunking changes."""
    row = df.select(F.xxhash64(*(F.col(f"`{c}`") for c in sorted(df.columns))).alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.x or 0, int(row.s or 0)


def write_verified(df: DataFrame, path: str) -> tuple[int, int, int]:
    """Writes, reads back and compares; the checksum is what a registry keeps."""
    df.write.mode("overwrite").parquet(path)
    wrote, held = checksum(df), checksum(df.sparkSession.read.parquet(path))
    if wrote != held:
        raise OSError(f"{path}: {held} was read, {wrote} was written")
    return held


def export_parquet(df: DataFrame, path: str, most_rows: int = 3_000_000) -> int:
    """A bounded export; too many rows or none are errors, not truncations."""
    n = df.count()
    if not 0 < n <= most_rows:
        raise ValueError(f"{n} rows; an export has 1 to {most_rows}")
    df.coalesce(1 if n < 500_000 else 8).write.mode("overwrite").parquet(path)
    return n


def export_tsv(df: DataFrame, path: str, required: str = "intensity") -> None:
    """Tab-separated rows that have a value."""
    df.where(F.col(required).isNotNull()).write.mode("overwrite").csv(path, sep="\t", header=True)


def brief(title: str, facts: dict[str, object], tables: dict[str, DataFrame], most: int = 20) -> str:
    """A short Markdown report; ``most`` rows of each table are shown."""
    out = [f"# {title}", "", *(f"- **{k}**: {v}" for k, v in facts.items())]
    for name, df in tables.items():
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in df.limit(most).collect()]
    return "\n".join(out) + "\n"


def append_version(spark: SparkSession, path: str, component: str, version: str, notes: str = "") -> bool:
    """Appends to the version log; a log that can't be written never stops a job."""
    try:
        spark.createDataFrame([(component, version, notes)], "component string, version string, notes string").withColumn("recorded_at", F.current_timestamp()).write.mode("append").parquet(path)
        return True
    except Exception:
        return False


def refresh(spark: SparkSession, directory: str, snapshots: list[tuple[str, Callable[[SparkSession], DataFrame]]], needs: dict[str, list[str]] | None = None) -> dict[str, str | None]:
    """Rebuilds snapshots in their order (B13). One that fails stops only those that need it (``needs``: name to
    names before it), which keep what they had."""
    out: dict[str, str | None] = {}
    for name, build in snapshots:
        if failed := [n for n in (needs or {}).get(name, []) if out.get(n, "not refreshed before it") is not None]:
            out[name] = f"needs {', '.join(failed)}"
            continue
        try:
            build(spark).write.mode("overwrite").parquet(f"{directory}/{name}.parquet")
            out[name] = None
        except Exception as e:
            out[name] = f"{type(e).__name__}: {e}"[:300]
    return out


def top_up(done: DataFrame, source: DataFrame, key: str, build: Callable[[DataFrame], DataFrame], most_keys: int | None = None) -> DataFrame:
    """Rows for the keys that are still missing, the first ``most_keys`` of them."""
    missing = lacking(source.select(key).distinct(), done, key)
    if most_keys is not None:
        missing = missing.orderBy(key).limit(most_keys)
    return build(source.join(missing, key, "left_semi"))
