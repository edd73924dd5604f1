"""Shared helpers of the corpus operators: tables, shared storage, row keys."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN_DIR: dict[str, str] = {}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a corpus directory, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in a local session that has none (tests) a temporary folder is made.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="peptrove-")
    return _OWN_DIR[app]


def own_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables are."""
    return f"{shared_dir(spark)}/peptrove/{spark.sparkContext.applicationId}"


def discard(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables; call it when its results have been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage with replicated-storage semantics: a lost executor
    costs only the tasks it was running, and row keys made by
    ``monotonically_increasing_id`` become fixed data.  The shuffle files of the
    write go when it ends, not when the driver next collects its garbage.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def with_row_id(df: DataFrame, name: str = "rid") -> DataFrame:
    """A key per row (documents may repeat, ids may be null); fix it with materialize()."""
    return df.withColumn(name, F.monotonically_increasing_id())


#: plan nodes under which rows keep their partition and order whatever columns are read
STEADY = re.compile(r"^(Project|Filter|Relation|LocalRelation|LogicalRDD|SubqueryAlias|MapInArrow)\b")


def steady(df: DataFrame) -> DataFrame:
    """``df`` if with_row_id() numbers its rows alike in every read, else a written copy of it.

    A scan does; a shuffle doesn't, because reading fewer columns may deal rows otherwise.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = [re.sub(r"^[\s:+\-]*", "", line) for line in plan.splitlines() if line.strip()]
    return df if all(STEADY.match(n) for n in nodes) else materialize(df, "rows")


#: bytes of files up to which Spark may choose to broadcast a written table
FREE_BYTES = 1 << 20


def dealt(df: DataFrame, written: DataFrame | None = None, times: int = 1) -> DataFrame:
    """One side of a join, to be dealt by the keys and not broadcast unless the written table it comes from is small.

    Spark takes files for as large as they are compressed, and a table for no larger after an explode (``times``
    the rows), so its threshold lets through many times as much, all of it through the driver.
    """
    size = int(str((written or df)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if size * times <= FREE_BYTES else df.hint("merge")


def crc32_of_id(col: str = "doc_id"):
    """crc32 of an integer id written as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null is the empty text."""
    col = batch.column(batch.schema.get_field_index(name))
    col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
    return [b"" if x is None else x for x in col.to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], name: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches' rows in parts of about ``most`` bytes of a text column, one row at least; nothing is copied."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(name))
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        ends = np.frombuffer(column.buffers()[1] or b"", np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        lo = 0
        while lo < len(column):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def give_back() -> None:
    """Returns what this process has freed to the system: workers live on, and so would their heaps."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A function for mapInArrow that gives its memory back when its task ends."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def chunks(values: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of about ``most`` bytes, one text at least."""
    lo, size = 0, 0
    for i, v in enumerate(values):
        if size and size + len(v) > most:
            yield lo, i
            lo, size = i, 0
        size += len(v)
    if lo < len(values):
        yield lo, len(values)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def extended(kept: T.StructType, more: str) -> T.StructType:
    """The kept columns' schema with the columns of a DDL string after them."""
    return T.StructType([*kept.fields, *T.StructType.fromDDL(more).fields])


def as_one(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns as one struct beside the text, so that no name of theirs can clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col(text_col).alias("text"))
