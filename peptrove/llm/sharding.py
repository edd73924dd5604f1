"""Sharding by sampled splitters: near-equal bytes, equal texts side by side.

Records are ordered by (hash of the text, id, row number), so that no two have
one key, however many rows are equal.  A size-weighted sample of the
keys gives splitters at its quantiles; records are dealt into those ranges,
the exact bytes of each range are counted, and a running sum inside a range
(never over more than a range) gives every record its byte position in the
whole order.  Splitters and the places where ranges begin are tables that are
broadcast: 40 bytes a range of ROWS_PER_RANGE rows.  Shard j takes the positions from ``j/n`` to ``(j+1)/n`` of all
bytes.  A boundary that falls into a group of equal texts moves to the group's
nearer edge when that shifts at most ``slack`` of a shard; otherwise the group
is cut there, so a text that holds a third of all rows spreads over as many
shards as its bytes need.  Ranges that the exact counts show to be overfull
are sampled and subdivided again.

Defined cases: a null text has no bytes and is grouped with other null texts
(and with empty ones); repeated rows and null ids each get a slot of their
own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialize, table

SHARDS = 40
ROWS_PER_RANGE = 200_000
RANGES_PER_SHARD = 32
SAMPLES_PER_RANGE = 8
#: a boundary moves by at most this share of a shard to keep equal texts together
SLACK = 0.02
OVERFULL = 4.0
KEY = ("key", "tie", "pick", "rid")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The records without their texts: id, size, checksum and the sort key."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("tie"),
        F.xxhash64(F.lit("sample"), F.col(id_col), text).alias("pick"),
        F.monotonically_increasing_id().alias("rid"),
    )


def draw(rows: DataFrame, expected: float, total: int, round_: int) -> list[tuple]:
    """A Poisson sample with chances proportional to size, the same on every run.

    Its expected length is ``expected``, a parameter and not a share of the input.
    """
    unit = (F.pmod(F.xxhash64(F.lit(round_), "pick", "rid"), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))
    sample = rows.where(unit * F.lit(float(max(total, 1))) < F.col("size") * F.lit(float(expected)))
    return sorted(tuple(r) for r in sample.select(*KEY).collect())


def quantiles(sample: list[tuple], n: int) -> list[tuple]:
    """n - 1 splitters at equal steps of the sorted, already weighted sample."""
    if not sample:
        return []
    return sorted({sample[min(len(sample) - 1, i * len(sample) // n)] for i in range(1, n)})


SPLITTERS = "array<struct<" + ",".join(f"{c}:long" for c in KEY) + ">>"


def ranged(rows: DataFrame, splitters: list[tuple]) -> DataFrame:
    """The rows with ``range``, how many splitters are at or below their key: a binary search in
    the JVM over a broadcast row."""
    if not splitters:
        return rows.withColumn("range", F.lit(0))
    n, step, steps = len(splitters), 1, []
    while step <= n:
        steps.insert(0, step)
        step *= 2
    table = rows.sparkSession.createDataFrame([(splitters,)], f"__s {SPLITTERS}")
    key = F.struct(*(F.col(c) for c in KEY))
    found = F.aggregate(
        F.array(*(F.lit(s) for s in steps)),
        F.lit(0),
        lambda lo, s: F.when((lo + s <= n) & (F.element_at("__s", F.least(lo + s, F.lit(n))) <= key), lo + s).otherwise(lo),
    )
    return rows.join(F.broadcast(table)).withColumn("range", found).drop("__s")  # one row


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs``."""
    rows = materialize(keyed(docs, id_col, text_col), "shard-keys")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = max(shards * RANGES_PER_SHARD, -(-count // ROWS_PER_RANGE))
    splitters = quantiles(draw(rows, ranges * SAMPLES_PER_RANGE, total, 0), ranges)
    counted: list = []
    for again in range(1, 5):
        counted = ranged(rows, splitters).groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("c")).collect()
        overfull = [r.range for r in counted if r.b > OVERFULL * total / ranges and r.c > 64]
        if not overfull:
            break
        only = rows.sparkSession.createDataFrame([(r,) for r in overfull], "range int")
        inside = ranged(rows, splitters).join(F.broadcast(only), "range", "left_semi")
        bytes_inside = sum(r.b for r in counted if r.range in set(overfull))
        finer = draw(inside, SAMPLES_PER_RANGE * ranges * bytes_inside / total, bytes_inside, again)
        more = quantiles(finer, max(2, int(ranges * bytes_inside / total) + 1))
        if not set(more) - set(splitters):
            break
        splitters = sorted({*splitters, *more})
    begins, b, c = [], 0, 0
    for r in sorted(counted, key=lambda r: r.range):
        begins.append((r.range, b, c))
        b, c = b + r.b, c + r.c
    begins = rows.sparkSession.createDataFrame(begins, "range int, bytes_before long, rows_before long")
    inside = Window.partitionBy("range").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, 0)
    placed = materialize(
        ranged(rows, splitters)
        .withColumn("below", F.sum("size").over(inside) - F.col("size"))
        .withColumn("nth", F.count("*").over(inside) - 1)
        .join(F.broadcast(begins), "range")
        .select("doc_id", "size", "text_crc32", "key", (F.col("bytes_before") + F.col("below")).alias("pos"), (F.col("rows_before") + F.col("nth")).alias("idx")),
        "shard-places",
    )
    cuts = boundaries(placed, shards, total)
    shard = F.aggregate(F.array(*(F.lit(x).cast("long") for x in cuts)), F.lit(0), lambda n, x: n + (F.col("pos") >= x).cast("int")) if cuts else F.lit(0)
    sharded = placed.withColumn("shard", shard)
    first = {r.shard: r.i for r in sharded.groupBy("shard").agg(F.min("idx").alias("i")).collect()}
    start = F.element_at(F.array(*(F.lit(first.get(i, 0)).cast("long") for i in range(shards))), F.col("shard") + 1)
    return sharded.select("doc_id", "size", "text_crc32", "shard", (F.col("idx") - start).alias("slot"))


def boundaries(placed: DataFrame, shards: int, total: int) -> list[int]:
    """Byte positions where shards 1 to n-1 begin."""
    ideal = [total * j // shards for j in range(1, shards)]
    if not total or not ideal:
        return []
    crossed = F.lit(False)
    for t in ideal:
        crossed |= (F.col("pos") <= t) & (F.col("pos") + F.col("size") > t)
    at = placed.where(crossed).select("key", "pos", "size").collect()
    keys = sorted({r.key for r in at})
    extent = {r.key: (r.lo, r.hi) for r in placed.where(F.col("key").isin(keys)).groupBy("key").agg(F.min("pos").alias("lo"), F.max(F.col("pos") + F.col("size")).alias("hi")).collect()}
    slack, cuts = SLACK * total / shards, []
    for t in ideal:
        row = next(r for r in at if r.pos <= t < r.pos + r.size)
        lo, hi = extent[row.key]
        cut = lo if t - lo <= hi - t else hi
        if abs(cut - t) > slack:
            cut = row.pos if t - row.pos <= row.pos + row.size - t else row.pos + row.size
        cuts.append(cut)
    return cuts


def op6_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
