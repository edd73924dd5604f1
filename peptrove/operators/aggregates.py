"""Aggregates of one or two levels."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def mean_of_positive(col: str) -> Column:
    """avg(nullif(x, 0))."""
    return F.avg(F.when(F.col(col) != 0, F.col(col)))


def quartiles(col: Column, prefix: str, digits: int = 4) -> list[Column]:
    """Exact interpolated quartiles."""
    return [F.round(F.percentile(col, F.lit(p)), digits).alias(f"{prefix}_{n}") for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]


def distinct_list(col: Column) -> Column:
    """Sorted distinct values, null left out."""
    return F.array_sort(F.collect_set(col))


def joined_distinct(col: Column, sep: str = ", ") -> Column:
    return F.array_join(distinct_list(col), sep)


def argmax(value: str, *by: Column | str) -> Column:
    """The value with the greatest measures; ties go to the greater later measure, then value."""
    return F.max_by(value, F.struct(*by, F.col(value)))


def histogram(df: DataFrame, col: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Equal bins over [lo, hi): bin from 1, centre, n; values outside are left out."""
    width = (hi - lo) / bins
    b = F.width_bucket(F.col(col), F.lit(lo), F.lit(hi), F.lit(bins))
    counts = df.where(F.col(col).isNotNull()).select(b.alias("bin")).where(F.col("bin").between(1, bins)).groupBy("bin").agg(F.count("*").alias("n"))
    return counts.select(F.col("bin").cast("long").alias("bin"), F.round(F.lit(lo) + (F.col("bin") - 0.5) * width, 6).alias("centre"), "n")


def log2_bucket(col: Column) -> Column:
    """Floor of the binary logarithm of a whole number from 1, by its length in binary (F12, SF23)."""
    return F.length(F.bin(col.cast("long"))) - 1


def log2_histogram(df: DataFrame, col: str) -> DataFrame:
    b = log2_bucket(F.col(col))
    counts = df.where(F.col(col) >= 1).groupBy(b.cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    lo = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bucket").cast("int"))
    hi = lo * 2 - 1
    return counts.select("bucket", F.when(lo == hi, lo.cast("string")).otherwise(F.concat_ws("-", lo.cast("string"), hi.cast("string"))).alias("label"), "n")


def trimmed_histogram(df: DataFrame, col: str, low: float = 0.005, high: float = 0.995, bins: int = 40) -> DataFrame:
    """Equal bins between two quantiles, the ends included in the outer bins."""
    fence = interpolated(df, col, {"lo": low, "hi": high})
    kept = df.select(col).join(F.broadcast(fence)).where(F.col(col).between(F.col("lo"), F.col("hi")))  # the fence is one row
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col(col) - F.col("lo")) / width))).otherwise(0)
    return kept.groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def share_of_total(df: DataFrame, keys: list[str], measures: dict[str, Column], digits: int = 6) -> DataFrame:
    """Aggregates a key, each with its share of the sum over all keys (F16)."""
    per = df.groupBy(*keys).agg(*(c.alias(n) for n, c in measures.items()))
    total = per.agg(*(F.sum(n).alias(f"__{n}") for n in measures))
    joined = per.join(F.broadcast(total))  # one row
    return joined.select(*keys, *measures, *(F.round(F.when(F.col(f"__{n}") != 0, F.col(n) / F.col(f"__{n}")), digits).alias(f"{n}_share") for n in measures))


def percentile_rank(df: DataFrame, col: str, value: float, digits: int = 4) -> DataFrame:
    """The share of rows below a value, in per cent."""
    return df.where(F.col(col).isNotNull()).agg(F.round(100.0 * count_if(F.col(col) < value) / F.count("*"), digits).alias("percentile"), F.count("*").alias("n"))


def sums(keys: list[str], df: DataFrame, *cols: str) -> DataFrame:
    """Additive statistics: n, sums and sums of squares, never means."""
    aggs = [F.count("*").alias("n")]
    for c in cols:
        aggs += [F.count(c).alias(f"{c}_n"), F.sum(c).alias(f"{c}_sum"), F.sum(F.col(c) * F.col(c)).alias(f"{c}_sumsq")]
    return df.groupBy(*keys).agg(*aggs)


def combine(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Adds up partial statistics under coarser keys."""
    fields = [c for c in parts.columns if c == "n" or c.endswith(("_n", "_sum", "_sumsq"))]
    return parts.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in fields))


def subtract(total: DataFrame, part: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics without a part; what is left without rows goes."""
    fields = [c for c in total.columns if c not in keys]
    p = part.select(*keys, *(F.col(c).alias(f"__{c}") for c in fields))
    out = total.join(p, keys, "left").select(*keys, *((F.col(c) - F.coalesce(F.col(f"__{c}"), F.lit(0))).alias(c) for c in fields))
    return out.where(F.col("n") > 0)


def mean_sd(col: str) -> list[Column]:
    """Mean and sample deviation from additive statistics."""
    n, s, q = F.col(f"{col}_n"), F.col(f"{col}_sum"), F.col(f"{col}_sumsq")
    return [F.when(n > 0, s / n).alias(f"{col}_mean"), F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (q - s * s / n) / (n - 1)))).alias(f"{col}_sd")]


def robust_sd(df: DataFrame, col: str, keys: list[str] | None = None) -> DataFrame:
    """1.4826 times the median distance from the median."""
    keys = keys or []
    if not keys:
        far = df.join(F.broadcast(interpolated(df, col, {"__m": 0.5}))).select(F.abs(F.col(col) - F.col("__m")).alias("__d"))  # one row
        sd = interpolated(far, "__d", {"robust_sd": 0.5}).select((1.4826 * F.col("robust_sd")).alias("robust_sd"))
        return df.agg(F.count(col).alias("n")).join(F.broadcast(sd)).select("robust_sd", "n")  # one row
    med = df.groupBy(*keys).agg(F.percentile(col, F.lit(0.5)).alias("__m"))
    near = df.join(med, keys)
    return near.groupBy(*keys).agg((1.4826 * F.percentile(F.abs(F.col(col) - F.col("__m")), F.lit(0.5))).alias("robust_sd"), F.count(col).alias("n"))


def spread(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Greatest less least value of each key with two or more, at the middle and nine tenths of the
    sorted list, the largest, and the share up to 1 (F23)."""
    per = df.groupBy(*keys).agg((F.max(col) - F.min(col)).alias("s"), F.count(col).alias("n")).where("n > 1")
    at = lambda p: F.greatest(F.ceil(F.lit(p) * F.col("n")) - 1, F.lit(0))
    one = per.agg(F.count("*").alias("n_keys"), F.max("s").alias("largest"), (count_if(F.col("s") <= 1.0) / F.count("*")).alias("share_to_1"))
    ranked = order_statistics(per, "s", {"median": at(0.5), "p90": at(0.9)})
    return one.join(F.broadcast(ranked)).select("n_keys", "median", "p90", "largest", "share_to_1")  # one row


def fill_if_unambiguous(df: DataFrame, name: str, value: str) -> DataFrame:
    """Fills a null value where the name has exactly one in all rows."""
    only = df.where(F.col(value).isNotNull() & F.col(name).isNotNull()).groupBy(name).agg(F.count_distinct(value).alias("__k"), F.min(value).alias("__v")).where("__k = 1")
    return df.join(only.select(name, "__v"), name, "left").withColumn("filled", F.coalesce(value, "__v")).drop("__v")


def allowed(df: DataFrame, key: str, at: Column, tie: str, limit: int, seconds: float) -> DataFrame:
    """Marks requests that have fewer than ``limit`` allowed ones of their key in the window before them.

    A refused request counts for nothing, so each answer depends on the ones before it: a key's requests
    are read in order, and at most ``limit`` times are held."""
    import pyarrow as pa
    from pyspark.sql import types as T

    names = [*df.columns, "allowed"]
    n = names.index(key)

    def run(batches):
        group, held = object(), deque()
        for batch in batches:
            out = []
            for k, t in zip(batch.column(n).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if k != group:
                    group, held = k, deque()
                while held and held[0] < t - seconds:
                    held.popleft()
                out.append(len(held) < limit)
                if out[-1]:
                    held.append(t)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.bool_())], names=names)

    rows = df.withColumn("__at", at.cast("double")).where(F.col("__at").isNotNull()).repartition(F.col(key)).sortWithinPartitions(key, "__at", tie)
    return rows.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("allowed", T.BooleanType())]))


def order_statistics(df: DataFrame, col: str, at: dict[str, Column], levels: int = 2, bins: int = 1 << 16) -> DataFrame:
    """One row: for each name the value of that rank (from 0, an expression of ``n``, the number of values).

    Every level counts equal bins of what the last one left, so no task ever holds all different
    values; the last step sorts the values of one bin."""
    rows = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("__v"))
    every = rows.agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    wanted = F.inline(F.array(*(F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in at.items())))
    state = every.where("n > 0").select(wanted, F.col("lo").alias("l0"), ((F.col("hi") - F.col("lo")) / bins).alias("w0"))

    def bin_of(k: int) -> Column:
        step = (F.col("__v") - F.col(f"l{k}")) / F.col(f"w{k}")
        return F.when(F.col(f"w{k}") > 0, F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(step)))).otherwise(0).cast("long")

    def reached(counts: DataFrame, by: str) -> DataFrame:
        """Of each name the row in which its rank lies, with the rank inside it."""
        upto = F.sum("c").over(Window.partitionBy("name").orderBy(by))
        inside = counts.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("c"))
        return inside.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("upto"))).withColumn("rank", F.col("rank") - F.col("before")).drop("c", "upto", "before")

    met = rows.join(F.broadcast(state))  # a row a name
    for k in range(levels):
        kept = [c for c in met.columns if c != "__v"]
        state = reached(met.groupBy(*kept, bin_of(k).alias(f"b{k}")).agg(F.count("*").alias("c")), f"b{k}")
        state = state.withColumn(f"l{k + 1}", F.col(f"l{k}") + F.col(f"b{k}") * F.col(f"w{k}")).withColumn(f"w{k + 1}", F.col(f"w{k}") / bins)
        met = rows.join(F.broadcast(state))
        for j in range(k + 1):
            met = met.where(bin_of(j) == F.col(f"b{j}"))
    found = reached(met.groupBy("name", "rank", "__v").agg(F.count("*").alias("c")), "__v")
    return found.agg(*(F.max(F.when(F.col("name") == name, F.col("__v"))).alias(name) for name in at))


def interpolated(df: DataFrame, col: str, at: dict[str, float]) -> DataFrame:
    """One row of exact quantiles, each interpolated between two neighbours, without gathering the values."""
    place = lambda p: F.lit(p) * (F.col("n") - 1)
    ranks = {f"{name}_{side}": f(place(p)) for name, p in at.items() for side, f in (("lo", F.floor), ("hi", F.ceil))}
    found, n = order_statistics(df, col, ranks), df.agg(F.count(col).alias("n"))
    part = lambda name, p: F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * (place(p) - F.floor(place(p)))
    return found.join(F.broadcast(n)).select(*(part(name, p).alias(name) for name, p in at.items()))  # one row


def running_cycle(df: DataFrame, keys: list[str], order: str, starts: Column) -> DataFrame:
    """Numbers the stretches that begin where ``starts`` holds."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cycle", F.sum(starts.cast("int")).over(w))
