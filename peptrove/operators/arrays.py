"""Parallel arrays, traces and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def each(array: Column | str, name: str) -> Column:
    """One field of every element of an array of structs."""
    return F.transform(array, lambda x: x[name])


def fold(df: DataFrame, keys: list[str], ordinal: str, *cols: str) -> DataFrame:
    """Rows to parallel arrays, all in the order of the ordinal."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(ordinal, *cols))).alias("__r"))
    return rows.select(*keys, *(each("__r", c).alias(c) for c in (ordinal, *cols)))


def unfold(df: DataFrame, *cols: str, ordinal: str = "pos") -> DataFrame:
    """Parallel arrays to rows (J13); shorter arrays give nulls."""
    rest = [c for c in df.columns if c not in cols]
    return df.select(*rest, F.posexplode(F.arrays_zip(*cols)).alias(ordinal, "__z")).select(*rest, ordinal, *(F.col(f"__z.{c}") for c in cols))


def numbers_of(col: Column, sep: str = ";") -> Column:
    """A string of numbers to an array, null for what isn't one."""
    return F.transform(F.split(col, sep), lambda x: F.nanvl(x.try_cast("double"), F.lit(None)))


def from_json_rows(df: DataFrame, col: str, schema: str) -> DataFrame:
    """A JSON list to rows beside the other columns."""
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, F.inline(F.from_json(F.col(col), f"array<struct<{schema}>>")))


def strongest(points: Column, k: int, by: str = "intensity") -> Column:
    """The k elements of an array of structs with the greatest measure, ties in their order."""
    ranked = F.array_sort(F.transform(points, lambda p, i: F.struct((-p[by]).alias("less"), i.alias("i"), p.alias("p"))))
    return F.slice(F.transform(ranked, lambda r: r["p"]), 1, k)


def apex(rt: Column, intensity: Column) -> Column:
    """Retention time of the first greatest intensity (J5); null for empty traces."""
    best = F.array_max(F.transform(F.arrays_zip(intensity.alias("i"), rt.alias("r")), lambda p, k: F.struct(p["i"].alias("i"), (-k).alias("k"), p["r"].alias("r"))))
    return best["r"]


def interpolate(x: Column, y: Column, at: Column) -> Column:
    """Linear interpolation of a sorted trace at one place; 0 outside."""
    n = F.size(x)
    k = F.size(F.filter(x, lambda v: v <= at))
    x0, y0, x1, y1 = F.get(x, k - 1), F.get(y, k - 1), F.get(x, k), F.get(y, k)
    inside = F.when(x0 == at, y0).otherwise(y0 + (y1 - y0) * (at - x0) / (x1 - x0))
    return F.when((n == 0) | (at < F.get(x, F.lit(0))) | (at > F.get(x, n - 1)), F.lit(0.0)).otherwise(inside)


def grid(half: float = 0.5, points: int = 41) -> Column:
    return F.array(*(F.lit(round(-half + 2 * half * i / (points - 1), 6)) for i in range(points)))


def on_grid(rt: Column, intensity: Column, half: float = 0.5, points: int = 41) -> Column:
    """A trace on a grid around its own apex (J6), without leaving the JVM."""
    centre = apex(rt, intensity)
    return F.transform(grid(half, points), lambda g: interpolate(rt, intensity, centre + g))


def grid_average(df: DataFrame, keys: list[str], rt: str, intensity: str, half: float = 0.5, points: int = 41) -> DataFrame:
    """Mean over runs of the apex-aligned traces of each key (J6, J7): an aggregate a grid point,
    so partial sums are combined before the shuffle. Empty traces don't count."""
    shaped = df.where(F.size(rt) > 0).select(*keys, F.posexplode(on_grid(F.col(rt), F.col(intensity), half, points)).alias("__k", "__v"))
    per = shaped.groupBy(*keys, "__k").agg(F.count("*").alias("n_runs"), F.avg("__v").alias("intensity"))
    folded = per.groupBy(*keys).agg(F.max("n_runs").alias("n_runs"), F.array_sort(F.collect_list(F.struct("__k", "intensity"))).alias("__g"))
    return folded.select(*keys, "n_runs", grid(half, points).alias("rt"), each("__g", "intensity").alias("intensity"))


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays of one length; null if either is constant (SF25)."""
    z = F.arrays_zip(a.alias("a"), b.alias("b"))
    add = lambda f: F.aggregate(F.transform(z, f), F.lit(0.0), lambda s, v: s + v)
    n = F.greatest(F.size(z), F.lit(1))
    sa, sb = add(lambda p: p["a"]), add(lambda p: p["b"])
    cov, va, vb = add(lambda p: p["a"] * p["b"]) - sa * sb / n, add(lambda p: p["a"] * p["a"]) - sa * sa / n, add(lambda p: p["b"] * p["b"]) - sb * sb / n
    return F.when((va > 1e-12) & (vb > 1e-12), cov / F.sqrt(va * vb))


def area(rt: Column, intensity: Column) -> Column:
    """Trapezoid area of a sorted trace."""
    n = F.size(rt)
    parts = F.transform(F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: (F.get(rt, i) - F.get(rt, i - 1)) * (F.get(intensity, i) + F.get(intensity, i - 1)) / 2)
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)


def compare_traces(df: DataFrame, keys: list[str], rt: str, own: str, ref_rt: str, ref: str) -> DataFrame:
    """Own trace against a reference's: correlation on the reference's points inside the own
    window, apex distance in seconds, area ratio there (J10)."""
    lo, hi = F.get(F.col(rt), F.lit(0)), F.get(F.col(rt), F.size(rt) - 1)
    kept = F.filter(F.arrays_zip(F.col(ref_rt).alias("r"), F.col(ref).alias("i")), lambda p: p["r"].between(lo, hi))
    shaped = df.withColumn("__r", F.transform(kept, lambda p: p["r"])).withColumn("__i", F.transform(kept, lambda p: p["i"]))
    shaped = shaped.withColumn("__o", F.transform("__r", lambda t: interpolate(F.col(rt), F.col(own), t)))
    return shaped.select(
        *keys, F.size("__r").alias("n_points"), pearson(F.col("__o"), F.col("__i")).alias("r"),
        (F.abs(apex(F.col(rt), F.col(own)) - apex(F.col(ref_rt), F.col(ref))) * 60).alias("apex_delta_s"),
        F.when(area(F.col("__r"), F.col("__i")) > 0, area(F.col("__r"), F.col("__o")) / area(F.col("__r"), F.col("__i"))).alias("area_ratio"),
    )


def resample(values: Column, points: int) -> Column:
    """A list on evenly spaced places, ends kept."""
    n = F.size(values)

    def at(i: Column) -> Column:
        x = i * (n - 1) / (points - 1)
        lo = F.floor(x).cast("int")
        return F.get(values, lo) * (1 - (x - lo)) + F.coalesce(F.get(values, lo + 1), F.lit(0.0)) * (x - lo)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)).otherwise(F.array_repeat(F.lit(0.0), points))


def extract_traces(peaks: DataFrame, targets: DataFrame, ppm: float = 15.0, window: float = 0.5, im_tol: float = 0.03, points: int = 32) -> DataFrame:
    """Chromatograms of target ions from peaks (J8): for each target and channel the intensity
    summed a cycle inside the m/z, time, isolation and mobility gates, on ``points`` places.

    peaks: cycle, rt, mz, im (null: not gated), iso_low, iso_high (null: not gated), intensity;
    targets: target, channel, target_mz, precursor_mz, target_rt, target_im (null: not gated).
    Every cycle of a target's time window counts, with 0 where nothing is found.
    """
    from .joins import binned_range_join, ppm_range_join, with_bins

    # the cycles of a time, not of each target that has it
    cycles, times = peaks.select("cycle", "rt").distinct(), targets.select("target_rt").distinct()
    inside = binned_range_join(times, cycles, "target_rt", "rt", window).groupBy("target_rt").agg(F.collect_list(F.struct("cycle", "rt")).alias("__w"))
    frame = targets.select("target", "channel", "target_rt").distinct().join(inside, "target_rt")
    frame = frame.groupBy("target", "channel").agg(F.array_sort(F.flatten(F.collect_list("__w"))).alias("__w"))
    # a target meets the peaks near its m/z and its time only
    near, timed = with_bins(targets, peaks, "target_rt", "rt", window, "__time")
    hits = ppm_range_join(near, timed, "target_mz", "mz", ppm, ["__time"]).where(
        (F.abs(F.col("rt") - F.col("target_rt")) <= window)
        & F.coalesce(F.col("precursor_mz").between(F.col("iso_low"), F.col("iso_high")), F.lit(True))
        & F.coalesce(F.abs(F.col("im") - F.col("target_im")) <= im_tol, F.lit(True))
    )
    found = hits.where("cycle is not null").groupBy("target", "channel", "cycle").agg(F.sum("intensity").alias("intensity"))
    found = found.groupBy("target", "channel").agg(F.map_from_entries(F.collect_list(F.struct("cycle", "intensity"))).alias("__m"))
    values = F.transform("__w", lambda w: F.coalesce(F.try_element_at("__m", w["cycle"]), F.lit(0.0)))
    full = frame.join(found, ["target", "channel"], "left").select("target", "channel", values.alias("intensity"))
    return full.select("target", "channel", F.size("intensity").alias("n_cycles"), resample(F.col("intensity"), points).alias("trace"))


def normalise(df: DataFrame, by: list[str], trace: str = "trace") -> DataFrame:
    """Traces divided by the greatest value of their block (J8's three ways: no key, target, channel)."""
    top = df.groupBy(*by).agg(F.max(F.array_max(trace)).alias("__top"))
    return df.join(top, by).withColumn(trace, F.transform(trace, lambda v: F.when(F.col("__top") > 0, v / F.col("__top")).otherwise(0.0))).drop("__top")


def relative(values: Column, digits: int = 6) -> Column:
    """Values as shares of the greatest."""
    top = F.array_max(values)
    return F.transform(values, lambda v: F.when(top > 0, F.round(v / top, digits)).otherwise(0.0))


def positions(seq: Column, part: Column) -> Column:
    """All starts from 1, overlapping ones too, where a string stands in another."""
    n, m = F.length(seq), F.length(part)
    every = F.when((m > 0) & (n >= m), F.sequence(F.lit(1), n - m + 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda i: F.substr(seq, i, m) == part)


def coverage(df: DataFrame, keys: list[str], seq: str, peptide: str, same_il: bool = True) -> DataFrame:
    """Positions of a sequence that any of its peptides cover, and their share in per cent.

    Each peptide gives its own intervals; intervals are merged by a running maximum, so no
    position is ever a row.
    """
    from pyspark.sql import Window

    shape = (lambda c: F.translate(F.upper(c), "I", "L")) if same_il else F.upper
    spans = df.select(*keys, F.length(seq).alias("__n"), F.length(peptide).alias("__m"), F.explode_outer(positions(shape(F.col(seq)), shape(F.col(peptide)))).alias("__s"))
    spans = spans.withColumn("__e", F.col("__s") + F.col("__m") - 1)
    before = Window.partitionBy(*keys).orderBy("__s", "__e").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("__b", F.coalesce(F.max("__e").over(before), F.lit(0)))
    new = F.greatest(F.lit(0), F.col("__e") - F.greatest(F.col("__b"), F.col("__s") - 1))
    out = spans.groupBy(*keys).agg(F.max("__n").alias("length"), F.coalesce(F.sum(new), F.lit(0)).cast("long").alias("covered"), F.count("__s").alias("n_placed"))
    return out.withColumn("percent", F.when(F.col("length") > 0, F.round(100.0 * F.col("covered") / F.col("length"), 2)))


def word_hits(df: DataFrame, key: str, text: str, words: DataFrame, word: str, least: int, most: int) -> DataFrame:
    """Dictionary words that stand anywhere in a text, once a text (J15): its substrings of the
    dictionary's lengths meet the dictionary in a join."""
    n = F.length(text)

    def of_length(k: Column) -> Column:
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr(F.col(text), i, k))).otherwise(F.array().cast("array<string>"))

    parts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(least), F.lit(most)), of_length)))
    return df.select(key, text, F.explode(parts).alias(word)).join(words, word)


def usage(df: DataFrame, keys: list[str], labels: str, search: str, top: int = 6) -> DataFrame:
    """How many searches used each fragment label of a precursor, the ``top`` ones by count and label."""
    from .dedup import first_n

    used = df.select(*keys, search, F.explode(F.array_distinct(labels)).alias("label"))
    total = df.groupBy(*keys).agg(F.count_distinct(search).alias("n_total"))
    counts = used.groupBy(*keys, "label").agg(F.count_distinct(search).alias("n_searches")).join(total, keys)
    counts = counts.withColumn("percent", F.round(100.0 * F.col("n_searches") / F.col("n_total"), 1))
    return first_n(counts, keys, top, F.desc("n_searches"), F.col("label"))


def ensemble(df: DataFrame, keys: list[str], label: str, rel: str, model: str) -> DataFrame:
    """Spectra of several models averaged a label; a model without it counts as 0."""
    models = df.groupBy(*keys).agg(F.count_distinct(model).alias("n_models"))
    per = df.groupBy(*keys, label).agg(F.sum(rel).alias("__s"), F.count_distinct(model).alias("n_agree")).join(models, keys)
    return per.select(*keys, label, (F.col("__s") / F.col("n_models")).alias(rel), "n_agree", "n_models")
