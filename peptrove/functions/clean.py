"""Predicates and cleaning of measured values (C1-C8, C15-C20, D13, SF20-SF32)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: least and greatest magnitude of a 4-byte float
TINY, HUGE = 1e-37, 3.4e38

# Names that stand for an organism that isn't known.
UNKNOWN_ORGANISMS = ["", "unknown", "unknwon", "none", "nan", "null", "n/a", "na", "?", "-", "undetermined"]


def float4(col: Column) -> Column:
    """NaN and out-of-range values to null, underflow to 0."""
    x = col.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) > HUGE), None).when(F.abs(x) < TINY, 0.0).otherwise(x)


def numeric(col: Column) -> Column:
    """A number from text, null where it isn't one or is NaN."""
    n = col.try_cast("double")
    return F.when(~F.isnan(n), n)


def mobility(col: Column, low: float = 0.3, high: float = 2.5) -> Column:
    """Ion mobility inside its open range, else null (C4)."""
    return F.when((col > low) & (col < high), col)


def indexed_time(col: Column, low: float = -100.0, high: float = 300.0) -> Column:
    """Indexed retention time inside its open range, else null."""
    return F.when((col > low) & (col < high), col)


def passes_q(q: Column, most: float = 0.01, keep_null: bool = False) -> Column:
    """The false-discovery gate (C1); what a null q means differs by report kind."""
    ok = F.coalesce(q <= most, F.lit(False))
    return ok | q.isNull() if keep_null else ok


def truthy(col: Column) -> Column:
    """Text flags as they come in reports."""
    return F.coalesce(F.lower(F.trim(col.cast("string"))).isin("true", "1", "yes", "t", "y"), F.lit(False))


def flag(col: Column) -> Column:
    """'True'/'False' to boolean; anything else stays null."""
    low = F.lower(F.trim(col.cast("string")))
    return F.when(low == "true", True).when(low == "false", False)


def real_organism(col: Column) -> Column:
    """Whether the name is an organism (C3); false for null."""
    low = F.lower(F.trim(col))
    return F.coalesce(~low.isin(*UNKNOWN_ORGANISMS, "standard") & ~F.startswith(low, F.lit("translate_table")), F.lit(False))


def canonical_organism(col: Column) -> Column:
    """The name without a common name in brackets; null for names that mean unknown.
    Brackets that hold a strain or other qualifier stay."""
    s = F.trim(col)
    inner = F.trim(F.regexp_extract(s, r"\s*\(([^)]*)\)\s*$", 1))
    common = (inner != "") & (F.length(inner) <= 24) & ~inner.rlike(r"(?i)\d|/|\b(strain|isolate|subsp|serovar|var|pv|atcc|str)\b")
    short = F.when(common, F.trim(F.regexp_replace(s, r"\s*\(([^)]*)\)\s*$", ""))).otherwise(s)
    return F.when(F.lower(s).isin(*UNKNOWN_ORGANISMS) | F.lower(short).isin(*UNKNOWN_ORGANISMS), None).otherwise(short)


def species_label(name: Column) -> Column:
    """The name without strain, serotype or subspecies."""
    return F.trim(F.regexp_replace(name, r"(?i)\s*(\((strain|isolate|serotype|serovar)[^)]*\)|\b(strain|serotype|serovar|subsp\.?)\s.*)$", ""))


def species_key(taxon: Column, name: Column) -> Column:
    """One key a species: the taxon if there is one, else its name."""
    return F.coalesce(taxon.cast("string"), F.concat(F.lit("name:"), name))


def looks_contaminant(group: Column, flagged: Column | None = None) -> Column:
    """The flag, or a contaminant-library prefix (C16); never null."""
    by_name = F.coalesce(group.rlike(r"(?i)^(crap|cont[_-])"), F.lit(False))
    return by_name if flagged is None else F.coalesce(flagged, F.lit(False)) | by_name


def plain_accession(col: Column) -> Column:
    """Without a contaminant-library prefix (SF16)."""
    return F.regexp_replace(col, r"(?i)^(crap|cont)[-_]?", "")


def first_date(col: Column, *formats: str) -> Column:
    """The first format that fits (SF20)."""
    formats = formats or ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "M/d/yyyy h:mm:ss a", "M/d/yyyy H:mm:ss", "yyyy-MM-dd")
    return F.coalesce(*(F.try_to_timestamp(col, F.lit(f)) for f in formats))


# Samples per day of a chromatography method to its gradient in minutes.
GRADIENT_OF_SPD = {30: 44.0, 60: 21.0, 100: 11.5, 200: 5.5, 300: 2.3, 500: 2.2}


def samples_per_day(run: Column) -> Column:
    """From a run's name: 60SPD, or 60-samples-per-day (SF21)."""
    m = F.coalesce(F.nullif(F.regexp_extract(run, r"(?i)(\d+)\s*spd\b", 1), F.lit("")), F.nullif(F.regexp_extract(run, r"(?i)(\d+)[- ]samples[- ]per[- ]day", 1), F.lit("")))
    return m.cast("int")


def gradient_minutes(spd: Column, longest_rt: Column) -> Column:
    """The method's gradient, else the longest retention time seen."""
    known = F.create_map(*(F.lit(x) for kv in GRADIENT_OF_SPD.items() for x in kv))
    return F.coalesce(F.try_element_at(known, spd), F.round(longest_rt, 2))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """A share in per cent, 100 at most; null without a whole."""
    return F.when(whole > 0, F.least(F.lit(100.0), F.round(F.lit(100.0) * part / whole, digits)))


def minus_log10(p: Column, floor: float = 1e-300) -> Column:
    return -F.log10(F.greatest(p, F.lit(floor)))


def acquisition(platform: Column) -> Column:
    """The acquisition label that a platform gives data-independent searches."""
    return F.when(platform == "timstof", "diaPASEF").otherwise("DIA")


def platform(has_mobility: Column, run: Column) -> Column:
    """Of aggregated columns: real mobility, or run folders without raw files."""
    low = F.lower(run)
    folders, raws = F.bool_or(low.endswith(".d")), F.bool_or(low.endswith(".raw") | low.endswith(".mzml"))
    return F.when(F.bool_or(has_mobility) | (folders & ~raws), "timstof").otherwise("orbitrap")


def has_replicates(condition: Column) -> Column:
    """Whether a row's condition names anything; with count() a design of single runs shows (SF17)."""
    return F.nullif(F.trim(condition), F.lit("")).isNotNull()
