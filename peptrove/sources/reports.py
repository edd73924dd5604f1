"""Search-engine reports to one shape.

Every reader resolves the report's headers against candidate names on the
driver, which reads the schema only, and then selects lazily, so pruned columns
and filters reach the Parquet scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean
from ..functions.chem import modifications, precursor_mz, proforma, stripped
from ..functions.genes import clean_symbol
from ..functions.text import first_token, stem
from ..operators.arrays import each

# Candidate headers of precursor reports, in order of preference.
PRECURSOR_HEADERS = {
    "run": ["Run", "File.Name"], "modified": ["Modified.Sequence"], "seq": ["Stripped.Sequence"], "charge": ["Precursor.Charge"], "mz": ["Precursor.Mz"], "rt": ["RT"], "im": ["IM"],
    "irt": ["iRT", "RT.Predicted"], "iim": ["iIM"], "q": ["Q.Value"], "global_q": ["Global.Q.Value"], "pg_q": ["PG.Q.Value"], "intensity": ["Precursor.Quantity"],
    "normalized": ["Precursor.Normalised"], "grp": ["Protein.Group", "Protein.Ids"], "gene": ["Genes"],
}
# Patterns of headers of fragment-level reports, in order of preference; underscores count as dots.
FRAGMENT_PATTERNS = {
    "run": [r"^R\.FileName$", r"^R\.Raw ?File ?Name$", r"^R\.Replicate$", r"^R\."],
    "grp": [r"^PG\.ProteinGroups$", r"^PG\.ProteinAccessions$", r"ProteinGroups?$", r"^Group$"],
    "gene": [r"^PG\.Genes$", r"Genes?$"],
    "organism": [r"^PEP\.AllOccurringOrganisms$", r"AllOccurringOrganisms$", r"^PG\.Organisms$", r"Organisms?$"],
    "pg_q": [r"^PG\.Qvalue$", r"PG.*Qvalue"],
    "seq": [r"^PEP\.StrippedSequence$", r"StrippedSequence$"],
    "modified": [r"^EG\.ModifiedSequence$", r"^EG\.ModifiedPeptide$", r"ModifiedSequence$", r"^EG\.PrecursorId$", r"^FG\.LabeledSequence$"],
    "charge": [r"^FG\.Charge$", r"Charge$"],
    "q": [r"^EG\.Qvalue$", r"EG.*Qvalue"],
    "decoy": [r"^EG\.IsDecoy$", r"IsDecoy$"],
    "mz": [r"^FG\.PrecMz$", r"^EG\.PrecursorMz$", r"PrecMz$", r"PrecursorMz$"],
    "rt": [r"^EG\.ApexRT$", r"^EG\.MeanApexRT$", r"^EG\.RTEmpirical$", r"ApexRT$"],
    "irt": [r"^EG\.iRT$", r"^EG\.IRTEmpirical$", r"^EG\.RTPredicted$", r"\biRT\b"],
    "im": [r"^EG\.IonMobility$", r"^EG\.ApexIonMobility$", r"^FG\.ApexIonMobility$", r"IonMobility$"],
    "ccs": [r"^EG\.CCS$", r"\bCCS\b"],
    "intensity": [r"^FG\.Quantity$", r"^FG\.MS2Quantity$", r"^EG\.TotalQuantity.*$", r"^FG\.MS2RawQuantity$", r"Quantity$"],
    "normalized": [r"^FG\.Normalized.*(MS2|PeakArea|Quantity)", r"^EG\.Normalized.*(Quantity|Intensity)"],
    "pep": [r"^EG\.PEP$", r"PosteriorErrorProbability"],
    "instrument": [r"^R\.Instrument", r"Instrument"],
    "collision_energy": [r"CollisionEnergy", r"\bNCE\b", r"^FG\.CollisionEnergy"],
    "frg_mz": [r"^F\.FrgMz$", r"FrgMz$"],
    "frg_type": [r"^F\.FrgType$", r"FrgType$"],
    "frg_num": [r"^F\.FrgNum$", r"FrgNum$"],
    "frg_z": [r"^F\.FrgZ$", r"^F\.FrgCharge$", r"^F\.Charge$", r"FrgZ$"],
    "frg_loss": [r"^F\.FrgLossType$", r"FrgLossType$"],
    "frg_area": [r"^F\.PeakArea$", r"^F\.NormalizedPeakArea$", r"^F\.MeasuredRelativeIntensity$", r"PeakArea$"],
    "frg_ion": [r"^F\.FrgIon$", r"FrgIon$"],
    "frg_measured": [r"^F\.MeasuredRelativeIntensity$", r"MeasuredRelativeIntensity$"],
    "frg_predicted": [r"^F\.PredictedRelativeIntensity$", r"PredictedRelativeIntensity$"],
    "frg_excluded": [r"^F\.ExcludedFromQuantification$"],
}
FRAGMENT_FIELDS = ["frg_mz", "frg_type", "frg_num", "frg_z", "frg_loss", "frg_area", "frg_ion", "frg_measured", "frg_predicted", "frg_excluded"]
DESIGN_HEADERS = {"run": "R_FileName", "condition": "R_Condition", "replicate": "R_Replicate", "fraction": "R_Fraction", "label": "R_Label"}
JUNK_GENES = ["", "nan", "none", "null"]


def resolve(columns: list[str], candidates: list[str], pattern: bool = False) -> str | None:
    """The first candidate that a header matches, as it is or with dots for underscores (A4)."""
    for c in candidates:
        for name in columns:
            for shape in (name, name.replace("_", ".")):
                if re.search(c, shape, re.I) if pattern else shape == c:
                    return name
    return None


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, or tab-separated text."""
    if path.lower().endswith((".tsv", ".txt", ".csv")):
        return spark.read.csv(path, sep="," if path.lower().endswith(".csv") else "\t", header=True)
    return spark.read.parquet(path)


def normalised(df: DataFrame, headers: dict[str, list[str]], pattern: bool) -> DataFrame:
    """The known columns under one set of names; null where a report has none."""
    cols = []
    for name, candidates in headers.items():
        found = resolve(df.columns, candidates, pattern)
        cols.append((F.col(f"`{found}`") if found else F.lit(None).cast("string")).alias(name))
    return df.select(*cols)


NUMBERS = ["mz", "rt", "im", "irt", "iim", "q", "global_q", "pg_q", "intensity", "normalized", "pep", "ccs", "collision_energy", "frg_mz", "frg_area", "frg_measured", "frg_predicted"]


def typed(df: DataFrame) -> DataFrame:
    """Numbers from text, out-of-range and invalid values to null."""
    for c in NUMBERS:
        if c in df.columns:
            df = df.withColumn(c, clean.float4(clean.numeric(F.col(c).cast("string"))))
    if "im" in df.columns:
        df = df.withColumn("im", clean.mobility(F.col("im")))
    if "irt" in df.columns:
        df = df.withColumn("irt", clean.indexed_time(F.col("irt")))
    return df.withColumn("charge", F.col("charge").cast("string").try_cast("double").cast("int"))


def precursors(df: DataFrame, most_q: float = 0.01) -> DataFrame:
    """A precursor report's rows (A2): q-gated (null q goes), run names without path, m/z computed where absent."""
    rows = typed(normalised(df, PRECURSOR_HEADERS, False)).withColumn("run", stem(F.col("run")))
    rows = rows.where(clean.passes_q(F.col("q"), most_q))
    return first_seen(identified(rows))


def fragment_precursors(df: DataFrame, most_q: float = 0.01) -> DataFrame:
    """A fragment-level report's precursors (A3): decoys go first, then the q gate, which keeps a null q."""
    rows = normalised(df, FRAGMENT_PATTERNS, True).where(~clean.truthy(F.col("decoy")))
    rows = typed(rows.drop(*FRAGMENT_FIELDS)).withColumn("run", stem(F.col("run")))
    rows = rows.where(clean.passes_q(F.col("q"), most_q, keep_null=True)).withColumn("modified", F.regexp_replace("modified", "^_|_$", ""))
    return first_seen(identified(rows.drop("decoy")))


def identified(rows: DataFrame) -> DataFrame:
    return rows.withColumn("seq", F.coalesce("seq", stripped(F.col("modified")))).withColumn("mz", F.coalesce("mz", precursor_mz(F.col("modified"), F.col("charge")))).withColumn("n_mods", F.coalesce(F.size(modifications(F.col("modified"))), F.lit(0))).withColumn("proforma", proforma(F.col("modified")))


def first_seen(rows: DataFrame) -> DataFrame:
    """One row a (run, modified sequence, charge): the lowest q, then the strongest (G3, made deterministic)."""
    from ..operators.dedup import first_by

    rest = [F.col(c) for c in rows.columns if c not in ("run", "modified", "charge", "q", "intensity")]
    return first_by(rows, ["run", "modified", "charge"], F.col("q").asc_nulls_last(), F.col("intensity").desc_nulls_last(), *rest)


def spectra(df: DataFrame, most_q: float = 0.01) -> DataFrame:
    """A fragment-level report folded to one row a precursor with parallel fragment arrays.

    The arrays are of one length and in the order of m/z; a row with null q goes; a repeated
    fragment row counts once; losses stay part of the fragment's identity.
    """
    rows = normalised(df, FRAGMENT_PATTERNS, True).where(~clean.truthy(F.col("decoy"))).withColumn("run", stem(F.col("run")))
    rows = typed(rows).where(clean.passes_q(F.col("q"), most_q)).withColumn("frg_excluded", clean.flag(F.col("frg_excluded")))
    rows = rows.withColumn("frg_num", F.col("frg_num").try_cast("int")).withColumn("frg_z", F.col("frg_z").try_cast("int"))
    fields = [c for c in FRAGMENT_FIELDS if c in rows.columns]
    folded = rows.groupBy("run", "modified", "charge").agg(F.array_sort(F.collect_set(F.struct(*fields))).alias("f"), F.min("q").alias("q"), F.max("intensity").alias("intensity"), F.min("seq").alias("seq"))
    return folded.select("run", "modified", "charge", "q", "intensity", "seq", *(each("f", c).alias(c) for c in fields))


def proteins(rows: DataFrame) -> DataFrame:
    """Roll-up to (run, protein group) (F19): distinct peptides, precursors, summed intensities (null
    where none was given), least q, the least real gene, contaminant flag (C16)."""
    gene = F.when(~F.lower(F.trim("gene")).isin(JUNK_GENES), F.trim("gene"))
    out = rows.groupBy("run", "grp").agg(
        F.count_distinct("seq").alias("n_peptides"), F.count("*").alias("n_precursors"), F.sum("intensity").alias("intensity"), F.sum("normalized").alias("normalized"), F.min("pg_q").alias("pg_q"), F.min(gene).alias("gene"),
    ) if "pg_q" in rows.columns and "normalized" in rows.columns else rows.groupBy("run", "grp").agg(F.count_distinct("seq").alias("n_peptides"), F.count("*").alias("n_precursors"), F.sum("intensity").alias("intensity"), F.min(gene).alias("gene"))
    if "normalized" in out.columns:
        out = out.withColumn("normalized", F.when(F.col("normalized") != 0, F.col("normalized")))
    return out.withColumn("is_contaminant", F.coalesce(F.concat_ws(" ", "grp", "gene").rlike("(?i)krt|keratin|cont_|contaminant"), F.lit(False)))


def group_counts(rows: DataFrame) -> DataFrame:
    """Protein groups, and accessions in them."""
    acc = rows.select("grp", F.explode(F.split("grp", ";")).alias("a"))
    return acc.agg(F.count_distinct("grp").alias("n_groups"), F.count_distinct(F.trim("a")).alias("n_accessions"))


def run_summary(rows: DataFrame) -> DataFrame:
    """Latest retention time, rows and gradient of each run (F21, SF21)."""
    out = rows.groupBy("run").agg(F.max("rt").alias("longest_rt"), F.count("*").alias("n_precursors"), F.count("im").alias("n_im"))
    return out.withColumn("gradient", clean.gradient_minutes(clean.samples_per_day(F.col("run")), F.col("longest_rt"))).withColumn("has_mobility", F.col("n_im") > 0)


def run_design(df: DataFrame) -> DataFrame:
    """Distinct design rows of a report."""
    cols = [(F.col(f"`{f}`") if (f := resolve(df.columns, [h])) else F.lit(None).cast("string")).alias(n) for n, h in DESIGN_HEADERS.items()]
    return df.select(*cols).distinct()


def key_values(df: DataFrame, run: str, key: str, value: str) -> DataFrame:
    """Two-column parameter lists to one map a run (A14); of repeated keys the least value."""
    once = df.groupBy(run, key).agg(F.min(value).alias(value))
    return once.groupBy(run).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("fields"))


def library(df: DataFrame, keys: list[str], required: list[str], optional: list[str]) -> DataFrame:
    """Spectral-library rows to one list of fragments a precursor (A10)."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"library lacks {', '.join(missing)}")
    cols = [*required, *(c for c in optional if c in df.columns)]
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("fragments"))


def chromatograms(df: DataFrame, key: str = "pr", most: int = 40) -> DataFrame:
    """Long (key, feature, rt, value) rows to traces sorted by time, ``most`` points each."""
    rows = df.groupBy(key, "feature").agg(F.slice(F.array_sort(F.collect_list(F.struct("rt", "value"))), 1, most).alias("p"))
    return rows.select(key, "feature", F.transform("p", lambda x: x["rt"]).alias("trace_rt"), F.transform("p", lambda x: x["value"]).alias("trace_intensity"))


LABEL = r"^([abcxyz])(\d+)\^(\d+)$"


def reference_traces(df: DataFrame, key: str = "pr", least: int = 8) -> DataFrame:
    """Traces worth comparing with (A11): labelled ions and MS1 of ``least`` points or more."""
    kept = chromatograms(df.where((F.col("feature") == "ms1") | F.col("feature").rlike(LABEL)), key, 1 << 20)
    return kept.where(F.size("trace_rt") >= least)


def peak_cycles(peaks: DataFrame, key: str = "run") -> DataFrame:
    """Peaks (run, scan, level, rt, mz, intensity) with their cycle, which an MS1 scan begins, and times in
    seconds where a run's look like minutes (A12). The running sum goes over scans, not peaks."""
    from ..operators.aggregates import running_cycle

    scans = peaks.groupBy(key, "scan").agg(F.min("level").alias("level"), F.min("rt").alias("rt"))
    cycles = running_cycle(scans, [key], "scan", F.col("level") == 1).select(key, "scan", "cycle")
    unit = scans.groupBy(key).agg(F.when(F.max("rt") < 200, 60.0).otherwise(1.0).alias("unit"))
    return peaks.join(cycles, [key, "scan"]).join(unit, key).withColumn("rt", F.col("rt") * F.col("unit")).drop("unit")


def decode_floats(col: Column) -> Column:
    """Comma-joined base64 pieces of little-endian 4-byte floats to an array (A8), in the JVM."""
    raw = F.aggregate(F.transform(F.split(col, ","), lambda p: F.hex(F.unbase64(p))), F.lit(""), lambda a, b: F.concat(a, b))
    n = (F.length(raw) / 8).cast("int")

    def at(i: Column) -> Column:
        byte = lambda k: F.substr(raw, i * 8 + 1 + 2 * k, F.lit(2))
        bits = F.conv(F.concat(byte(3), byte(2), byte(1), byte(0)), 16, 10).cast("long")
        exponent, mantissa = F.shiftright(bits, 23) % 256, bits % 8388608
        value = F.when(exponent == 0, mantissa / 8388608.0 * F.pow(F.lit(2.0), F.lit(-126.0))).otherwise((1 + mantissa / 8388608.0) * F.pow(F.lit(2.0), exponent - 127.0))
        return F.when(exponent == 255, None).when(bits >= 2147483648, -value).otherwise(value)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<double>"))


def gene_reference(df: DataFrame) -> DataFrame:
    """Symbols, aliases and previous symbols to one approved symbol each: an approved one wins over
    the other kinds, then the least (M11). df: symbol, aliases, previous (joined by |)."""
    from ..operators.dedup import first_by

    kind = lambda c, k, n: df.select(F.col("symbol").alias("approved_symbol"), F.explode(F.split(c, r"\|")).alias("key"), F.lit(k).alias("kind"), F.lit(n).alias("o"))
    rows = df.select(F.col("symbol").alias("approved_symbol"), F.col("symbol").alias("key"), F.lit("approved").alias("kind"), F.lit(0).alias("o")).unionByName(kind("previous", "previous", 1)).unionByName(kind("aliases", "alias", 2))
    rows = rows.withColumn("symbol_upper", F.upper(F.trim("key"))).where(F.col("symbol_upper") != "")
    return first_by(rows, ["symbol_upper"], "o", "approved_symbol").select("symbol_upper", "approved_symbol", F.col("kind").alias("symbol_kind"))


def marker_panel(df: DataFrame, tissues: list[str], gene: str = "gene") -> DataFrame:
    """A wide table of z-scores to rows (positive ones) with each gene's best tissue and runner-up."""
    from ..operators.dedup import margin

    stacked = df.select(F.upper(gene).alias("gene"), F.inline(F.array(*(F.struct(F.lit(t).alias("tissue"), F.col(f"`{t}`").cast("double").alias("z")) for t in tissues))))
    best = margin(stacked.where("z > 0"), ["gene"], "tissue", "z")
    return best.withColumn("runner_up_z", F.col("z") - F.col("margin"))


def symbols(rows: DataFrame) -> DataFrame:
    return rows.select(clean_symbol(F.col("gene")).alias("symbol"), first_token(F.col("grp")).alias("accession"))
