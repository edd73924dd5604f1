"""Text functions over columns (SF1-SF17, D3, D12, D16)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_token(col: Column, sep: str = ";") -> Column:
    """The first of several values written in one string, trimmed; null if empty."""
    return F.nullif(F.trim(F.split_part(col, F.lit(sep), F.lit(1))), F.lit(""))


def tokens(col: Column, sep: str = ";") -> Column:
    """All non-empty values of a multi-value string, trimmed."""
    return F.filter(F.transform(F.split(col, sep), F.trim), lambda x: x != "")


def basename(path: Column) -> Column:
    """What follows the last slash of either kind."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    """The base name without its last extension."""
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def anonymous(col: Column, prefix: str, keep_extension: bool = False) -> Column:
    """A stable label for a name that may not be shown: prefix and six digits of its SHA-1."""
    label = F.concat(F.lit(f"{prefix}-"), F.substring(F.sha1(col.cast("binary")), 1, 6))
    if keep_extension:
        label = F.concat(label, F.regexp_extract(col, r"(\.[A-Za-z0-9]+)$", 1))
    return F.when(col.isNotNull(), label)


def strip_trailing_digits(col: Column) -> Column:
    return F.regexp_replace(col, "[0-9]+$", "")


def number_after(col: Column, lead: str, tail: str = "") -> Column:
    """The integer between two pieces of text, or null."""
    return F.nullif(F.regexp_extract(col, f"{lead}([0-9]+){tail}", 1), F.lit("")).cast("int")


def is_palindrome(col: Column, least: int = 4) -> Column:
    return (F.length(col) >= least) & (col == F.reverse(col))


def letters(col: Column) -> Column:
    """The characters of a string as an array; empty for the empty string."""
    return F.when(F.length(col) > 0, F.split(col, "")).otherwise(F.array().cast("array<string>"))


def distinct_letters(col: Column) -> Column:
    return F.size(F.array_distinct(letters(col)))


def has_few_letters(col: Column, most: int = 4, least_length: int = 6) -> Column:
    return (F.length(col) >= least_length) & (distinct_letters(col) <= most)


def common_prefix(names: Column) -> Column:
    """Longest common prefix of an array of strings, without a trailing index or separator:
    that of its least and greatest member."""
    lo, hi = F.array_min(names), F.array_max(names)
    n = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(lo))), F.lit(0), lambda k, i: F.when((k == i - 1) & (F.substr(lo, i, F.lit(1)) == F.substr(hi, i, F.lit(1))) & (i <= F.length(lo)), i).otherwise(k))
    cut = F.regexp_replace(F.substr(lo, F.lit(1), n), "[_\\-. 0-9]+$", "")
    return F.coalesce(F.nullif(cut, F.lit("")), F.element_at(names, 1))


def case_variants(query: str) -> list[str]:
    """Spellings under which an identifier may be stored, in order and once each."""
    return list(dict.fromkeys([query, query.upper(), query.lower(), query.capitalize(), query.title()]))


def escape_like(query: str) -> str:
    """A literal for LIKE patterns."""
    return query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_ignoring_case(col: Column, query: str) -> Column:
    """Substring search that takes the query literally."""
    return col.ilike(f"%{escape_like(query)}%")


#: words of a person query that say nothing
STOPWORDS = frozenset("the and for of lab group core dr prof".split())


def person_tokens(query: str, least: int = 4) -> list[str]:
    words = [w for w in "".join(c if c.isalnum() else " " for c in query.lower()).split()]
    return [w for w in dict.fromkeys(words) if len(w) >= least and w not in STOPWORDS]


def names_person(first: Column, last: Column, query: str) -> Column:
    """Every word of the query stands as a whole word in the name (C11); no words match nobody."""
    full, out = F.lower(F.concat_ws(" ", first, last)), None
    for w in person_tokens(query):
        here = full.rlike(rf"\b{w}\b")
        out = here if out is None else out & here
    return F.lit(False) if out is None else out


def path_provenance(path: Column, home: str = "home institution", core: str = "core facility") -> Column:
    """struct(scope, campus, client, pi, project) from a facility's folder convention (D16):
    .../service/[on_campus|off_campus]/..., or .../lab/<project>."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda x: x != "")
    low = F.transform(parts, F.lower)
    at, lab = F.array_position(low, "service"), F.array_position(low, "lab")
    part = lambda i: F.get(parts, (i - 1).cast("int"))
    campus_word = F.lower(part(at + 1))
    campus = F.when((at > 0) & campus_word.isin("on_campus", "off_campus"), campus_word)
    start = at + F.when(campus.isNotNull(), 2).otherwise(1)
    on, out = campus.eqNullSafe("on_campus"), (at > 0)
    return F.struct(
        F.when(out, "customer").when(lab > 0, "internal").otherwise("unknown").alias("scope"),
        campus.alias("campus"),
        F.when(out & on, home).when(out, part(start)).when(lab > 0, core).alias("client"),
        F.when(out & on, part(start)).when(out, part(start + 1)).alias("pi"),
        F.when(out & on, part(start + 1)).when(out, part(start + 2)).when(lab > 0, part(lab + 1)).alias("project"),
    )


def canonical_institute(name: Column, rules: list[tuple[str, str]], none: str = "(institute not given)") -> Column:
    """One display name for the spellings that a rule (pattern, name) recognises, the first rule
    first; other names stay as they are (SF15)."""
    s = F.trim(F.coalesce(name, F.lit("")))
    n = F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), r"[.,\-/]", " "), r"\s+", " "))
    out = s
    for pattern, display in reversed(rules):
        out = F.when(n.rlike(pattern), display).otherwise(out)
    return F.when(s == "", none).otherwise(out)


# What a description of a construct mentions, the shape of a species name, the letters of a written-out sequence.
CONSTRUCT_WORDS = ["clone", "express", "recombinant", "tagged", " from ", "construct", " host", "cell line", "transfect"]
BINOMIAL = r"^[A-Z][a-z]+ [a-z]+(?:\s*\([^)]*\))?$"
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"


def is_binomial(organism: Column) -> Column:
    """Genus species, with a strain in brackets at most (SF17)."""
    return F.coalesce(F.trim(organism).rlike(BINOMIAL), F.lit(False))


def is_narrative(organism: Column, parts: list[str] = CONSTRUCT_WORDS, most_words: int = 4) -> Column:
    """A sentence about a construct instead of an organism (SF17): too many words, or one of the parts."""
    low = F.lower(organism)
    mentioned = F.exists(F.array(*(F.lit(p) for p in parts)), lambda p: F.contains(low, p))
    return F.coalesce(mentioned | (F.size(F.split(F.trim(organism), r"\s+")) > most_words), F.lit(False))


def without_timestamp(name: Column) -> Column:
    """A name without the date and time that an export puts before it, so that repeated exports share one name (SF12)."""
    return F.regexp_replace(name, r"^\d{8}_\d{6}_", "")


def report_name(path: Column) -> Column:
    """What an exported report is called: its file name without the report suffix, or its folder's name if nothing is left (SF12)."""
    name = F.regexp_replace(basename(path), r"(?i)_Report(_FRAN \(Normal\))?\.(parquet|tsv)$", "")
    return F.when(name != "", name).otherwise(F.regexp_extract(path, r"([^/\\]*)[/\\][^/\\]*$", 1))


def inline_sequences(description: Column, least: int = 25) -> Column:
    """Protein sequences written out in a text (SF17)."""
    return F.regexp_extract_all(F.replace(description, F.lit("\n"), F.lit(" ")), F.lit(f"([{AMINO_ACIDS}]{{{least},}})"), F.lit(1))
