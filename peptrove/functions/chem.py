"""Peptide chemistry as column expressions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import letters

# Monoisotopic residue masses, hydropathy, and masses of water, a proton and modifications.
RESIDUES = {
    "G": 57.02146, "A": 71.03711, "S": 87.03203, "P": 97.05276, "V": 99.06841, "T": 101.04768, "C": 103.00919, "L": 113.08406, "I": 113.08406, "N": 114.04293,
    "D": 115.02694, "Q": 128.05858, "K": 128.09496, "E": 129.04259, "M": 131.04049, "H": 137.05891, "F": 147.06841, "R": 156.10111, "Y": 163.06333, "W": 186.07931,
}
HYDROPATHY = {
    "A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5,
    "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2,
}
WATER, PROTON, CARBAMIDOMETHYL = 18.0105646, 1.0072765, 57.02146
WATER_SHORT, PROTON_SHORT = 18.010565, 1.007276
UNIMOD = {1: 42.010565, 4: 57.021464, 5: 43.005814, 7: 0.984016, 21: 79.966331, 26: 39.994915, 27: -18.010565, 28: -17.026549, 35: 15.994915, 121: 114.042927, 259: 8.014199, 267: 10.008269, 385: -17.026549, 1301: 128.094963}

COUNTED = "CWHPMKR"


def table_of(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def residues(seq: Column) -> Column:
    """The sequence's valid residues in order."""
    return F.filter(letters(F.upper(F.trim(seq))), lambda c: c.isin(*RESIDUES))


def let(value: Column, body) -> Column:
    """An expression of a value that is worked out once, however often the expression names it."""
    return F.get(F.transform(F.array(value), body), 0)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def physchem(seq: Column) -> Column:
    """Length, mass, m/z at 2 and 3 charges, mean hydropathy, residue counts, tryptic end (D1); null without residues."""
    def of(aa: Column) -> Column:
        up, n = F.upper(F.trim(seq)), F.size(aa)
        counts = F.struct(*((F.length(up) - F.length(F.replace(up, F.lit(c), F.lit("")))).alias(c) for c in COUNTED))
        weigh = lambda values: total(F.transform(aa, lambda c: F.element_at(table_of(values), c)))

        def shown(x: Column) -> Column:
            mass, gravy = x["mass"], x["gravy"]
            return F.struct(
                n.alias("length"), mass.alias("monoisotopic_mass"), F.round((mass + 2 * PROTON_SHORT) / 2, 4).alias("mz_2plus"), F.round((mass + 3 * PROTON_SHORT) / 3, 4).alias("mz_3plus"),
                gravy.alias("gravy"), (gravy > 0).alias("hydrophobic"), counts.alias("counts"), F.right(up, F.lit(1)).isin("K", "R").alias("tryptic"),
            )

        return F.when(n > 0, let(F.struct(F.round(weigh(RESIDUES) + WATER_SHORT, 4).alias("mass"), F.round(weigh(HYDROPATHY) / n, 3).alias("gravy")), shown))

    return let(residues(seq), of)


def il_key(seq: Column) -> Column:
    """One spelling for sequences that differ in I and L only (D2, SF14)."""
    return F.translate(F.upper(seq), "I", "L")


def il_variants(seq: str, most: int = 12) -> list[str]:
    """All spellings, or none where there are more than 2**most (the enumerating form of il_key)."""
    s = seq.upper()
    if sum(c in "IL" for c in s) > most:
        return []
    return ["".join(p) for p in product(*("IL" if c in "IL" else c for c in s))]


def ladder(seq: Column, charges: int = 2, carbamidomethyl: bool = True) -> Column:
    """Array of struct(mz, ion, type, series, charge): the b and y ions by m/z."""
    def of(mass: Column) -> Column:
        n = F.size(mass)
        cuts = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))

        def ions(kind: str) -> Column:
            def at(i: Column) -> Column:
                part = F.slice(mass, F.lit(1), i) if kind == "b" else F.slice(mass, n - i + 1, i)

                def charged(neutral: Column) -> Column:
                    return F.array(*(F.struct(F.round((neutral + z * PROTON) / z, 5).alias("mz"), F.concat(F.lit(kind), i.cast("string")).alias("ion"), F.lit(kind).alias("type"), i.alias("series"), F.lit(z).alias("charge")) for z in range(1, charges + 1)))

                return let(total(part) + F.lit(WATER if kind == "y" else 0.0), charged)

            return F.flatten(F.transform(cuts, at))

        return F.array_sort(F.concat(ions("b"), ions("y")))

    return let(F.transform(residues(seq), lambda c: F.element_at(table_of(RESIDUES), c) + (F.when(c == "C", CARBAMIDOMETHYL).otherwise(0.0) if carbamidomethyl else F.lit(0.0))), of)


def ion_mz(seq: Column, label: Column, charge: Column | int = 1) -> Column:
    """m/z of a named ion such as y8 on any sequence (D10); null if it has none."""
    z = charge if isinstance(charge, Column) else F.lit(charge)
    single = F.filter(ladder(seq, 1), lambda x: x["ion"] == F.trim(label))
    return (F.get(single, 0)["mz"] + (z - 1) * PROTON) / z


def fallback_ions(seq: Column, ys: int = 4, bs: int = 2) -> Column:
    """The largest y and then b ions of one charge, from the second of each series up."""
    n = F.size(residues(seq))

    def best(kind: str, k: int) -> Column:
        own = F.filter(ladder(seq, 1), lambda x: (x["type"] == kind) & x["series"].between(2, n - 1))
        return F.slice(F.reverse(F.array_sort(F.transform(own, lambda x: x["mz"]))), 1, k)

    return F.concat(best("y", ys), best("b", bs))


def mirrored(decoy: Column, ions: Column) -> Column:
    """The same named ions (array of struct label, charge) on a decoy sequence."""
    single = ladder(decoy, 1)
    found = F.transform(ions, lambda i: (F.get(F.filter(single, lambda x: x["ion"] == i["label"]), 0)["mz"] + (i["charge"] - 1) * PROTON) / i["charge"])
    return F.filter(found, lambda x: x.isNotNull())


def stripped(modified: Column) -> Column:
    """The bare sequence of a modified one."""
    return F.upper(F.regexp_replace(F.regexp_replace(modified, r"\([^)]*\)|\[[^\]]*\]", ""), "[^A-Za-z]", ""))


def modifications(modified: Column) -> Column:
    """What stands in brackets of either kind, in order."""
    found = F.regexp_extract_all(modified, F.lit(r"\(([^)]+)\)|\[([^\]]+)\]"), F.lit(0))
    return F.transform(found, lambda m: F.regexp_replace(m, r"^[(\[]|[)\]]$", ""))


def proforma(modified: Column) -> Column:
    """Round brackets as square ones, in ProForma's spelling."""
    return F.replace(F.regexp_replace(modified, r"\(([^)]+)\)", "[$1]"), F.lit("[UniMod:"), F.lit("[UNIMOD:"))


def precursor_mz(modified: Column, charge: Column) -> Column:
    """m/z of a modified sequence (D11); null without residues or a charge from 1."""
    bare = stripped(modified)
    mods = F.transform(F.regexp_extract_all(modified, F.lit(r"(?i)\(UniMod:(\d+)\)"), F.lit(1)), lambda m: F.coalesce(F.try_element_at(table_of(UNIMOD), m.cast("int")), F.lit(0.0)))
    neutral = total(F.transform(letters(bare), lambda c: F.coalesce(F.try_element_at(table_of(RESIDUES), c), F.lit(0.0)))) + WATER + total(mods)
    z = charge.cast("int")
    return F.when((F.length(bare) > 0) & (z >= 1), F.round((neutral + z * PROTON) / z, 5))


def flyability(c1: Column, c2: Column, c3: Column, c4: Column) -> Column:
    """Expected class, scaled to 0-1."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c1 + 2 * c2 + 3 * c3 + 4 * c4 - 1) / 3)), 4)


def likeliest_class(c1: Column, c2: Column, c3: Column, c4: Column) -> Column:
    """The class of the largest probability; of equals the highest (SF26)."""
    top = F.greatest(c1, c2, c3, c4)
    return F.when(c4 == top, 4).when(c3 == top, 3).when(c2 == top, 2).otherwise(1)


def trace_label(ion: Column, charge: Column, loss: Column) -> Column:
    """y6+ -NH3: ion, a plus a charge, the loss if there is one."""
    none = loss.isNull() | F.lower(loss).isin("", "noloss", "none")
    return F.concat(ion, F.repeat(F.lit("+"), charge), F.when(none, "").otherwise(F.concat(F.lit(" -"), loss)))
