"""Known answers and edge cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from peptrove.functions import chem, clean, genes, taxa, text


def one(spark, col, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) if v is not None else F.lit(None).cast("string").alias(k) for k, v in values.items()))
    return df.select(col.alias("x")).first().x


def test_ladder_of_a_known_peptide(spark):
    ions = {(i.ion, i.charge): i.mz for i in one(spark, chem.ladder(F.col("s"), 2), s="PEPTIDE")}
    assert abs(ions["b2", 1] - 227.10263) < 1e-4 and abs(ions["y1", 1] - 148.06043) < 1e-4
    assert len(ions) == 24
    assert one(spark, chem.ladder(F.col("s")), s="A") == [] and one(spark, chem.ladder(F.col("s")), s="12") == []


def test_named_and_mirrored_ions(spark):
    assert abs(one(spark, chem.ion_mz(F.col("s"), F.lit("y1")), s="PEPTIDE") - 148.06043) < 1e-4
    assert one(spark, chem.ion_mz(F.col("s"), F.lit("y9")), s="PEPTIDE") is None
    ions = F.array(F.struct(F.lit("y1").alias("label"), F.lit(1).alias("charge")), F.struct(F.lit("y99").alias("label"), F.lit(1).alias("charge")))
    assert len(one(spark, chem.mirrored(F.col("s"), ions), s="EDITPEP")) == 1
    assert len(one(spark, chem.fallback_ions(F.col("s")), s="PEPTIDEK")) == 6


def test_physchem(spark):
    p = one(spark, chem.physchem(F.col("s")), s=" peptidek ")
    assert p.length == 8 and p.tryptic and p.counts.K == 1 and p.counts.P == 2
    assert abs(p.monoisotopic_mass - 927.4549) < 1e-3 and abs(p.mz_2plus - (p.monoisotopic_mass + 2 * 1.007276) / 2) < 1e-3
    assert one(spark, chem.physchem(F.col("s")), s="123") is None and one(spark, chem.physchem(F.col("s")), s=None) is None


def test_il_spellings(spark):
    assert one(spark, chem.il_key(F.col("s")), s="AAQEEYIKR") == one(spark, chem.il_key(F.col("s")), s="AAQEEYLKR")
    assert set(chem.il_variants("AIL")) == {"AII", "AIL", "ALI", "ALL"} and chem.il_variants("I" * 13) == []


def test_modified_sequences(spark):
    s = "AC(UniMod:4)M[Oxidation]K"
    assert one(spark, chem.stripped(F.col("s")), s=s) == "ACMK"
    assert one(spark, chem.modifications(F.col("s")), s=s) == ["UniMod:4", "Oxidation"]
    assert one(spark, chem.proforma(F.col("s")), s=s) == "AC[UNIMOD:4]M[Oxidation]K"
    plain, carb = (one(spark, chem.precursor_mz(F.col("s"), F.lit(2)), s=x) for x in ("ACK", "AC(UniMod:4)K"))
    assert abs(carb - plain - 57.021464 / 2) < 1e-4
    assert one(spark, chem.precursor_mz(F.col("s"), F.lit(0)), s="ACK") is None


def test_classes_and_flyability(spark):
    assert one(spark, chem.likeliest_class(*(F.lit(x) for x in (0.4, 0.1, 0.1, 0.4)))) == 4
    assert one(spark, chem.flyability(*(F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)))) == 1.0
    assert one(spark, chem.trace_label(F.lit("y6"), F.lit(2), F.lit("NH3"))) == "y6++ -NH3"
    assert one(spark, chem.trace_label(F.lit("y6"), F.lit(1), F.lit("noloss"))) == "y6+"


@pytest.mark.parametrize(
    "name, want",
    [("Unknown", None), ("  ", None), (None, None), ("Homo sapiens (Human)", "Homo sapiens"), ("  Mus musculus ", "Mus musculus"), ("Escherichia coli (strain K12)", "Escherichia coli (strain K12)"), ("(unknown)", None), ("nan", None)],
)
def test_canonical_organism(spark, name, want):
    assert one(spark, clean.canonical_organism(F.col("s")), s=name) == want


def test_cleaning(spark):
    assert one(spark, clean.float4(F.lit(1e-46))) == 0 and one(spark, clean.float4(F.lit(3e39))) is None and one(spark, clean.float4(F.lit(float("nan")))) is None
    assert one(spark, clean.mobility(F.lit(0.3))) is None and one(spark, clean.mobility(F.lit(0.31))) == 0.31 and one(spark, clean.mobility(F.lit(2.6))) is None
    assert one(spark, clean.indexed_time(F.lit(-2900.0))) is None and one(spark, clean.indexed_time(F.lit(12.0))) == 12.0
    assert one(spark, clean.passes_q(F.lit(None).cast("double"))) is False and one(spark, clean.passes_q(F.lit(None).cast("double"), keep_null=True)) is True
    assert one(spark, clean.numeric(F.col("s")), s="NaN") is None and one(spark, clean.numeric(F.col("s")), s="1.5") == 1.5 and one(spark, clean.numeric(F.col("s")), s="x") is None
    assert one(spark, clean.flag(F.col("s")), s="True") is True and one(spark, clean.flag(F.col("s")), s="") is None
    assert one(spark, clean.looks_contaminant(F.col("s")), s="Cont_P02769") and one(spark, clean.looks_contaminant(F.col("s")), s="cRAP-P02768") and not one(spark, clean.looks_contaminant(F.col("s")), s="CONTACTIN")
    assert one(spark, clean.samples_per_day(F.col("s")), s="run_60SPD-1") == 60 and one(spark, clean.samples_per_day(F.col("s")), s="100-samples-per-day") == 100
    assert one(spark, clean.gradient_minutes(F.lit(60), F.lit(9.0))) == 21.0 and one(spark, clean.gradient_minutes(F.lit(7), F.lit(9.129))) == 9.13
    assert one(spark, clean.percent(F.lit(5), F.lit(4))) == 100.0
    assert str(one(spark, clean.first_date(F.col("s")), s="3/4/2024 1:02:03 PM")) == "2024-03-04 13:02:03"


def test_genes(spark):
    sym = lambda s: one(spark, genes.clean_symbol(F.col("s")), s=s)
    assert sym("ALB;AFP") == "ALB" and sym("A0A077S9R2") is None and sym("") is None and sym(None) is None and sym("P02649") is None
    cls = lambda s: one(spark, genes.function_class(F.col("s")), s=s)
    assert cls("alb") == "Blood / plasma" and cls("MYH7;X") == "Muscle" and cls("RPLP0") == "Ribosome / translation" and cls("XYZ") == "Other" and cls("") == "Other"
    kind = lambda s: one(spark, genes.contaminant_kind(F.lit("p"), F.col("s")), s=s)
    assert kind("KRT33") == "hair keratin" and kind("Cont_KRT1") == "skin keratin" and kind("KRT8") == "keratin (epithelial)" and kind("LYZ") == "lysozyme" and kind("zzz") == "contaminant"
    custom = lambda g, n: one(spark, genes.made_up(F.col("g"), F.col("n")), g=g, n=n)
    assert custom("P0000", "x") and custom("P1", "x") and custom("P02649", "whoKnows") and not custom("P02649", "APOE")


def test_taxa(spark):
    assert one(spark, taxa.taxon_group(F.col("s")), s="Homo sapiens") == "Mammals" and one(spark, taxa.taxon_group(F.col("s")), s="Foo bar") == taxa.OTHER


def test_text(spark):
    assert one(spark, text.basename(F.col("s")), s=r"C:\a\b.raw") == "b.raw" and one(spark, text.stem(F.col("s")), s="/x/y.z.raw") == "y.z"
    assert one(spark, text.common_prefix(F.array(F.lit("Ex_Mucke_30m_1"), F.lit("Ex_Mucke_30m_2")))) == "Ex_Mucke_30m"
    assert one(spark, text.anonymous(F.col("s"), "run", True), s="a.raw").endswith(".raw") and one(spark, text.anonymous(F.col("s"), "run"), s=None) is None
    assert one(spark, text.names_person(F.lit("Ada"), F.col("s"), "Chen"), s="Chen") and not one(spark, text.names_person(F.lit("Ada"), F.col("s"), "Chen"), s="Muchena")
    assert not one(spark, text.contains_ignoring_case(F.col("s"), "%"), s="abc") and one(spark, text.contains_ignoring_case(F.col("s"), "B_"), s="ab_c")
    assert text.case_variants("abc") == ["abc", "ABC", "Abc"]
    p = one(spark, text.path_provenance(F.col("s")), s="/data/service/off_campus/Inst/Pi/Proj/x.raw")
    assert (p.scope, p.campus, p.client, p.pi, p.project) == ("customer", "off_campus", "Inst", "Pi", "Proj")
    p = one(spark, text.path_provenance(F.col("s")), s="/data/service/on_campus/Pi/Proj")
    assert (p.client, p.pi, p.project) == ("home institution", "Pi", "Proj")
    assert one(spark, text.path_provenance(F.col("s")), s="/x/lab/QC").project == "QC" and one(spark, text.path_provenance(F.col("s")), s="/x").scope == "unknown"
    assert one(spark, text.is_palindrome(F.col("s")), s="ABBA") and one(spark, text.number_after(F.col("s"), "avg of ", " runs"), s="avg of 12 runs") == 12


def test_export_names(spark):
    names = lambda p: one(spark, text.report_name(F.col("p")), p=p)
    assert names("/d/Ver_15_Report.parquet") == "Ver_15" and names("D:\\x\\a_Report_FRAN (Normal).tsv") == "a" and names("/d/e/_report.parquet") == "e"
    assert one(spark, text.without_timestamp(F.col("p")), p="20240102_030405_run") == "run" and one(spark, text.without_timestamp(F.col("p")), p="2024_run") == "2024_run"
