"""Report readers, governed tables, sinks and incremental loading."""

import base64
import struct

import pytest
from pyspark.sql import functions as F

from peptrove.sources import reports as P
from peptrove.sources import sinks as K
from peptrove.sources.tables import Governed, NotAllowed, TableRule
from peptrove.streaming import incremental as I  # noqa: E741


def test_precursor_report(spark, tmp_path):
    cols = ["Run", "Modified.Sequence", "Stripped.Sequence", "Precursor.Charge", "RT", "IM", "iRT", "Q.Value", "Precursor.Quantity", "Protein.Group", "Genes"]
    data = [
        ("/d/run1.raw", "AC(UniMod:4)K", "ACK", "2", "1.0", "0.0", "5", "0.001", "10", "P1;P2", "ALB"), ("run1.raw", "AC(UniMod:4)K", "ACK", "2", "1.0", "0.9", "5", "0.0005", "11", "P1;P2", "ALB"),
        ("run1.raw", "PEPK", "PEPK", "2", "1.0", "0.9", "-2900", "0.02", "9", "P1", ""), ("run1.raw", "PEPR", "PEPR", "3", "1.0", "2.6", "3e12", "NaN", "9", "P1", "nan"), ("run1.raw", "AAAK", "AAAK", "2", "2.0", "0.9", "3", "1e-46", "0", "P3", "nan"),
    ]
    path = str(tmp_path / "report.tsv")
    spark.createDataFrame(data, cols).coalesce(1).write.csv(path, sep="\t", header=True)
    out = {r.modified: r for r in P.precursors(P.read_report(spark, path)).collect()}
    assert set(out) == {"AC(UniMod:4)K", "AAAK"} and out["AC(UniMod:4)K"].q == 0.0005 and out["AC(UniMod:4)K"].run == "run1"
    assert out["AAAK"].q == 0.0 and out["AAAK"].mz is not None and out["AC(UniMod:4)K"].n_mods == 1
    roll = {r.grp: r for r in P.proteins(P.precursors(P.read_report(spark, path))).collect()}
    assert roll["P1;P2"].n_peptides == 1 and roll["P3"].gene is None
    counts = P.group_counts(spark.createDataFrame([("P1;P2",), ("P1",)], "grp string")).first()
    assert (counts.n_groups, counts.n_accessions) == (2, 2)


@pytest.mark.parametrize("sep", [".", "_"])
def test_fragment_report(spark, sep):
    names = [n.replace(".", sep) for n in ["R.FileName", "PG.ProteinGroups", "PEP.StrippedSequence", "EG.ModifiedSequence", "FG.Charge", "EG.Qvalue", "EG.IsDecoy", "FG.Quantity", "F.FrgMz", "F.FrgType", "F.FrgNum", "F.FrgZ", "F.FrgLossType", "F.PeakArea", "F.ExcludedFromQuantification"]]
    row = lambda mod, q, decoy, mz, loss, area, ex: ("r.raw", "P1", "ACK", mod, 2, q, decoy, "5", mz, "y", "1", "1", loss, area, ex)
    df = spark.createDataFrame([row("_ACK_", "0.001", "False", "300.1", "noloss", "7", "False"), row("_ACK_", "0.001", "False", "283.1", "NH3", "6", ""), row("_ACK_", "0.001", "False", "283.1", "NH3", "6", ""), row("_DCY_", "NaN", "True", "1", "noloss", "1", ""), row("_NQ_", None, "False", "2", "noloss", "1", "")], names)
    assert {r.modified for r in P.fragment_precursors(df).collect()} == {"ACK", "NQ"}
    s = P.spectra(df).collect()
    assert len(s) == 1 and s[0].frg_mz == [283.1, 300.1] and s[0].frg_loss == ["NH3", "noloss"] and s[0].frg_excluded == [None, False]


def test_fallback_headers(spark):
    """Reports without the preferred headers: the next pattern is taken, also for times, quality and labels."""
    names = ["R.Raw File Name", "Group", "EG.PrecursorId", "FG.Charge", "EG.Qvalue", "PG.Qvalue", "EG.PrecursorMz", "EG.MeanApexRT", "EG.IRTEmpirical", "EG.CCS", "EG.TotalQuantity (Settings)", "FG.NormalizedMS2PeakArea", "F.FrgIon", "F.FrgMz", "F.FrgCharge", "F.MeasuredRelativeIntensity"]
    df = spark.createDataFrame([("/d/a.raw", "P1", "_ACK_", 2, "0.001", "0.02", "400.5", "3.5", "12.5", "350", "77", "70", "y4", "300.1", "1", "55")], names)
    r = P.fragment_precursors(df).first()
    assert (r.run, r.grp, r.modified, r.mz, r.rt, r.irt, r.intensity, r.normalized) == ("a", "P1", "ACK", 400.5, 3.5, 12.5, 77.0, 70.0) and r.pg_q == pytest.approx(0.02) and r.ccs == 350.0
    s = P.spectra(df).first()
    assert s.frg_ion == ["y4"] and s.frg_z == [1] and s.frg_area == [55.0] and s.frg_measured == [55.0]


def test_float_decoding(spark):
    xs = [0.0, 1.5, -2.25, 1e10, 3.14159]
    parts = [base64.b64encode(struct.pack("<2f", *xs[:2])).decode(), base64.b64encode(struct.pack("<3f", *xs[2:])).decode()]
    got = spark.createDataFrame([(",".join(parts),), ("",)], "s string").select(P.decode_floats(F.col("s")).alias("x")).collect()
    assert got[0].x == pytest.approx(xs, rel=1e-6) and got[1].x == []


def test_lookups(spark):
    genes = spark.createDataFrame([("ABC", "XYZ|DEF", "OLD"), ("DEF", "", "")], "symbol string, aliases string, previous string")
    out = {r.symbol_upper: (r.approved_symbol, r.symbol_kind) for r in P.gene_reference(genes).collect()}
    assert out["DEF"] == ("DEF", "approved") and out["XYZ"] == ("ABC", "alias") and out["OLD"] == ("ABC", "previous")
    wide = spark.createDataFrame([("g1", 3.0, 1.0), ("g2", -1.0, 2.0)], "gene string, brain double, skin double")
    assert {r.gene: (r.tissue, r.runner_up_z) for r in P.marker_panel(wide, ["brain", "skin"]).collect()} == {"G1": ("brain", 1.0), "G2": ("skin", None)}
    kv = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("r", "a", "0")], "run string, k string, v string")
    assert P.key_values(kv, "run", "k", "v").first().fields == {"a": "0", "b": "2"}
    with pytest.raises(ValueError):
        P.library(kv, ["run"], ["mz"], [])
    peaks = spark.createDataFrame([("r", 1, 1, 0.1, 5.0), ("r", 2, 2, 0.2, 5.0), ("r", 3, 1, 0.3, 5.0), ("r", 4, 2, 0.4, 5.0)], "run string, scan int, level int, rt double, mz double")
    assert [(r.cycle, round(r.rt)) for r in P.peak_cycles(peaks).orderBy("scan").collect()] == [(1, 6), (1, 12), (2, 18), (2, 24)]
    xic = spark.createDataFrame([("p", "y7^1", float(9 - i), float(i)) for i in range(9)] + [("p", "index", 0.0, 0.0), ("p", "b2^1", 0.0, 1.0)], "pr string, feature string, rt double, value double")
    t = P.reference_traces(xic).collect()
    assert len(t) == 1 and t[0].trace_rt == sorted(t[0].trace_rt)


def test_governed_tables(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([("s1", "Ann"), ("s2", "Bob")], "search_id string, pi string").write.parquet(f"{d}/secret.parquet")
    spark.range(3).write.parquet(f"{d}/open.parquet")
    rules = {"open": TableRule(), "secret": TableRule("lab", {"pi": "pi"}, "search_id")}
    assert Governed(spark, d, rules).table("open").count() == 3
    with pytest.raises(NotAllowed):
        Governed(spark, d, rules).table("secret")
    with pytest.raises(NotAllowed):
        Governed(spark, d, rules).table("other")
    lab = Governed(spark, d, rules, "lab", ["s1"]).table("secret").collect()
    assert [r.search_id for r in lab] == ["s1"] and lab[0].pi.startswith("pi-")
    assert Governed(spark, d, rules, "full").table("secret").count() == 2
    with pytest.raises(NotAllowed):
        Governed(spark, d, rules).sql("DELETE FROM open", ["open"])
    g = Governed(spark, d, rules)
    assert g.fetch(g.sql("SELECT count(*) AS n FROM open", ["open"]), "val") == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "search_id string, v int")
    path = str(tmp_path / "t")
    K.replace_partitions(df, path)
    K.replace_partitions(spark.createDataFrame([("b", 3)], "search_id string, v int"), path)
    assert sorted((r.search_id, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]
    assert K.checksum(df) == K.checksum(df.repartition(3)) != K.checksum(df.limit(1))
    assert K.write_verified(df, str(tmp_path / "w"))[0] == 2
    with pytest.raises(ValueError):
        K.export_parquet(df.limit(0), str(tmp_path / "e"))
    with pytest.raises(ValueError):
        K.export_parquet(df, str(tmp_path / "e"), most_rows=1)
    def broken(_):
        raise RuntimeError("no")
    state = K.refresh(spark, str(tmp_path), [("bad", broken), ("good", lambda s: s.range(2))])
    assert state["good"] is None and "no" in state["bad"] and spark.read.parquet(str(tmp_path / "good.parquet")).count() == 2
    kept = K.refresh(spark, str(tmp_path), [("bad", broken), ("good", lambda s: s.range(5)), ("child", lambda s: s.range(1)), ("grandchild", lambda s: s.range(1))], {"child": ["bad", "good"], "grandchild": ["child"], "good": []})
    assert kept["good"] is None and kept["child"] == "needs bad" and kept["grandchild"] == "needs child" and not (tmp_path / "child.parquet").exists()
    assert K.append_version(spark, str(tmp_path / "log"), "c", "1") and "| search_id |" in K.brief("t", {"n": 2}, {"rows": df})
    built = K.top_up(df.where("v = 1").select("search_id"), df, "search_id", lambda x: x)
    assert [r.search_id for r in built.collect()] == ["b"]


def test_incremental_loading(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    spark.createDataFrame([("a", 1), ("b", 2)], "search_id string, v int").write.parquet(src)
    schema = spark.read.parquet(src).schema
    I.load(I.arriving(spark, src, schema), out, chk, "search_id")
    spark.createDataFrame([("b", 5)], "search_id string, v int").write.mode("append").parquet(src)
    I.load(I.arriving(spark, src, schema), out, chk, "search_id")
    assert sorted((r.search_id, r.v) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 5)]
    events = str(tmp_path / "ev")
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'x' AS k UNION ALL SELECT timestamp'2024-01-01 00:20:00', 'x' UNION ALL SELECT timestamp'2024-01-03 00:00:00', 'y'").write.parquet(events)
    stream = I.windowed_counts(I.arriving(spark, events, spark.read.parquet(events).schema), "ts", "1 hour", ["k"])
    q = stream.writeStream.format("memory").queryName("counted").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    assert spark.sql("SELECT k, n FROM counted WHERE k = 'x'").collect()[0].n == 2
