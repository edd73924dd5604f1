"""The API's validation, pages and fallbacks; the SQLite source; lanes; words."""

import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from peptrove.api import Corpus, clamp
from peptrove.functions import clean, text, words
from peptrove.operators import lanes
from peptrove.plans.roles import Roles
from peptrove.sources import sqlite

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
def test_corpus(spark):
    c = Corpus(Roles(spark, DATA))
    assert c.overview().first().n_precursors == 6000
    with pytest.raises(ValueError):
        c.search_peptides(" x ")
    assert c.search_peptides("red bolt").where("name <> 'red bolt'").count() == 0
    assert c.search_peptides("widg", limit=500).count() == c.search_peptides("WIDG", limit=3).count() + c.search_peptides("widg", limit=500, offset=3).count()
    assert c.count_peptides("widg").first().n_total >= c.search_peptides("widg", limit=500).count()
    assert c.search_proteins("brand#1").count() > 0 and c.protein("no such").count() == 0
    assert sum(r.n_share for r in c.peptide(1).collect()) == pytest.approx(1.0, abs=1e-5)
    assert c.gene("widget").count() == 1 and c.species("nation_1").count() > 0 and c.searches(limit=7).count() == 7
    assert c.ions("PEPTIDE", 9).agg(F.max("charge")).first()[0] == 3 and c.coverage("PEPTIDE", ["PEP", "TLDE"]).first().covered == 7
    t = spark.createDataFrame([("a", 1.0, 0.0), ("a", 2.0, 0.0)], "key string, mz double, rt double")
    o = spark.createDataFrame([("b", 1.01, 0.5), ("b", 2.0, 9.0), ("a", 1.0, 0.0), ("c", 5.0, 0.0)], "partner string, other_mz double, other_rt double")
    assert [tuple(r) for r in c.interference(t, o, tol=0.0101).collect()] == [("a", "b", 2, 1, 0.5, True, 2)]
    assert clamp(None, 5, 1, 9) == 5 and clamp(99, 5, 1, 9) == 9


def test_sqlite_source(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE t (id INTEGER, name TEXT, v REAL, b BLOB)")
        con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(i, f"n{i}" if i % 2 else None, i / 2, bytes([i])) for i in range(50)])
    sqlite.register(spark)
    df = spark.read.format("sqlite").option("path", path).option("table", "t").option("key", "id").option("partitions", "4").load()
    assert df.schema.simpleString() == "struct<id:bigint,name:string,v:double,b:binary>"
    assert df.rdd.getNumPartitions() == 4 and df.agg(F.sum("id"), F.count("name"), F.max("v")).first() == (1225, 25, 24.5)
    q = spark.read.format("sqlite").option("path", path).option("query", "SELECT id, v FROM t WHERE id < 3").load()
    assert sorted(tuple(r) for r in q.collect()) == [(0, 0.0), (1, 0.5), (2, 1.0)]


def test_lanes_and_words(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, "n")], "x int, y string")
    assert sorted(tuple(r) for r in lanes.concatenated([a, b]).collect()) == [(1, None), (2, "n")]
    p = spark.createDataFrame([(1, [1], [1]), (2, [1], [1, 2])], "k int, a array<int>, b array<int>")
    assert [r.k for r in lanes.parallel(p, "a", "b").collect()] == [2]
    ranks = spark.createDataFrame([("CELL", 10), ("THAT", 1)], "word string, rank int")
    w = spark.createDataFrame([("k", "that"), ("k", "cell"), ("k", "zzz"), ("q", "ox")], "k string, w string")
    out = {r.k: (r.sense, r.content_word) for r in words.sense_scores(w, "k", "w", ranks).collect()}
    assert out == {"k": ((1 + 10 + 12000) / 3, "CELL"), "q": (12000.0, None)}
    one = spark.createDataFrame([("Univ. of X,  Y", "Homo sapiens", "AAAAACDEFGHIKLMNPQRSTVWYAAA", "run.d"), (None, "a clone of it", "", "x.raw")], "i string, o string, s string, r string")
    got = one.select(text.canonical_institute(F.col("i"), [("univ of x y", "X")]).alias("i"), text.is_binomial(F.col("o")).alias("b"), text.is_narrative(F.col("o")).alias("n"), F.size(text.inline_sequences(F.col("s"))).alias("s")).collect()
    assert [tuple(r) for r in got] == [("X", True, False, 1), ("(institute not given)", False, True, 0)]
    hidden = one.select(words.is_hidden(F.col("o"), F.lit("x"), ["homo sapiens"], ["spicy"]).alias("h")).collect()
    assert [r.h for r in hidden] == [True, False]
    assert one.groupBy("r").agg(clean.platform(F.lit(False), F.col("r")).alias("p")).orderBy("r").first().p == "timstof"
