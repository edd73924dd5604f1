import random

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from peptrove.llm import decontamination as D

ITEMS = {1: "alpha beta gamma", 2: " ".join(f"w{i}" for i in range(20)), 3: None, 4: "", 5: "Alpha, BETA: gamma!", 10: "ﬀ é"}


def test_against_brute_force(spark, odd):
    rng = random.Random(1)
    known = [f"w{i}" for i in range(20)]
    texts = [None, "", "alpha beta gamma", "x alpha beta gamma alpha beta gamma y", " ".join(known), " ".join(known[:12]), " ".join(known[3:16]) + " tail", "é ﬀ é", "ALPHA beta-Gamma"]
    texts += [" ".join(rng.choice(["alpha", "beta", "gamma", "q", *known[:3]]) for _ in range(40)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(ITEMS.items()), "item_id long, text string")
    for block_bytes in (1 << 20, 40):  # one automaton, and several
        got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in D.scan(docs, bench, ["doc_id"], block_bytes=block_bytes).collect()}
        plain = {i: D.brute_force(t or "", {k: v for k, v in ITEMS.items() if v}) for i, t in enumerate(texts)}
        assert got == {i: (n, hit, sorted(map(str, ids))) for i, (n, hit, ids) in plain.items()}


def test_spans_are_of_the_original_text(spark):
    text = "Xé!  ALPHA,\nbeta...Gamma? tail"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = D.scan(docs, spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string"), ["doc_id"], spans=True).first()
    assert [text[a:b] for a, b in zip(r.hit_from, r.hit_to, strict=True)] == ["ALPHA,\nbeta...Gamma"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=18), min_size=1, max_size=4), st.lists(st.sampled_from("abcd"), max_size=60))
def test_automaton_finds_every_window(items, doc):
    texts = {i: " ".join(w) for i, w in enumerate(items)}
    own = " ".join(doc).encode()
    number, machine = D.automaton([t.encode() for t in texts.values()], 13)
    ids, spans = D.occurrences(D.words(own), number, machine)
    assert (len(D.words(own)), D.covered(spans), sorted(ids)) == D.brute_force(own.decode(), texts)


def test_a_third_of_the_items_is_one_text(spark):
    """Equal items are one pattern with many ids, and the blocks hold each text once."""
    items = [(i, "alpha beta gamma" if i % 3 == 0 else f"w{i} x{i} y{i}") for i in range(300)] + [(None, "q r"), (7, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    blocks = list(D.item_blocks(bench, 1 << 9, "item_id", "text"))
    texts = [t for own, _, _ in blocks for t in own]
    assert len(texts) == len(set(texts)) == 202 and [last for *_, last in blocks] == [False] * (len(blocks) - 1) + [True] and len(blocks) > 3
    docs = spark.createDataFrame([(1, "so alpha beta gamma w7 x7 y7"), (2, "q r"), (3, "none")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.item_ids) for r in D.scan(docs, bench, ["doc_id"], block_bytes=1 << 9).collect()}
    assert got == {1: (6, sorted([str(i) for i in range(0, 300, 3)] + ["7"])), 2: (2, [""]), 3: (0, [])}


def test_odd_rows_and_empty_tables(spark, odd, nothing):
    bench = spark.createDataFrame([(1, "one"), (2, None)], "item_id long, text string")
    kept = D.decontaminate(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2  # "one" and "One, two." go
    assert D.decontaminate(nothing, bench).count() == 0
    assert D.decontaminate(odd, bench.limit(0)).count() == odd.count()


def test_sql_is_the_same(spark, tmp_path):
    docs = [(1, "alpha beta gamma"), (2, None), (3, "x alpha beta gamma " * 3)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", list(ITEMS.items()))
    rel = con.sql(D.OP2_SQL)
    want = sorted(tuple(r) for r in rel.fetchall())
    for name in ("documents", "benchmark"):
        con.sql(f"SELECT * FROM {name}").write_parquet(str(tmp_path / f"{name}.parquet"))
    got = sorted(tuple(r) for r in D.op2_aho_corasick(spark, str(tmp_path)).select(*rel.columns).collect())
    assert got == want and got[0][-2] == D.digest([1, 5])
