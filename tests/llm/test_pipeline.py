"""The pipeline against its stages' plain definitions, and on odd and empty tables."""

import pytest

import corpus_pipeline as C
from peptrove.llm import decontamination, jaccard, packing, registry, secret_scan, toxicity

from .conftest import prose
from .test_toxicity import labelled

SECRET = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    rows = labelled(150, 8)
    texts = [t for t, _ in rows]
    item = " ".join(f"item{i}" for i in range(30))
    texts += [texts[5], texts[6] + " end", item, f"{prose(77, 80)} {SECRET} more", None, "", item[:60]]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, item


def test_stages_against_brute_force(spark, folder):
    d, item = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    net = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    scores = net.scores([(r.text or "").encode() for r in rows], toxicity.Lookup(net.vocabulary))
    rows = [r for r, s in zip(rows, scores, strict=True) if s < 0.5]
    classes = jaccard.brute_force([r.text for r in rows])
    rows = [r for i, r in enumerate(rows) if classes[i][0] == i]
    kept = {}
    for r in rows:
        n, hit, _ = decontamination.brute_force(r.text or "", {1: item})
        if not (hit and 20 * hit >= n):
            own = secret_scan.judge([(r.text or "").encode()], [r.source], secret_scan.default_forest())[0]
            kept[r.doc_id] = secret_scan.redacted((r.text or "").encode(), own)
    want = {i: len(ids) // 4 + 1 for i, ids in zip(kept, packing.tokenizer(packing.vocabulary_path()).encode(list(kept.values())), strict=True)}
    out = C.run(spark, d).collect()
    assert {r.doc_id: r.doc_tokens for r in out} == want and sum(r.length for r in out) == sum(want.values())
    assert any(b"[secret]" in t for t in kept.values()) and len(want) < 150


def test_columns_hold_through_the_stages(spark, folder):
    d, _ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert 4 <= len(C.STAGES) <= 5 and [n for n, _ in C.STAGES][-1] == "packing"
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns
        assert stage(spark, docs.limit(0), d).count() == 0


def test_registry_has_all_ten():
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{i}" for i in range(1, 11)} and set(registry.ORACLE_SQL) <= set(registry.QUERIES)
