import random
from collections import Counter

import pytest

from peptrove.llm import licenses as L

TEXTS = [
    None, "", "!!!", "ALL RIGHTS. reserved, all rights reserved CC-BY cc by", "Released under the MIT License. " * 30, "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3.", "mit license", "license mit the under released", "all rights all rights reserved", "K İ cc by", "cc é by", "general public license" * 2,
    "plain words " * 400, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, t, 0.1, "x") for i, t in enumerate(TEXTS)] + [(99, TEXTS[4], 0.1, "x")] * 2, "doc_id long, text string, score double, labels string")
    return L.scan(df, ["doc_id"]).collect()


def test_base_against_brute_force(found):
    texts = dict(enumerate(TEXTS)) | {99: TEXTS[4]}
    assert len(found) == len(TEXTS) + 2
    for r in found:
        n, places = L.brute_force(texts[r.doc_id])
        assert r.n_words == n and [(p["at"], p["label"]) for p in r.places] == places and r.base_labels == sorted({x for _, x in places})
        assert set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1


def test_method_labels(found):
    labels = {r.doc_id: r.labels for r in found}
    assert labels[4] == ["mit"] and labels[5] == ["cc-by", "cc-by-nc-4.0"] and labels[6] == ["apache-2.0"] and labels[7] == ["gpl", "gpl-3.0"] and labels[15] == ["mit"]
    assert labels[9] == [] and labels[14] == [] and labels[0] == []


def test_postings_must_agree_on_a_place(spark):
    scattered = "released one two three under four the five mit license"
    df = spark.createDataFrame([(1, scattered), (2, "released under the mit license")], "doc_id long, text string")
    score = {r.doc_id: r.scores[0] for r in L.scan(df, ["doc_id"]).collect()}
    assert score[1] < score[2] and score[2] == pytest.approx(1.0)


def test_index_takes_the_rarest_words():
    index = L.positional_index(1000, {"the": 900, "software": 10, "license": 30})
    mit = [p["w"] for p in index if p["t"] == 1]
    assert "the" not in mit and sum(p["x"] for p in index if p["t"] == 1) == pytest.approx(1.0)


def licensed():
    """Whole texts, parts of them, several in one file, with words changed, dropped and put in."""
    rng, out = random.Random(3), list(TEXTS)
    for _, text, _ in L.TEMPLATES:
        own = text.split()
        changed = [rng.choice(["word", w]) if rng.random() < 0.1 else w for w in own]
        out += [text, "lead words " + " ".join(own[: len(own) // 2]), " ".join(changed), " ".join(own[:9] + ["inserted"] + own[9:]), text + " the and " + rng.choice(L.TEMPLATES)[1], " ".join(w for w in own if rng.random() > 0.05)]
    return out + ["the software of the license and public use " * 5] * 30


def test_method_against_brute_force(spark):
    """Scores, labels and score of the method, with templates laid at every place."""
    texts = licensed()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want, n_labels = L.brute_scores(texts), Counter()
    for r in L.scan(df, ["doc_id"]).collect():
        assert r.scores == pytest.approx(want[r.doc_id], abs=1e-9)
        base = L.brute_force(texts[r.doc_id])[1]
        own = {label for (label, _, _), x in zip(L.TEMPLATES, want[r.doc_id], strict=True) if x >= L.LEAST}
        assert r.labels == sorted(own | {x for _, x in base}) and r.score == pytest.approx(min(1.0, max([*want[r.doc_id], 0.5 * bool(base)])))
        n_labels.update(own)
    assert set(n_labels) == {label for label, _, _ in L.TEMPLATES}


def test_whole_licences_are_labelled(spark):
    df = spark.createDataFrame([(i, "x y " + t + " tail") for i, (_, t, _) in enumerate(L.TEMPLATES)], "doc_id long, text string")
    assert all(L.TEMPLATES[r.doc_id][0] in r.labels and r.score == pytest.approx(1.0) for r in L.scan(df, ["doc_id"]).collect())


def test_odd_rows(spark, odd, nothing):
    assert L.scan(odd, ["doc_id"]).count() == odd.count()
    assert L.scan(nothing, ["doc_id"]).collect() == []


def test_only_jvm_operators(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "d"))
    plan = L.scan(spark.read.parquet(str(tmp_path / "d")), ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "Exchange"))
