"""Plans over sequences against brute force on every letter run of awkward texts."""

import re
from collections import Counter

import pytest

from peptrove.functions import chem
from peptrove.plans.catalog import QUERIES

LONG = ["lorem ipsum " * 30 + "Gasket bolts1THETHER é ion; WKR noonnoon aabbaabb 12", "steel", "", None, "ANDION" * 20 + " " + "xz" * 40 + "WW"]


def test_whole_texts(spark, tmp_path):
    """Brute force over every letter run of the texts."""
    spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("bolt steel",), ("gasket xzx",)], "p_name string").write.parquet(str(tmp_path / "part.parquet"))
    got = {n: QUERIES[n](spark, str(tmp_path)).collect() for n in ("word_hunt", "coverage_pct", "b_y_ions", "physchem", "sequence_shapes")}
    seqs = {(i, k): w.upper() for i, t in enumerate(LONG) for k, w in enumerate(re.findall("[A-Za-z]+", t or ""))}
    words = {w: [s for s in seqs.values() if w in s] for w in ("BOLT", "STEEL", "GASKET", "XZX")}
    assert {r.word: (r.n_peptides, r.example) for r in got["word_hunt"]} == {w: (len(s), min(s)) for w, s in words.items() if s}

    def covered(s):
        s = s.replace("I", "L")
        return len({i + j for p in ("THE", "LON", "AND", "ER", "THTH") for i in range(len(s)) if s.startswith(p, i) for j in range(len(p))})

    assert {(r.doc_id, r.pos): (r.length, r.covered, r.percent) for r in got["coverage_pct"]} == {k: (len(s), covered(s), round(100 * covered(s) / len(s), 2)) for k, s in seqs.items()}
    mass = {k: [chem.RESIDUES[c] for c in s if c in chem.RESIDUES] for k, s in seqs.items()}
    found = {(r.doc_id, r.pos): r for r in got["physchem"]}
    assert found.keys() == {k for k, m in mass.items() if m}
    assert all(r.length == len(mass[k]) and r.mass == pytest.approx(sum(mass[k]) + 18.010565, abs=6e-4) and r.tryptic == (seqs[k][-1] in "KR") and r.n_w == seqs[k].count("W") for k, r in found.items())
    ions = {(r.seq, r.ion, r.charge): (r.mz, r.n_rows) for r in got["b_y_ions"]}
    fixed = {s: [chem.RESIDUES[c] + 57.02146 * (c == "C") for c in s if c in chem.RESIDUES] for s in seqs.values()}
    count = Counter(seqs.values())
    want = {(s, f"{y}{i}", z): ((sum(m[-i:]) + 18.0105646 if y == "y" else sum(m[:i])) + z * 1.0072765) / z for s, m in fixed.items() for y in "by" for i in range(1, len(m)) for z in (1, 2)}
    assert ions.keys() == want.keys() and all(ions[k][0] == pytest.approx(v, abs=6e-3) and ions[k][1] == count[k[0]] for k, v in want.items())
    shapes = {(r.doc_id, r.pos): (r.palindrome, r.few_letters) for r in got["sequence_shapes"]}
    assert shapes == {k: (len(s) >= 4 and s == s[::-1], len(s) >= 6 and len(set(s)) <= 4) for k, s in seqs.items()}
