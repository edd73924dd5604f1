import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from peptrove.llm import packing as P
from peptrove.llm._bpe import Bpe

PATH = P.vocabulary_path()


@pytest.fixture(scope="module")
def bpe():
    return Bpe(PATH)


def library(bpe, text):
    return np.array(bpe.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


ODD = ["it's I'll they're x'd 'S 12ab34 ###!!", "<|endoftext|> a<|startoftext|>b", " \x1c a\x1db", "éÉ İstanbul ΣΑΣ Σ ſ K 漢字 かな ́a é   \u0085 x y", "", "a" * 100 + " " + "1" * 50, "😀😀 a😀b", "don't DON'T o'clock'll ''s 's's '", "×3 ÷ ª º µ ß Ω ɐ", "é café", "tab\tnew\nline"]


def test_ids_are_the_library_s(bpe):
    assert bpe.encode([t.encode() for t in ODD]) == [library(bpe, t) for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abtheinér'sdmlv10 #.,É\ńñ漢ß"), max_size=40), max_size=6))
def test_ids_are_the_library_s_for_any_text(texts):
    own = P.tokenizer(PATH)
    assert own.encode([t.encode() for t in texts]) == [library(own, t) for t in texts]


def test_cache_limits_change_nothing():
    small = Bpe(PATH, longest=4, held=3, held_pieces=5)
    assert small.encode([t.encode() for t in ODD]) == [library(small, t) for t in ODD] == small.encode([t.encode() for t in ODD])


def check(rows, documents):
    """Every id lies in one piece; offsets are gapless; lengths fit."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r[0]].append(r)
        sequences[r[5]].append(r)
    assert set(pieces) == set(documents)
    for d, own in pieces.items():
        at = 0
        for _, start, n, crc, total, _, _ in sorted(own, key=lambda r: r[1]):
            assert start == at and n > 0 and total == len(documents[d]) // 4 and crc == zlib.crc32(documents[d][4 * start : 4 * (start + n)])
            at += n
        assert at == len(documents[d]) // 4
    sizes = []
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r[6]):
            assert r[6] == at
            at += r[2]
        sizes.append(at)
    assert max(sizes, default=0) <= P.LENGTH
    return sizes


def padding(sizes):
    return sum(P.LENGTH - n for n in sizes if n & (n - 1))


@pytest.mark.parametrize("lengths", [[1], [2048], [2049], [1100] * 300, list(range(1, 2500, 7)), [1] * 5000, [5000, 3, 70_000, 2047, 1]])
def test_packer(lengths):
    documents = {i: np.arange(n, dtype="<u4").tobytes() for i, n in enumerate(lengths)}
    packer = P.Packer(most_open=64)
    rows = [r for i, ids in documents.items() for r in packer.add(i, ids)]
    assert packer.n_open <= 64
    sizes = check(rows + list(packer.finish()), documents)
    assert padding(sizes) == 0 and sum(n < P.LENGTH for n in sizes) <= 11


def test_rule_is_least_sum_of_squares():
    packer = P.Packer(16)
    rng = np.random.default_rng(2)
    for i in range(300):
        r = int(rng.integers(1, 16))
        def total(level):
            return int((level[1:16] ** 2).sum())
        options = {}
        for f in range(0, 16 - r + 1):
            if f and not packer.level[f]:
                continue
            level = packer.level.copy()
            if f:
                level[f] -= 1
            if f + r < 16:
                level[f + r] += 1
            options[f] = total(level)
        assert options[packer.place(r)] == min(options.values())
        list(packer.add(i, bytes(4 * r)))


def test_odd_rows(spark, odd, nothing, bpe):
    rows = [tuple(r) for r in P.pack(odd.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()]
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    check(rows, {i: library(bpe, t or "") + P.END for i, t in texts.items()})
    repeated = P.pack(odd).collect()
    assert sum(r.length for r in repeated) == sum(len(library(bpe, r.text or "")) // 4 + 1 for r in odd.collect())
    assert P.pack(nothing).collect() == []
