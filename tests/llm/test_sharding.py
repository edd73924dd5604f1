import zlib
from collections import defaultdict

import xxhash

from peptrove.llm import sharding as S


def check(rows, docs, shards):
    want = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in docs)
    assert sorted((r.size, r.text_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values()) and set(by) <= set(range(shards))
    return {k: sum(r.size for r in own) for k, own in by.items()}


def test_bytes_are_near_equal_and_groups_hold_together(spark, monkeypatch):
    docs = [f"text {i} " * (1 + i % 40) for i in range(3000)] + ["hot copy " * 20] * 1500 + ["pair"] * 2
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string").repartition(5)
    rows = S.shard_by_bytes(df, 20).collect()
    sizes = check(rows, docs, 20)
    mean, largest = sum(sizes.values()) / 20, max(len(t.encode()) + 16 for t in docs)
    assert len(sizes) == 20 and all(abs(s - mean) <= 2 * S.SLACK * mean + 2 * largest for s in sizes.values())
    of = defaultdict(set)
    for r in rows:
        of[r.text_crc32].add(r.shard)
    split = [k for k, v in of.items() if len(v) > 1]
    assert split == [zlib.crc32(b"hot copy " * 0 + ("hot copy " * 20).encode())]  # only the text larger than a shard
    again = {(r.doc_id, r.shard, r.slot) for r in S.shard_by_bytes(df.repartition(2), 20).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}  # the input's partitions don't matter


def test_odd_rows(spark, odd, nothing):
    texts = [r.text for r in odd.select("text").collect()]
    check(S.shard_by_bytes(odd, 5).collect(), texts, 5)
    assert S.shard_by_bytes(nothing, 5).collect() == []
    check(S.shard_by_bytes(odd.limit(1), 5).collect(), [odd.limit(1).first().text], 5)


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    monkeypatch.setattr(S, "RANGES_PER_SHARD", 8)
    docs = ["a"] * 900 + [f"t{i}" * 9 for i in range(300)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    sizes = check(S.shard_by_bytes(df, 10).collect(), docs, 10)
    assert max(sizes.values()) < 1.3 * min(sizes.values())


def brute_force(rows, shards):
    """(doc_id, size, shard, slot) by sorting all records in one list: positions, then boundaries that move to a group's edge."""
    signed = lambda t: (h := xxhash.xxh64(t.encode(), 42).intdigest()) - (h >> 63 << 64)
    order = sorted((signed(t or ""), i, len((t or "").encode()) + 16) for i, t in rows)
    total, at, placed = sum(s for *_, s in order), 0, []
    for key, i, size in order:
        placed.append((key, i, size, at))
        at += size
    cuts = []
    for j in range(1, shards):
        t = total * j // shards
        key, _, size, pos = next(r for r in placed if r[3] <= t < r[3] + r[2])
        lo, hi = min(r[3] for r in placed if r[0] == key), max(r[3] + r[2] for r in placed if r[0] == key)
        cut = lo if t - lo <= hi - t else hi
        if abs(cut - t) > S.SLACK * total / shards:
            cut = pos if t - pos <= pos + size - t else pos + size
        cuts.append(cut)
    seen, out = defaultdict(int), []
    for _, i, size, pos in placed:
        shard = sum(pos >= c for c in cuts)
        out.append((i, size, shard, seen[shard]))
        seen[shard] += 1
    return sorted(out)


def test_against_one_sorted_list(spark, tmp_path):
    rows = [(i, f"t {i} " * (1 + i * 7 % 60)) for i in range(700)] + [(700 + i, "copy é " * 9) for i in range(350)] + [(2000, ""), (2001, "x" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((r.doc_id, r.size, r.shard, r.slot) for r in S.shard_by_bytes(df, 12).collect()) == brute_force(rows, 12)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = S.op6_sampled_splitters(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.size, r.shard, r.slot) for r in got) == brute_force(rows, S.SHARDS) and {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_a_third_of_all_rows_is_one_row(spark, monkeypatch):
    """Equal ids and texts, and null ones: no range has more than its share of them."""
    monkeypatch.setattr(S, "RANGES_PER_SHARD", 8)
    docs = [(7, "same row of text")] * 2000 + [(None, None)] * 1500 + [(i, f"other {i}") for i in range(2500)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    sizes = check(S.shard_by_bytes(df, 10).collect(), [t for _, t in docs], 10)
    assert max(sizes.values()) < 1.1 * min(sizes.values())
    rows = S.keyed(df).cache()
    splitters = S.quantiles(S.draw(rows, 640, rows.agg({"size": "sum"}).first()[0], 0), 80)
    counts = sorted(r["count"] for r in S.ranged(rows, splitters).groupBy("range").count().collect())
    assert len(counts) > 60 and counts[-1] < 6000 / 80 * 6
