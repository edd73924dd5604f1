"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

Texts become sets of five-word shingles.  Texts with the same words are one
node from the start, with a count of copies, so a group of copies costs one
row however large it is.  A node has ``trees`` paths of MinHash values, each in
a prefix trie of its own; sorted by their paths the members of a trie node stand
together, and the tries are held as the groups of equal prefixes, never in one
place.

Two nodes are candidates when they share a long enough prefix in any tree, and
how long that is the tries decide.  A node starts at the full depth and its
prefixes are shortened in two steps.  In each tree it goes up as long as the
trie node there holds at most ``LEAF`` texts, to ``base`` at most: where few
texts meet, short prefixes cost nothing.  Where many meet (near copies,
passages that many documents share) it stays deep, and only if the prefixes
that it has then wouldn't find a pair at the threshold with the target recall,
``1 - prod(1 - threshold ** k)`` over its trees' lengths k, the longest of them
are shortened together, level by level, until they do.  A trie node that any
text searches is searched for all texts below it.

Candidates are verified on their whole shingle sets.  Nodes that candidates
connect form a group; a group is dealt into chunks of bounded size, and each
pair of chunks is one task's block, so no group is collected and no pair is
ever a row: a block gives, for each of its nodes, its links (weighted with
copies) and the least node it is connected to; a pair of a group that is
verified is a link, whether or not it shares a prefix.  Where prefixes connect many
nodes loosely, the groups are the trie nodes instead, whichever needs fewer
rows; a pair then counts in the first tree that it shares.

Result: a row per document with its class (least doc_id of all connected
documents) and its number of links (other documents at the threshold or more).

Defined cases: a text with one to four words has one shingle, all its words;
null texts and texts without words are in no link, each is its own class;
repeated rows are copies; in an empty table there is nothing; other columns
are not read by the join and kept by ``dedupe``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import dealt, lean, materialize, slices, steady, table, texts_of, with_row_id
from ._words import hashed, mix64
from .components import components

WORDS = 5
THRESHOLD = 0.8
TREES = 24
RECALL = 0.999
#: levels of the tries below ``base``, the shortest prefix
STEPS = 3
#: texts up to which a trie node is searched at the next shorter prefix
LEAF = 32
#: nodes, and words, in a chunk of a group; groups of up to FINE chunks of FEW_NODES are dealt finer
CHUNK_NODES, FEW_NODES, FINE = 512, 128, 16
CHUNK_WORDS = 2_000_000
SEED = 20_240_601


def evidence(k: int, threshold: float) -> float:
    """What a prefix of k values adds to the logarithm of a missed pair's chance."""
    return -math.log1p(-(threshold**k))


def base_depth(trees: int = TREES, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The shortest prefix: one less than the longest that gives the recall in all trees alone."""
    k = 1
    while trees * evidence(k + 1, threshold) >= -math.log1p(-recall):
        k += 1
    return max(1, k - 1)


def shingles(docs: np.ndarray, words: np.ndarray, n_docs: int, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and 64-bit hashes of all shingles, in order."""
    total = len(words)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, total - n + 1), np.uint64)
        for k in range(n):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + words[k : total - n + 1 + k] if total >= n else rolled
        inside = docs[: total - n + 1] == docs[n - 1 :] if total >= n else np.zeros(0, bool)
        own, hashes = docs[: len(inside)][inside], mix64(rolled[inside])
        count = np.bincount(docs, minlength=n_docs)
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            first = np.searchsorted(docs, short)
            h = count[short].astype(np.uint64)
            for k in range(n - 1):
                more = count[short] > k
                h = np.where(more, h * np.uint64(0x9E3779B97F4A7C15) + words[np.minimum(first + k, total - 1)], h)
            own, hashes = np.concatenate([own, short]), np.concatenate([hashes, mix64(h)])
            order = np.argsort(own, kind="stable")
            own, hashes = own[order], hashes[order]
    return own, hashes


def content(docs: np.ndarray, words: np.ndarray, n_docs: int) -> np.ndarray:
    """Two 64-bit numbers for each text's sequence of words."""
    out = np.zeros((2, n_docs), np.uint64)
    if len(words):
        first = np.concatenate([[0], np.flatnonzero(np.diff(docs)) + 1])
        place = (np.arange(len(docs)) - np.repeat(first, np.diff(np.append(first, len(docs))))).astype(np.uint64)
        with np.errstate(over="ignore"):
            for k, c in enumerate((0xD6E8FEB86659FD93, 0xA3B195354A39B70D)):
                out[k, docs[first]] = np.add.reduceat(mix64((words ^ np.uint64(c)) + place * np.uint64(0xC2B2AE3D27D4EB4F)), first)
    return out


def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**31, n, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, np.uint32)


def paths_of(own: np.ndarray, hashes: np.ndarray, n_docs: int, trees: int, base: int) -> np.ndarray:
    """(texts, 2 * trees): for each tree a number for the first ``base`` MinHash values, and the next
    STEPS values as 16 bits each, the first one highest; 0 without shingles."""
    out = np.zeros((n_docs, 2 * trees), np.uint64)
    if len(own):
        first = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        depth = base + STEPS
        a, b = multipliers(trees * depth)
        with np.errstate(over="ignore"):
            for t in range(trees):
                key, rest = np.full(len(first), t + 1, np.uint64), np.zeros(len(first), np.uint64)
                for j in range(depth):
                    least = np.minimum.reduceat(x * a[t * depth + j] + b[t * depth + j], first).astype(np.uint64)
                    if j < base:
                        key = mix64(key ^ least)
                    else:
                        rest = (rest << np.uint64(16)) | (mix64(least) >> np.uint64(48))
                out[own[first], 2 * t], out[own[first], 2 * t + 1] = key, rest
    return out


def signatures(rows: DataFrame, base: int, trees: int = TREES) -> DataFrame:
    """rid, doc_id, n_words, h1, h2 and the trie paths of rows (rid, doc_id, text)."""

    def run(batches):
        for batch in slices(batches, "text"):
            n = batch.num_rows
            docs, words = hashed(texts_of(batch, "text"))
            h = content(docs, words, n)
            paths = paths_of(*shingles(docs, words, n), n, trees, base)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.bincount(docs, minlength=n)), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * n * trees + 1, 2 * trees, dtype=np.int32)), pa.array(paths.view(np.int64).ravel()))],
                names=["rid", "doc_id", "n_words", "h1", "h2", "paths"])

    return rows.mapInArrow(lean(run), "rid long, doc_id long, n_words long, h1 long, h2 long, paths array<long>")


def shortened(shared: DataFrame, base: int, trees: int, threshold: float, recall: float, leaf: int = LEAF) -> DataFrame:
    """node, tree, depth and key of the prefix that each path ends up with. ``shared``: node, tree, key, rest and
    n (texts with this key) of the paths that aren't alone at ``base``."""
    depth, few = base + STEPS, shared.where(F.col("n") <= leaf).select("node", "tree", F.lit(base).alias("depth"), F.xxhash64("key", F.lit(0).cast("long"), F.lit(base)).alias("key"))
    many = shared.where(F.col("n") > leaf).select("node", "tree", "key", "rest")
    up = lambda k: F.call_function("shiftright", F.col("rest"), F.lit(16 * (depth - k)))
    levels = list(range(base + 1, depth))
    # texts of the trie nodes, from the full paths up
    full = many.groupBy("key", "rest").agg(F.count("*").alias("n"))
    sized = full.select("key", "rest", F.col("n").alias(f"n{depth}"))
    for k in levels:
        above = full.groupBy("key", up(k).alias("p")).agg(F.sum("n").alias(f"n{k}"))
        sized = sized.withColumn("p", up(k)).join(above, ["key", "p"]).drop("p")
    wanted = F.lit(depth)
    for k in reversed(levels):
        wanted = F.when(F.col(f"n{k}") <= leaf, k).otherwise(wanted)
    paths = many.join(sized.select("key", "rest", wanted.alias("wanted")), ["key", "rest"])
    # how deep each node may stay for the recall: its other trees are at base
    counts = paths.groupBy("node").agg(*(F.count(F.when(F.col("wanted") == k, 1)).alias(f"c{k}") for k in range(base + 1, depth + 1)))
    alone = F.lit(trees) - sum((F.col(f"c{k}") for k in range(base + 1, depth + 1)), F.lit(0))
    limit = F.lit(base)
    for x in range(base + 1, depth + 1):
        found = alone * F.lit(evidence(base, threshold)) + sum((F.col(f"c{k}") * F.lit(evidence(min(k, x), threshold)) for k in range(base + 1, depth + 1)), F.lit(0.0))
        limit = F.when(found >= F.lit(-math.log1p(-recall)), x).otherwise(limit)
    own = materialize(paths.join(counts.select("node", limit.alias("most")), "node").select("node", "tree", "key", "rest", F.least("wanted", "most").alias("d")), "depths")
    # the shortest prefix that any text below it searches
    searched = own.groupBy("key", "rest").agg(*(F.max((F.col("d") == k).cast("int")).alias(f"s{k}") for k in (base, *levels)))
    ends, at = searched.select("key", "rest"), F.lit(depth)
    for k in reversed((base, *levels)):
        above = searched.groupBy("key", up(k).alias("p")).agg(F.max(f"s{k}").alias(f"a{k}"))
        ends = ends.withColumn("p", up(k)).join(above, ["key", "p"]).drop("p")
        at = F.when(F.col(f"a{k}") == 1, k).otherwise(at)
    ends = ends.select("key", "rest", at.alias("depth"))
    prefix = F.lit(0).cast("long")
    for k in range(base + 1, depth + 1):
        prefix = F.when(F.col("depth") == k, up(k)).otherwise(prefix)
    deep = own.select("node", "tree", "key", "rest").join(ends, ["key", "rest"]).select("node", "tree", "depth", F.xxhash64("key", prefix, "depth").alias("key"))
    return few.unionByName(deep)


def linked(texts: list[bytes], keys: np.ndarray | None, chunk: np.ndarray, across: bool, tree: int, threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs of a block that have the Jaccard similarity. In a block of
    two chunks only pairs across count; in a block of a trie node (``tree`` from 0) only pairs
    that share no earlier tree's prefix (``keys``, 0 for none)."""
    m = len(texts)
    own, hashes = shingles(*hashed(texts), m)
    order = np.lexsort((own, hashes))
    own, hashes = own[order], hashes[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (hashes[1:] != hashes[:-1])
    own, hashes = own[new], hashes[new]
    size = np.bincount(own, minlength=m)
    run = np.cumsum(np.concatenate([[True], hashes[1:] != hashes[:-1]])) - 1 if len(hashes) else np.empty(0, np.int64)
    shared = np.bincount(run)[run] > 1 if len(run) else np.empty(0, bool)
    own, column = own[shared], np.unique(run[shared], return_inverse=True)[1]
    common = np.zeros((m, m), np.float32)
    width = max(64, (1 << 21) // max(m, 1))
    n_columns = int(column.max()) + 1 if len(column) else 0
    at = np.searchsorted(column, np.arange(0, n_columns + width, width))
    for c, (lo, hi) in enumerate(zip(at, at[1:])):
        x = np.zeros((m, min(width, n_columns - c * width)), np.float32)
        x[own[lo:hi], column[lo:hi] - c * width] = 1
        common += x @ x.T
    either = size[:, None] + size[None, :] - common
    out = (common > 0) & (common >= threshold * either - 1e-9)
    np.fill_diagonal(out, False)
    if across:
        out &= chunk[:, None] != chunk[None, :]
    if tree >= 0:
        for i in np.flatnonzero(out.any(1)):
            js = np.flatnonzero(out[i])
            out[i, js] = ((keys[js] == keys[i]) & (keys[i] != 0)).argmax(1) == tree
    return out


def least_connected(link: np.ndarray) -> np.ndarray:
    """For each node of a block the least index that links connect it to."""
    root = np.arange(len(link))
    while True:
        lowest = np.where(link, root[None, :], len(link)).min(1, initial=len(link))
        new = np.minimum(root, lowest)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def verify(blocks: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root) for the nodes of each block that have links in it. ``blocks``:
    g1, g2, g3 (the block), tree, chunk, node, copies, h1, keys, text."""
    kept = ["g1", "g2", "g3", "tree", "chunk", "node", "copies", "h1", "keys", "text"]

    def close(rows: list) -> pa.RecordBatch | None:
        rows.sort(key=lambda r: r[5])
        texts, keys = [r[9] for r in rows], np.array([r[8] for r in rows], np.int64) if rows[0][3] >= 0 else None
        if any(int(h.astype(np.int64)) != r[7] for h, r in zip(content(*hashed(texts), len(rows))[0], rows, strict=True)):
            raise RuntimeError("the input's rows changed between two reads")
        link = linked(texts, keys, np.array([r[4] for r in rows]), rows[0][1] != rows[0][2], rows[0][3], threshold)
        some = np.flatnonzero(link.any(1))
        if not len(some):
            return None
        node, copies, root = np.array([r[5] for r in rows]), np.array([r[6] for r in rows]), least_connected(link)
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array((link[some] @ copies).astype(np.int64)), pa.array(node[root[some]])], names=["node", "links", "root"])

    def run(batches):
        group, held = None, []
        for batch in slices(batches, "text"):
            columns = [texts_of(batch, c) if c == "text" else batch.column(batch.schema.get_field_index(c)).to_pylist() for c in kept]
            for row in zip(*columns, strict=True):
                if row[:3] != group:
                    if len(held) > 1 and (out := close(held)) is not None:
                        yield out
                    group, held = row[:3], []
                held.append(row)
        if len(held) > 1 and (out := close(held)) is not None:
            yield out

    placed = blocks.select(*kept).repartition("g1", "g2", "g3").sortWithinPartitions("g1", "g2", "g3")
    return placed.mapInArrow(lean(run), "node long, links long, root long")


def block_rows(nodes: DataFrame, group: str, sizes: DataFrame, tree) -> DataFrame:
    """Deals groups into chunks; every pair of chunks is a block. ``sizes``: group, chunks."""
    placed = nodes.join(dealt(sizes), group).withColumn("chunk", F.pmod(F.xxhash64(F.col("node"), F.lit(7)), F.col("chunks")).cast("long"))
    other = F.explode(F.when(F.col("chunks") > 1, F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)).otherwise(F.array(F.lit(0).cast("long"))))
    placed = placed.withColumn("other", other)
    return placed.select(F.col(group).alias("g1"), F.least("chunk", "other").alias("g2"), F.greatest("chunk", "other").alias("g3"), tree.cast("int").alias("tree"), "chunk", "node")


def chunk_count():
    n = F.count("*")
    by_nodes = F.greatest(F.ceil(n / F.lit(CHUNK_NODES)), F.least(F.ceil(n / F.lit(FEW_NODES)), F.lit(FINE)))
    return F.greatest(by_nodes, F.ceil(F.sum("n_words") / F.lit(CHUNK_WORDS))).cast("long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, leaf: int = LEAF) -> DataFrame:
    """rid, doc_id, class_rid, class_id, n_links, n_copies for every row; rid as with_row_id() numbers them."""
    base = base_depth(trees, threshold, recall)
    rows = with_row_id(steady(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).select("rid", "doc_id", "text")
    sig = materialize(signatures(rows, base, trees), "signatures")
    worded = sig.where("n_words > 0")
    reps = worded.groupBy("h1", "h2").agg(F.min("rid").alias("node"), F.count("*").alias("copies"), F.min("doc_id").alias("least_id"))
    nodes = materialize(reps.join(dealt(sig.select(F.col("rid").alias("node"), "n_words", "paths")), "node"), "nodes")
    path = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.get("paths", 2 * t).alias("key"), F.get("paths", 2 * t + 1).alias("rest")))
    paths = nodes.select("node", F.inline(path))
    met = paths.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(paths.join(met, "key"), "shared-paths")
    ends = materialize(shortened(shared, base, trees, threshold, recall, leaf).join(dealt(nodes.select("node", "n_words")), "node"), "prefixes")
    tries = ends.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lead"), chunk_count().alias("chunks"), F.min("tree").alias("tree")).where("n > 1")
    tries = materialize(tries, "tries")
    hits = materialize(ends.select("node", "key").join(dealt(tries), "key"), "hits")
    groups = components(hits.select(F.col("node").alias("a"), F.col("lead").alias("b")))
    member = groups.select(F.col("a").alias("node"), F.col("b").alias("grp")).unionByName(groups.select(F.col("b").alias("node"), F.col("b").alias("grp")).distinct())
    member = materialize(member.join(dealt(nodes.select("node", "n_words")), "node"), "members")
    whole = member.groupBy("grp").agg(chunk_count().alias("chunks"), F.count("*").alias("m"))
    loose = hits.join(dealt(member.select("node", "grp")), "node").groupBy("grp").agg(F.sum("chunks").alias("loose_rows"))
    plan = materialize(whole.join(loose, "grp").withColumn("by_group", F.col("m") * F.col("chunks") <= F.col("loose_rows")), "plans")
    by_group = block_rows(member.select("node", "grp"), "grp", plan.where("by_group").select("grp", "chunks"), F.lit(-1))
    scattered = member.join(plan.where("not by_group").select("grp"), "grp", "left_semi").select("node")
    by_trie = block_rows(hits.join(scattered, "node", "left_semi").select("node", "key", "tree"), "key", tries.select("key", "chunks"), F.col("tree"))
    entries = F.map_from_entries(F.collect_list(F.struct("tree", "key")))  # one a tree at most
    keys = hits.join(scattered, "node", "left_semi").groupBy("node").agg(entries.alias("m"))
    keys = keys.select("node", F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.coalesce(F.try_element_at("m", t), F.lit(0).cast("long"))).alias("keys"))
    payload = rows.select(F.col("rid").alias("node"), "text").join(dealt(member.select("node")), "node", "left_semi")
    payload = materialize(payload.join(dealt(nodes.select("node", "copies", "h1")), "node").join(keys, "node", "left"), "payload")
    found = materialize(verify(by_group.unionByName(by_trie).join(dealt(payload), "node"), threshold), "links")
    stars = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    info = nodes.select("node", "h1", "h2", "copies", "least_id").join(dealt(stars.select(F.col("a").alias("node"), F.col("b").alias("root"))), "node", "left").join(links, "node", "left")
    info = materialize(info.select("node", "h1", "h2", "copies", "least_id", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "node-classes")
    ids = info.groupBy("root").agg(F.min("least_id").alias("class_id"))
    joined = sig.select("rid", "doc_id", "n_words", "h1", "h2").join(info.join(ids, "root").select("h1", "h2", "root", "class_id", "copies", "links"), ["h1", "h2"], "left")
    alone = F.col("n_words") == 0
    return joined.select(
        "rid", "doc_id", F.when(alone, F.col("rid")).otherwise(F.col("root")).alias("class_rid"), F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"), F.when(alone, F.lit(1)).otherwise(F.col("copies")).cast("long").alias("n_copies"),
    )


def dedupe(docs: DataFrame, **options) -> DataFrame:
    """One row of each class stays: the first by (doc_id, row)."""
    docs = steady(docs)
    found = classes(docs, **options)
    kept = found.groupBy("class_rid").agg(F.min(F.struct("doc_id", "rid")).alias("k")).select(F.col("k.rid").alias("__rid"))
    return with_row_id(docs, "__rid").join(kept, "__rid", "left_semi").select(*docs.columns)


def op10_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def brute_force(texts: list[str | None], threshold: float = THRESHOLD, n: int = WORDS) -> list[tuple[int, int]]:
    """(least index of the class, links) for each text, comparing all pairs (for tests)."""
    from ._words import words

    sets = []
    for t in texts:
        w = words((t or "").encode())
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    m = len(texts)
    root, links = list(range(m)), [0] * m

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(m):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(find(i), links[i]) for i in range(m)]
