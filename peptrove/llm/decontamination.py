"""Benchmark decontamination with one Aho-Corasick automaton over words.

Test items are normalised to words; every 13 consecutive words of an item (all
of them, in an item with fewer) form a pattern over word numbers.  A document
is scanned once: its words are numbered by the benchmark's vocabulary (any
other word is 0, on which the automaton falls back to its root) and every
occurrence of every pattern is found, overlapping ones too.  Offsets in words
map back to character offsets of the original text.

Items of the same text are one, with all their ids.  The different texts are
small beside the documents, but they are never assumed to be: they are dealt
into blocks of about ``block_bytes``, each with an automaton of its own that is
broadcast, and one scan a block carries the hits on.  The driver holds one
block at a time.  With one block, which is the usual case, the texts are read
once.  A worker holds about 170 MB for an automaton of 1 MB of items, which is
what bounds a block.

Defined cases: null and empty texts have no words, no hits and aren't
contaminated; repeated rows each get a row; equal items are all reported; item
ids of any kind are read as text, a null id is the empty one; an
empty benchmark or table gives zeros or no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import as_one, extended, lean, materialize, slices, table, texts_of
from ._words import WORD_RE, words

WINDOW = 13
#: contaminated: at least one hit word, and one word in SHARE or more
SHARE = 20
BLOCK_BYTES = 1 << 20
CARRY = "item_ids array<string>, hit_from array<long>, hit_to array<long>"

_BUILT: dict[str, tuple] = {}


def patterns(texts: list[bytes], window: int = WINDOW) -> tuple[dict[bytes, int], dict[tuple, set[int]]]:
    """Numbers of the texts' words from 1, and the places of texts by pattern."""
    number: dict[bytes, int] = {}
    found: dict[tuple, set[int]] = {}
    for place, text in enumerate(texts):
        own = [number.setdefault(w, len(number) + 1) for w in words(text)]
        if own:
            for i in range(max(1, len(own) - window + 1)):
                found.setdefault(tuple(own[i : i + window]), set()).add(place)
    return number, found


def automaton(texts: list[bytes], window: int = WINDOW) -> tuple[dict[bytes, int], object]:
    number, found = patterns(texts, window)
    machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for pattern, places in found.items():
        machine.add_word(pattern, (len(pattern), tuple(places)))
    if found:
        machine.make_automaton()
    return number, machine if found else None


def occurrences(own: list[bytes], number: dict[bytes, int], machine) -> tuple[set[int], list[tuple[int, int]]]:
    """Places of item texts and [from, to) in words of all occurrences in one document."""
    places: set[int] = set()
    spans: list[tuple[int, int]] = []
    if machine is not None and own:
        for end, (n, here) in machine.iter(tuple([number.get(w, 0) for w in own])):
            places.update(here)
            if spans and spans[-1][1] >= end + 1 - n >= spans[-1][0]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], end + 1))
            else:
                spans.append((end + 1 - n, end + 1))
    return places, spans


def covered(spans: list[tuple[int, int]]) -> int:
    """Words inside any span."""
    n, last = 0, 0
    for lo, hi in sorted(spans):
        n += max(0, hi - max(lo, last))
        last = max(last, hi)
    return n


def char_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in words as [start, end) in characters of the original text."""
    at = [(m.start(), m.end()) for m in WORD_RE.finditer(text)]
    return [(at[lo][0], at[hi - 1][1]) for lo, hi in spans]


def item_blocks(benchmark: DataFrame, block_bytes: int, id_col: str, text_col: str) -> Iterator[tuple[list[bytes], list[list[str]], bool]]:
    """(texts, their ids, whether it is the last): all items in blocks that are each small enough to be
    broadcast, collected one at a time. Equal texts come once."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    items = rows.groupBy("t").agg(F.array_sort(F.collect_set("i")).alias("i"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("t") + F.aggregate("i", F.lit(0), lambda n, x: n + F.octet_length(x))), F.lit(0))).first()[0]
    if size > block_bytes:
        items = materialize(items, "items")
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        own = items.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k).collect()
        yield [r.t.encode() for r in own], [r.i for r in own], k == n - 1


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, spans: bool = False) -> DataFrame:
    """Columns ``keep`` of every row, n_words, n_hit, item_ids (sorted), and with
    ``spans`` the hit stretches as character offsets hit_from and hit_to."""
    spark = docs.sparkSession
    kept = docs.select(*keep).schema
    text = "__text"
    state = docs.select(*keep, F.col(text_col).alias(text), *(F.lit(None).cast(c.split(" ", 1)[1]).alias(c.split(" ", 1)[0]) for c in CARRY.split(", ")))
    for block, item_ids, last in item_blocks(benchmark, block_bytes, item_col, item_text):
        sent, name = spark.sparkContext.broadcast((block, item_ids)), uuid.uuid4().hex

        def run(batches, sent=sent, name=name, last=last):
            if name not in _BUILT:
                _BUILT.clear()
                _BUILT[name] = (*automaton(sent.value[0], window), sent.value[1])
            number, machine, ids_of = _BUILT[name]
            for batch in slices(batches, text):
                texts = texts_of(batch, text)
                before = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("item_ids", "hit_from", "hit_to")]
                n_words, n_hit, ids, los, his = [], [], [], [], []
                for t, a, lo, hi in zip(texts, *before, strict=True):
                    own = words(t)
                    found, stretches = occurrences(own, number, machine)
                    found = {i for k in found for i in ids_of[k]}.union(a or ())
                    stretches += list(zip(lo or (), hi or (), strict=True))
                    n_words.append(len(own))
                    n_hit.append(covered(stretches))
                    ids.append(sorted(found))
                    merged = merge(stretches)
                    if last:
                        merged = char_spans(t.decode("utf-8", "replace"), merged) if spans and merged else []
                    los.append([x for x, _ in merged])
                    his.append([x for _, x in merged])
                long_list = pa.list_(pa.int64())
                out = {f.name: batch.column(i) for i, f in enumerate(batch.schema) if f.name in kept.names}
                if not last:
                    out[text] = batch.column(batch.schema.get_field_index(text))
                else:
                    out |= {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64())}
                out |= {"item_ids": pa.array(ids, pa.list_(pa.string())), "hit_from": pa.array(los, long_list), "hit_to": pa.array(his, long_list)}
                yield pa.RecordBatch.from_pydict(out)

        middle = "n_words long, n_hit long" if last else f"`{text}` string"
        state = state.mapInArrow(lean(run), extended(kept, f"{middle}, {CARRY}"))
        if not last:
            state = materialize(state, "decontamination-block")
            sent.destroy()
    return state if spans else state.drop("hit_from", "hit_to")


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def is_contaminated(share: int = SHARE):
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with their columns."""
    return scan(as_one(docs), benchmark, ["__row"]).where(~is_contaminated()).select("__row.*")


def op2_aho_corasick(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    listed = F.array_join(F.array_sort("item_ids"), ",")
    return hits.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


OP2_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.p = bw.p),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM h) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s
       FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(it.s, '')) AS items_sha256,
       coalesce(hit.n_hit, 0) > 0 AND 20 * coalesce(hit.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""


def brute_force(text: str, items: dict[int, str], window: int = WINDOW) -> tuple[int, int, list[int]]:
    """n_words, n_hit and item ids by comparing every window (for tests)."""
    own, inside, ids = words(text.encode()), set(), set()
    for item_id, item in items.items():
        w = words(item.encode())
        n = min(window, len(w))
        wanted = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(own) - n + 1 if n else 0):
            if tuple(own[i : i + n]) in wanted:
                inside.update(range(i, i + n))
                ids.add(item_id)
    return len(own), len(inside), sorted(ids)


def digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
