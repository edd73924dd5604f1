"""Packing into windows of 2048 tokens by the online sum-of-squares rule.

A document is its ids and then id 1.  Full windows are cut from its front; the
rest is placed whole.  ``level[f]`` counts the windows that are filled to f and
still open; the rest of length r goes to the level f (0 is a new window) whose
change of ``sum(level ** 2)`` is least, which keeps the levels even and so
finds later rests a place that fills a window exactly.

Every task packs the documents of its own input partition: nothing is
shuffled, and a task that is run again gives the same rows.  The open windows
a task holds are bounded (``most_open``): beyond that, and at the end, the
emptiest windows are cut up to fill the fullest ones.  What is left in the
last window is dealt into sequences whose lengths are powers of two, which
need no padding.

Defined cases: null and empty texts are the one id 1; a very long text is many
full windows and one rest; repeated rows are packed one by one; an empty table
gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ._bpe import Bpe
from ._common import lean, slices, table, texts_of

LENGTH = 2048
END = (1).to_bytes(4, "little")
VOCABULARY = "word_bpe_49k.json"
MOST_OPEN = 4096
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_BPE: dict[str, Bpe] = {}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def tokenizer(path: str) -> Bpe:
    if path not in _BPE:
        _BPE[path] = Bpe(path)
    return _BPE[path]


class Packer:
    """Sum-of-squares packing of documents' ids; rows come out as windows close."""

    def __init__(self, length: int = LENGTH, first_sequence: int = 0, most_open: int = MOST_OPEN):
        self.length, self.most_open = length, most_open
        self.next = first_sequence
        self.level = np.zeros(length + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(length + 1)]  # by fill: windows, each a list of pieces
        self.n_open = 0

    def place(self, r: int) -> int:
        """The level, 0 for a new window, whose use adds least to the sum of squares."""
        top = self.length - r
        leave = 1 - 2 * self.level[1 : top + 1]
        enter = 2 * self.level[r + 1 : self.length + 1] + 1
        enter[top - 1 :] = 0  # a full window is in no level
        change = np.where(self.level[1 : top + 1] > 0, leave + enter, np.iinfo(np.int64).max)
        fresh = 2 * self.level[r] + 1 if r < self.length else 0
        if not len(change):
            return 0
        best = len(change) - 1 - int(change[::-1].argmin())  # of equals the fullest
        return best + 1 if change[best] <= fresh else 0

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        total = len(ids) // 4
        at = 0
        while total - at >= self.length:
            yield from self.close([(doc_id, at, ids[4 * at : 4 * (at + self.length)], total)])
            at += self.length
        if at < total:
            piece = (doc_id, at, ids[4 * at :], total)
            r = total - at
            f = self.place(r)
            window = self.open[f].pop() if f else []
            if f:
                self.level[f] -= 1
            else:
                self.n_open += 1
            window.append(piece)
            if f + r == self.length:
                self.n_open -= 1
                yield from self.close(window)
            else:
                self.open[f + r].append(window)
                self.level[f + r] += 1
            if self.n_open > self.most_open:
                yield from self.drain(self.most_open // 2)

    def close(self, window: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, total in window:
            n = len(ids) // 4
            yield doc_id, start, n, zlib.crc32(ids), total, self.next, offset
            offset += n
        self.next += 1

    def drain(self, keep: int) -> Iterator[tuple]:
        """Cuts up the emptiest open windows to fill the fullest, until at most ``keep`` are open."""
        windows = [(f, w) for f in range(1, self.length) for w in self.open[f]]
        lo, hi = 0, len(windows) - 1
        while lo < hi and hi - lo + 1 > keep:
            fill, window = windows[hi]
            have, source = windows[lo]
            need = self.length - fill
            while need and source:
                doc_id, start, ids, total = source.pop()
                n = len(ids) // 4
                if n <= need:
                    window.append((doc_id, start, ids, total))
                else:  # the end of the piece stays in its window
                    window.append((doc_id, start, ids[: 4 * need], total))
                    source.append((doc_id, start + need, ids[4 * need :], total))
                    n = need
                need, have, fill = need - n, have - n, fill + n
            windows[lo], windows[hi] = (have, source), (fill, window)
            if not source:
                lo += 1
            if fill == self.length:
                yield from self.close(window)
                hi -= 1
        self.level[:] = 0
        self.open = [[] for _ in range(self.length + 1)]
        self.n_open = 0
        for fill, window in windows[lo : hi + 1]:
            self.open[fill].append(window)
            self.level[fill] += 1
            self.n_open += 1

    def finish(self) -> Iterator[tuple]:
        yield from self.drain(1)
        for window in [w for level in self.open for w in level]:
            rest = sum(len(p[2]) // 4 for p in window)
            queue = window[::-1]
            while rest:
                size = 1 << (rest.bit_length() - 1)
                taken, need = [], size
                while need:
                    doc_id, start, ids, total = queue.pop()
                    n = min(need, len(ids) // 4)
                    taken.append((doc_id, start, ids[: 4 * n], total))
                    if 4 * n < len(ids):
                        queue.append((doc_id, start + n, ids[4 * n :], total))
                    need -= n
                yield from self.close(taken)
                rest -= size


def pack_partition(batches: Iterable[pa.RecordBatch], path: str, length: int, id_col: str, text_col: str, partition: int) -> Iterator[pa.RecordBatch]:
    bpe, packer = tokenizer(path), Packer(length, partition << 32)

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7, names=[c.split()[0] for c in SCHEMA.split(", ")])

    for batch in slices(batches, text_col):
        ids, rows = batch.column(batch.schema.get_field_index(id_col)).to_pylist(), []
        for doc_id, encoded in zip(ids, bpe.encode(texts_of(batch, text_col)), strict=True):
            rows += packer.add(doc_id, encoded + END)
        if rows:
            yield out(rows)
    yield out(list(packer.finish()))
    bpe.forget()


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, as in SCHEMA. ``path``: the tokenizer file, by default the public one's place."""
    path = path or vocabulary_path()

    def run(batches):
        return pack_partition(batches, path, length, id_col, text_col, TaskContext.get().partitionId())

    return docs.select(docs[id_col].cast("long").alias(id_col), text_col).mapInArrow(lean(run), SCHEMA)


def op7_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
