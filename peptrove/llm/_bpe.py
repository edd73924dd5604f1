"""Byte-pair encoding of many short pieces at once, equal to the tokenizer file's.

The tokenizer library spends about 20 microseconds on a word; a corpus has
millions of different ones.  Here the pieces of equal byte length form a
matrix of symbol numbers, and in each round every row merges its pair of
lowest rank.  Plain texts (ASCII and Latin letters) are cut into pieces with
array operations and each different piece is encoded once, known by its 64-bit
hash; other texts go by dictionary of chunks, and what the matrix can't hold
(long pieces, unusual characters) goes to the library itself, so every id is
the library's.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import regex
from tokenizers import Tokenizer

from ._words import hash_spans

#: kinds of the bytes of plain texts: 0 white space, 1 letter, 2 digit, 3 other, 4 not plain
SPACE, LETTER, DIGIT, OTHER, ODD = range(5)
KIND = np.array(
    [
        SPACE if b == 0x20 or 9 <= b <= 13 else DIGIT if 0x30 <= b <= 0x39 else LETTER if 0x61 <= b <= 0x7A or 0x80 <= b <= 0xBF or 0xC3 <= b <= 0xC8 else ODD if b >= 0x80 or 0x1C <= b <= 0x1F else OTHER
        for b in range(256)
    ],
    np.uint8,
)

NEVER = np.int32(2**31 - 1)


class Bpe:
    """Ids of whitespace-free chunks of text, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, longest: int = 24, held: int = 200_000, held_pieces: int = 2_000_000):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab, merges = data["model"]["vocab"], data["model"]["merges"]
        pattern = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern).findall
        self.longest, self.held, self.cache = longest, held, {}
        self.held_pieces = held_pieces
        self.forget()
        shown = byte_characters()
        end = data["model"]["end_of_word_suffix"]
        self.inner = np.array([vocab[shown[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[shown[b] + end] for b in range(256)], np.int32)
        left = np.array([vocab[a] for a, _ in merges], np.uint64)
        right = np.array([vocab[b] for _, b in merges], np.uint64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self._table((left << np.uint64(16)) | right)

    def _table(self, codes: np.ndarray) -> None:
        """Open addressing over the merges' pairs, filled round by round."""
        self.bits = 18
        size = 1 << self.bits
        self.keys = np.full(size, 2**32 - 1, np.uint32)
        self.ranks = np.full(size, NEVER, np.int32)
        rest = np.arange(len(codes))
        step = 0
        while len(rest):
            slot = (self._slot(codes[rest]) + step) & (size - 1)
            free = self.keys[slot] == 2**32 - 1
            taken, first = np.unique(slot[free], return_index=True)
            who = rest[free][first]
            self.keys[taken], self.ranks[taken] = codes[who], who
            rest = np.setdiff1d(rest, who, assume_unique=True)
            step += 1
        self.probes = step

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        codes = ((left.astype(np.uint32) << np.uint32(16)) | right.astype(np.uint32)).ravel()
        slot = self._slot(codes)
        key = self.keys[slot]
        out = np.where(key == codes, self.ranks[slot], NEVER)
        rest = np.flatnonzero((key != codes) & (key != 2**32 - 1))
        for step in range(1, self.probes):
            if not len(rest):
                break
            at = (slot[rest] + step) & (len(self.keys) - 1)
            key = self.keys[at]
            same = key == codes[rest]
            out[rest[same]] = self.ranks[at[same]]
            rest = rest[~same & (key != 2**32 - 1)]
        return out.reshape(left.shape)

    def merge_rows(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of pieces given as rows of bytes, and how many each row has."""
        n, width = raw.shape
        symbols = self.inner[raw]
        symbols[:, -1] = self.final[raw[:, -1]]
        length = np.full(n, width)
        if width > 1:
            ranks = np.concatenate([self.rank(symbols[:, :-1], symbols[:, 1:]), np.full((n, 1), NEVER, np.int32)], 1)
            column = np.arange(width)
            active = np.arange(n)
            while True:
                r = ranks[active]
                at = r.argmin(1)
                best = r[np.arange(len(active)), at]
                go = best != NEVER
                if not go.any():
                    break
                active, at, best = active[go], at[go], best[go]
                rows = np.arange(len(active))
                s, r = symbols[active], r[go]
                s[rows, at] = self.merged[best]
                shift = np.minimum(column + (column > at[:, None]), width - 1)
                s, r = np.take_along_axis(s, shift, 1), np.take_along_axis(r, shift, 1)
                r[:, -1] = NEVER
                length[active] -= 1
                m = length[active]
                before = np.maximum(at - 1, 0)
                r[rows, before] = np.where(at > 0, self.rank(s[rows, before], s[rows, at]), r[rows, before])
                after = np.minimum(at + 1, width - 1)
                r[rows, at] = np.where(at + 1 < m, self.rank(s[rows, at], s[rows, after]), NEVER)
                symbols[active], ranks[active] = s, r
        return symbols, length

    def encode_equal(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of one length in bytes."""
        symbols, length = self.merge_rows(np.frombuffer(b"".join(pieces), np.uint8).reshape(len(pieces), -1))
        flat = symbols.astype("<u4")
        return [flat[i, : length[i]].tobytes() for i in range(len(pieces))]

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        groups: dict[int, list[tuple[str, bytes]]] = {}
        out = {}
        for p in pieces:
            b = p.encode()
            if len(b) <= self.longest:
                groups.setdefault(len(b), []).append((p, b))
            else:
                out[p] = self._by_library(p)
        for group in groups.values():
            for lo in range(0, len(group), 20_000):
                part = group[lo : lo + 20_000]
                out.update(zip((p for p, _ in part), self.encode_equal([b for _, b in part]), strict=True))
        return out

    def _by_library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, chunks: set[str]) -> None:
        """Puts the ids of these chunks into the cache."""
        if len(self.cache) + len(chunks) > self.held:
            self.cache.clear()
        parts: dict[str, list[str]] = {}
        for c in chunks:
            if max(c) < "ɐ":
                low = (c if c.isascii() else unicodedata.normalize("NFC", c)).lower()
                parts[c] = [low] if low.isalpha() else self.split(low)
            else:
                self.cache[c] = self._by_library(c)
        known = self.encode_pieces(list({p for own in parts.values() for p in own}))
        for c, own in parts.items():
            self.cache[c] = known[own[0]] if len(own) == 1 else b"".join([known[p] for p in own])

    def encode_by_chunk(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, each different chunk between white space once."""
        odd = regex.compile("[\x1c-\x1f]").search  # str.split takes these for white space, the tokenizer does not
        split = [None if odd(t) else t.split() for t in texts]
        missing = {c for own in split if own is not None for c in own}.difference(self.cache)
        if missing:
            if len(self.cache) + len(missing) > self.held:
                missing = {c for own in split if own is not None for c in own}
            self.learn(missing)
        get = self.cache.__getitem__
        return [self._by_library(t) if own is None else b"".join(map(get, own)) for t, own in zip(texts, split, strict=True)]

    def forget(self) -> None:
        """Known pieces: sorted hashes, and where their ids lie."""
        self.hashes = np.empty(0, np.uint64)
        self.places = np.empty(0, np.int64)
        self.counts = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)
        self.cache.clear()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of whole UTF-8 texts."""
        low: list[bytes] = []
        for t in texts:
            if t.isascii():
                low.append(t.lower())
            else:
                s = t.decode("utf-8", "replace")
                low.append((s if unicodedata.is_normalized("NFC", s) else unicodedata.normalize("NFC", s)).lower().encode())
        raw = np.frombuffer(b" ".join(low) + b" ", np.uint8)
        ends = np.cumsum([len(t) + 1 for t in low])
        kinds = KIND[raw]
        strange = np.flatnonzero((kinds == ODD) | (raw == 0xC3) & np.isin(np.append(raw[1:], 0), (0x97, 0xB7)))  # the signs for times and divided by
        other = set(np.unique(np.searchsorted(ends, strange, "right")).tolist())
        starts, lengths = self.cut(raw, kinds)
        hashes = hash_spans(raw, starts, starts + lengths)
        plain = ~np.isin(np.searchsorted(ends, starts, "right"), list(other)) if other else slice(None)
        starts, lengths, hashes = starts[plain], lengths[plain], hashes[plain]
        at = self.find(raw, starts, lengths, hashes)
        counts = self.counts[at]
        total = np.cumsum(counts)
        flat = self.ids[np.repeat(self.places[at] - (total - counts), counts) + np.arange(total[-1] if len(total) else 0)].astype("<u4")
        last = np.concatenate([[0], total])[np.searchsorted(starts, ends, "left")].tolist()
        out, lo = [], 0
        for hi in last:
            out.append(flat[lo:hi].tobytes())
            lo = hi
        if other:
            rest = sorted(other)
            for k, ids in zip(rest, self.encode_by_chunk([texts[k].decode("utf-8", "replace") for k in rest]), strict=True):
                out[k] = ids
        return out

    def cut(self, raw: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the pieces: runs of letters or of other characters, single
        digits, and the endings 's 't 're 've 'm 'll 'd."""
        edge = np.empty(len(raw) + 1, bool)
        edge[0] = edge[-1] = True
        edge[1:-1] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT)
        at = np.flatnonzero(edge)
        starts, ends = at[:-1], at[1:]
        kept = kinds[starts] != SPACE
        starts, ends = starts[kept].copy(), ends[kept].copy()
        quote = np.flatnonzero((raw[starts[:-1]] == 0x27) & (ends[:-1] - starts[:-1] == 1) & (starts[1:] == ends[:-1]) & (kinds[starts[1:]] == LETTER)) if len(starts) else []
        if len(quote):
            a, room = starts[quote + 1], ends[quote + 1] - starts[quote + 1]
            one, two = raw[a], raw[np.minimum(a + 1, len(raw) - 1)]
            pair = (room > 1) & ((one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
            n = np.where(np.isin(one, list(b"stmd")), 1, np.where(pair, 2, 0))
            ends[quote] += n
            starts[quote + 1] += n
        lengths = ends - starts
        return starts[lengths > 0], lengths[lengths > 0]

    def find(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Places of the pieces among the known ones, after the new ones are encoded."""
        every, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        new = every
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, new), len(self.hashes) - 1)
            unknown = self.hashes[at] != new
            if len(self.hashes) + unknown.sum() > self.held_pieces:
                self.forget()
            else:
                new, first = new[unknown], first[unknown]
        if len(new):
            counts, ids = np.zeros(len(new), np.int64), []
            places, done = np.zeros(len(new), np.int64), len(self.ids)
            size = lengths[first]
            order = np.argsort(size, kind="stable")
            for lo, hi in runs(size[order], 20_000):
                own = order[lo:hi]
                width = int(size[own[0]])
                if width <= self.longest:
                    symbols, length = self.merge_rows(raw[starts[first[own]][:, None] + np.arange(width)])
                    flat = symbols[np.arange(width) < length[:, None]]
                else:
                    each = [np.frombuffer(self._by_library(raw[s : s + width].tobytes().decode()), "<u4") for s in starts[first[own]]]
                    length, flat = np.array([len(x) for x in each]), np.concatenate(each)
                counts[own] = length
                places[own] = done + np.cumsum(length) - length
                done += len(flat)
                ids.append(flat.astype(np.uint32))
            merged = np.concatenate([self.hashes, new])
            order = np.argsort(merged, kind="stable")
            self.hashes, self.places, self.counts = merged[order], np.concatenate([self.places, places])[order], np.concatenate([self.counts, counts])[order]
            self.ids = np.concatenate([self.ids, *ids])
        return np.searchsorted(self.hashes, every)[which]


def runs(values: np.ndarray, most: int):
    """Ranges of equal values in a sorted array, of ``most`` at most."""
    at = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    for lo, hi in zip(at, at[1:]):
        for k in range(lo, hi, most):
            yield k, min(hi, k + most)


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies:
    printable ones stand for themselves, the others are numbered from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
