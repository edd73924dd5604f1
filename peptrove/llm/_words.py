"""Words of whole texts as numpy arrays.

A word is a maximal run of ASCII digits and letters and of non-ASCII
characters, after A-Z is lower-cased: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
On UTF-8 bytes that is one table look-up a byte, because every byte of a
non-ASCII character is 0x80 or more.
"""

from __future__ import annotations

import re

import numpy as np

#: byte -> lower-cased byte of a word, or a space
WORD_BYTES = bytes(
    (b + 32 if 0x41 <= b <= 0x5A else b) if (b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A) else 0x20
    for b in range(256)
)
WORD_RE = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
PIECE = 1 << 20

_MUL = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_POW: list[np.ndarray] = []


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64."""
    if not _POW or len(_POW[0]) < n:
        m = max(n, PIECE + (1 << 16))
        inverse = pow(_MUL, -1, 1 << 64)
        _POW[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m - 1, x, np.uint64)])) for x in (_MUL, inverse)]
    return _POW[0], _POW[1]


def mix64(h: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


def spans_of(norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs that aren't spaces."""
    inside = np.empty(len(norm) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = norm != 0x20
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def hash_spans(norm: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span: prefix sums of byte * power, shifted to position 0."""
    power, inverse = _powers(len(norm) + 1)
    total = np.empty(len(norm) + 1, np.uint64)
    total[0] = 0
    np.cumsum((norm.astype(np.uint64) + np.uint64(1)) * power[: len(norm)], out=total[1:])
    return mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def pieces(texts: list[bytes], table: bytes = WORD_BYTES, most: int = PIECE):
    """(first text, normalised bytes, lengths): whole texts up to ``most`` bytes together;
    a longer text comes in parts that end at a space, with the same number."""
    lo, held, size = 0, [], 0
    for i, t in enumerate(texts):
        n = t.translate(table)
        if size and size + len(n) > most:
            yield lo, held
            lo, held, size = i, [], 0
        if len(n) > most:
            at = 0
            while at < len(n):
                end = len(n) if len(n) - at <= most else n.rfind(b" ", at, at + most)
                if end <= at:
                    end = n.find(b" ", at + most)
                    end = len(n) if end < 0 else end
                yield i, [n[at:end]]
                at = end
            lo = i + 1
            continue
        held.append(n)
        size += len(n) + 1
    if held:
        yield lo, held


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For all words of all texts in order: the text's number, and the word's hash."""
    docs, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for first, held in pieces(texts):
        norm = np.frombuffer(b" ".join(held), np.uint8)
        if not len(norm):
            continue
        starts, ends = spans_of(norm)
        if not len(starts):
            continue
        begins = np.cumsum([0] + [len(x) + 1 for x in held])
        docs.append(first + np.searchsorted(begins, starts, "right") - 1)
        hashes.append(hash_spans(norm, starts, ends))
    return np.concatenate(docs), np.concatenate(hashes)
