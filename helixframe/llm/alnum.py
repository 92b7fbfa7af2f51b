"""Runs of letters, digits and non-ASCII characters of many texts at once, in numpy from Arrow's buffers.

Only A-Z are lower-cased. A UTF-8 byte of 0x80 or more belongs to a non-ASCII character, so a
table over bytes tells word characters from the rest.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

from helixframe.llm import textbytes

_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass
class Spans:
    """Words of consecutive documents; those of document i are ``[first[i], first[i + 1])``."""

    data: np.ndarray  # lower-cased bytes
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def find_spans(data: np.ndarray, bounds: np.ndarray) -> Spans:
    """The words of a chunk whose document i is ``data[bounds[i]:bounds[i + 1]]``."""
    n = len(data)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = _INSIDE[data]
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = inside[:n]
    cut = np.zeros(n + 1, dtype=bool)
    cut[bounds] = True
    start = np.flatnonzero(inside & (~before | cut))
    end = np.flatnonzero(before & (~inside | cut))
    return Spans(textbytes.LOWER[data], start, end, np.searchsorted(start, bounds))


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_STEP = _crc_table()
#: Longer words are few; each is handled by itself.
SHORT = 64


def _after_zeros() -> np.ndarray:
    """[n, j, b]: what byte j of a checksum, with value b, becomes after n more zero bytes."""
    byte = np.arange(256, dtype=np.uint32)
    out = [np.stack([byte << np.uint32(8 * j) for j in range(4)])]
    for _ in range(SHORT):
        out.append(_STEP[out[-1] & 255] ^ (out[-1] >> np.uint32(8)))
    return np.stack(out)


_SHIFT = _after_zeros()


def crc32_words(words: Spans) -> np.ndarray:
    """The unsigned crc32 of every word's UTF-8 bytes."""
    length = words.end - words.start
    order = np.argsort(-np.minimum(length, SHORT + 1).astype(np.int16), kind="stable")
    start, cut = words.start[order], np.minimum(length, SHORT + 1)[order]
    state = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    longer = np.searchsorted(-cut, -np.arange(SHORT), side="left")  # words of more than k bytes come first
    for k in range(SHORT):
        m = longer[k]
        if not m:
            break
        state[:m] = _STEP[(state[:m] ^ words.data[start[:m] + k]) & 255] ^ (state[:m] >> np.uint32(8))
    out = np.empty(len(order), dtype=np.uint32)
    out[order] = ~state
    for i in np.flatnonzero(length > SHORT):
        out[i] = zlib.crc32(words.data[words.start[i] : words.end[i]])
    return out


def crc32_pairs(words: Spans, crc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(left, crc32) of every two neighbouring words of a document, joined by one space.

    The checksum of a concatenation is the left one moved on by as many zero bytes as the right part
    has, exclusive-or the right one's.
    """
    opens = np.zeros(len(crc) + 1, dtype=bool)
    opens[words.first] = True
    left = np.flatnonzero(~opens[1 : len(crc)])
    spaced = ~crc[left]
    spaced = ~(_STEP[(spaced ^ np.uint32(0x20)) & 255] ^ (spaced >> np.uint32(8)))
    length = (words.end - words.start)[left + 1]
    n = np.minimum(length, SHORT)
    moved = _SHIFT[n, 0, spaced & 255]
    for j in (1, 2, 3):
        moved ^= _SHIFT[n, j, (spaced >> np.uint32(8 * j)) & 255]
    out = moved ^ crc[left + 1]
    for i in np.flatnonzero(length > SHORT):
        right = left[i] + 1
        out[i] = zlib.crc32(words.data[words.start[right] : words.end[right]], int(spaced[i]))
    return left, out


_BYTE = textbytes.odd_constants(256, 37)
_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse up to n; the two tables are kept and grow to the longest chunk."""
    if not _POWERS or len(_POWERS[0][0]) <= n:
        both = np.ones((2, max(n, textbytes.CHUNK_BYTES) + 1), dtype=np.uint64)
        both[0, 1:], both[1, 1:] = _BASE, _INVERSE
        _POWERS[0] = tuple(np.cumprod(both, axis=1, dtype=np.uint64))
    return _POWERS[0]


def hash_words(words: Spans) -> np.ndarray:
    """A 64-bit hash of every word, of its bytes and their places in it."""
    n = len(words.data)
    power, inverse = _powers(n)
    summed = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[words.data] * power[:n], out=summed[1:])
    raw = (summed[words.end] - summed[words.start]) * inverse[words.start]
    return textbytes.mix(raw + (words.end - words.start).astype(np.uint64)).view(np.int64)
