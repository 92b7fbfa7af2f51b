"""Words of many texts at once: offsets and 64-bit hashes in numpy, straight from Arrow's buffers.

A word is a longest run of bytes other than space and 0x09-0x0D, with A-Z lower-cased. Texts are
cut into chunks of whole documents, so memory follows the chunk size or the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_constants(n: int, seed: int) -> np.ndarray:
    steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(steps + np.uint64(seed)) | np.uint64(1)


_BYTE = odd_constants(256, 11)
_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Words:
    """Words of consecutive documents; those of document i are ``[first[i], first[i + 1])``."""

    data: np.ndarray  # the chunk's bytes
    bounds: np.ndarray  # document i is data[bounds[i]:bounds[i + 1]]
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a string column; NULL counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, bounds


def chunks(texts: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first document, bytes, bounds) of pieces of whole documents."""
    raw, bounds = text_buffers(texts)
    n, at = len(bounds) - 1, 0
    while at < n:
        stop = int(np.searchsorted(bounds, bounds[at] + chunk_bytes, side="right")) - 1
        stop = min(n, max(stop, at + 1))
        low = bounds[at]
        yield at, raw[low : bounds[stop]], bounds[at : stop + 1] - low
        at = stop


def find_words(data: np.ndarray, bounds: np.ndarray) -> Words:
    n = len(data)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = ~_SPACE[data]
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = inside[:n]
    cut = np.zeros(n + 1, dtype=bool)
    cut[bounds] = True
    start = np.flatnonzero(inside & (~before | cut))
    end = np.flatnonzero(before & (~inside | cut))
    power, inverse = _powers(_BASE, n), _powers(_INVERSE, n)
    summed = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[LOWER[data]] * power[:n], out=summed[1:])
    raw = (summed[end] - summed[start]) * inverse[start]
    hashes = mix(raw + (end - start).astype(np.uint64))
    return Words(data, bounds, start, end, hashes, np.searchsorted(start, bounds))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): each document's ``size``-word shingles, or its whole text if it is shorter."""
    weight = odd_constants(size, 29)
    counts = words.counts
    n_out = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    first = np.concatenate([[0], np.cumsum(n_out)])
    out = np.zeros(first[-1], dtype=np.uint64)
    full = max(0, len(words.hash) - size + 1)
    whole = np.zeros(full, dtype=np.uint64)
    for k in range(size):
        whole += words.hash[k : k + full] * weight[k]
    owner = np.repeat(np.arange(len(counts)), n_out)
    place = words.first[:-1][owner] + (np.arange(first[-1]) - first[:-1][owner])
    long_enough = counts[owner] >= size
    out[long_enough] = whole[place[long_enough]]
    for doc in np.flatnonzero((counts > 0) & (counts < size)):
        own = words.hash[words.first[doc] : words.first[doc + 1]]
        out[first[doc]] = (own * weight[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return mix(out), first
