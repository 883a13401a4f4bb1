"""Words of text columns as 64-bit hashes, computed on the UTF-8 bytes of an Arrow array with numpy.

A word is a run of bytes other than space and 0x09-0x0D; A-Z count as a-z. The bytes of a batch are worked on in
chunks that end between words, so memory is a small multiple of the text besides one number per word.

A word's hash is the sum of random numbers drawn for (place, byte). Two different words differ in such a number at some
place, so they collide with odds of 2^-64 whatever letters they are made of; a polynomial modulo 2^64 would not do, its
collisions are made of letters alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.default_rng(20240229)
PLACES = 64  # places with a table of their own; later ones mix the numbers of place and byte
PLAIN = _RNG.integers(0, 2**64, (PLACES + 1, 256), dtype=np.uint64)
FOLDED = PLAIN.copy()
FOLDED[:, 65:91] = FOLDED[:, 97:123]
FOLDED[:, _SPACE] = 0
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of the splitmix64 generator (fixed public constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values in a row and where each value starts (one more entry than values); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offs = np.frombuffer(where, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def place_hashes(part: np.ndarray, lead: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hash of each run of bytes from one start in `lead` to the next; bytes whose numbers are 0 in the table count as
    not there."""
    size = np.diff(np.append(lead, len(part)))
    place = np.arange(len(part), dtype=np.int64) - np.repeat(lead, size)
    numbers = table.reshape(-1)[(np.minimum(place, PLACES) << 8) | part]
    if len(size) and size.max() > PLACES:
        far = np.flatnonzero(place >= PLACES)
        there = numbers[far] != 0
        numbers[far] = mix(numbers[far] + place[far].astype(np.uint64) * _PLACE[0]) * there
    return mix(np.add.reduceat(numbers, lead)) if len(lead) else np.zeros(0, np.uint64)


def chunks(data: np.ndarray, offs: np.ndarray):
    """(first byte, bytes, is-space flags, positions of word starts) of chunks that cut no word."""
    n, cut = len(data), np.zeros(len(data) + 1, bool)
    cut[offs] = True
    a = 0
    while a < n:
        b = min(a + CHUNK, n)
        while b < n and not (cut[b] or _SPACE[data[b]]):
            more = np.flatnonzero(cut[b:b + CHUNK] | np.r_[_SPACE[data[b:b + CHUNK]], True][:len(cut[b:b + CHUNK])])
            b = b + int(more[0]) if len(more) else min(b + CHUNK, n)
        part = data[a:b]
        space = _SPACE[part]
        first = ~space
        first[1:] &= space[:-1] | cut[a + 1:b]
        yield a, part, space, np.flatnonzero(first)
        a = b


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each value's words start."""
    data, offs = utf8(column)
    hashes, starts = [], []
    for a, part, _, s in chunks(data, offs):
        if not len(s):
            continue
        hashes.append(place_hashes(part[s[0]:], s - s[0], FOLDED))
        starts.append(s + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offs)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of n words, in order."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    h = words[:count] * _PLACE[0]
    for j in range(1, n):
        h = h + words[j:j + count] * _PLACE[j]
    return mix(h + np.uint64(n))


def shingles(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of n words in a row; fewer words make one shingle, no word makes none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(grams(words, min(n, len(words))))


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i] + 1, ... of sizes[i] members, for all i in a row."""
    starts, sizes = starts.astype(np.int64), sizes.astype(np.int64)
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
