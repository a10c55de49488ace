"""64-bit hashes of the words of whole texts, computed on their UTF-8 bytes at once.

A word is a run of bytes other than ASCII white space, A-Z lower-cased. Its hash is that of the
polynomial of its bytes, which prefix sums over the text give for all words together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18  # the tables over a chunk's bytes stay in a core's cache
BASE = 0x9E3779B97F4A7C15


def _solid(data: np.ndarray) -> np.ndarray:
    """Bytes other than white space: the space, and the five from the tab on."""
    return (data - np.uint8(9) > 4) & (data != 32)


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, CHUNK_BYTES)
        _powers[:] = [
            np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))
            for base in (BASE, pow(BASE, -1, 2**64))
        ]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash(data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Word hashes of each of the texts that lie in `data` up to the given ends."""
    if not len(data):
        return [np.empty(0, np.uint64)] * len(ends)
    power, inverse = _power_tables(len(data))
    solid, edge = _solid(data), np.zeros(len(data) + 1, bool)
    edge[ends] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    values = (data + np.uint8(32) * (data - np.uint8(ord("A")) < 26)).astype(np.uint64)  # A-Z lower-cased
    values += np.uint64(1)
    values *= power[: len(data)]
    np.cumsum(values, out=sums[1:])
    hashes = mix((sums[stop] - sums[start]) * inverse[start])
    return np.split(hashes, np.searchsorted(start, ends[:-1]))


def hashed_texts(texts: pa.Array) -> Iterator[np.ndarray]:
    """Word hashes of each text in order; null is empty. Works in chunks cut between texts, and inside a
    longer text at white space."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, values = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK_BYTES, side="right")) - 1)
        upto = min(upto, len(texts))
        begin, end = int(ends[at]), int(ends[upto])
        if end - begin <= CHUNK_BYTES:
            yield from _hash(data[begin:end], ends[at + 1 : upto + 1] - begin)
        else:
            parts = []
            while begin < end:
                cut = min(end, begin + CHUNK_BYTES)
                if cut < end:
                    found = np.flatnonzero(~_solid(data[begin:cut]))
                    # a word longer than a chunk is taken whole
                    rest = np.flatnonzero(~_solid(data[cut:end])) if not len(found) else found
                    cut = begin + int(found[-1]) + 1 if len(found) else cut + int(rest[0]) if len(rest) else end
                parts += _hash(data[begin:cut], np.array([cut - begin]))
                begin = cut
            yield np.concatenate(parts)
        at = upto
