"""Runs of bytes in whole texts as dictionary-encoded arrays (task side)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from runsieve.llm.common import ship

ship(__name__)

_BASE = np.uint64(0x9E3779B97F4A7C15)


def byte_class(chars: str) -> np.ndarray:
    """A mask over byte values that holds the ASCII characters given."""
    mask = np.zeros(256, dtype=bool)
    mask[[ord(c) for c in chars]] = True
    return mask


def slices(data: bytes, breaks: np.ndarray, limit: int) -> Iterator[bytes]:
    """A text in parts of about ``limit`` bytes that end at a breaking byte; a run without one stays whole."""
    lo = 0
    while len(data) - lo > limit:
        hi = lo + limit
        while hi < len(data):
            at = np.flatnonzero(breaks[np.frombuffer(data, np.uint8, min(limit, len(data) - hi), hi)])
            if len(at):
                hi += int(at[0])
                break
            hi = min(hi + limit, len(data))
        yield data[lo:hi]
        lo = hi
    yield data[lo:]


def runs(raw: np.ndarray, breaks: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes outside ``breaks``, and those bytes one run after the other.
    ``cut`` marks bytes at which a further run begins."""
    inside = ~breaks[raw]
    if cut is None:
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        return edges[::2], edges[1::2], raw[inside]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:]
    last[:-1] &= ~inside[1:] | cut[1:]
    return np.flatnonzero(first), np.flatnonzero(last) + 1, raw[inside]


def encoded(letters: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Each run as a number, and the distinct runs by number."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    got = words.dictionary_encode()
    return got.indices.to_numpy(), got.dictionary


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each entry of a dictionary of non-empty byte strings."""
    if not len(words):
        return np.empty(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    lengths = np.diff(offsets)
    letters = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)
    firsts = offsets[:-1] - offsets[0]
    powers = np.multiply.accumulate(np.full(int(lengths.max()), _BASE, dtype=np.uint64))
    place = np.arange(len(letters)) - np.repeat(firsts, lengths)
    return np.add.reduceat(letters * powers[place], firsts) + lengths.astype(np.uint64)
