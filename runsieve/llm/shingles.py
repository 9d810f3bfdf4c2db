"""Word shingles of whole texts as sets of 64-bit hashes (task side)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from runsieve.llm.common import ship

ship(__name__)

_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Bytes of text that are hashed together.
BLOCK_BYTES = 1 << 20
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def scramble(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Values of the first places of a word; later ones are computed.
_PLACES = scramble(np.arange(64 * 257, dtype=np.uint64) * _STEP)


def _letter_values(letters: np.ndarray, place: np.ndarray) -> np.ndarray:
    """An independent number for each byte value, 0 included, at each place of a word."""
    at = place * 257 + letters + 1
    values = _PLACES[np.minimum(at, len(_PLACES) - 1)]
    far = at >= len(_PLACES)
    if far.any():
        values[far] = scramble(at[far].astype(np.uint64) * _STEP)
    return values


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, _BASE, dtype=np.uint64))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start offset and hash of each run of non-blank bytes."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = ~_BLANK[raw]
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    lengths = ends - starts
    # Bytes of the words alone, word after word.
    letters = raw[inside].astype(np.int64)
    firsts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(letters)) - np.repeat(firsts, lengths)
    return starts, scramble(np.add.reduceat(_letter_values(letters, place), firsts))


def _join_words(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words."""
    n = len(words) - k + 1
    total = np.zeros(n, np.uint64)
    for i, p in enumerate(_powers(k)):
        total += words[i : i + n] * p
    return scramble(total)


def shingle_sets(texts: Iterable[str | None], k: int) -> Iterator[np.ndarray]:
    """The set of each text, ascending: distinct runs of ``k`` words with A-Z lower-cased; a text of fewer
    words is one run; a text without words, or null, is the empty set. Texts are taken as they are needed."""
    block, size = [], 0
    for text in texts:
        block.append((text or "").encode("utf-8", "surrogatepass").lower())
        size += len(block[-1]) + 1
        if size >= BLOCK_BYTES:
            yield from _block_sets(block, k)
            block, size = [], 0
    if block:
        yield from _block_sets(block, k)


def _block_sets(block: list[bytes], k: int) -> Iterator[np.ndarray]:
    starts, hashes = _word_hashes(b"\n".join(block))
    limits = np.searchsorted(starts, np.cumsum([0] + [len(b) + 1 for b in block]))
    for lo, hi in zip(limits[:-1], limits[1:]):
        words = hashes[lo:hi]
        yield np.unique(_join_words(words, min(k, len(words)))) if len(words) else words


def digest(items: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        a, b = scramble(items ^ _BASE).sum(dtype=np.uint64), scramble(items ^ _STEP).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def parity(items: np.ndarray, words: int) -> np.ndarray:
    """``words`` 64-bit words in which each item flips one bit: the bits in which two sets differ are at
    most the items in which they differ."""
    bits = np.bincount((items & np.uint64(words * 64 - 1)).astype(np.int64), minlength=words * 64) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)
