"""Words, shingles and signatures of many texts at once, as numpy arrays.

All functions work on whole texts. A list of texts is laid out in one byte buffer, so the
cost per text is a few array passes and no Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U64 = np.uint64
_PRIME = 0x9E3779B97F4A7C15 | 1
_STEP = 4096
BLOCK_BYTES = 1 << 20


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_LOW = _powers(_PRIME, _STEP)
_HIGH_BASE = pow(_PRIME, _STEP, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit integers (a bijection)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def blocks(texts: Iterable[str | bytes | None], size: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive runs of texts of about ``size`` bytes (one text may be longer): (first index, texts)."""
    first, held, total = 0, [], 0
    for i, text in enumerate(texts):
        data = b"" if text is None else text if isinstance(text, bytes) else text.encode("utf-8")
        if held and total + len(data) > size:
            yield first, held
            first, held, total = i, [], 0
        held.append(data)
        total += len(data) + 1
    if held:
        yield first, held


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of some texts, A-Z lowered.

    ``hash`` one 64-bit hash a word, ``first`` the word number at which each text begins (one
    entry more than texts), ``start`` and ``end`` byte places in ``data``, ``base`` the byte
    place at which each text begins.
    """

    def __init__(self, texts: list[bytes], lower: bool = True, letters: bool = False):
        """``letters``: words are runs of ASCII letters, digits and all non-ASCII characters instead."""
        self.raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", dtype=np.uint8)
        data = self.raw
        if lower:
            data = data | (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
        self.data = data
        if letters:
            word = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)) | ((data >= 65) & (data <= 90))
        else:
            word = (data != 32) & ((data < 9) | (data > 13))
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        self.start, self.end = edge[0::2], edge[1::2]
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.base = np.concatenate(([0], np.cumsum(lengths + 1))) + 1
        self.first = np.searchsorted(self.start, self.base)
        self.hash = self._hash(word)

    def _hash(self, word: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.empty(0, dtype=U64)
        size = self.end - self.start
        # Bytes of words only, each with its place inside its word.
        letters = self.data[word].astype(U64)
        begin = np.concatenate(([0], np.cumsum(size)[:-1]))
        place = np.arange(len(letters), dtype=np.int64) - np.repeat(begin, size)
        letters += U64(1)
        if int(size.max()) > _STEP:
            letters *= _powers(_HIGH_BASE, int(size.max()) // _STEP + 1)[place // _STEP]
            place %= _STEP
        letters *= _LOW[place]
        return mix(np.add.reduceat(letters, begin) + size.astype(U64) * U64(0xD6E8FEB86659FD93))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the ``k`` words from each shingle's first on, shingle number at which each text begins).

        A text of fewer words has its whole sequence as one shingle; without words, none.
        """
        count = np.diff(self.first)
        held = np.where(count >= k, count - k + 1, np.minimum(count, 1))
        offset = np.concatenate(([0], np.cumsum(held)))
        at = np.repeat(self.first[:-1] - offset[:-1], held) + np.arange(offset[-1])
        room = np.repeat(np.minimum(count, k), held)
        out = room.astype(U64)
        for j in range(k):
            out *= U64(0x9FB21C651E98DF25)
            out += np.where(j < room, self.hash[np.minimum(at + j, len(self.hash) - 1)], U64(0)) if len(at) else U64(0)
            out ^= out >> U64(29)
        return mix(out), offset


def distinct(values: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each run, and the new offsets."""
    parts = [np.unique(values[a:b]) for a, b in zip(offset[:-1], offset[1:])]
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    flat = np.concatenate(parts) if parts else np.empty(0, dtype=U64)
    return flat, np.concatenate(([0], np.cumsum(sizes)))


def minhashes(values: np.ndarray, offset: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """``count`` minima of each run of values, 16 bits of each, one row a run; rows of empty runs are zero."""
    out = np.zeros((len(offset) - 1, count), dtype=np.uint16)
    full = np.flatnonzero(np.diff(offset))
    if not len(full):
        return out
    draw = np.random.default_rng(seed).integers(0, 1 << 63, size=(2, count), dtype=np.int64).astype(U64)
    begin = offset[:-1][full]
    for j in range(count):
        turned = values * (draw[0, j] << U64(1) | U64(1))
        turned += draw[1, j]
        out[full, j] = (mix(np.minimum.reduceat(turned, begin)) >> U64(48)).astype(np.uint16)
    return out
