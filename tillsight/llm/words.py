"""Words of whole texts as numpy arrays: UTF-8 bytes in, word bounds and 64-bit word hashes out.

Everything works on blocks of rows of about ``BLOCK_BYTES`` and at most
``BLOCK_ROWS`` rows, so memory does not follow the size of an Arrow batch. A text longer than that is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
BLOCK_ROWS = 1024

_U = np.uint64
_BASE = 0x9E3779B97F4A7C55
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ``[^\x20\x09-\x0D]+``
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: digits, small letters and everything beyond ASCII
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (splitmix64's finisher)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers: dict[str, np.ndarray] = {}


def _power(base: int, size: int) -> np.ndarray:
    key = f"{base}"
    if key not in _powers or len(_powers[key]) < size:
        steps = np.full(max(size, BLOCK_BYTES + 1), base, _U)
        steps[0] = 1
        made = np.cumprod(steps)
        if size > BLOCK_BYTES + 1:  # a huge text: used once, not kept
            return made
        _powers[key] = made
    return _powers[key]


@dataclass
class Words:
    """Words of a block of texts; word ``i`` is ``data[starts[i]:ends[i]]``, text ``d`` has words ``bounds[d]:bounds[d + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def _sums(self) -> np.ndarray:
        sums = np.zeros(len(self.data) + 1, _U)
        np.cumsum((self.data.astype(_U) + _U(1)) * _power(_BASE, len(self.data) + 1)[: len(self.data)], out=sums[1:])
        return sums

    def hashes(self, *prefixes: int) -> list[np.ndarray]:
        """Hashes of the whole words, then of their first ``p`` bytes for each ``p``."""
        sums, back = self._sums(), _power(_BASE_INVERSE, len(self.data) + 1)
        out = []
        for p in (0, *prefixes):
            ends = np.minimum(self.starts + p, self.ends) if p else self.ends
            length = (ends - self.starts).astype(_U)
            out.append(mix((sums[ends] - sums[self.starts]) * back[self.starts] + (length << _U(48)) + _U(p)))
        return out


def split(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> Words:
    """Words of texts ``data[offsets[d]:offsets[d + 1]]`` whose bytes are in ``kind``; A-Z counts as a-z."""
    data = LOWER[data]
    mask = np.zeros(len(data) + 2, bool)
    mask[1:-1] = kind[data]
    first, last = mask[1:-1] & ~mask[:-2], mask[1:-1] & ~mask[2:]
    edges = offsets[1:-1]
    inner = edges[(edges > 0) & (edges < len(data))]
    first[inner] = mask[1:-1][inner]  # a word ends where its text ends
    last[inner - 1] = mask[1:-1][inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def text_blocks(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row + 1, bytes, offsets)`` of consecutive blocks of texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = pc.fill_null(column.cast(pa.large_string()), "")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, "right")) - 1
        stop = min(max(stop, row + 1), row + BLOCK_ROWS, len(column))
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(text, hash)`` of every run of ``size`` words; a shorter text counts as one run."""
    word = words.hashes()[0]
    total, counts = len(word), words.counts
    run = np.zeros(total, _U)
    short = []
    for k in range(size):
        run[: total - k] = run[: total - k] * _U(0xD6E8FEB86659FD93) + word[k:]
        if k + 1 < size:
            docs = np.flatnonzero(counts == k + 1)
            short.append((docs, mix(run[words.bounds[docs]] + _U(k + 1))))
    place = np.arange(total)
    owner = words.owner()
    full = place + size <= words.bounds[1:][owner]
    texts = np.concatenate([owner[full], *[d for d, _ in short]])
    return texts, np.concatenate([mix(run[full]), *[h for _, h in short]])


def distinct(texts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(text, hash)``, sorted."""
    order = np.lexsort((hashes, texts))
    texts, hashes = texts[order], hashes[order]
    keep = np.ones(len(texts), bool)
    keep[1:] = (texts[1:] != texts[:-1]) | (hashes[1:] != hashes[:-1])
    return texts[keep], hashes[keep]
