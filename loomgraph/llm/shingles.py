"""Shingle hashes of whole texts in numpy, for use inside tasks.

Words are maximal runs of bytes other than blanks, with A-Z lower-cased. A
shingle is five words in a row; a text with fewer words has one shingle, all its
words; a text without words has none. Everything is hashed to 64 bits, the same
in every process. Texts are handled a megabyte at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

WIDTH = 5
_SLICE = 1 << 20

_random = np.random.Generator(np.random.PCG64(20240229))
# A value per byte, blanks aside; multiplying by an odd base can be undone modulo 2^64.
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, size: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < size:
        steps = np.full(max(size, _SLICE + 4096), base, dtype=np.uint64)
        steps[0] = 1
        known = _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return known[:size]


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on all (the splitmix finaliser)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word of ``data``: a polynomial of its bytes, from running sums."""
    inside = np.empty(len(data) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~_BLANK[data]
    edges = np.diff(inside)
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), out=sums[1:])
    return mixed((sums[end] - sums[start]) * _powers(_INVERSE, len(data) + 1)[start]), start, end


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of all words, in pieces that end between words."""
    found, starts, ends, at = [], [], [], 0
    view = np.frombuffer(data, dtype=np.uint8)
    while at < len(data):
        stop = min(at + _SLICE, len(data))
        while stop < len(data) and not _BLANK[view[stop]]:
            gap = np.flatnonzero(_BLANK[view[stop : stop + 65536]])
            stop = stop + int(gap[0]) if len(gap) else min(stop + 65536, len(data))
        hashes, begin, end = _word_hashes(view[at:stop])
        found.append(hashes)
        starts.append(begin + at)
        ends.append(end + at)
        at = stop
    empty = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(found or [empty[0].view(np.uint64)]), np.concatenate(starts or empty), np.concatenate(ends or empty)


def _fold(parts: list[np.ndarray]) -> np.ndarray:
    total = parts[0]
    for part in parts[1:]:
        total = total * np.uint64(_BASE) + part
    return mixed(total)


def shingle_sets(texts: Iterable[bytes | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes (uint64) of each text, in order."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append(text or b"")
        size += len(held[-1]) + 1
        if size >= _SLICE:
            yield from _sets(held, width)
            held, size = [], 0
    yield from _sets(held, width)


def _sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    hashes, starts, _ = word_hashes(b" ".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, dtype=np.int64)
    bounds = np.concatenate([[0], np.searchsorted(starts, ends)])
    runs = len(hashes) - width + 1
    every = _fold([hashes[i : i + runs] for i in range(width)]) if runs > 0 else hashes[:0]
    for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if last - first >= width:
            yield np.unique(every[first : last - width + 1])
        elif last > first:
            short = _fold([hashes[i : i + 1] for i in range(first, last)])
            yield mixed(short + np.uint64(last - first))
        else:
            yield hashes[:0]


def set_id(shingles: np.ndarray) -> int:
    """One signed 64-bit hash for a whole set."""
    place = np.arange(1, len(shingles) + 1, dtype=np.uint64)
    total = mixed(shingles + place * np.uint64(_BASE)).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mixed(np.array([total]))[0].view(np.int64))
