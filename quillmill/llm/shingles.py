"""Words and word shingles as 64-bit numbers, computed over whole batches of texts with numpy."""

from __future__ import annotations

from functools import cache

import numpy as np

BLANKS = b" \t\n\x0b\x0c\r"
_FIRST, _LAST, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all others."""
    x = (x ^ (x >> np.uint64(30))) * _LAST
    x = (x ^ (x >> np.uint64(27))) * _TURN
    return x ^ (x >> np.uint64(31))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    byte = mix(np.arange(1, 257, dtype=np.uint64) * _FIRST) | np.uint64(1)
    blank = np.zeros(256, bool)
    blank[list(BLANKS)] = True
    return byte, blank


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse modulo 2 ** 64."""
    if not _powers or len(_powers[0]) < n:
        base = 0x5851F42D4C957F2D
        inverse = pow(base, -1, 1 << 64)
        size = max(n, 1 << 20)
        _powers[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)])) for x in (base, inverse)]
    return _powers[0], _powers[1]


#: Bytes that are hashed at once; longer inputs are taken in slices that end in white space.
SLICE = 1 << 20


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words (runs of bytes other than ASCII white space) of the texts in order: hash, text, first byte, end byte.

    Besides its result it needs some SLICE * 40 bytes (and that much for each SLICE of a longer word).
    """
    _, blank = _tables()
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    found, at = [], 0
    while at < len(data) - 1:
        stop = min(len(data), at + SLICE)
        while stop < len(data):  # on to the next white space
            gap = np.flatnonzero(blank[data[stop : stop + SLICE]])
            stop = min(len(data), stop + (int(gap[0]) + 1 if len(gap) else SLICE))
            if len(gap):
                break
        hashes, starts, ends = _hashed(data[at:stop])
        found.append((hashes, starts + at, ends + at))
        at = stop - 1  # the white space that ends this slice begins the next
    hashes, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    begins = np.concatenate([[1], 1 + np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    owner = np.searchsorted(begins, starts, "right") - 1
    return hashes, owner, starts - begins[owner], ends - begins[owner]


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and end byte of each word of bytes that begin and end with white space."""
    byte, blank = _tables()
    white = blank[data]
    starts = np.flatnonzero(white[:-1] & ~white[1:]) + 1
    ends = np.flatnonzero(~white[:-1] & white[1:]) + 1
    power, inverse = powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(byte[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + _FIRST * (ends - starts).astype(np.uint64)), starts, ends


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive numbers."""
    out = np.zeros(len(hashes) - k + 1, np.uint64)
    for i in range(k):
        out = mix(out * _TURN + hashes[i : len(hashes) - k + 1 + i] + _FIRST)
    return out


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its k-word shingles; a text with fewer words has one, of all its words."""
    hashes, owner, _, _ = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts))
    stops = np.cumsum(counts)
    every = runs(hashes, k) if len(hashes) >= k else np.zeros(0, np.uint64)
    out = []
    for stop, n in zip(stops.tolist(), counts.tolist(), strict=True):
        if n >= k:
            out.append(np.unique(every[stop - n : stop - k + 1]))
        elif n:
            out.append(runs(hashes[stop - n : stop], n) ^ np.uint64(n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
