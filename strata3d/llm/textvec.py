"""Whole texts as numpy arrays: the shared small helpers of the text models.

Every function takes a list of texts (None counts as empty) and works on one flat array of code
points, so that the work per character is a few vector operations. Callers cut Arrow batches with
`pieces`, which bounds memory by CHUNK characters or by one text, whichever is larger.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np

#: Features of repeated tokens, by distance.
REPEATED = {1: 0x517CC1B727220A95, 2: 0x2545F4914F6CDD1D}
#: Characters worked on at a time.
CHUNK = 400_000
SPACE, LETTER, DIGIT, SIGN = 0, 1, 2, 3
_KIND = {"L": LETTER, "M": LETTER, "N": DIGIT, "Z": SPACE, "C": SPACE}
_BASE = np.uint64(0x9E3779B97F4A7C15)          # odd, so it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def pieces(texts: list[str | None], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together stay near `most` characters."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts end to end, and the row each belongs to."""
    texts = [t or "" for t in texts]
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) for t in texts])
    return flat, row


@cache
def _classes() -> np.ndarray:
    return np.array([_KIND.get(unicodedata.category(chr(i))[0], SIGN) for i in range(0x10000)],
                    np.uint8)


def classes(flat: np.ndarray) -> np.ndarray:
    """Letter (with its marks), digit, space or sign; signs beyond the basic plane as well."""
    out = _classes()[np.minimum(flat, 0xFFFF)]
    for c in np.unique(flat[flat > 0xFFFF]):
        out[flat == c] = _KIND.get(unicodedata.category(chr(c))[0], SIGN)
    return out


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK * 2)
        step = np.full(size, _BASE, np.uint64)
        back = np.full(size, _INVERSE, np.uint64)
        step[0] = back[0] = 1
        _POWERS[:] = [np.multiply.accumulate(step), np.multiply.accumulate(back)]
    return _POWERS[0], _POWERS[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hashes(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span, from prefix sums of a polynomial: no loop over spans."""
    power, back = _powers(len(flat) + 1)
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power[:len(flat)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * back[start])


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each token: a run of letters, of digits, or of one sign."""
    flat, row = codes(texts)
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    cls = classes(flat)
    new = np.ones(len(flat), bool)
    new[1:] = (cls[1:] != cls[:-1]) | (row[1:] != row[:-1]) | (
        (cls[1:] == SIGN) & (flat[1:] != flat[:-1]))
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(flat))
    held = cls[start] != SPACE
    start, end = start[held], end[held]
    return span_hashes(flat, start, end), row[start]


def with_pairs(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens followed by pairs of neighbouring tokens of one row."""
    if len(h) < 2:
        return h, row
    same = row[1:] == row[:-1]
    pair = mixed(h[:-1][same] * np.uint64(3) + h[1:][same])
    return np.concatenate([h, pair]), np.concatenate([row, row[1:][same]])


def repeats(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """One fixed feature for each token that equals the token `n` before it in its row."""
    at = np.flatnonzero((h[n:] == h[:-n]) & (row[n:] == row[:-n])) + n
    return np.full(len(at), REPEATED[n], np.uint64), row[at]


def counted(row: np.ndarray, feature: np.ndarray, bits: int) -> tuple[
        np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature (under 2^bits) and count of each distinct (row, feature), in that order."""
    key = np.sort((row << bits) | feature.astype(np.int64))
    if not len(key):
        return key, key, np.zeros(0, np.float32)
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    n = np.diff(np.append(at, len(key))).astype(np.float32)
    return key[at] >> bits, key[at] & ((1 << bits) - 1), n
