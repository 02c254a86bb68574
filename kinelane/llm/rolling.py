"""Vectorised 64-bit hashes of words, word windows and byte windows, from prefix sums of powers of an odd number."""

from __future__ import annotations

import numpy as np

_ROOT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BYTE = np.random.default_rng(64).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: True for bytes of words, which white space (blank, tab to carriage return) separates.
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of a text that are hashed at a time.
SEGMENT = 1 << 19
_tables: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """base ** i for i < n, modulo 2 ** 64."""
    if base not in _tables or len(_tables[base]) < n:
        out = np.full(max(n, SEGMENT + 4096), base, np.uint64)
        out[0] = 1
        _tables[base] = np.multiply.accumulate(out)
    return _tables[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit; arrays of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _prefix(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(len(values), base), out=out[1:])
    return out


def _between(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    inverse = pow(base, -1, 1 << 64)
    return (prefix[ends] - prefix[starts]) * _powers(len(prefix), inverse)[starts]


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = WORD_BYTE[np.frombuffer(raw, np.uint8)]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash for every word of a text of any length, read in segments that end between words."""
    found, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + SEGMENT)
        while end < len(raw) and WORD_BYTE[raw[end]]:
            end += 1
        part = raw[at:end]
        starts, ends = word_spans(part)
        if len(starts):
            prefix = _prefix(_BYTE[np.frombuffer(part, np.uint8)], _ROOT)
            found.append(mix(_between(prefix, starts, ends, _ROOT) + (ends - starts).astype(np.uint64)))
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def window_hashes(values: np.ndarray, width: int, at: np.ndarray | None = None, salt: int = 0) -> np.ndarray:
    """Hash of every ``width`` consecutive values, or of those that start at the positions ``at``."""
    if len(values) < width:
        return np.empty(0, np.uint64)
    base = (_ROOT * (2 * salt + 3)) & _MASK
    out = []
    at = np.arange(len(values) - width + 1) if at is None else at
    for begin in range(0, len(values) - width + 1, SEGMENT):
        own = at[np.searchsorted(at, begin) : np.searchsorted(at, begin + SEGMENT)] - begin
        if len(own):
            prefix = _prefix(values[begin : begin + SEGMENT + width], base)
            out.append(mix(_between(prefix, own, own + width, base)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def byte_windows(raw: bytes, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive bytes of a segment."""
    if len(raw) < width:
        return np.empty(0, np.uint64)
    prefix = _prefix(_BYTE[np.frombuffer(raw, np.uint8)], _ROOT)
    n = len(raw) - width + 1
    inverse = _powers(len(prefix), pow(_ROOT, -1, 1 << 64))
    return mix((prefix[width:] - prefix[:n]) * inverse[:n])
