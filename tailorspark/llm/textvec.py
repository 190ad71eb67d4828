"""Vectorised word splitting and hashing for whole batches of texts.

A Python loop over words costs about a microsecond each; here a batch of texts
becomes one numpy array and words are index ranges of it.  A range's hash comes
from prefix sums of a polynomial modulo 2**64 over mixed symbols, so a word
costs the same in any position and any batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_U = np.uint64
_R = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_RINV = pow(_R, -1, 1 << 64)
_pow = np.ones(1, _U)
_ipow = np.ones(1, _U)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _ipow
    if len(_pow) <= n:
        size = max(n + 1, 1 << 16)
        p = np.full(size, _U(_R))
        p[0] = 1
        _pow = np.cumprod(p)
        p[1:] = _U(_RINV)
        _ipow = np.cumprod(p)
    return _pow, _ipow


_BYTES = mix64(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))


def range_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every ``symbols[start:end]``; equal content gives equal hashes.

    ``symbols``: uint8 (bytes) or uint32 (code points).
    """
    n = len(symbols)
    p, ip = _powers(n)
    v = _BYTES[symbols] if symbols.dtype == np.uint8 else mix64((symbols.astype(_U) + _U(1)) * _U(0xD6E8FEB86659FD93))
    total = np.zeros(n + 1, _U)
    np.cumsum(v * p[:n], out=total[1:])
    h = (total[ends] - total[starts]) * ip[starts]
    return mix64(h + (ends - starts).astype(_U) * _U(0xA24BAED4963EE407))


def pieces(texts: Sequence, limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about ``limit`` characters, one text at least."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if size and size + n > limit:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of several texts.

    ``data``: the UTF-8 bytes of all texts, each followed by a line feed;
    ``starts``/``ends``: of every word; ``bounds[i]:bounds[i + 1]``: the words of
    text i; ``offsets[i]``: where text i begins.
    """

    def __init__(self, texts: Sequence, lower: bool = False):
        raw = [(t or "").encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
        joined = b"\n".join(raw) + b"\n"
        self.data = np.frombuffer(joined.translate(_LOWER) if lower else joined, np.uint8)
        self.offsets = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(r) + 1 for r in raw], out=self.offsets[1:])
        solid = np.zeros(len(self.data) + 1, np.int8)
        solid[1:] = ~_SPACE[self.data]
        change = np.diff(solid)
        self.starts = np.flatnonzero(change == 1)
        self.ends = np.flatnonzero(change == -1)
        self.bounds = np.searchsorted(self.starts, self.offsets)

    def hashes(self) -> np.ndarray:
        return range_hashes(self.data, self.starts, self.ends)
