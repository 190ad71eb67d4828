"""Counts that describe the form of a text, for whole batches of texts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd

from tailorspark.llm.textvec import Words, mix64, pieces, range_hashes

_U = np.uint64
#: Names of the counts, in the order of ``measure``'s columns.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
          "n_distinct_words", "n_upper", "n_letters", "n_digits", "n_marks"]


def _byte_set(chars: str) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[[ord(c) for c in chars]] = 1
    return out


_SYMBOLS = _byte_set("#*$%&|<>")
_UPPER = _byte_set("".join(chr(c) for c in range(65, 91)))
_LOWER = _byte_set("".join(chr(c) for c in range(97, 123)))
_DIGITS = _byte_set("0123456789")
_MARKS = _byte_set("!?")
#: Bytes that begin a character outside white space (continuation bytes of UTF-8 begin none).
_SOLID = np.array([not (0x80 <= b < 0xC0 or b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)], np.uint8)


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every key how often it occurs, and whether it occurred before."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    codes, _ = pd.factorize(keys)
    seen = np.ones(len(keys), bool)
    first = np.empty(codes.max() + 1, np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    seen[first] = False
    return np.bincount(codes)[codes], seen


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _batch(texts: Sequence) -> np.ndarray:
    w = Words(texts)
    n = len(texts)
    chars = {k: _per_text(t[w.data], w.offsets) for k, t in {
        "word_chars": _SOLID, "n_symbols": _SYMBOLS, "n_upper": _UPPER, "lower": _LOWER, "n_digits": _DIGITS,
        "n_marks": _MARKS}.items()}
    h = w.hashes()
    of = np.repeat(np.arange(n), np.diff(w.bounds)).astype(_U)
    _, seen = _repeated(mix64(h ^ mix64(of + _U(1))))

    # lines: every text is followed by a line feed of its own
    end = np.flatnonzero(w.data == 0x0A)
    begin = np.append(0, end[:-1] + 1)
    solid = np.searchsorted(w.starts, end) > np.searchsorted(w.starts, begin)
    begin, end = begin[solid], end[solid]
    line_of = np.searchsorted(w.offsets, begin, side="right") - 1
    line_bounds = np.searchsorted(line_of, np.arange(n + 1))
    _, copied = _repeated(mix64(range_hashes(w.data, begin, end) ^ mix64(line_of.astype(_U) + _U(1))))

    # windows of three words inside one text; a word is repeated if any window over it is
    covered = np.zeros(len(h), bool)
    if len(h) >= 3:
        inside = np.flatnonzero(of[2:] == of[:-2])
        k = mix64(h[:-2] * _U(0x9E3779B97F4A7C15) + h[1:-1])
        k = mix64(k * _U(0x9E3779B97F4A7C15) + h[2:]) ^ mix64(of[:-2] + _U(1))
        often = inside[_repeated(k[inside])[0] > 1]
        for step in range(3):
            covered[often + step] = True
    got = {"n_words": np.diff(w.bounds), "n_lines": np.diff(line_bounds), "n_dup_lines": _per_text(copied, line_bounds),
           "n_repeat_words": _per_text(covered, w.bounds), "n_distinct_words": _per_text(~seen, w.bounds),
           "n_letters": chars["n_upper"] + chars["lower"], **chars}
    return np.stack([got[c] for c in COUNTS], axis=1)


def measure(texts: Sequence) -> np.ndarray:
    """[text, count] as named in ``COUNTS``; null is an empty text.

    Words ``[^\\x20\\x09-\\x0D]+``; lines are split at line feeds and count if they
    have a word; letters and upper case are ASCII.
    """
    parts = [_batch(texts[a:b]) for a, b in pieces(texts, 1 << 20)]
    return np.concatenate(parts) if parts else np.zeros((0, len(COUNTS)), np.int64)
