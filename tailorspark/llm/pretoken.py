"""Splitting texts into the pre-tokens of byte-level BPE, for whole batches.

The pattern is that of the public vocabularies:
contractions ``'s 't 're 've 'm 'll 'd``, an optional space before a run of
letters, of numbers or of other signs, and white space (all but the last of a
run, if something follows).  Instead of matching it text by text, every
character's class comes from a table and boundaries from comparing neighbours.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd

from tailorspark.llm.textvec import pieces, range_hashes

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Characters of Unicode's White_Space property.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes = None
_PIECE = 1 << 20


def _class_table() -> np.ndarray:
    global _classes
    if _classes is None:
        import regex
        every = "".join(map(chr, range(0x110000)))
        table = np.full(0x110000, OTHER, np.uint8)
        for kind, name in ((LETTER, "L"), (NUMBER, "N")):
            for m in regex.finditer(rf"\p{{{name}}}+", every):
                table[m.start():m.end()] = kind
        table[_WHITE] = SPACE
        _classes = table
    return _classes


def boundaries(cp: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Start positions of the pre-tokens of concatenated texts.

    ``cp``: code points; ``doc_starts``: where each non-empty text begins.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = _class_table()[cp]
    first = np.zeros(n + 1, bool)  # of a text
    first[doc_starts] = True
    first[n] = True
    cut = np.empty(n, bool)
    cut[0] = True
    cut[1:] = (kind[1:] != kind[:-1]) | first[1:n]

    # white space before something: its last character stands alone, or, if a blank, leads the next token
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n])
    cut[last] = True
    blank = last[cp[last] == 0x20]
    cut[blank + 1] = False

    # an apostrophe that begins a token and stands before letters takes a contraction's letters
    q = np.flatnonzero((cp[:-1] == 0x27) & cut[:-1] & (kind[1:] == LETTER) & ~first[1:n])
    if len(q):
        end = np.append(cp, [0, 0])
        a, b = end[q + 1], end[q + 2]
        same = (q + 2 < n) & ~first[np.minimum(q + 2, n)]
        two = np.isin(a, [ord(c) for c in "stmd"])
        three = np.zeros(len(q), bool)
        for x, y in ("re", "ve", "ll"):
            three |= (a == ord(x)) & (b == ord(y)) & same
        for hit, width in ((two, 2), (three & ~two, 3)):
            p = q[hit]
            cut[p + 1] = False
            rest = p + width
            rest = rest[rest < n]
            rest = rest[(kind[rest] == LETTER) & ~first[rest]]
            cut[rest] = True
    return np.flatnonzero(cut)


class Vocabulary:
    """Distinct pre-tokens of several texts, and every text as numbers into them.

    ``words``: distinct pre-tokens (str), most frequent first; ``codes``: word
    number of every pre-token, text after text; ``counts``: pre-tokens per text.
    Equal hashes are checked to be equal words, so ``codes`` is exact.
    """

    def __init__(self, texts: Sequence[str]):
        hashes, spans, counts = [], [], []
        base = 0
        for lo, hi in pieces(texts, _PIECE):
            joined = "".join(texts[lo:hi])
            cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            sizes = np.array([len(t) for t in texts[lo:hi]], np.int64)
            begin = np.cumsum(sizes) - sizes
            start = boundaries(cp, begin[sizes > 0])
            stop = np.append(start, len(cp))[1:]  # none of empty texts
            hashes.append(range_hashes(cp, start, stop))
            counts.append(np.diff(np.append(np.searchsorted(start, begin), len(start))))
            spans.append(np.stack([start + base, stop + base]))
            base += len(cp)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        if not base:
            self.words, self.codes = [], np.zeros(0, np.int64)
            return
        start, stop = np.concatenate(spans, axis=1)
        joined = "".join(texts)
        codes, _ = pd.factorize(np.concatenate(hashes))
        n = int(codes.max()) + 1
        sample = np.empty(n, np.int64)
        sample[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        words = [joined[a:b] for a, b in zip(start[sample].tolist(), stop[sample].tolist())]
        if not self._same(joined, start, stop, codes, sample):
            index: dict[str, int] = {}
            every = (joined[a:b] for a, b in zip(start.tolist(), stop.tolist()))
            codes = np.array([index.setdefault(w, len(index)) for w in every], np.int64)
            words, n = list(index), len(index)
        order = np.argsort(-np.bincount(codes, minlength=n), kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.codes = place[codes]
        self.words = [words[i] for i in order.tolist()]

    @staticmethod
    def _same(joined: str, start, stop, codes, sample) -> bool:
        """Every pre-token is, character by character, the one its code stands for."""
        rep = start[sample][codes]
        if not np.array_equal(stop - start, (stop[sample] - start[sample])[codes]):
            return False
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        step = 1 << 16
        for i in range(0, len(start), step):
            a, b, r = start[i:i + step], stop[i:i + step], rep[i:i + step]
            # pre-tokens are adjacent, so this stretch of characters is one slice
            shift = np.repeat(r - a, b - a)
            lo, hi = int(a[0]), int(b[-1])
            if not np.array_equal(cp[lo:hi], cp[np.arange(lo, hi) + shift]):
                return False
        return True
