"""Periodic runs of words: stretches that repeat themselves at a fixed distance.

A run is a stretch of consecutive words with smallest period q and at least
``max(min_words, 2 q)`` words that cannot be made longer keeping q.  The words of a
batch of texts become one sequence of numbers, a unique one between any two texts,
and one run-length grammar (``recompression``).  For every period a grid of positions
so narrow that each run holds a position that equals the one q further on: about
n log n positions in all.  Where such a pair agrees, two extension queries on the
grammar give the whole run; multiples of a period find the same stretch and the
smallest stays.

Texts are rows of their own, so there is no shuffle; a task's memory is bounded by
pieces of ``PIECE_CHARS`` characters, or one longer text.

Defined results.  A null or empty text has no words and no runs, and ``collapsed`` is
empty.  Words are ``[^\\x20\\x09-\\x0D]+``, compared exactly.  Repeated rows and equal
texts get equal results; an empty table gives no rows.  Input columns pass through; one
of them called like a result column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tailorspark.llm.recompression import Grammar
from tailorspark.llm.textvec import pieces

#: Least number of words of a run.
MIN_WORDS = 12
PIECE_CHARS = 1 << 21
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RESULT = ["n_words", "runs", "collapsed"]


def _grid_pairs(x: np.ndarray, sizes: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions i and periods q with x[i] = x[i + q] on the grid of q (and a neighbour that agrees too).

    ``x``: a separator, then every text followed by one; ``sizes``: words of the texts, descending.
    """
    ends = np.cumsum(sizes + 1)
    at, period = [], []
    longest = int(sizes[0]) if len(sizes) else 0
    for q in range(1, longest // 2 + 1):
        least = max(min_words, 2 * q)
        texts = int(np.searchsorted(-sizes, -least, side="right"))  # those that long
        if not texts:
            break
        # a run has least - q neighbouring positions or more that agree with the one q further on
        step = least - q
        seen = x[:int(ends[texts - 1]) + 1]
        i = np.flatnonzero(seen[step:-q:step] == seen[step + q::step]) * step + step
        if step > 1 and len(i):
            i = i[(seen[i + 1] == seen[np.minimum(i + 1 + q, len(seen) - 1)]) | (seen[i - 1] == seen[i - 1 + q])]
        at.append(i)
        period.append(np.full(len(i), q, np.int64))
    none = np.zeros(0, np.int64)
    return (np.concatenate(at), np.concatenate(period)) if at else (none, none)


def runs_of(texts: Sequence[list], min_words: int = MIN_WORDS) -> list[np.ndarray]:
    """For every list of words its runs as rows (start, length, period), by start, then period."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    if not len(sizes) or sizes[0] < min_words:
        return out
    order = order[:int(np.searchsorted(-sizes, -min_words, side="right"))]
    sizes = sizes[:len(order)]
    number: dict = {}
    x = np.zeros(int((sizes + 1).sum()) + 1, np.int64)
    begin = np.cumsum(sizes + 1) - sizes  # of every text; 0 is a separator
    for i, a, n in zip(order, begin.tolist(), sizes.tolist()):  # a word's number is where it stands first
        x[a:a + n] = np.fromiter(map(number.setdefault, texts[i], range(a, a + n)), np.int64, n)
    gaps = np.append(0, begin + sizes)
    x[gaps] = gaps
    i, q = _grid_pairs(x, sizes, min_words)
    if not len(i):
        return out
    grammar = Grammar(x)
    ahead, behind = grammar.right(i, i + q), grammar.left(i - 1, i + q - 1)
    start, length = i - behind, behind + q + ahead
    long = length >= np.maximum(min_words, 2 * q)
    # the same stretch under several periods, or found several times: the smallest period
    found = np.stack([start[long], length[long], q[long]], axis=1)
    found = found[np.lexsort(found.T[::-1])]
    fresh = np.append(True, (found[1:, :2] != found[:-1, :2]).any(axis=1))[:len(found)]
    found = found[fresh]
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    of = np.searchsorted(begin, found[:, 0], side="right") - 1
    found[:, 0] -= begin[of]
    cut = np.searchsorted(of, np.arange(len(order) + 1))
    for k, i in enumerate(order):
        out[i] = found[cut[k]:cut[k + 1]]
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of n words stays if every run is cut to its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:n] == 0


def _piece(texts: list, min_words: int) -> list[pa.Array]:
    words = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
    runs = runs_of(words, min_words)
    collapsed = [b" ".join(w if not len(r) else [x for x, k in zip(w, kept_words(len(w), r).tolist()) if k])
                 for w, r in zip(words, runs)]
    every = np.concatenate(runs)
    spans = pa.StructArray.from_arrays([pa.array(every[:, c]) for c in range(3)], fields=list(_RUN))
    ends = np.cumsum([0, *map(len, runs)]).astype(np.int32)
    return [pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), spans),
            pa.array(collapsed, pa.binary()).cast(pa.string())]


def _search(column: str, keep: list[str], min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(column).to_pylist()
            rest = batch.select(keep)
            for a, b in pieces(texts, PIECE_CHARS):
                yield pa.RecordBatch.from_arrays([*rest.slice(a, b - a).columns, *_piece(texts[a:b], min_words)],
                                                 names=[*keep, *RESULT])
    return run


def periodic_runs(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (array of start, length, period; word numbers from 0; by start, then period) and
    ``collapsed``: the words left if every run is cut to its first period, joined by one blank."""
    keep = [c for c in docs.columns if c not in RESULT]
    run = "array<struct<start:bigint,length:bigint,period:bigint>>"
    extra = T._parse_datatype_string(f"n_words bigint, runs {run}, collapsed string")
    schema = T.StructType([*[docs.schema[c] for c in keep], *extra.fields])
    source = docs if text in keep else docs.withColumn("_text", docs[text])
    column = text if text in keep else "_text"
    return source.mapInArrow(_search(column, keep, min_words), schema)
