"""Secret scans with one combined automaton.

Every rule has a *trigger* - the shortest beginning that all its matches share -
and the triggers of all rules are compiled into one minimal deterministic
automaton (``automaton``), which reads each byte once and says where which
trigger ends.  From there the trigger's backward automaton goes to where the
match begins, and the rule's own automaton from there to the longest end:
leftmost, non-overlapping within a kind, those with too short a value dropped
after they have taken their place.  Private keys alone, whose end line may be
any distance away, are ended by a regular expression at the place found.

Defined results: null or empty text -> no span.  Positions count code points,
end exclusive.  Kinds may overlap each other; each keeps its spans.  Rows keep
their multiplicity; columns besides the text pass through unread (one named
``spans`` is replaced).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tailorspark.llm.automaton import Automaton

# A private key reaches to its end line, whatever its length; without one (cut off, or another block begins first)
# to the end of its header fields and base64 lines, of which only the last may be short.  Line breaks may be
# escaped and lines quoted or indented, as in source code and JSON.
_KEY = r"(?:[A-Z]+ )*PRIVATE KEY-----"
_TO_END = rf"(?:[^-]++|-(?!----BEGIN |----END {_KEY}))*+-----END {_KEY}"
_KEY_GAP = r"(?:\\[nrt]|[\s\"'`>#*|,;+\\])*+"
_KEY_LINES = (rf"(?:{_KEY_GAP}(?:(?:Proc-Type|DEK-Info|Version|Comment):[^\n]*+|[A-Za-z0-9+/]{{16,}}+={{0,2}}))*+"
              r"(?:(?<=[A-Za-z0-9+/=])(?:\\r)?(?:\\n|\r?\n)[\x20\t\"'>#*]*+[A-Za-z0-9+/]+={0,2}(?=[\x20\t\"',;]*+(?:[\r\n\\]|\Z)))?+")

# Kind, trigger (assign's ends with the value's first character), rule (value in group "v" where a least
# length holds), least length.
RULES = [
    ("assign",
     r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]",
     r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?(?P<v>[A-Za-z0-9+/_.=-]+)", 6),
    ("access", r"AKIA[A-Z0-9]", r"(?P<v>AKIA[A-Z0-9]+)", 20),
    ("hex", r"[0-9a-f]{24}", r"(?P<v>[0-9a-f]+)", 24),
    ("private_key", r"-----BEGIN ", rf"(?P<v>-----BEGIN {_KEY}(?:{_TO_END}|{_KEY_LINES}))", 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{4}", r"(?P<v>gh[pousr]_[A-Za-z0-9]{36,})", 1),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{2}", r"(?P<v>xox[abprs]-[A-Za-z0-9-]{10,})", 1),
    ("google", r"AIza[A-Za-z0-9_-]{4}", r"(?P<v>AIza[A-Za-z0-9_-]{35})", 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{2}", r"(?P<v>eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1),
    ("stripe", r"[rs]k_live_", r"(?P<v>[rs]k_live_[A-Za-z0-9]{16,})", 1),
]
KINDS = [r[0] for r in RULES]
#: The first three are the base kinds.
BASE = KINDS[:3]
MARK = "[SECRET]"

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                                  T.StructField("end", T.IntegerType())]))
_compiled = None


def _tools():
    """All automata, compiled once in a Python worker: of all triggers, and by rule backward and forward."""
    global _compiled
    if _compiled is None:
        _compiled = (Automaton([r[1] for r in RULES]), [Automaton([r[1]], anchored=True, backward=True) for r in RULES],
                     [re.compile(r[2]) if r[0] == "private_key" else Automaton([r[2]], anchored=True) for r in RULES])
    return _compiled


def _matches(k: int, runs: list[tuple[int, int, int]], raw: bytes, text: str) -> Iterator[tuple[int, int]]:
    """Byte positions of the matches of rule ``k``, given where triggers end."""
    _, backward, forward = _tools()
    kind, _, _, least = RULES[k]
    free = 0  # what is before belongs to an earlier match
    for first, last, mask in runs:
        end = max(first, free + 1)
        while mask >> k & 1 and end <= last:
            size = backward[k].longest(raw, end - 1, free - 1, -1)
            start = end - size
            value = end - 1 if kind == "assign" else start
            end += 1
            if not size:
                continue
            if kind == "private_key":
                m = forward[k].match(text, len(raw[:start].decode("utf-8", "surrogatepass")))
                taken = len(m.group().encode("utf-8", "surrogatepass")) if m else 0
            else:
                taken = forward[k].longest(raw, start, len(raw))
            if taken:
                free = start + taken
                end = max(end, free + 1)
                if free - value >= least:
                    yield start, free


def find_spans(texts) -> list[list[tuple[str, int, int]]]:
    """Spans of every text, by start and then kind as listed."""
    raw = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
    out: list[list[tuple[str, int, int]]] = [[] for _ in raw]
    for i, runs in _tools()[0].runs(raw).items():
        spans = [(a, k, b) for k in range(len(RULES)) for a, b in _matches(k, runs, raw[i], texts[i])]
        if spans and len(raw[i]) != len(texts[i]):
            # code points before each byte
            before = np.concatenate([[0], np.cumsum(np.frombuffer(raw[i], np.uint8) & 0xC0 != 0x80)])
            spans = [(int(before[a]), k, int(before[b])) for a, k, b in spans]
        out[i] = [(KINDS[k], a, b) for a, k, b in sorted(spans)]
    return out


def find_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``spans`` (kind, start, end) to every row; a map-only pass."""
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "spans"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["spans"] = [[{"kind": k, "start": s, "end": e} for k, s, e in found]
                          for found in find_spans(b[text_col].tolist())]
            yield b

    return kept.mapInPandas(run, T.StructType([*kept.schema.fields, T.StructField("spans", SPANS)]))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace every secret by ``MARK`` (overlapping spans by one); other columns stay."""
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b[text_col].tolist()
            for i, found in enumerate(find_spans(texts)):
                if found:
                    texts[i] = _without(texts[i], found)
            b[text_col] = texts
            yield b

    return kept.mapInPandas(run, kept.schema)


def _without(text: str, found: list[tuple[str, int, int]]) -> str:
    parts, at, reach = [], 0, -1
    for _, start, end in found:
        if start > reach:
            parts += [text[at:start], MARK]
        reach = max(reach, end)
        at = reach
    return "".join(parts) + text[at:]
