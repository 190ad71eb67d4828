"""A set of regular expressions as one minimal deterministic automaton over bytes.

The expressions' syntax trees (from the standard library's parser) become one
nondeterministic automaton, subset construction makes it deterministic with an
unanchored start, and partition refinement minimises it.  The result is a flat
transition array; scanning is one table look-up per byte whatever the number of
rules.  ``runs`` tells where each rule's matches end; an anchored automaton gives
the longest match from a place, forward or (built ``backward``) towards its
beginning.  Supported: literals, classes, groups, alternation, counted and open repeats.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np

_parse, _op = re._parser.parse, re._constants  # noqa: SLF001


class _Nfa:
    def __init__(self, backward: bool = False):
        self.backward = backward
        self.empty: list[list[int]] = []
        self.moves: list[tuple[int, int] | None] = []  # (byte set as 256-bit integer, target)

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def symbol(self, at: int, chars: int) -> int:
        end = self.state()
        self.moves[at] = (chars, end)
        follow = self.state()
        self.empty[end].append(follow)
        return follow

    def add(self, tree, at: int, fold: bool) -> int:
        for kind, arg in reversed(tree) if self.backward else tree:
            if kind is _op.LITERAL:
                at = self.symbol(at, _bytes([arg], fold))
            elif kind is _op.IN:
                at = self.symbol(at, _class(arg, fold))
            elif kind is _op.SUBPATTERN:
                at = self.add(arg[3], at, (fold or bool(arg[1] & re.IGNORECASE)) and not arg[2] & re.IGNORECASE)
            elif kind is _op.BRANCH:
                ends = []
                for option in arg[1]:
                    begin = self.state()
                    self.empty[at].append(begin)
                    ends.append(self.add(option, begin, fold))
                at = self.state()
                for e in ends:
                    self.empty[e].append(at)
            elif kind is _op.MAX_REPEAT:
                least, most, body = arg
                for _ in range(least):
                    at = self.add(body, at, fold)
                if most is _op.MAXREPEAT:
                    loop = self.state()
                    self.empty[at].append(loop)
                    end = self.add(body, loop, fold)
                    self.empty[end].append(loop)
                    at = self.state()
                    self.empty[loop].append(at)
                else:
                    skipped = [at]
                    for _ in range(most - least):
                        at = self.add(body, at, fold)
                        skipped.append(at)
                    at = self.state()
                    for s in skipped:
                        self.empty[s].append(at)
            else:
                raise ValueError(f"unsupported in a scan rule: {kind}")
        return at


def _bytes(codes, fold: bool) -> int:
    out = 0
    for c in codes:
        if c > 127:
            raise ValueError("scan rules are ASCII")
        for x in {c, ord(chr(c).lower()), ord(chr(c).upper())} if fold else {c}:
            out |= 1 << x
    return out


def _class(items, fold: bool) -> int:
    out, negate = 0, False
    for kind, arg in items:
        if kind is _op.NEGATE:
            negate = True
        elif kind is _op.RANGE:
            out |= _bytes(range(arg[0], arg[1] + 1), fold)
        elif kind is _op.LITERAL:
            out |= _bytes([arg], fold)
        else:
            raise ValueError(f"unsupported in a scan rule: {kind}")
    return ((1 << 256) - 1) & ~out if negate else out


class Automaton:
    """``masks[s]``: bit r is set if rule r ends in state s.

    States are numbered so that ending states come last, from ``first_end`` on;
    ``table[s * n_classes + byte_class]`` is the next state, already times
    ``n_classes``.
    """

    def __init__(self, rules: Sequence[str], anchored: bool = False, backward: bool = False):
        nfa = _Nfa(backward)
        start = nfa.state()
        ends = {}
        for r, rule in enumerate(rules):
            begin = nfa.state()
            nfa.empty[start].append(begin)
            ends[nfa.add(_parse(rule), begin, False)] = 1 << r
        closure = [self._closure(nfa, s) for s in range(len(nfa.empty))]

        # bytes that no rule tells apart share a class
        sets = sorted({m[0] for m in nfa.moves if m})
        signature = [tuple(s >> b & 1 for s in sets) for b in range(256)]
        kinds = {k: i for i, k in enumerate(dict.fromkeys(signature))}
        self.classes = np.array([kinds[s] for s in signature], np.uint8)
        sample = {c: b for b, c in reversed(list(enumerate(self.classes.tolist())))}
        n = self.n_classes = len(kinds)

        # subset construction; unless anchored, the start is always among the states, so a match may begin anywhere
        first = closure[start]
        index, order, table = {first: 0}, [first], []
        for states in order:
            row = []
            for c in range(n):
                to = set() if anchored else set(first)
                for s in states:
                    if nfa.moves[s] and nfa.moves[s][0] >> sample[c] & 1:
                        to |= closure[nfa.moves[s][1]]
                key = frozenset(to)
                if key not in index:
                    index[key] = len(order)
                    order.append(key)
                row.append(index[key])
            table.append(row)
        masks = [sum(m for s, m in ends.items() if s in states) for states in order]
        self._minimise(np.array(table), np.array(masks, np.int64))

    @staticmethod
    def _closure(nfa: _Nfa, s: int) -> frozenset:
        seen, todo = {s}, [s]
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def _minimise(self, table: np.ndarray, masks: np.ndarray) -> None:
        """Refine the partition by masks until successors agree; then number ending blocks last."""
        block = np.unique(masks, return_inverse=True)[1].reshape(-1)
        while True:
            rows = np.column_stack([block, block[table]])
            finer = np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1)
            if finer.max() == block.max():
                break
            block = finer
        pick = np.unique(block, return_index=True)[1]
        rank = np.argsort(np.argsort(masks[pick] != 0, kind="stable"), kind="stable")
        place = np.argsort(rank, kind="stable")
        self.masks = masks[pick][place]
        self.table = (rank[block[table[pick]]][place] * self.n_classes).astype(np.int32).reshape(-1)
        self.start = int(rank[block[0]]) * self.n_classes
        self.first_end = int((self.masks == 0).sum()) * self.n_classes
        self._list, self._classes = self.table.tolist(), self.classes.tolist()
        rows = self.table.reshape(-1, self.n_classes)
        stuck = np.flatnonzero((rows == np.arange(len(rows))[:, None] * self.n_classes).all(1) & (self.masks == 0))
        self._dead = int(stuck[0]) * self.n_classes if len(stuck) else -1

    #: With fewer texts left than this, one at a time beats one step for all.
    NARROW = 96

    def longest(self, data: bytes, at: int, stop: int, step: int = 1) -> int:
        """Bytes of the longest match from ``at`` on, by ``step`` until ``stop``; 0 if there is none."""
        table, classes, s, best = self._list, self._classes, self.start, 0
        for k in range(at, stop, step):
            s = table[s + classes[data[k]]]
            if s >= self.first_end:
                best = (k - at) * step + 1
            elif s == self._dead:
                break
        return best

    def scan(self, texts: Sequence[bytes]) -> np.ndarray:
        """Bit mask of the rules that end somewhere in each text."""
        found = np.zeros(len(texts), np.int64)
        for i, runs in self.runs(texts).items():
            for _, _, mask in runs:
                found[i] |= mask
        return found

    def runs(self, texts: Sequence[bytes]) -> dict[int, list[tuple[int, int, int]]]:
        """Text number -> ``(first, last, mask)`` in order: the rules in mask end after each of bytes first to last.

        Every byte is looked at once.  All texts advance together, one byte a
        step, longest first, so those that have ended drop off the end of the
        state array.  Neighbouring ends of the same rules are one run.
        """
        lengths = np.array([len(t) for t in texts], np.int64)
        if not lengths.sum():
            return {}
        order = np.argsort(-lengths, kind="stable")
        data = self.classes[np.frombuffer(b"".join(texts[i] for i in order), np.uint8)]
        lengths = lengths[order]
        begin = np.cumsum(lengths) - lengths
        state = np.full(len(order), self.start, np.int32)
        changes: dict[int, list[tuple[int, int]]] = {}  # (bytes read, mask from there on)
        last: dict[int, int] = {}
        steps = int(lengths[self.NARROW - 1]) if len(order) >= self.NARROW else 0
        alive = np.searchsorted(-lengths, -np.arange(steps), side="left")  # texts longer than the step's number
        for i in range(steps):
            k = alive[i]
            s = self.table[state[:k] + data[begin[:k] + i]]
            state[:k] = s
            ended = s >= self.first_end
            if last or ended.any():
                at = np.flatnonzero(ended)
                now = dict(zip(at.tolist(), self.masks[s[at] // self.n_classes].tolist()))
                for j in last.keys() - now.keys():
                    changes[j].append((i + 1, 0))
                for j, mask in now.items():
                    if last.get(j) != mask:
                        changes.setdefault(j, []).append((i + 1, mask))
                last = now
        table, first_end, masks, n = self._list, self.first_end, self.masks.tolist(), self.n_classes
        for j in np.flatnonzero(lengths > steps).tolist():
            s, mask = int(state[j]), last.get(j, 0)
            for i, c in enumerate(data[begin[j] + steps:begin[j] + lengths[j]].tolist(), steps + 1):
                s = table[s + c]
                if s >= first_end:
                    if masks[s // n] != mask:
                        mask = masks[s // n]
                        changes.setdefault(j, []).append((i, mask))
                elif mask:
                    mask = 0
                    changes[j].append((i, 0))
        return {int(order[j]): [(a, b - 1, mask) for (a, mask), (b, _) in zip(got, [*got[1:], (int(lengths[j]) + 1, 0)]) if mask]
                for j, got in sorted(changes.items())}
