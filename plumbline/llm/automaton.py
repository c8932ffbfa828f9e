"""Rules as regular expressions, compiled together into one table over bytes.

A rule's pattern becomes a nondeterministic automaton; subset construction makes all rules' automata one
deterministic one, minimisation merges states that no continuation tells apart, and bytes that no state
tells apart share a column. The table is read once per byte, whatever the number of rules.

Patterns know literals, escapes, classes, groups, ``|``, ``?``, ``*``, ``+``, ``{n}``, ``{n,}`` and
``{n,m}``, over ASCII. Matches are the longest at their place, which is what a backtracking engine finds
for patterns whose choices do not depend on each other's order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

#: A byte that no UTF-8 text holds; it parts rows and brings every state back to the start.
BREAK = 0xFF

_ESCAPES = {"n": "\n", "r": "\r", "t": "\t"}


def _bit(c: str) -> int:
    if ord(c) > 127:
        raise ValueError("patterns are ASCII")
    return 1 << ord(c)


class _Reader:
    """Recursive descent over a pattern; nodes are tuples whose first part names them."""

    def __init__(self, pattern: str, fold: bool):
        self.text, self.at, self.fold = pattern, 0, fold

    def more(self, ends: str = "") -> bool:
        return self.at < len(self.text) and self.text[self.at] not in ends

    def take(self) -> str:
        if not self.more():
            raise ValueError(f"pattern ends early: {self.text}")
        self.at += 1
        return self.text[self.at - 1]

    def either(self):
        choices = [self.sequence()]
        while self.more() and self.text[self.at] == "|":
            self.at += 1
            choices.append(self.sequence())
        return ("either", choices)

    def sequence(self):
        parts = []
        while self.more("|)"):
            parts.append(self.repeated(self.atom()))
        return ("sequence", parts)

    def atom(self):
        c = self.take()
        if c == "(":
            inside = self.either()
            if self.take() != ")":
                raise ValueError(f"open group: {self.text}")
            return inside
        if c in "*+?{}]":
            raise ValueError(f"nothing to repeat, or an unescaped {c}: {self.text}")
        if c == "[":
            return ("bytes", self.members())
        return ("bytes", self.folded(_bit(self.escaped() if c == "\\" else c)))

    def escaped(self) -> str:
        c = self.take()
        if c == "x":
            return chr(int(self.take() + self.take(), 16))
        if c.isalnum() and c not in _ESCAPES:
            raise ValueError(f"unknown escape \\{c}: {self.text}")
        return _ESCAPES.get(c, c)

    def members(self) -> int:
        mask = 0
        while (c := self.take()) != "]":
            first = self.escaped() if c == "\\" else c
            last = first
            if self.more() and self.text[self.at] == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.at += 1
                c = self.take()
                last = self.escaped() if c == "\\" else c
            for code in range(ord(first), ord(last) + 1):
                mask |= _bit(chr(code))
        return self.folded(mask)

    def folded(self, mask: int) -> int:
        if self.fold:
            for low in range(ord("a"), ord("z") + 1):
                pair = 1 << low | 1 << (low - 32)
                if mask & pair:
                    mask |= pair
        return mask

    def repeated(self, node):
        while self.more() and self.text[self.at] in "?*+{":
            c = self.take()
            if c == "{":
                counts = re.compile(r"(\d+)(,?)(\d*)\}").match(self.text, self.at)
                if not counts:
                    raise ValueError(f"bad count: {self.text}")
                self.at = counts.end()
                least = int(counts[1])
                most = least if not counts[2] else int(counts[3]) if counts[3] else None
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            node = ("repeat", node, least, most)
        return node


def parse(pattern: str, fold: bool = False):
    """The pattern's tree; ``fold`` lets ASCII letters stand for either case."""
    reader = _Reader(pattern, fold)
    tree = reader.either()
    if reader.more():
        raise ValueError(f"unmatched ): {pattern}")
    return tree


@dataclass
class _Fragments:
    """States of a nondeterministic automaton: free moves, and moves over sets of bytes."""

    free: list[list[int]] = field(default_factory=list)
    moves: list[list[tuple[int, int]]] = field(default_factory=list)

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def add(self, node, start: int) -> int:
        """Builds ``node`` from ``start`` on; gives the state behind it."""
        kind = node[0]
        if kind == "bytes":
            end = self.state()
            self.moves[start].append((node[1], end))
            return end
        if kind == "sequence":
            for part in node[1]:
                start = self.add(part, start)
            return start
        if kind == "either":
            end = self.state()
            for choice in node[1]:
                first = self.state()
                self.free[start].append(first)
                self.free[self.add(choice, first)].append(end)
            return end
        _, inside, least, most = node
        for _ in range(least):
            start = self.add(inside, start)
        if most is None:
            loop, end = self.state(), self.state()
            self.free[start].append(loop)
            self.free[self.add(inside, loop)].append(loop)
            self.free[loop].append(end)
            return end
        end = self.state()
        for _ in range(most - least):
            self.free[start].append(end)
            first = self.state()
            self.free[start].append(first)
            start = self.add(inside, first)
        self.free[start].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for target in self.free[todo.pop()]:
                if target not in seen:
                    seen.add(target)
                    todo.append(target)
        return frozenset(seen)


@dataclass
class Automaton:
    """``table[state * width + column[byte]]`` is the next state; state 0 is the start.

    ``accepts[state]`` has bit r when a match of rule r ends there. In a searching automaton a match may
    begin at any byte, and ``idle`` is the one state in which none has begun. In an anchored one a match
    begins at the first byte only, and ``idle`` is where none can go on (-1 if there is no such state).
    """

    table: np.ndarray
    column: np.ndarray
    width: int
    accepts: np.ndarray
    idle: int


def compile_rules(trees: list, search: bool) -> Automaton:
    """All rules' trees as one minimal automaton."""
    parts = _Fragments()
    start, ends = parts.state(), []
    for tree in trees:
        first = parts.state()
        parts.free[start].append(first)
        ends.append(parts.add(tree, first))
    begin = parts.closure([start])
    if any(end in begin for end in ends):
        raise ValueError("a rule matches the empty text")

    masks = sorted({mask for moves in parts.moves for mask, _ in moves})
    kinds: dict[tuple, int] = {}
    column = np.zeros(256, dtype=np.uint8)
    for byte in range(256):
        column[byte] = kinds.setdefault(tuple(mask >> byte & 1 for mask in masks), len(kinds))
    by_mask = {m: [k for signature, k in kinds.items() if signature[i]] for i, m in enumerate(masks)}

    numbers, rows, todo = {begin: 0}, [], [begin]
    for states in todo:  # grows while it is read
        reached: list[set[int]] = [set() for _ in kinds]
        for state in states:
            for mask, target in parts.moves[state]:
                for kind in by_mask[mask]:
                    reached[kind].add(target)
        row = []
        for targets in reached:
            after = parts.closure(targets) | begin if search else parts.closure(targets)
            if after not in numbers:
                numbers[after] = len(numbers)
                todo.append(after)
            row.append(numbers[after])
        rows.append(row)
    accepts = np.array([sum(1 << r for r, end in enumerate(ends) if end in states) for states in todo])
    idle = 0 if search else numbers.get(frozenset(), -1)
    return _minimal(np.array(rows), column, accepts, idle)


def _minimal(rows: np.ndarray, column: np.ndarray, accepts: np.ndarray, idle: int) -> Automaton:
    """Merges states that agree on all continuations; the idle state stays apart, as it says more."""
    label = accepts * 2 + (np.arange(len(rows)) == idle)
    block = np.unique(label, return_inverse=True)[1].reshape(-1)
    while True:
        signature = np.column_stack([block, block[rows]])
        finer = np.unique(signature, axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    # number the blocks by their first state, so that the start stays 0
    first = np.full(block.max() + 1, len(rows))
    np.minimum.at(first, block, np.arange(len(rows)))
    rank = np.empty(len(first), dtype=np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    members = np.sort(first)
    width = rows.shape[1]
    table = rank[block[rows[members]]].astype(np.int32) * width
    return Automaton(
        table.reshape(-1), column, width, accepts[members], int(rank[block[idle]]) if idle >= 0 else -1
    )


#: Bytes that a lane reads; all lanes of a text are read side by side.
LANE = 512

#: Rounds in which lanes are read again side by side.
ROUNDS = 2


def run(machine: Automaton, data: np.ndarray) -> np.ndarray:
    """The searching automaton's state, times its width, behind every byte.

    The bytes are cut into lanes, and every lane starts out idle. Where the lane before ended in another
    state, a lane is read again from that state until it comes to what it had. A second round mends lanes
    that follow mended ones, and what is wrong then is mended from left to right.
    """
    lanes = -(-len(data) // LANE)
    padded = np.full(lanes * LANE, BREAK, dtype=np.uint8)
    padded[: len(data)] = data
    columns = np.ascontiguousarray(machine.column[padded].reshape(lanes, LANE).T)
    out = np.empty((LANE, lanes), dtype=np.int32)
    start = np.full(lanes, machine.idle * machine.width, dtype=np.int32)
    state = start
    for i in range(LANE):
        state = np.take(machine.table, state + columns[i], out=out[i], mode="clip")
    for _ in range(ROUNDS if lanes else 0):
        wanted = np.concatenate([start[:1], out[-1, :-1]])
        again = np.flatnonzero(wanted != start)
        if not len(again):
            break
        start[again] = wanted[again]
        state = start[again]
        for i in range(LANE):
            state = machine.table[state + columns[i, again]]
            moved = state != out[i, again]
            out[i, again] = state
            if not moved.all():
                again, state = again[moved], state[moved]
                if not len(again):
                    break
    states = out.T.reshape(-1)[: len(data)]
    # what is left passes a state through many lanes; it is followed byte by byte
    table, column = memoryview(machine.table), memoryview(machine.column[padded])
    for lane in range(1, lanes):
        at = lane * LANE
        if states[at - 1] != start[lane]:
            state = int(states[at - 1])
            while at < len(data):
                state = table[state + column[at]]
                if at % LANE == 0:
                    start[at // LANE] = states[at - 1]
                if state == states[at]:
                    break
                states[at] = state
                at += 1
    return states


def rows_of(machine: Automaton) -> tuple[list[list[int]], list[bool]]:
    """An anchored automaton for reading byte by byte: next state by state and byte (-1: none), accepting."""
    table = (machine.table // machine.width).reshape(-1, machine.width)[:, machine.column]
    if machine.idle >= 0:
        table[table == machine.idle] = -1
    return table.tolist(), [bool(a) for a in machine.accepts]
