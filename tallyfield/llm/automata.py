"""Regular expressions over bytes to minimal deterministic automata in transition arrays.

Supported syntax: literals, ``\\xHH`` and escaped literals, classes, groups, ``|``, ``? * + {m} {m,} {m,n}`` and
``(?i:...)`` for ASCII letters in either case.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def parse(pattern: str):
    """Syntax tree: ("set", bytes), ("cat", parts), ("alt", parts), ("rep", part, least, most or None)."""
    at = 0

    def byte() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c != "\\":
            return ord(c)
        c = pattern[at]
        at += 1
        if c == "x":
            at += 2
            return int(pattern[at - 2 : at], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def members() -> frozenset[int]:
        nonlocal at
        found: set[int] = set()
        negated = pattern[at] == "^"
        at += negated
        while pattern[at] != "]":
            low = byte()
            high = low
            if pattern[at] == "-" and pattern[at + 1] != "]":
                at += 1
                high = byte()
            found.update(range(low, high + 1))
        at += 1
        return frozenset(set(range(256)) - found if negated else found)

    def choice(fold: bool):
        nonlocal at
        parts = [sequence(fold)]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            parts.append(sequence(fold))
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(fold: bool):
        nonlocal at
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            c = pattern[at]
            if c == "(":
                inner = fold
                at += 1
                if pattern.startswith("?i:", at):
                    inner, at = True, at + 3
                node = choice(inner)
                if at >= len(pattern):
                    raise ValueError(f"group not closed in {pattern}")
                at += 1
            elif c == "[":
                at += 1
                node = ("set", members())
            else:
                b = byte()
                both = {ord(chr(b).lower()), ord(chr(b).upper())} if fold and b < 128 else {b}
                node = ("set", frozenset(both))
            while at < len(pattern) and pattern[at] in "?*+{":
                c = pattern[at]
                at += 1
                if c == "{":
                    end = pattern.index("}", at)
                    low, comma, high = pattern[at:end].partition(",")
                    at = end + 1
                    least, most = int(low), (int(high) if high else None) if comma else int(low)
                else:
                    least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
                node = ("rep", node, least, most)
            parts.append(node)
        return ("cat", parts)

    tree = choice(False)
    if at != len(pattern):
        raise ValueError(f"unexpected {pattern[at]} in {pattern}")
    return tree


class _Nfa:
    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append(None)
        return len(self.free) - 1

    def build(self, node, backwards: bool) -> tuple[int, int]:
        kind = node[0]
        if kind == "set":
            a, b = self.state(), self.state()
            self.moves[a] = (node[1], b)
            return a, b
        if kind == "cat":
            a = b = self.state()
            for part in reversed(node[1]) if backwards else node[1]:
                begin, end = self.build(part, backwards)
                self.free[b].append(begin)
                b = end
            return a, b
        if kind == "alt":
            a, b = self.state(), self.state()
            for part in node[1]:
                begin, end = self.build(part, backwards)
                self.free[a].append(begin)
                self.free[end].append(b)
            return a, b
        _, part, least, most = node
        a = b = self.state()
        for _ in range(least):
            begin, end = self.build(part, backwards)
            self.free[b].append(begin)
            b = end
        if most is None:
            begin, end = self.build(part, backwards)
            self.free[b].append(begin)
            self.free[end].append(begin)
            last = self.state()
            self.free[b].append(last)
            self.free[end].append(last)
            return a, last
        last = self.state()
        self.free[b].append(last)
        for _ in range(most - least):
            begin, end = self.build(part, backwards)
            self.free[b].append(begin)
            self.free[end].append(last)
            b = end
        return a, last


@dataclass
class Automaton:
    """``step[state, byte_class]`` is the next state, ``accepts[state]`` a bit mask of patterns; state 0 starts."""

    classes: bytes
    step: np.ndarray
    accepts: np.ndarray
    dead: int

    def rows(self) -> list[list]:
        """States as lists: a next state for each byte class, and last the accepted patterns."""
        rows: list[list] = [[] for _ in range(len(self.step))]
        for row, nexts, mask in zip(rows, self.step.tolist(), self.accepts.tolist()):
            row.extend(rows[n] for n in nexts)
            row.append(mask)
        return rows


def compile_patterns(patterns: list[str], anywhere: bool, backwards: bool = False) -> Automaton:
    """One minimal automaton for all patterns by subset construction.

    ``anywhere`` lets a match begin at every byte; ``backwards`` is for text read from its end, so that the
    automaton accepts where a match begins.
    """
    nfa = _Nfa()
    ends, begins = {}, []
    for i, p in enumerate(patterns):
        begin, end = nfa.build(parse(p), backwards)
        begins.append(begin)
        ends[end] = ends.get(end, 0) | 1 << i

    def closure(states) -> frozenset[int]:
        seen, open_ = set(states), list(states)
        while open_:
            for s in nfa.free[open_.pop()]:
                if s not in seen:
                    seen.add(s)
                    open_.append(s)
        return frozenset(s for s in seen if nfa.moves[s] is not None or s in ends)

    # bytes that no pattern tells apart share a class
    split: dict[tuple, int] = {}
    sets = list({m[0] for m in nfa.moves if m is not None})
    classes = bytearray(256)
    examples = []
    for b in range(256):
        key = tuple(b in s for s in sets)
        if key not in split:
            split[key] = len(split)
            examples.append(b)
        classes[b] = split[key]

    fresh = closure(begins)
    index, order, step = {fresh: 0}, [fresh], []
    for states in order:
        row = []
        for b in examples:
            reached = {nfa.moves[s][1] for s in states if nfa.moves[s] is not None and b in nfa.moves[s][0]}
            nexts = closure(reached) | fresh if anywhere else closure(reached)
            if nexts not in index:
                index[nexts] = len(order)
                order.append(nexts)
            row.append(index[nexts])
        step.append(row)
    accepts = np.zeros(len(order), np.int64)
    for i, states in enumerate(order):
        for s in states:
            accepts[i] |= ends.get(s, 0)
    return _minimal(bytes(classes), np.array(step, np.int32), accepts)


def _minimal(classes: bytes, step: np.ndarray, accepts: np.ndarray) -> Automaton:
    """Merge states by refining the partition by accepted patterns until no transition tells two apart."""
    block = np.unique(accepts, return_inverse=True)[1].reshape(-1)
    while True:
        _, refined = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)
        refined = refined.reshape(-1)
        if refined.max() == block.max():
            break
        block = refined
    # state 0 keeps its number
    renumber = np.full(block.max() + 1, -1, np.int64)
    count = 0
    for b in block.tolist():
        if renumber[b] < 0:
            renumber[b] = count
            count += 1
    block = renumber[block]
    first = np.zeros(count, np.int64)
    first[block[::-1]] = np.arange(len(block))[::-1]
    small, accept = block[step[first]].astype(np.int32), accepts[first]
    dead = [i for i in range(count) if not accept[i] and (small[i] == i).all()]
    return Automaton(classes, small, accept, dead[0] if dead else -1)
