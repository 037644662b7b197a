"""Secret scan: all rules in one combined deterministic automaton, one pass over the bytes of a text.

The rules are compiled backwards, with a match allowed to end anywhere, so one pass from the last byte to the
first tells every position at which a match of a rule begins. Matches are then taken per rule from the left,
without overlap, each as long as its own automaton accepts; only bytes of matches are read again.

Defined results: a null or empty text has no spans; equal rows give equal rows; an empty table gives an empty
table; columns other than the named ones are ignored (``redact_secrets`` keeps them).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .automata import compile_patterns
from .common import column_of, map_text, replace_text


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds a match; what follows ``lead`` (nothing: all of it) must have ``least`` bytes."""

    kind: str
    pattern: str
    least: int = 0
    lead: str = ""


# Token formats as published by their issuers.
RULES = (
    Rule(
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
        6,
        r"""[A-Za-z_]+["']?\x20*[:=]\x20*["']?""",
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("stripe", r"sk_live_[A-Za-z0-9]+", 24),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.all = compile_patterns([r.pattern for r in rules], anywhere=True, backwards=True)
        self.start = self.all.rows()[0]
        self.one = [compile_patterns([r.pattern], anywhere=False) for r in rules]
        self.one_start = [a.rows()[0] for a in self.one]
        self.dead = [a.rows()[a.dead] if a.dead >= 0 else None for a in self.one]
        self.lead = [re.compile(r.lead.encode()) for r in rules]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, in that order."""
        row = self.start
        hits = []
        for at, c in enumerate(data[::-1].translate(self.all.classes)):
            row = row[c]
            if row[-1]:
                hits.append((at, row[-1]))
        if not hits:
            return []
        found = []
        last = len(data) - 1
        free = [0] * len(self.rules)
        for at, mask in reversed(hits):
            begin = last - at
            while mask:
                rule = (mask & -mask).bit_length() - 1
                mask &= mask - 1
                if begin >= free[rule]:
                    end = free[rule] = self._end(rule, data, begin)
                    value = self.lead[rule].match(data, begin, end).end()
                    if end - value >= self.rules[rule].least:
                        found.append((begin, rule, end))
        found.sort()
        return found

    def _end(self, rule: int, data: bytes, begin: int) -> int:
        """End of the longest match of a rule that begins at a byte."""
        row, end, classes, step, accepts = 0, begin, self.one[rule].classes, self.one[rule].step, self.one[rule].accepts
        dead = self.one[rule].dead
        for at in range(begin, len(data)):
            row = step[row, classes[data[at]]]
            if row == dead:
                break
            if accepts[row]:
                end = at + 1
        return end


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def _points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets to code points."""
    if data.isascii() or not spans:
        return spans
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80, out=before[1:])
    return [(int(before[a]), r, int(before[b])) for a, r, b in spans]


def secret_spans(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """(id, spans) for every row; ``spans`` holds (kind, start, end) in code points, end exclusive, sorted by
    start and then in the order of the rules."""
    kinds = [r.kind for r in rules]

    def work(part, texts):
        scan = scanner(rules)
        spans = [
            [{"kind": kinds[r], "start": a, "end": b} for a, r, b in _points(t, scan.spans(t))] for t in texts
        ]
        return {id_col: column_of(part, id_col), "spans": spans}

    kind = df.schema[id_col].dataType.simpleString()
    return map_text(
        df, text_col, f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>", work, id_col
    )


def redact_secrets(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows and columns; every secret is replaced by ``[kind]``, overlapping ones by that of the first."""

    def work(texts):
        scan, out = scanner(rules), []
        for t in texts:
            parts, done = [], 0
            for begin, rule, end in scan.spans(t):
                if begin >= done:
                    parts += [t[done:begin], b"[%s]" % rules[rule].kind.encode()]
                done = max(done, end)
            out.append(b"".join([*parts, t[done:]]) if parts else t)
        return out

    return replace_text(df, work, text_col)
