"""Secrets in texts, found by one automaton for all rules.

The rules are compiled into one searching automaton (``automaton``), which reads every byte of every text
once. It tells where matches end, and where no match has begun ("idle"). The match that ends at a mark
began behind the last idle place before it, so only the stretches between idle places that hold marks are
read again, rule by rule from the left, to give spans.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.automaton import BREAK, compile_rules, parse, rows_of, run
from plumbline.llm.wordhash import text_slices


@dataclass(frozen=True)
class Rule:
    """Matches of ``head`` and ``tail`` together, leftmost and longest, not overlapping.

    A match counts when its tail (``whole``: the match) has ``least`` code points or more; one that does
    not is passed over as a whole, as a search that is filtered afterwards does. ``fold``: letters in
    either case. ``seek`` may name another pattern for the scan, where the rule itself would match nearly
    everywhere or multiply the states: every match that counts has to begin with a match of it.
    """

    kind: str
    head: str
    tail: str
    least: int
    whole: bool = True
    fold: bool = False
    seek: str | None = None


# The asked-for kinds (fixed values).
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]+",
         8, whole=False, fold=True),
    Rule("access", "AKIA", "[A-Z0-9]+", 16),
    Rule("hex", "", "[0-9a-f]+", 32, seek="[0-9a-f]{8}"),
)

# Public formats of well-known credentials (fixed values).
FORMATS = (
    Rule("github", "gh[oprsu]_", "[A-Za-z0-9]+", 40),
    Rule("slack", "xox[abeoprs]-", "[A-Za-z0-9-]+", 20),
    Rule("google", "AIza", "[A-Za-z0-9_-]+", 39),
    Rule("stripe", "[prs]k_live_", "[A-Za-z0-9]+", 24),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]+", 40, seek="eyJ"),
    Rule("private_key", "-----BEGIN (RSA |EC |DSA |OPENSSH |PGP |ENCRYPTED )?PRIVATE KEY( BLOCK)?", "-----", 1),
)

RULES = BASE + FORMATS


class Scanner:
    """The compiled rules."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        seek = [parse(r.seek or f"({r.head})({r.tail})", r.fold) for r in rules]
        self.machine = compile_rules(seek, search=True)
        self.hits = self.machine.accepts != 0
        whole = [parse(f"({r.head})({r.tail})", r.fold) for r in rules]
        self.whole = [rows_of(compile_rules([tree], search=False)) for tree in whole]
        self.heads = [
            rows_of(compile_rules([parse(r.head, r.fold)], search=False)) if r.head else None for r in rules
        ]

    def rows(self, column: pa.Array):
        """Per text its spans as (start, rule number, end), in code points, sorted."""
        for _, rows, data, offsets in text_slices(column):
            found: list[list[tuple[int, int, int]]] = [[] for _ in range(rows)]
            places = offsets[1:] + np.arange(rows)  # where the breaks between rows come to lie
            parted = np.insert(data, offsets[1:], BREAK)
            states = run(self.machine, parted) // self.machine.width
            marks = np.flatnonzero(self.hits[states])
            if len(marks):
                idle = np.flatnonzero(states == self.machine.idle)
                behind = np.searchsorted(idle, marks)
                # the stretch of a mark: behind the last idle byte before it, up to the next idle byte
                begins = np.where(behind > 0, idle[np.maximum(behind - 1, 0)] + 1, 0)
                stretch, first = np.unique(begins, return_index=True)
                bits = np.bitwise_or.reduceat(self.machine.accepts[states[marks]], first)
                ends = idle[behind[first]]
                owners = np.searchsorted(places, stretch)
                last = -1
                for a, b, bit, row in zip(stretch.tolist(), ends.tolist(), bits.tolist(), owners.tolist()):
                    base = int(offsets[row]) + row
                    if row != last:
                        text, last = data[offsets[row] : offsets[row + 1]].tobytes(), row
                        free = [0] * len(self.rules)  # where the next match of a rule may begin
                    for r in range(len(self.rules)):
                        if bit >> r & 1:
                            spans, free[r] = self._spans(r, text, max(a - base, free[r]), b - base)
                            found[row].extend(spans)
            for row, spans in enumerate(found):
                yield self._code_points(spans, data[offsets[row] : offsets[row + 1]]) if spans else spans

    def _spans(self, r: int, text: bytes, at: int, behind: int):
        """The rule's matches that count and begin from ``at`` on, before ``behind``; where it left off."""
        rule, (table, accepts), out = self.rules[r], self.whole[r], []
        starts = table[0]
        while at < behind:
            if starts[text[at]] < 0 or (end := _longest(table, accepts, text, at)) < 0:
                at += 1
                continue
            first = at
            if not rule.whole and self.heads[r]:
                first = _longest(*self.heads[r], text, at)
            if sum(b & 0xC0 != 0x80 for b in text[first:end]) >= rule.least:
                out.append((at, r, end))
            at = end
        return out, at

    @staticmethod
    def _code_points(spans, data: np.ndarray):
        before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        return sorted((int(before[s]), r, int(before[e])) for s, r, e in spans)


def _longest(table: list[list[int]], accepts: list[bool], text: bytes, at: int) -> int:
    """Where the longest match that begins at ``at`` ends; -1 for none."""
    state, end = 0, -1
    for i in range(at, len(text)):
        state = table[state][text[i]]
        if state < 0:
            break
        if accepts[state]:
            end = i + 1
    return end


SPANS = "array<struct<kind:string,start:long,end:long>>"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: doc_id, spans (kind, start, end), by start, then in the order of the rules.

    Places are code points from 0, ends exclusive. A null text is empty and holds nothing. Rows of equal or
    null id are scanned each by itself. Spans of different kinds may overlap, those of one do not. Nothing
    is shuffled; empty tables and other columns are fine.
    """
    scanner = Scanner(rules)
    kinds = [r.kind for r in rules]
    inside = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def find(batches):
        for batch in batches:
            spans = list(scanner.rows(batch.column("text")))
            bounds = np.concatenate([[0], np.cumsum([len(s) for s in spans])]).astype(np.int32)
            flat = [s for row in spans for s in row]
            columns = [pa.array([kinds[r] for _, r, _ in flat], pa.string()),
                       pa.array([s for s, _, _ in flat], pa.int64()), pa.array([e for _, _, e in flat], pa.int64())]
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(columns, fields=list(inside)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        find, f"doc_id {kind}, spans {SPANS}"
    )


def digest(found: DataFrame, base: tuple[str, ...] = tuple(r.kind for r in BASE)) -> DataFrame:
    """Per row of ``scan``: doc_id, n_<kind> for the base kinds, base_sha256, spans as one string."""

    def joined(spans):
        parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.array_join(parts, ",")

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select(
        "doc_id", *counts, F.sha2(joined(of(*base)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
