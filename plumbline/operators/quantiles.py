"""Exact quantiles of numeric columns, without sorting or shuffling the column.

The built-in exact percentile keeps every distinct value of a column in one task. Here a sketch
brackets each wanted rank, one counting pass proves the bracket, and the bracket is narrowed again
until few rows are left in it. Each pass is a plain aggregate combined before its shuffle, and only
counts reach the driver. The sketch is never trusted: a rank outside its bracket widens it again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.coercion import quoted

_SKETCH = 10_000  # accuracy of the sketch: ranks are off by at most 1/10000 of the rows
_SLACK = 2.0 / _SKETCH
_FEW = 20_000  # rows of a bracket that are finished by sorting them


@dataclass
class _Wanted:
    """Ranks ``first`` and ``last`` (0-based, equal or neighbours) of one column.

    Both lie among the ``inside`` rows with values low..high; ``below`` rows are smaller.
    """

    column: str
    first: int
    last: int
    low: float
    high: float
    below: int
    inside: int
    values: tuple[float, float] | None = None

    def bracketed(self) -> Column:
        c = _number(self.column)
        return F.when(c.between(F.lit(self.low), F.lit(self.high)), c)


def _number(name: str) -> Column:
    c = F.col(quoted(name)).cast("double")
    return F.when(~F.isnan(c), c)


def _row(df: DataFrame, aggregates: list[Column]) -> list:
    if not aggregates:
        return []
    return list(df.agg(*(a.alias(f"a{i}") for i, a in enumerate(aggregates))).first())


def _tighten(df: DataFrame, wanted: list[_Wanted], brackets: list[tuple[float, float]]) -> None:
    """Count the rows below and inside the proposed brackets, and keep the part with the ranks."""
    tests = []
    for w, (low, high) in zip(wanted, brackets):
        inside = w.bracketed()
        tests += [F.count_if(inside < low), F.count_if(inside <= high)]
    counts = _row(df, tests)
    for i, (w, (low, high)) in enumerate(zip(wanted, brackets)):
        smaller, up_to = w.below + counts[2 * i], w.below + counts[2 * i + 1]
        end = w.below + w.inside
        if w.first >= smaller:
            w.low, w.below = low, smaller
        if w.last < up_to:
            w.high, end = high, up_to
        w.inside = end - w.below


def _finish(df: DataFrame, wanted: list[_Wanted]) -> None:
    """Sort the few rows left in each bracket; a bracket of one value needs no sorting."""
    todo = []
    for w in wanted:
        if w.low == w.high:
            w.values = w.low, w.low
        elif w.values is None:
            todo.append(w)
    ordered = [F.sort_array(F.collect_list(w.bracketed())) for w in todo]
    pairs = _row(
        df,
        [
            F.array(o[w.first - w.below], o[w.last - w.below])
            for w, o in zip(todo, ordered)
        ],
    )
    for w, pair in zip(todo, pairs):
        w.values = tuple(pair)


def exact_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float]
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each column; None for a column without values."""
    if not columns:
        return {}
    around = [min(1.0, max(0.0, p + s)) for p in probabilities for s in (-_SLACK, _SLACK)]
    base = _row(
        df,
        [
            a
            for c in columns
            for a in (
                F.count(_number(c)),
                F.min(_number(c)),
                F.max(_number(c)),
                F.percentile_approx(_number(c), around, _SKETCH),
            )
        ],
    )
    wanted: dict[tuple[str, float], _Wanted] = {}
    proposed = []
    for i, c in enumerate(columns):
        n, low, high, sketch = base[4 * i : 4 * i + 4]
        for k, p in enumerate(probabilities if n else []):
            at = p * (n - 1)
            wanted[c, p] = _Wanted(c, math.floor(at), math.ceil(at), low, high, 0, n)
            proposed.append((sketch[2 * k], sketch[2 * k + 1]))
    large = [(w, b) for w, b in zip(wanted.values(), proposed) if w.inside > _FEW]
    _tighten(df, [w for w, _ in large], [b for _, b in large])
    while True:
        large = [
            w
            for w in wanted.values()
            if w.values is None and w.inside > _FEW and w.low != w.high
        ]
        if not large:
            break
        before = [(w.low, w.high) for w in large]
        _tighten(df, large, _sketched(df, large))
        _halve(df, [w for w, b in zip(large, before) if (w.low, w.high) == b])
    _finish(df, list(wanted.values()))
    result: dict[str, list[float | None]] = {}
    for c in columns:
        result[c] = []
        for p in probabilities:
            if (c, p) not in wanted:
                result[c].append(None)
                continue
            w = wanted[c, p]
            (a, b), n = w.values, base[4 * columns.index(c)]
            result[c].append(a if a == b else a + (b - a) * (p * (n - 1) - w.first))
    return result


def _sketched(df: DataFrame, wanted: list[_Wanted]) -> list[tuple[float, float]]:
    """Brackets around the ranks, from a sketch of the rows inside the present brackets."""
    sketches = []
    for w in wanted:
        low = (w.first - w.below) / w.inside - _SLACK
        high = (w.last - w.below) / w.inside + _SLACK
        sketches.append(
            F.percentile_approx(w.bracketed(), [max(0.0, low), min(1.0, high)], _SKETCH)
        )
    return [tuple(pair) for pair in _row(df, sketches)]


def _halve(df: DataFrame, wanted: list[_Wanted]) -> None:
    """Cut brackets at the middle value, for brackets that the sketch cannot narrow.

    Neighbouring ranks on both sides of the cut are found by that: their values are the largest up
    to the cut and the smallest beyond it.
    """
    largest = 1.7e308
    cuts = [max(-largest, w.low) / 2 + min(largest, w.high) / 2 for w in wanted]
    found = _row(
        df,
        [
            a
            for w, cut in zip(wanted, cuts)
            for a in (
                F.count_if(w.bracketed() <= cut),
                F.max(F.when(w.bracketed() <= cut, w.bracketed())),
                F.min(F.when(w.bracketed() > cut, w.bracketed())),
            )
        ],
    )
    for i, (w, cut) in enumerate(zip(wanted, cuts)):
        n, under, over = found[3 * i : 3 * i + 3]
        if w.last < w.below + n:
            w.high, w.inside = under, n
        elif w.first >= w.below + n:
            w.low, w.below, w.inside = over, w.below + n, w.inside - n
        else:
            w.values = under, over
