"""Mixing sources to target weights by fitting a subset of document lengths to each budget.

Documents are counted by exact length. A source first gives as many whole passes as its target holds.
The rest of the target is filled length by length in proportion, and what remains of it after that is
met by a bounded knapsack over the lengths still free. A source that this leaves off its target repeats
documents unevenly, its long ones first. Which documents of a length are taken is
decided by a seeded hash of their ids.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import with_positions

WORD = r"[^\x20\x09-\x0D]+"

#: Sums that the knapsack tells apart, up to its budget: all of them up to so many words, and above one
#: of each range of budget / KNAPSACK words. Larger rests are filled greedily down to it where they can be.
KNAPSACK = 1 << 16

_CHOICE = "source_key string, size long, chosen long"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: Sequence[int], weights: Sequence[float], limit: float) -> list[float]:
    """Shares of sum(sizes) by weight, none above ``limit`` times its size; excess is shared anew."""
    target = [0.0] * len(sizes)
    free = set(range(len(sizes)))
    left = float(sum(sizes))
    while free:
        weight = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / weight >= limit * sizes[i]}
        if not over:
            for i in free:
                target[i] = left * weights[i] / weight
            break
        for i in over:
            target[i] = limit * sizes[i]
        left -= sum(target[i] for i in over)
        free -= over
    return target


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take, so that the words come near ``budget``.

    At most ``counts`` of each; lengths are positive and distinct, sum(lengths * counts) > budget.
    """
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(lengths), dtype=np.int64)
    # floor(count * budget / total) in whole numbers, however large they are
    taken = np.array([int(c) * budget // total for c in counts], dtype=np.int64)
    rest = budget - int((lengths * taken).sum())
    free = counts - taken
    order = np.argsort(-lengths, kind="stable")
    for i in order:
        if rest <= KNAPSACK:
            break
        more = min(int(free[i]), (rest - KNAPSACK) // int(lengths[i]) + 1, rest // int(lengths[i]))
        taken[i] += more
        free[i] -= more
        rest -= more * int(lengths[i])
    taken += _knapsack(lengths, free, rest)
    return taken


def _knapsack(
    lengths: np.ndarray, free: np.ndarray, budget: int, low: int | None = None, high: int | None = None
) -> np.ndarray:
    """Bounded knapsack by dynamic programming: the reachable sum nearest to ``budget``, the lower of two.

    With ``low`` and ``high`` a sum between them goes before others, and one near them before one far
    off. Sums are true ones; of those that fall into one range the first one stays.
    """
    low, high = budget if low is None else low, budget if high is None else high
    if high <= 0 or not len(lengths):
        return np.zeros(len(lengths), dtype=np.int64)
    unit = -(-high // KNAPSACK)
    top = high + min(high, int(lengths.max()))
    sums = np.full(top // unit + 1, -1, dtype=np.int64)
    sums[0] = 0
    via = np.full(len(sums), -1, dtype=np.int64)
    steps: list[tuple[int, int]] = []
    # a step that gives the budget itself, though another sum may hold its range
    last = 0 if budget == 0 else -1
    for i in np.argsort(-lengths, kind="stable"):
        length, power = int(lengths[i]), 1
        left = min(int(free[i]), top // length)
        while left > 0 and last < 0:
            n = min(power, left)
            left -= n
            power *= 2
            w = n * length
            held = sums[sums >= 0]
            found = held[held <= top - w] + w
            if (found == budget).any():
                last = w
            place = found // unit
            new = sums[place] < 0
            sums[place[new]] = found[new]
            via[place[new]] = len(steps)
            steps.append((int(i), n))
        if last >= 0:
            break
    out = np.zeros(len(lengths), dtype=np.int64)
    if last > 0:
        i, n = steps[-1]
        out[i] += n
        at = budget - last
    elif last == 0:
        at = 0
    else:
        held = np.sort(sums[sums >= 0])
        off = np.maximum(np.maximum(low - held, held - high), 0)
        held = held[off == off.min()]
        at = int(held[np.argmin(np.abs(held - budget))])
    while at > 0:
        i, n = steps[via[at // unit]]
        out[i] += n
        at -= n * int(lengths[i])
    return out


def _in_proportion(lengths: np.ndarray, counts: np.ndarray, target: int, limit: int) -> np.ndarray:
    """Whole passes, then a subset for the rest."""
    total = int((lengths * counts).sum())
    passes = min(limit, target // total)
    taken = passes * counts
    if passes < limit:
        taken = taken + fit_budget(lengths, counts, target - passes * total)
    return taken


def _long_first(lengths: np.ndarray, counts: np.ndarray, target: int, limit: int) -> np.ndarray:
    """The long documents by a knapsack near their share, then the short ones in proportion.

    Long are those of more than a thousandth of the target. The knapsack leaves no more than the short
    ones can fill, where it can.
    """
    long = lengths * 1000 > target
    total, short = int((lengths * counts).sum()), int((lengths * counts)[~long].sum())
    low = max(0, target - limit * short)
    share = min(max((total - short) * target // total, low), target)
    taken = np.zeros(len(lengths), dtype=np.int64)
    taken[long] = _knapsack(lengths[long], limit * counts[long], share, low, target)
    if short:
        rest = max(0, target - int((lengths * taken).sum()))
        taken[~long] = _in_proportion(lengths[~long], counts[~long], rest, limit)
    return taken


def fit_source(lengths: np.ndarray, counts: np.ndarray, target: int, limit: int) -> np.ndarray:
    """How often documents of each length are taken in all, at most ``limit`` times each.

    Whole passes first, then a subset for the rest. Where no subset comes near, documents may be
    repeated unevenly to come nearer: the long ones first, and if that misses, all of them.
    """

    def miss(t):
        return abs(int((lengths * t).sum()) - target)

    taken = _in_proportion(lengths, counts, target, limit)
    if 1000 * miss(taken) > target:
        taken = min(taken, _long_first(lengths, counts, target, limit), key=miss)
        if miss(taken):
            taken = min(taken, _knapsack(lengths, limit * counts, target), key=miss)
    return taken


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    limit: int = 3,
    seed: int = 17,
) -> DataFrame:
    """One row per input row: doc_id, size, source, source_size, target, copies, taken.

    ``size`` counts the text's words; a null text has none. ``weights`` repeat over the sources in code
    point order, null last. ``copies`` says how often the mix holds the document, at most ``limit``
    times; ``taken`` is ``copies * size``. Documents without words are never taken. Rows of equal id,
    source and size are interchangeable. An empty table gives no rows.
    The driver sees one row per source.
    """
    keyed = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t")).alias("source_key"),
        word_count(F.col("text")).alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id")).alias("draw"),
    )
    placed = with_positions(keyed, ["source_key", "size", "draw", "doc_id"], "mix")
    lengths = placed.groupBy("source_key", "size").agg(
        F.count("*").alias("n"), F.min("position").alias("first_position")
    )
    totals = lengths.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n")).alias("s")).collect()
    totals = sorted((r["source_key"].encode(), r["source_key"], int(r["s"])) for r in totals)
    sizes = [s for *_, s in totals]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], limit)
    plan = docs.sparkSession.createDataFrame(
        [(k, s, float(t)) for (_, k, s), t in zip(totals, targets)],
        "source_key string, source_size long, target double",
    )

    def choose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["size"] > 0].sort_values("size")
        size = int(rows["source_size"].iloc[0]) if len(rows) else 0
        if not size:
            return pd.DataFrame(
                {c: pd.Series(dtype="int64" if c != "source_key" else "object") for c in ("source_key", "size", "chosen")}
            )
        chosen = fit_source(
            rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), round(float(rows["target"].iloc[0])), limit
        )
        return pd.DataFrame({"source_key": key[0], "size": rows["size"], "chosen": chosen})

    choice = (
        lengths.join(F.broadcast(plan), "source_key")
        .groupBy("source_key")
        .applyInPandas(choose, _CHOICE)
    )
    starts = lengths.select("source_key", "size", "first_position", "n").join(
        choice, ["source_key", "size"], "left"
    )
    rank = F.col("position") - F.col("first_position")
    each, rest = F.expr("chosen div n"), F.col("chosen") % F.col("n")
    copies = F.coalesce(each + (rank < rest).cast("long"), F.lit(0))
    return (
        placed.join(starts, ["source_key", "size"])
        .join(F.broadcast(plan), "source_key")
        .withColumn("copies", copies)
        .select(
            "doc_id", "size", "source", "source_size", "target", "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
        )
    )
