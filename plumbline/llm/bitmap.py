"""A bitmap of fixed size that lets through what may be in a set, for filters inside tasks.

The bitmap has ``BITS`` bits whatever the set's size, so shipping it to tasks is bounded. A fuller
bitmap lets more through; what is let through is always joined with the real set afterwards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23


def bitmap_of(df: DataFrame, column: str) -> np.ndarray:
    """The bitmap of a long column; nulls are not in it. The driver gets at most BITS / 64 words."""
    place = F.pmod(F.col(column), F.lit(BITS))
    word = F.shiftright(place, 6).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    words = np.zeros(BITS // 64, dtype=np.int64)
    rows = df.filter(F.col(column).isNotNull()).groupBy(word.alias("word")).agg(F.bit_or(bit))
    for at, bits in rows.collect():
        words[at] = bits
    return words


def maybe_in(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = values.astype(np.int64) % BITS
    return (words[place >> 6] >> (place & 63)) & 1 == 1
