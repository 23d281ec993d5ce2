"""Token-set ratio: how alike two names are when shared words are set aside.

The ratio needs longest common subsequences, which no built-in gives, so it is an Arrow-batched function; callers pass
each pair of distinct texts once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, with the rows of the table as bits of one number."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | (1 << i)
    open_bits = full = (1 << len(a)) - 1
    for c in b:
        hit = open_bits & places.get(c, 0)
        open_bits = ((open_bits + hit) | (open_bits - hit)) & full
    return len(a) - open_bits.bit_count()


def token_set_ratio(a: str, b: str) -> float:
    """0 to 100. 0 if either has no token, 100 if they share one and either has no other."""
    one, two = set(a.split()), set(b.split())
    if not one or not two:
        return 0.0
    shared = one & two
    if shared and (one <= two or two <= one):
        return 100.0
    x, y = " ".join(sorted(one - two)), " ".join(sorted(two - one))
    core = len(" ".join(sorted(shared)))
    gap = 1 if shared else 0
    size_x, size_y = core + gap + len(x), core + gap + len(y)
    part = lambda distance, whole: 100.0 - 100.0 * distance / whole if whole else 100.0
    best = part(len(x) + len(y) - 2 * lcs_length(x, y), size_x + size_y)
    if shared:
        best = max(best, part(gap + len(x), core + size_x), part(gap + len(y), core + size_y))
    return best


@F.pandas_udf(DoubleType())
def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    return _ratios(a, b)
