"""The token-sorted similarity of names: 200 * LCS / (length a + length b) of the sorted, blank-joined tokens."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit per character of a."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def token_sort_ratio(a: str, b: str) -> float:
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    total = len(a) + len(b)
    return 200.0 * lcs_length(a, b) / total if total else 100.0


@F.pandas_udf(DoubleType())
def token_sort(a: pd.Series, b: pd.Series) -> pd.Series:
    """Column form; repeated pairs of a batch are computed once."""
    pairs = list(zip(a, b, strict=True))
    table = {p: (np.nan if None in p else token_sort_ratio(*p)) for p in set(pairs)}
    return pd.Series([table[p] for p in pairs], dtype="float64")
