"""Kernels of strings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells of one step's tables.
_CELLS = 4_000_000


def subsequence_kernels(a: list[str], b: list[str], length: int = 3, decay: float = 0.5) -> np.ndarray:
    """For every pair of strings the sum over common subsequences of ``length`` characters, wherever they lie, of decay ** (span in one + span in the other).

    All pairs of a batch advance together through the recurrence over the characters of both; shorter strings are filled up with characters that match nothing.
    """
    codes = [[np.array([ord(c) for c in x], np.int64) for x in side] for side in (a, b)]
    n, m = (max(1, max(map(len, side), default=1)) for side in codes)
    if len(a) > 1 and len(a) * (n + 1) * (m + 1) > _CELLS:
        half = len(a) // 2
        return np.concatenate([subsequence_kernels(a[:half], b[:half], length, decay), subsequence_kernels(a[half:], b[half:], length, decay)])
    s, t = np.full((len(a), n), -1), np.full((len(a), m), -2)
    for to, side in ((s, codes[0]), (t, codes[1])):
        for i, x in enumerate(side):
            to[i, : len(x)] = x
    same = s[:, :, None] == t[:, None, :]
    inside = np.ones((len(a), n + 1, m + 1))  # of subsequences of i characters, with the decay up to the ends of both prefixes
    for _ in range(length - 1):
        later = np.zeros_like(inside)
        for i in range(1, n + 1):
            open_ = np.zeros(len(a))
            for j in range(1, m + 1):
                open_ = decay * open_ + decay * decay * same[:, i - 1, j - 1] * inside[:, i - 1, j - 1]
                later[:, i, j] = decay * later[:, i - 1, j] + open_
        inside = later
    return decay * decay * (same * inside[:, :-1, :-1]).sum((1, 2))


def subsequence_kernel(a: Column, b: Column, length: int = 3, decay: float = 0.5, normalised: bool = False) -> Column:
    """The kernel of two string columns, ``normalised`` by the root of both strings' own (0 where a string is shorter than ``length``); null with a null string."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        known = x.notna() & y.notna()
        out = np.full(len(x), np.nan)
        u, v = x[known].to_list(), y[known].to_list()
        k = subsequence_kernels(u, v, length, decay)
        if normalised:
            own = subsequence_kernels(u, u, length, decay) * subsequence_kernels(v, v, length, decay)
            k = np.divide(k, np.sqrt(own), out=np.zeros_like(k), where=own > 0)
        out[known.to_numpy()] = k
        return pd.Series(out).astype(object).where(known.to_numpy(), None)

    return F.pandas_udf(run, "double")(a, b)
