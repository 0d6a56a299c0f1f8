"""How many of the rows that a counted row stands for a random sample holds."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _units(keys: np.ndarray, number: int) -> np.ndarray:
    """Numbers in (0, 1) that follow from a row's 64-bit key and the number of the sample (splitmix64)."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.int64).view(np.uint64) + np.uint64((number + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def _law(n: int, rate: float, again: bool) -> tuple[int, np.ndarray]:
    """(least number, distribution function from there on) of how many of ``n`` rows are drawn.

    What lies further than ten deviations and thirty rows from the mean is left out.
    """
    mean = n * rate
    reach = 10 * math.sqrt(mean if again else mean * (1 - rate)) + 30
    low, high = max(0, math.floor(mean - reach)), math.ceil(mean + reach)
    k = np.arange(low + 1, (high if again else min(high, n)) + 1)
    steps = np.log(mean / k) if again else np.log((n - k + 1) / k * (rate / (1 - rate)))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    upto = np.cumsum(np.exp(logs - logs.max()))
    return low, upto / upto[-1]


def drawn(units: np.ndarray, n: np.ndarray, rate: float, again: bool) -> np.ndarray:
    """Of rows that stand for ``n`` each, how many each sample holds, from uniform numbers (rows x samples)."""
    if rate >= 1 and not again:
        return np.broadcast_to(n[:, None], units.shape)
    out = np.empty(units.shape, np.int64)
    order = np.argsort(n, kind="stable")
    sizes, first = np.unique(n[order], return_index=True)
    for size, at in zip(sizes, np.split(order, first[1:])):
        low, upto = _law(int(size), rate, again)
        out[at] = low + np.minimum(np.searchsorted(upto, units[at], side="right"), len(upto) - 1)
    return out


def draws(key: Column, n: Column, numbers: list[int], rate: float, again: bool) -> Column:
    """Array: for each of the samples ``numbers``, how many of a row's ``n`` rows it holds.

    Each of the rows is in a sample with the chance ``rate``; with ``again`` a row is drawn
    as often as a Poisson number of that mean says, as bootstraps of Spark ML do. The numbers
    follow from ``key``, a 64-bit hash of the row, so a retry draws the same.
    """

    @F.pandas_udf("array<bigint>")
    def many(keys: pd.Series, rows: pd.Series) -> pd.Series:
        k = keys.to_numpy()
        units = np.stack([_units(k, i) for i in numbers], axis=1)
        return pd.Series(list(drawn(units, rows.to_numpy(), rate, again)))

    return many(key, n)
