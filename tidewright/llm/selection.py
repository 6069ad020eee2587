"""Exact selection of the k largest values of a distributed column, by repeated histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 256


def kth_largest(df: DataFrame, value: str, k: int, rounds: int = 12) -> float:
    """A threshold t so that the rows with value > t number fewer than k and those with value >= t at least k.

    Each round counts the rows in BINS equal bins of the interval that still holds the k-th value; only counts come to the driver.
    After the rounds the interval's least value over its lower end is exact, since the interval then holds one distinct double or, at worst,
    doubles that differ by 256**-12 of the range.
    """
    low, high, n = df.agg(F.min(value), F.max(value), F.count(value)).first()
    if k <= 0 or n == 0:
        return float("inf")
    if k >= n:
        return low
    above = 0
    for _ in range(rounds):
        if high <= low:
            break
        width = (high - low) / BINS
        if width == 0 or low + width == low:
            break
        inside = df.where((F.col(value) >= low) & (F.col(value) <= high))
        bin_ = F.least(F.floor((F.col(value) - F.lit(low)) / F.lit(width)).cast("int"), F.lit(BINS - 1))
        found = {r.b: r for r in inside.groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).collect()}
        for b in sorted(found, reverse=True):
            if above + found[b].n >= k:
                low, high = found[b].lo, found[b].hi
                break
            above += found[b].n
    return low
