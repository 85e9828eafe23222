"""Counts of symbol n-grams over a small alphabet, whatever the corpus: at most size ** order rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ngram_keys(symbols, begin, order: int, size: int):
    """For each symbol of many concatenated texts, its n-gram as one number; symbol 0 stands before a text begins.

    begin: where each text that isn't empty starts.
    """
    import numpy as np

    out = symbols.astype(np.int64)
    place = np.arange(len(symbols)) - np.repeat(begin, np.diff(np.r_[begin, len(symbols)]))
    for back in range(1, order):
        before = np.zeros(len(symbols), np.int64)
        before[back:] = symbols[:-back] if back else symbols
        before[place < back] = 0
        out += before * size**back
    return out


def summed(counts: DataFrame) -> DataFrame:
    """Rows (key, n) of many tasks as one row for each key."""
    return counts.groupBy("key").agg(F.sum("n").alias("n"))
