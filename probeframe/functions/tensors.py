"""Strips of flat tensor values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefix_strip(values: Column, rows: Column, row_size: int, upper: int) -> Column:
    """The first rows * row_size elements, clamped to [0, upper]."""
    return F.slice(values, F.lit(1), F.greatest(F.lit(0), F.least(rows * row_size, F.lit(upper))))


def chunked_strip(values: Column, counts: Column, chunk: int) -> Column:
    """values is cut into equal chunks; the first counts[i] (clamped to [0, chunk]) of each are put together."""
    return F.flatten(F.transform(counts, lambda n, i: F.slice(values, i * chunk + 1, F.greatest(F.lit(0), F.least(n, F.lit(chunk))))))
