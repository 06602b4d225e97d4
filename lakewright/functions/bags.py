"""Groups and bags of an array's words, made inside the row: nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .batches import places


def with_places(rows: DataFrame, words: str, out: str) -> DataFrame:
    """rows with array<struct<term, places>> of an array of words: each distinct word and where it stands, from 0."""
    return rows.withColumn(out, places(F.col(f"`{words}`")))


def numbered(grouped: Column) -> Column:
    """Words of with_places() with their number among equal ones: sets of these intersect as the bags do."""
    return F.flatten(F.transform(grouped, lambda g: F.transform(g["places"], lambda _, k: F.concat(g["term"], F.lit("\x01"), k.cast("string")))))
