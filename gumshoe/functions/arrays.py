"""Rows from arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, items: Column | str, name: str, *keep: Column | str) -> DataFrame:
    """(keep..., name): one row per item of an array, none for an empty one.

    For arrays computed from text. A plain `explode` makes the optimizer test the array for
    null and for size below the projection that computes it, so each text would be worked on
    three times; the outer form followed by a filter computes it once.
    """
    return df.select(*keep, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())
