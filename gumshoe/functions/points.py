"""Map point lists: code[:value][:color] or city:lat:lon[:value][:color]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_points(
    df: DataFrame, text: str, key: str, coordinates: bool = False, min_size: float = 50.0, color: str = "red"
) -> DataFrame:
    """One row per point. A third (fifth) part is the colour; a lone second (fourth) part is a
    value when it is a number, else a colour. Later points overwrite earlier ones of a code."""
    items = df.select(key, F.posexplode(F.split(text, ",", -1)).alias("pos", "item"))
    parts = items.withColumn("p", F.transform(F.split(F.trim("item"), ":", -1), lambda x: F.trim(x)))
    fixed = 3 if coordinates else 1

    def part(i: int) -> Column:
        return F.get("p", F.lit(i))

    n = F.size("p")
    number = part(fixed).try_cast("double")
    value = F.when(n == fixed, F.lit(min_size)).otherwise(F.coalesce(number, F.lit(min_size)))
    tint = (
        F.when(n == fixed + 2, part(fixed + 1))
        .when((n == fixed + 1) & number.isNull(), part(fixed))
        .otherwise(F.lit(color))
    )
    columns = [F.upper(part(0)).alias("code")]
    if coordinates:
        columns += [part(1).try_cast("double").alias("latitude"), part(2).try_cast("double").alias("longitude")]
    rows = parts.where(n.between(fixed, fixed + 2)).select(
        key, "pos", *columns, value.alias("value"), tint.alias("color")
    )
    others = [c for c in rows.columns if c not in (key, "code")]
    last = rows.groupBy(key, "code").agg(F.max(F.struct(*others)).alias("last"))
    return last.select(key, "code", *[F.col(f"last.{c}").alias(c) for c in others if c != "pos"])
