"""Comma lists and name prefixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def with_prefix(names: Sequence[str], prefix: str) -> list[str]:
    """Parameter-side: names with their kind prefix."""
    return [n if n.startswith(prefix + ".") else f"{prefix}.{n}" for n in names]


def add_prefix(name: Column, prefix: str) -> Column:
    return F.when(name.startswith(prefix + "."), name).otherwise(F.concat(F.lit(prefix + "."), name))


def split_list(text: Column, prefix: str | None = None, sep: str = ",") -> Column:
    """Comma text to a list without empty items, each carrying the kind prefix."""
    items = F.filter(F.split(text, sep, -1), lambda x: x != "")
    if prefix:
        items = F.transform(items, lambda x: add_prefix(x, prefix))
    return F.coalesce(items, F.array().cast("array<string>"))


def split_alternatives(text: Column) -> Column:
    """Pipe-separated labels, trimmed, without empty ones."""
    parts = F.transform(F.split(text, r"\|", -1), lambda x: F.trim(x))
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def joined(items: Column | str) -> Column:
    return F.array_join(items, ",")
