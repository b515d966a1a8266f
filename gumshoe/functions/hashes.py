"""Digests of rows, contents and metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\u001f"


def fingerprint(*fields: Column) -> Column:
    """Digest over the fields joined by a unit separator; null counts as empty."""
    texts = [F.coalesce(f.cast("string"), F.lit("")) for f in fields]
    return F.sha2(F.concat_ws(SEPARATOR, *texts), 256)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def meta_hash(metadata: Column) -> Column:
    """Digest of a string map, whatever the order of its entries."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(metadata)))
    return F.sha2(F.to_json(ordered), 256)
