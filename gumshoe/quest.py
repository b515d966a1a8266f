"""The investigation ("quest") as a set of DataFrames, one per kind."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITY_KINDS = ("countries", "cities", "orgs", "idents", "events")
EDGE_KINDS = ("relations", "links", "quotes")
KINDS = ENTITY_KINDS + EDGE_KINDS + ("sources",)

# The name prefix of every kind.
PREFIX = {
    "countries": "country",
    "cities": "city",
    "orgs": "org",
    "idents": "ident",
    "events": "event",
    "relations": "relation",
    "links": "link",
    "quotes": "quote",
    "sources": "source",
}

# Edge kind -> (from column, to column, kind of the from side, kind of the to side).
EDGE_ENDS = {
    "relations": ("rfrom", "rto", "idents", "idents"),
    "links": ("lfrom", "lto", "idents", "events"),
    "quotes": ("qfrom", "qto", "events", "events"),
}

_STRINGS = T.ArrayType(T.StringType())


def _schema(*extra: tuple[str, T.DataType]) -> T.StructType:
    base = [
        ("name", T.StringType()),
        ("label", T.StringType()),
        ("description", T.StringType()),
        ("short", T.StringType()),
        ("content", _STRINGS),
        ("cats", _STRINGS),
        ("sources", _STRINGS),
        ("city", T.StringType()),
        ("country", T.StringType()),
        ("docname", T.StringType()),
    ]
    return T.StructType([T.StructField(n, t) for n, t in [*base, *extra]])


_SPAN = (("begin", T.DateType()), ("end", T.DateType()))
SCHEMAS = {
    "countries": _schema(("altlabels", _STRINGS)),
    "cities": _schema(("altlabels", _STRINGS)),
    "orgs": _schema(("altlabels", _STRINGS)),
    "idents": _schema(
        ("altlabels", _STRINGS),
        ("birth", T.DateType()),
        ("death", T.DateType()),
        ("orgs", _STRINGS),
        ("fetchmethod", T.StringType()),
    ),
    "events": _schema(*_SPAN, ("orgs", _STRINGS), ("fetchmethod", T.StringType())),
    "relations": _schema(("rfrom", T.StringType()), ("rto", T.StringType()), *_SPAN),
    "links": _schema(
        ("lfrom", T.StringType()),
        ("lto", T.StringType()),
        *_SPAN,
        ("fetchmethod", T.StringType()),
    ),
    "quotes": _schema(("qfrom", T.StringType()), ("qto", T.StringType())),
    "sources": _schema(
        ("url", T.StringType()),
        ("link", T.StringType()),
        ("local", T.StringType()),
        ("youtube", T.StringType()),
        ("bsky", T.StringType()),
        ("orgs", _STRINGS),
        ("fetchmethod", T.StringType()),
    ),
}


def conform(df: DataFrame, kind: str) -> DataFrame:
    """Bring a table to the schema of its kind; absent columns are null, absent lists empty."""
    have = set(df.columns)
    columns = []
    for field in SCHEMAS[kind].fields:
        if field.name in have:
            column = F.col(field.name).cast(field.dataType)
        else:
            column = F.lit(None).cast(field.dataType)
        if field.name in ("cats", "sources", "orgs", "content"):
            column = F.coalesce(column, F.array().cast(_STRINGS))
        if field.name == "short" and "label" in have:
            column = F.coalesce(column, F.col("label"))
        columns.append(column.alias(field.name))
    return df.select(*columns)


class Quest:
    """One DataFrame per kind. All operators take a quest and stay lazy.

    A table may be given as a function; it is then built when first asked for, so a query over
    one kind does not analyse the others.
    """

    def __init__(self, default_country: str | None = None, **tables: DataFrame | Callable[[], DataFrame]):
        unknown = set(tables) - set(KINDS)
        if unknown:
            raise ValueError(f"unknown kinds: {sorted(unknown)}")
        self.default_country = default_country
        self._tables = dict(tables)

    def __getattr__(self, kind: str) -> DataFrame:
        if kind.startswith("_") or kind not in KINDS:
            raise AttributeError(kind)
        return self.table(kind)

    def table(self, kind: str) -> DataFrame:
        if kind not in self._tables:
            raise KeyError(f"the quest has no {kind}")
        table = self._tables[kind]
        if callable(table):
            table = self._tables[kind] = table()
        return table

    def with_tables(self, **tables: DataFrame | Callable[[], DataFrame]) -> "Quest":
        return Quest(self.default_country, **{**self._tables, **tables})

    def citations(self, *kinds: str) -> DataFrame:
        """Bridge table (kind, name, source): who cites which source. The lists are as long as
        an author wrote them; everything downstream joins this table."""
        kinds = kinds or ENTITY_KINDS + EDGE_KINDS
        parts = [
            self.table(k).select(
                F.lit(k).alias("kind"), "name", F.explode("sources").alias("source")
            )
            for k in kinds
        ]
        return reduce(DataFrame.unionByName, parts)


def first_org(orgs: str = "orgs"):
    """First organisation of a list, null for an empty list."""
    return F.try_element_at(F.col(orgs), F.lit(1))


def named(df: DataFrame, kind: str) -> DataFrame:
    """(kind, name) rows of a table."""
    return df.select(F.lit(kind).alias("kind"), "name")


def edge_name(prefix: str, source: str, label: str, target: str):
    return F.concat(F.lit(prefix + "."), F.col(source), F.lit("__"), F.col(label), F.lit("__"), F.col(target))
