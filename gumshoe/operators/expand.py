"""One-hop expansion over relations, links and quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gumshoe.operators.attributes import end_cats
from gumshoe.operators.filters import cats_condition, filter_cats, get_edges
from gumshoe.quest import EDGE_ENDS, Quest
from gumshoe.session import pin


def touching(edges: DataFrame, start: str, stop: str, starts: DataFrame, stops: DataFrame, borders: bool) -> DataFrame:
    """Edges with an end in the given name sets: either end with borders, both without.

    Without borders this is two semi joins. With borders each end is looked up once and the
    flags are combined, so an edge is shuffled per end but never duplicated.
    """
    if not borders:
        inside = edges.join(starts.select(F.col("name").alias(start)), start, "left_semi").join(
            stops.select(F.col("name").alias(stop)), stop, "left_semi"
        )
        return inside.select(edges.columns)
    flagged = edges.join(
        starts.select(F.col("name").alias("_s")), F.col(start) == F.col("_s"), "left"
    ).join(stops.select(F.col("name").alias("_t")), F.col(stop) == F.col("_t"), "left")
    return flagged.where(F.col("_s").isNotNull() | F.col("_t").isNotNull()).drop("_s", "_t")


def kept_edges(quest: Quest, kind: str, starts: DataFrame, stops: DataFrame, borders: bool, cats=(), exclude_cats=()) -> DataFrame:
    """(name, start, stop) of `touching` over `get_edges`. What an end adds to the categories and whether its name
    is in the set are looked up together, so an edge is shuffled once per end."""
    start, stop, start_kind, stop_kind = EDGE_ENDS[kind]
    if not cats and not exclude_cats:
        return touching(quest.table(kind).select("name", start, stop), start, stop, starts, stops, borders)

    def ends(of_kind: str, names: DataFrame) -> DataFrame:
        marked = (names if borders else names.distinct()).select("name", F.lit(True).alias("_in"))
        return end_cats(quest, of_kind).join(marked, "name", "full")

    first = ends(start_kind, starts)
    if (start_kind, starts) == (stop_kind, stops):
        first = second = pin(first, joins=True)
    else:
        second = ends(stop_kind, stops)
    rows = quest.table(kind).select("name", start, stop, "cats")
    own = F.size("cats") > 0
    rows = rows.where(F.when(own, cats_condition(cats, exclude_cats)).otherwise(True))
    for end, side, names in ((start, "_a", first), (stop, "_b", second)):
        found = names.select(F.col("name").alias(side), F.col("cats").alias(side + "_cats"), F.col("_in").alias(side + "_in"))
        rows = rows.join(found, F.col(end) == F.col(side), "left")
    inside = [F.col("_a_in").isNotNull(), F.col("_b_in").isNotNull()]
    rows = rows.where(inside[0] | inside[1] if borders else inside[0] & inside[1])
    rows = rows.withColumn("cats", F.when(own, F.col("cats")).otherwise(F.concat("_a_cats", "_b_cats")))
    return filter_cats(rows, cats, exclude_cats).select("name", start, stop)


def _names(*frames: DataFrame) -> DataFrame:
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.union(frame)
    return rows.distinct()


def ident_relations(
    quest: Quest, idents: DataFrame, cats=(), borders: bool = True, exclude_cats=()
) -> tuple[DataFrame, DataFrame]:
    """(ident names, relations): relations touching `idents`. With borders the neighbours
    outside the set join it; without, only relations inside the set remain."""
    idents = idents.select("name")
    kept = touching(
        get_edges(quest, "relations", cats, exclude_cats), "rfrom", "rto", idents, idents, borders
    )
    if not borders:
        return idents, kept
    return _names(idents, kept.select("rfrom"), kept.select("rto")), kept


def ident_events(
    quest: Quest, idents: DataFrame, events: DataFrame, cats=(), borders: bool = True, exclude_cats=()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ident names, event names, links) for links touching either set."""
    idents, events = idents.select("name"), events.select("name")
    kept = touching(
        get_edges(quest, "links", cats, exclude_cats), "lfrom", "lto", idents, events, borders
    )
    if not borders:
        return idents, events, kept
    return _names(idents, kept.select("lfrom")), _names(events, kept.select("lto")), kept


def event_quotes(
    quest: Quest, events: DataFrame, cats=(), borders: bool = True, exclude_cats=()
) -> tuple[DataFrame, DataFrame]:
    """(event names, quotes) for quotes touching the events."""
    events = events.select("name")
    kept = touching(
        get_edges(quest, "quotes", cats, exclude_cats), "qfrom", "qto", events, events, borders
    )
    if not borders:
        return events, kept
    return _names(events, kept.select("qfrom"), kept.select("qto")), kept
