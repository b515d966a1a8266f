"""Results of several peers in one ranking; which peers to ask."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gumshoe.functions.arrays import unnest
from gumshoe.functions.urls import safe_url
from gumshoe.operators.index import SearchIndex, search_tokens
from gumshoe.operators.ranking import join_same, ranked, top_per_group
from gumshoe.operators.search import query_words, scored_hits


def norm_minmax(results: DataFrame, peer: str = "peer", score: str = "score") -> DataFrame:
    """Adds `normalized_score` = (s - min) / (max - min) per peer, 1 when all are equal; a
    missing score counts as 0. The bounds are aggregated first and joined back, so a peer with
    most of the rows is not gathered in one task."""
    value = F.coalesce(F.col(score), F.lit(0.0))
    bounds = results.groupBy(peer).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    span = F.col("_high") - F.col("_low")
    scaled = F.when(span == 0, 1.0).otherwise((value - F.col("_low")) / span)
    return join_same(results, bounds, [peer]).select(*results.columns, scaled.alias("normalized_score"))


def norm_rank(results: DataFrame, order: Sequence[str], peer: str = "peer", score: str = "score") -> DataFrame:
    """Adds `normalized_score` = 1 - rank / (n - 1) per peer, 1 for a single result; ties go by
    `order`."""
    value = F.coalesce(F.col(score), F.lit(0.0))
    placed = ranked(results.withColumn("_value", value), [F.desc("_value"), *[F.asc(c) for c in order]], [peer], "_rank")
    sizes = results.groupBy(peer).agg(F.count(F.lit(1)).alias("_n"))
    scaled = F.when(F.col("_n") == 1, 1.0).otherwise(1 - (F.col("_rank") - 1) / (F.col("_n") - 1))
    return join_same(placed, sizes, [peer]).select(*results.columns, scaled.alias("normalized_score"))


def fuse_results(
    results: DataFrame, method: str = "minmax", limit: int | None = None, ties: Sequence[str] = ("doc",), peer: str = "peer"
) -> DataFrame:
    """All peers' results by normalised score. Nothing is merged across peers; peers without
    results vanish."""
    if method == "minmax":
        scaled = norm_minmax(results, peer)
    elif method == "rank":
        scaled = norm_rank(results, ties, peer)
    else:
        raise ValueError(f"unknown method {method!r}: minmax or rank")
    out = scaled.orderBy(F.desc("normalized_score"), peer, *ties)
    return out.limit(limit) if limit is not None else out


def peer_vocabulary(docs: DataFrame, peer: str = "peer") -> DataFrame:
    """Published words (peer, term), folded: every term of the texts and of the entity labels, so a
    peer that holds a query word is always asked. Rows, written and pruned by term like postings."""
    texts = unnest(docs.select(peer, search_tokens(F.col("data")).alias("_t")), F.array_distinct("_t"), "term", peer)
    texts = texts.where((F.length("term") >= 3) & F.col("term").rlike(r"^\p{L}+$"))
    labels = unnest(docs.select(peer, search_tokens(F.col("title")).alias("_t")), "_t", "term", peer)
    return texts.select(peer, "term").union(labels.select(peer, "term")).distinct()


def route_peers(vocabulary: DataFrame, query: str, peer: str = "peer") -> DataFrame:
    """Peers whose published words meet the query words, both folded."""
    return vocabulary.where(F.col("term").isin(*query_words(query))).select(peer).distinct()


def peer_search(
    index: SearchIndex,
    query: str,
    mode: str = "fast",
    self_peer: str | None = None,
    limit_per_peer: int = 10,
    total_limit: int | None = None,
    method: str = "minmax",
    peer: str = "peer",
    memory: DataFrame | None = None,
    languages: DataFrame | None = None,
) -> DataFrame:
    """Search every chosen peer on its own statistics, keep its best, fuse.

    `fast` asks the peers that hold a query word, and oneself, `deep` all: routing is the fan-out itself, as
    only postings of the words are read. With a translation `memory` (lang, term, translation) and the
    peers' `languages` (peer, lang), each peer is also asked in the words of its language. One job,
    cut to `limit_per_peer` rows per peer in each task before the shuffle.
    """
    if mode not in ("fast", "deep"):
        raise ValueError(f"unknown mode {mode!r}: fast or deep")
    words = query_words(query)
    if memory is None:
        hits = index.hits(words)
    else:
        own = index.spark.createDataFrame([(w,) for w in words], "term string")
        told = memory.join(own, "term").select("lang", F.explode(search_tokens(F.col("translation"))).alias("term"))
        each = languages.select(peer, F.explode(F.array(*[F.lit(w) for w in words])).alias("term"))
        asked = languages.join(told, "lang").select(peer, "term").union(each)
        hits = index.table("postings").join(asked.distinct(), [peer, "term"], "left_semi")
    hits = hits.select("doc", "term", "tf", "doc_len", peer)
    if mode == "fast":
        chosen = hits.select(peer).distinct()
        if self_peer is not None:
            chosen = chosen.union(index.spark.createDataFrame([(self_peer,)], f"{peer} string")).distinct()
        hits = hits.join(chosen, peer, "left_semi")
    scored = scored_hits(hits, index.group_stats(), len(words), by=peer)
    best = top_per_group(scored, [peer], [F.desc("score"), F.asc("doc")], limit_per_peer)
    shown = best.join(index.docs().select("doc", "title", safe_url(F.coalesce("url", F.lit(""))).alias("url")), "doc")
    return fuse_results(shown, method, total_limit, peer=peer)
