"""Exports: CSV, graph text, snapshots, documents for retrieval."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gumshoe.functions.lists import joined
from gumshoe.operators.attributes import with_style
from gumshoe.operators.filters import Params, filter_rows
from gumshoe.operators.linked import source_referrers
from gumshoe.operators.ranking import ranked
from gumshoe.plans.report import Report, build_report, group_orgs
from gumshoe.quest import EDGE_ENDS, KINDS, Quest
from gumshoe.session import pin

# The columns of each exported table.
CSV_COLUMNS = {
    "countries": ("name", "label", "description", "cats"),
    "cities": ("name", "label", "description", "cats"),
    "orgs": ("name", "label", "description", "content", "cats", "country"),
    "idents": ("name", "label", "description", "content", "orgs", "cats", "country"),
    "events": ("name", "label", "description", "content", "begin", "end", "cats", "country"),
    "relations": ("name", "label", "description", "content", "from", "to", "begin", "end", "cats"),
    "links": ("name", "label", "description", "content", "from", "to", "cats"),
    "quotes": ("name", "label", "description", "content", "from", "to", "cats"),
    "sources": ("name", "label", "description", "content", "url", "link", "youtube", "bsky", "local", "cats"),
}


def export_rows(quest: Quest, report: Report, kind: str) -> DataFrame:
    """The rows of one exported table, lists as comma text."""
    rows = report.of(quest, kind)
    ends = EDGE_ENDS.get(kind, (None, None))

    def column(name: str):
        if name in ("from", "to"):
            return F.col(ends[0] if name == "from" else ends[1]).alias(name)
        if name in ("cats", "orgs", "content"):
            return joined(name).alias(name)
        return F.col(name)

    return rows.select(*[column(c) for c in CSV_COLUMNS[kind]])


def _write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def export_csv(quest: Quest, params: Params, folder: str) -> dict[str, str]:
    """Nine filtered tables, every field quoted. Returns the folder of each."""
    report = build_report(quest, params)
    paths = {}
    for kind in CSV_COLUMNS:
        paths[kind] = os.path.join(folder, f"{params.name.split('.')[-1]}_{kind}")
        _write_csv(export_rows(quest, report, kind), paths[kind])
    return paths


def extra_rows(records: DataFrame, params: Params, with_json: bool = False) -> DataFrame:
    """Whois records or channels after the generic filter, with the raw document on request."""
    rows = filter_rows(records, params.orgs, params.cats, params.countries)
    columns = ["name", "label", "description", joined("content").alias("content"), joined("cats").alias("cats"), "country"]
    return rows.select(*columns, *(["json"] if with_json else []))


def source_json_rows(quest: Quest, report: Report, **documents: DataFrame) -> DataFrame:
    """The sources table with one JSON column per document set (source, ...)."""
    rows = export_rows(quest, report, "sources")
    for name, docs in documents.items():
        fields = [F.col(c) for c in docs.columns if c != "source"]
        packed = docs.select(F.col("source").alias("name"), F.to_json(F.struct(*fields)).alias(name))
        rows = rows.join(packed, "name", "left")
    return rows


#: Rows of a JSON file, which is compressed and read by one task.
JSON_ROWS = 1_000_000


def snapshot(quest: Quest, path: str, kinds: Sequence[str] = KINDS, fmt: str = "parquet") -> None:
    """The whole quest as parquet or JSON lines, read again by `read_quest`. JSON repeats every field name in every
    row and is compressed."""
    options = {"compression": "gzip", "maxRecordsPerFile": JSON_ROWS} if fmt == "json" else {}
    for kind in kinds:
        quest.table(kind).write.mode("overwrite").format(fmt).options(**options).save(os.path.join(path, kind))


def write_mentions(mentions: DataFrame, path: str) -> None:
    """The inverted report, partitioned by kind; within it sorted by key, so that one entity's
    sources lie together without a file per entity."""
    ordered = mentions.repartitionByRange("kind", "key", "source").sortWithinPartitions("key", "source")
    ordered.write.mode("overwrite").partitionBy("kind").parquet(path)


def read_mentions(spark: SparkSession, path: str) -> DataFrame:
    """(kind, key, source) as `write_mentions` left them."""
    return spark.read.schema("key string, source string, kind string").parquet(path).select("kind", "key", "source")


def _id(name: str):
    return F.replace(F.col(name), F.lit("."), F.lit("_"))


def _optional(attribute: str):
    return F.when(F.col(attribute).isNotNull(), F.concat(F.lit(f", {attribute}="), F.col(attribute))).otherwise("")


def graph_dot(
    quest: Quest,
    params: Params,
    styles: dict | None = None,
    neighbours: bool = False,
    urls: DataFrame | None = None,
) -> DataFrame:
    """(place, line): the statements of the graph in order, one row each.

    Clusters per organisation hold their idents and events, then lonely events and idents, then
    edges. An object of several organisations is stated in each. `types` switches idents and
    events on; `urls` (name, url) adds addresses to ident nodes.
    """
    report = group_orgs(quest, build_report(quest, params, neighbours))
    report = replace(report, orgs=pin(report.orgs, joins=True))
    types = params.types
    on = {k: types is None or k in types for k in ("idents", "events")}

    def nodes(kind: str) -> DataFrame:
        rows = with_style(report.of(quest, kind), styles, kind)
        address = F.lit("")
        if kind == "idents" and urls is not None:
            rows = rows.join(urls.select("name", F.col("url").alias("_url")), "name", "left")
            address = F.when(F.col("_url").isNotNull(), F.concat(F.lit(', url="'), "_url", F.lit('"'))).otherwise("")
        line = F.concat(
            _id("name"), F.lit(' [shape="'), "shape", F.lit('", label="'), "label", F.lit('", style="'), "style", F.lit('"'),
            _optional("fillcolor"), _optional("color"), address, F.lit("];"),
        )
        return pin(rows.select("name", "orgs", line.alias("line")), joins=True)

    def edges(kind: str) -> DataFrame:
        start, stop = EDGE_ENDS[kind][:2]
        rows = with_style(report.of(quest, kind), styles, kind)
        line = F.concat(
            _id(start), F.lit(" -> "), _id(stop), F.lit(' [label="'), "label", F.lit('"'), _optional("color"), F.lit("];")
        )
        return rows.select("name", line.alias("line"))

    def placed(df: DataFrame, section: int, group, rank, name="name") -> DataFrame:
        return df.select(
            F.struct(
                F.lit(section).alias("section"), group.alias("group"), F.lit(rank).alias("rank"), F.col(name).alias("name")
            ).alias("place"),
            "line",
        )

    none = F.lit("")
    spark = quest.idents.sparkSession
    frame = spark.createDataFrame(
        [(0, "digraph %s {" % params.name.replace(".", "_")), (9, "}")], "section int, line string"
    )
    parts = [frame.select(F.struct("section", none.alias("group"), F.lit(0).alias("rank"), none.alias("name")).alias("place"), "line")]
    if on["idents"] or on["events"]:
        orgs = with_style(report.of(quest, "orgs"), styles, "orgs")
        opening = F.concat(F.lit("subgraph cluster_"), _id("name"), F.lit(' {style="'), "style", F.lit('";'))
        parts.append(placed(orgs.select("name", opening.alias("line")), 1, F.col("name"), 0))
        parts.append(placed(orgs.select("name", F.lit("}").alias("line")), 1, F.col("name"), 3))
    shown = report.orgs.select(F.col("name").alias("org"))
    for rank, kind in ((1, "idents"), (2, "events")):
        if not on[kind]:
            continue
        all_nodes = nodes(kind)
        member = all_nodes.select("name", F.explode("orgs").alias("org"), "line").join(shown, "org", "left_semi")
        parts.append(placed(member, 1, F.col("org"), rank))
        lonely = all_nodes.where(F.size("orgs") == 0).select("name")
        parts.append(placed(all_nodes.join(lonely, "name", "left_semi"), 2 if kind == "events" else 3, none, 0))
    if on["idents"]:
        parts.append(placed(edges("relations"), 4, none, 0))
    if on["events"]:
        parts.append(placed(edges("links"), 5, none, 0))
        parts.append(placed(edges("quotes"), 6, none, 0))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    # Ordering reads its input twice, once for the bounds.
    return pin(out, joins=True).orderBy("place")


def write_dot(lines: DataFrame, path: str) -> None:
    """The statements as text; part files in name order are the graph."""
    lines.select("line").write.mode("overwrite").text(path)


# The kinds that get retrieval documents.
RAG_KINDS = ("countries", "cities", "orgs", "idents", "events")


def _rag_objects(quest: Quest, kinds: Sequence[str]) -> DataFrame:
    out = None
    for kind in kinds:
        rows = quest.table(kind)
        framing = F.concat_ws("\n", "label", F.when(F.col("description") != "", F.col("description")), F.array_join("content", "\n"))
        rows = rows.select(
            F.col("name").alias("object"), F.lit(kind).alias("kind"), "label", framing.alias("framing"),
            joined("cats").alias("cats"), "country", F.explode("sources").alias("source"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def _source_values(quest: Quest) -> DataFrame:
    return quest.sources.select(F.col("name").alias("source"), "url", "link", "local", "youtube", "bsky")


def source_bodies(texts: DataFrame | None, labels: DataFrame | None) -> DataFrame | None:
    """(source, body): title, excerpt and text, then the labels the analysis found, one per
    line. `labels` is (source, bucket, label): the handful of known entities a source names."""
    body = None
    if texts is not None:
        have = [c for c in ("yt_title", "yt_text", "title", "excerpt", "text") if c in texts.columns]
        body = texts.select("source", F.concat_ws("\n", *have).alias("_text"))
    if labels is not None:
        named = labels.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("label")), "\n").alias("_labels"))
        body = named if body is None else body.join(named, "source", "full")
    if body is None:
        return None
    parts = [c for c in ("_text", "_labels") if c in body.columns]
    return body.select("source", F.concat_ws("\n", *parts).alias("body"))


def rag_documents(
    quest: Quest, texts: DataFrame | None = None, labels: DataFrame | None = None, kinds: Sequence[str] = RAG_KINDS
) -> DataFrame:
    """(filename, content, metadata): one document per entity and source, `<entity>##<source>`."""
    rows = _rag_objects(quest, kinds).join(_source_values(quest), "source")
    bodies = source_bodies(texts, labels)
    rows = rows.join(bodies, "source", "left") if bodies is not None else rows.withColumn("body", F.lit(None).cast("string"))
    return rows.select(
        F.concat("object", F.lit("##"), F.regexp_replace("source", r"^source\.", "")).alias("filename"),
        F.concat_ws("\n", "framing", "body").alias("content"),
        _metadata({"name": "object", "label": "label", "type": "kind", "cats": "cats", "country": "country", "src_name": "source",
                   "src_url": "url", "src_link": "link", "src_local": "local", "src_youtube": "youtube", "src_bsky": "bsky"}),
    )


def rag_documents_shared(
    quest: Quest,
    texts: DataFrame | None = None,
    labels: DataFrame | None = None,
    header_size: int = 1000,
) -> DataFrame:
    """(filename, part, content, metadata): one shared document per cited source, in parts.

    Part by part it reads `Referenced by:` and the citing labels in order, then the body. A
    source may be cited by any number of entities, so labels are ranked without gathering them
    and cut into parts of `header_size`; most sources have one. The body is the last part.
    """
    referrers = ranked(source_referrers(quest), [F.asc("label")], ["source"], "_rank")
    referrers = referrers.withColumn("part", F.floor((F.col("_rank") - 1) / header_size).cast("int"))
    headers = referrers.groupBy("source", "part").agg(
        F.array_join(F.array_sort(F.collect_list("label")), ", ").alias("_labels"), F.count(F.lit(1)).alias("_n")
    )
    header = F.when(F.col("part") == 0, F.concat(F.lit("Referenced by: "), "_labels")).otherwise(F.col("_labels"))
    totals = headers.groupBy("source").agg(F.max("part").alias("_last"), F.sum("_n").alias("referrers"))
    rows = headers.select("source", "part", header.alias("content"))
    bodies = source_bodies(texts, labels)
    if bodies is not None:
        body = totals.join(bodies, "source").select("source", (F.col("_last") + 1).alias("part"), F.col("body").alias("content"))
        rows = rows.unionByName(body)
    return rows.join(totals, "source").join(_source_values(quest), "source").select(
        F.concat(F.lit("source##"), F.regexp_replace("source", r"^source\.", "")).alias("filename"),
        "part",
        "content",
        _metadata({"src_name": "source", "src_url": "url", "src_link": "link", "src_local": "local",
                   "src_youtube": "youtube", "src_bsky": "bsky", "referrers": "referrers"}),
    )


def _metadata(fields: dict[str, str]):
    names = F.array(*[F.lit(n) for n in fields])
    values = F.array(*[F.col(c).cast("string") for c in fields.values()])
    return F.map_filter(F.map_from_arrays(names, values), lambda k, v: v.isNotNull()).alias("metadata")
