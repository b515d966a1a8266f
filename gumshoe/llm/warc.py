"""WARC archives: pages written as records, records found again by verifying the chain of their boundaries."""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gumshoe.llm.common import Scratch, small_batches
from gumshoe.session import shared_dir

# How a record begins, how its header ends, and how the record ends.
MAGIC, BREAK, END = "WARC/1.1\r\n", "\r\n\r\n", "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads of fewer bytes are always written whole.
LEAST_BYTES = 1000
#: Bits of the filter that tells pages that are surely no revisits, and records of a file.
SLOTS, RECORDS = 1 << 18, 100_000


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(">"))


def _page_of(record_id: Column) -> Column:
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")


def _header(fields: list[tuple[str, Column]]) -> Column:
    """Header of a record; a field without a value is left out."""
    lines = [F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")) for name, value in fields]
    return F.concat(F.lit(MAGIC), *[F.coalesce(line, F.lit("")) for line in lines], F.lit("\r\n"))


def _uri(url: Column) -> Column:
    """An address as a field: without characters that would end a line."""
    return F.regexp_replace(url, r"[\r\n]+", "%0A")


def _response(page: Column, url: Column, payload: Column, digest: Column) -> Column:
    size = F.octet_length(payload).cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(BREAK))
    fields = [
        ("WARC-Type", F.lit("response")),
        ("WARC-Record-ID", F.coalesce(_record_id(page), F.lit("<urn:page:>"))),
        ("WARC-Target-URI", _uri(url)),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(http) + F.octet_length(payload)),
    ]
    return F.concat(_header(fields), http, payload)


def _revisit(page: Column, url: Column, refers_to: Column, size: Column, digest: Column) -> Column:
    """A record without payload, which names the record that has it, its digest and its size."""
    fields = [
        ("WARC-Type", F.lit("revisit")),
        ("WARC-Record-ID", _record_id(page)),
        ("WARC-Target-URI", _uri(url)),
        ("WARC-Profile", F.lit(REVISIT_PROFILE)),
        ("WARC-Refers-To", _record_id(refers_to)),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        ("X-Payload-Length", size),
        ("Content-Length", F.lit(0)),
    ]
    return _header(fields)


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, refers_to, size, digest) of the pages of (page_id, url, html) whose payload, of at least
    LEAST_BYTES, a page with a larger id has too. Only digests are shuffled."""
    payload = F.coalesce("html", F.lit(""))
    known = pages.select("page_id", "url", F.octet_length(payload).cast("bigint").alias("size"), F.sha1(payload).alias("digest"))
    known = known.filter((F.col("size") >= LEAST_BYTES) & F.col("page_id").isNotNull())
    last = known.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("_first")).filter("_first < refers_to").drop("_first")
    return known.join(last, ["digest", "size"]).filter("page_id < refers_to").select("page_id", "url", "refers_to", "size", "digest")


def write_archives(pages: DataFrame, path: str, scratch: Scratch) -> None:
    """One record for each row of (page_id, url, html), in files below the folder.

    Payloads are written where they are read: a bit for the hash of each revisit's id, SLOTS in all, tells
    pages that are surely responses. Only the others are joined with the revisits by their id.
    """
    again = scratch.keep(revisits(pages))
    slot = F.pmod(F.xxhash64("page_id"), F.lit(SLOTS)).alias("slot")
    slots = F.broadcast(again.select(slot).distinct())  # at most SLOTS rows
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), slot)
    response = _response(F.col("page_id"), F.col("url"), F.col("html"), F.sha1("html")).alias("value")
    sure = rows.filter("page_id is null").unionByName(rows.filter("page_id is not null").join(slots, "slot", "left_anti"))
    perhaps = rows.join(slots, "slot", "left_semi").join(again.select("page_id"), "page_id", "left_anti")
    short = _revisit(*(F.col(c) for c in ("page_id", "url", "refers_to", "size", "digest"))).alias("value")
    records = sure.select(response).unionByName(perhaps.select(response)).unionByName(again.select(short))
    records.write.option("lineSep", END).option("maxRecordsPerFile", RECORDS).text(path)


_PIECES = (
    "file string, split bigint, inner bigint, bytes bigint, file_size bigint, stated bigint, whole boolean, kind string, record_id string, "
    "url string, refers_to string, stated_digest string, stated_size bigint, payload_bytes bigint, payload_digest string"
)


def _fields(head: bytes) -> dict[bytes, bytes]:
    """Header fields by their names in lower case; the first of a name counts."""
    out: dict[bytes, bytes] = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _number(value: bytes | None) -> int | None:
    return int(value) if value and value.isdigit() and len(value) < 16 else None


def _payload(fields: dict[bytes, bytes], block: bytes) -> bytes:
    """What a block holds for the reader: of a message, what follows its header."""
    return block.partition(BREAK.encode())[2] if fields.get(b"content-type", b"").startswith(b"application/http") else block


def _text(value: bytes | None) -> str | None:
    return None if value is None else value.decode("utf-8", "replace")


def _piece(value: bytes) -> tuple:
    """What a piece after a magic tells when it is read as a record."""
    head, found, rest = value.partition(BREAK.encode())
    fields = _fields(head) if found else {}
    length = _number(fields.get(b"content-length"))
    if length is None:
        return (None, False, *[None] * 8)
    stated = len(MAGIC) + len(head) + len(BREAK) + length + len(END)
    whole = len(rest) == length + len(END)
    payload = _payload(fields, rest[:length]) if whole else None
    return (
        stated, whole, *(_text(fields.get(n)) for n in (b"warc-type", b"warc-record-id", b"warc-target-uri", b"warc-refers-to", b"warc-payload-digest")),
        _number(fields.get(b"x-payload-length")), None if payload is None else len(payload), None if payload is None else hashlib.sha1(payload).hexdigest(),
    )


def _scan(spark: SparkSession, path: str, tell: Callable[[str, int, int, bytes], tuple | None], schema: str) -> DataFrame:
    """Rows (file, split, inner, bytes, file_size, ...) of `tell` for the pieces that it has any for.

    Spark reads the archives in splits and cuts them at the magic. A piece's place in its split follows
    from the sizes of those before it, which one task meets in their order.
    """
    small_batches(spark)
    source = spark.read.schema("value string").option("lineSep", MAGIC).text(path)
    pieces = source.select(
        F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("file_size"), F.col("value").cast("binary").alias("value")
    )
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        place, inner = None, 0
        for batch in batches:
            out = []
            for file, split, size, value in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3)):
                value = value.as_py()
                if place != (file, split):
                    place, inner = (file, split), 0
                told = tell(file, split, inner, value)
                if told is not None:
                    out.append((file, split, inner, len(MAGIC) + len(value), size, *told))
                inner += len(MAGIC) + len(value)
            types = types or pa.schema([(n, _ARROW[t]) for n, t in (f.split() for f in schema.split(", "))])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types.types)] if out else [pa.array([], t) for t in types.types], names=names)

    return pieces.mapInArrow(run, schema)


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def candidates(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """All places of the archives where the magic stands: (file, at, to) with what the piece up to the next magic
    tells. `to` is where the next record would begin by the stated length, null where no header is."""
    pieces = scratch.keep(_scan(spark, path, lambda file, split, inner, value: _piece(value), _PIECES))
    sizes = pieces.groupBy("file", "split").agg(F.sum("bytes").alias("_bytes"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", "split", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_start"))
    at = (F.col("_start") + F.col("inner") - len(MAGIC)).alias("at")
    placed = pieces.join(starts, ["file", "split"]).select(at, *pieces.columns)
    # What lies before the first magic is a piece as well, so that a file without any is seen.
    return scratch.keep(placed.withColumn("to", F.when(F.col("at") >= 0, F.col("at") + F.col("stated"))))


def chain(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(file, at) of the nodes (file, at, to) that are reached from the start of their file.

    Pointer jumping: with pointers over 1, 2, 4, ... records the reached part of each file doubles in a
    round of two equi joins, so the rounds are the logarithm of the records of a file. A pointer to a
    place where no record may begin leads nowhere.
    """
    reached = scratch.keep(nodes.filter("at = 0").select("file", "at"))
    jumps = scratch.keep(nodes.select("file", "at", "to"))
    targets = nodes.select("file", F.col("at").alias("to"))
    while True:
        ends = reached.join(jumps, ["file", "at"]).select("file", "to").join(targets, ["file", "to"], "left_semi")
        grown = scratch.keep(reached.unionByName(ends.select("file", F.col("to").alias("at"))))
        further = jumps.select("file", F.col("to").alias("at"), F.col("at").alias("_from")).join(jumps, ["file", "at"])
        doubled = scratch.keep(further.select("file", F.col("_from").alias("at"), "to"))
        scratch.drop(reached, jumps)
        reached, jumps = grown, doubled
        if jumps.isEmpty():
            scratch.drop(jumps)
            return reached


def _refuse(rows: DataFrame, what: str) -> None:
    found = rows.take(3)
    if found:
        raise ValueError(f"{what}: {found}")


def _joined(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(file, at, payload_bytes, payload_digest) of records whose payload holds the magic, from all their pieces.
    `wanted` has those pieces (file, split, inner, at, record); a bitmap of SLOTS bits of their hashes keeps the
    others from being moved."""
    slot = lambda file, split, inner: zlib.crc32(f"{file} {split} {inner}".encode()) % SLOTS
    slots = wanted.select(F.pmod(F.crc32(F.concat_ws(" ", "file", "split", "inner").cast("binary")), F.lit(SLOTS)).cast("int").alias("slot")).distinct()
    marks = np.zeros(SLOTS, bool)
    marks[[r["slot"] for r in slots.toLocalIterator()]] = True
    shared = spark.sparkContext.broadcast(np.packbits(marks))
    chosen = lambda file, split, inner, value: (value,) if shared.value[(s := slot(file, split, inner)) >> 3] >> (7 - (s & 7)) & 1 else None
    pieces = _scan(spark, path, chosen, "file string, split bigint, inner bigint, bytes bigint, file_size bigint, value binary")
    parts = wanted.join(pieces.select("file", "split", "inner", "value"), ["file", "split", "inner"]).groupBy("file", "record")
    blocks = parts.agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts")).select("file", "record", "parts.value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for parts in batch.column(2):
                head, _, rest = MAGIC.encode().join(parts.as_py()).partition(BREAK.encode())
                fields = _fields(head)
                payload = _payload(fields, rest[: _number(fields.get(b"content-length")) or 0])
                told.append((len(payload), hashlib.sha1(payload).hexdigest()))
            sizes, digests = zip(*told) if told else ((), ())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], names=["file", "at", "payload_bytes", "payload_digest"])

    return blocks.mapInArrow(run, "file string, at bigint, payload_bytes bigint, payload_digest string")


def read_archives(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """(file, at, page_id, url, record_type, refers_to, payload_bytes, payload_digest) of all records.

    1. Tasks read splits of the files and emit each place of the magic with the place of the successor that
       its header states.
    2. Pointer jumping from the start of each file keeps the records; the magic inside a payload is
       reached from no record.
    3. Payloads are hashed where they are read. Only those that the magic cuts are put together from
       their pieces.

    Sizes and digests are of the full payload, which a revisit has from its own header. An archive whose records
    do not reach its end, a payload with another digest than its record states, and a revisit of a
    record that is not there with that digest are errors. Empty files have no records.
    """
    found = candidates(spark, path, scratch)
    reached = chain(found.filter("to is not null").select("file", "at", "to"), scratch)
    known = scratch.keep(found.join(reached.withColumn("kept", F.lit(True)), ["file", "at"], "left").withColumn("kept", F.coalesce("kept", F.lit(False))))
    ends = known.groupBy("file").agg(F.max(F.when(F.col("kept"), F.col("to"))).alias("end"), F.max("file_size").alias("file_size"))
    _refuse(ends.filter("end is null or end <> file_size"), "archives whose records end before them")
    records = known.filter("kept")
    if not records.filter("not whole").isEmpty():
        owner = F.last(F.when(F.col("kept"), F.col("at")), ignorenulls=True).over(Window.partitionBy("file").orderBy("at"))
        cut = known.withColumn("record", owner).filter("at >= 0 and not (kept and whole)").select("file", "split", "inner", "at", "record")
        own = scratch.keep(_joined(spark, path, scratch.keep(cut)))
        joined = records.filter("not whole").drop("payload_bytes", "payload_digest").join(own, ["file", "at"])
        records = records.filter("whole").unionByName(joined)
    revisit = F.col("kind") == "revisit"
    stated = F.regexp_replace("stated_digest", "^sha1:", "")
    records = records.select(
        "file", "at", _page_of(F.col("record_id")).alias("page_id"), "url", F.col("kind").alias("record_type"), F.when(revisit, _page_of(F.col("refers_to"))).alias("refers_to"),
        F.when(revisit, F.col("stated_size")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, stated).otherwise(F.col("payload_digest")).alias("payload_digest"), stated.alias("_stated"),
    )
    records = scratch.keep(records)
    _refuse(records.filter("payload_digest <> _stated"), "payloads with another digest")
    named = records.filter("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "payload_bytes", "payload_digest").distinct()
    whole = records.filter("record_type <> 'revisit'").select("page_id", "payload_bytes", "payload_digest")
    _refuse(named.join(whole, ["page_id", "payload_bytes", "payload_digest"], "left_anti"), "revisits of records that are not there")
    return records.drop("_stated")


def archive_pages(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record for each row of pages to archives below `path` (a new folder of the shared one by default)
    and read them back: `read_archives`.

    Of pages with equal payloads of at least LEAST_BYTES, the one with the largest id is a response and the others
    revisit it. Null html is an empty payload; null addresses have no field; a page without an id is a
    response. Rows that repeat the largest id are all responses, those of another id all revisits. Payloads
    of any length are kept, as is the magic in them. No rows give no rows; other columns are not read.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    pages = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    path = path or os.path.join(shared_dir(spark), f"archives-{uuid.uuid4().hex}")
    write_archives(pages, path, scratch)
    return read_archives(spark, path, scratch)
