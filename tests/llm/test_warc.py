"""Archives written and read back, with records hidden in payloads and splits of any size."""

import hashlib

import pytest
from pyspark.sql import functions as F

from gumshoe.llm.common import Scratch
from gumshoe.llm.warc import MAGIC, archive_pages, chain, read_archives, write_archives

FAKE = f"{MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Type: application/http\r\nContent-Length: 21\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhi\r\n\r\n"


def sha(text):
    return hashlib.sha1((text or "").encode()).hexdigest()


@pytest.fixture(scope="module")
def pages():
    long = "<p>" + "é lorem " * 200 + "</p>"
    rows = [(1, "http://a/1", long), (2, "http://a/2", long), (9, "http://a/9", long), (3, "http://a/3", "short"), (4, "http://a/4", "short"), (5, None, None), (6, "http://a/6", ""), (None, "http://n", long)]
    rows += [(20 + i, f"http://f/{i}", x) for i, x in enumerate([FAKE, FAKE * 40, MAGIC, MAGIC * 3, "a" + FAKE[:60], FAKE[:-4], "\r\n\r\n" + FAKE, "x\r\n" * 900, FAKE + long])]
    rows += [(40 + i, "http://big", FAKE * 300) for i in range(3)] + [(60, "u\r\nWARC-Type: x", "z" * 999), (61, "u", "z" * 999), (62, "u", "z" * 1000), (63, "u", "z" * 1000)]
    rows += [(9, "http://again", long), (1, "http://again", long), (100, "http://c", "c" * 300_000)]
    return rows + [(1000 + i, f"http://{i}", f"<html>{i}" + "word " * (i % 300)) for i in range(300)]


def expected(rows):
    last = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 1000:
            last[html] = max(last.get(html, i), i)
    out = []
    for i, _, html in rows:
        to = last.get(html) if i is not None and last.get(html) not in (None, i) else None
        out.append((str(i), len((html or "").encode()), sha(html), "revisit" if to is not None else "response", to))
    return sorted(out, key=str)


COLUMNS = "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 3, "x") for r in rows], "page_id long, url string, html string, at int, value string")


@pytest.mark.parametrize("split", ["128m", "9k", "64k"])
def test_round_trip(spark, pages, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        got = archive_pages(frame(spark, pages).repartition(2)).select(*COLUMNS).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(((str(r[0]), *r[1:]) for r in got), key=str) == expected(pages)


def test_other_columns_and_fields(spark, pages):
    out = archive_pages(frame(spark, pages[:20]))
    urls = {r.page_id: r.url for r in out.filter("page_id in (2, 5, 3)").collect()}
    assert urls == {2: "http://a/2", 3: "http://a/3", 5: None}
    assert archive_pages(frame(spark, pages).limit(0)).count() == 0


def test_broken_archives_are_refused(spark, tmp_path, pages):
    scratch = Scratch(spark, "test")
    rows = frame(spark, pages[:6]).select("page_id", "url", "html").coalesce(1)
    whole = str(tmp_path / "whole")
    write_archives(rows, whole, scratch)
    assert read_archives(spark, whole, scratch).count() == 6
    files = sorted(x for x in (tmp_path / "whole").iterdir() if x.name.startswith("part") and x.stat().st_size)
    data = b"".join(f.read_bytes() for f in files)
    alone = b"".join(MAGIC.encode() + x for x in data.split(MAGIC.encode()) if b"WARC-Type: revisit" in x)
    for name, broken in (("cut", data[:-7]), ("start", b"x" + data), ("flipped", data.replace(b"lorem", b"LOREM")), ("longer", data + b"tail"), ("none", b"x"), ("alone", alone)):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "part-0").write_bytes(broken)
        with pytest.raises(ValueError):
            read_archives(spark, str(folder), scratch)


def test_chain(spark):
    """Chains of several lengths, pointers to no record, and records hidden beside them."""
    nodes, want = [], set()
    for file, n in (("a", 1), ("b", 2), ("c", 37), ("d", 64), ("e", 65)):
        nodes += [(file, 10 * i, 10 * (i + 1)) for i in range(n)] + [(file, 10 * i + 5, 10 * (i + 1)) for i in range(n)]
        want |= {(file, 10 * i) for i in range(n)}
    nodes += [("f", 3, 9), ("f", 9, 12), ("g", 0, 4), ("g", 5, 9)]
    want.add(("g", 0))
    got = chain(spark.createDataFrame(nodes, "file string, at long, to long"), Scratch(spark, "test")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_revisits_are_filtered(spark, monkeypatch):
    """A page that shares the bit of a revisit's id is still a response."""
    from gumshoe.llm import warc

    monkeypatch.setattr(warc, "SLOTS", 4)
    rows = [(i, "u", str(i % 60) * 1200) for i in range(90)]
    got = archive_pages(frame(spark, rows)).select(*COLUMNS).collect()
    assert sorted(((str(r[0]), *r[1:]) for r in got), key=str) == expected(rows)
    assert spark.range(1).select(F.lit(1)).count() == 1
