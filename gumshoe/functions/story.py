"""Post text with roles: segments, rendering, lossless chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Token kinds in the order they are tried.
TOKEN = re.compile(
    r"(?P<EXTSRC>:osint:extsrc:`[^`]+`)|(?P<EXTURL>:osint:exturl:`[^`]+`)|(?P<LINK>`[^`]+`_)"
    r"|(?P<MENTION>@\S+)|(?P<TAG>#\S+)|(?P<WORD>\S+)"
)
# What is cut from the value of each kind.
CUT = {
    "EXTSRC": (":osint:extsrc:", "`"),
    "EXTURL": (":osint:exturl:", "`"),
    "LINK": ("`_", "`"),
    "MENTION": ("@",),
    "TAG": ("#",),
}
MAX_LENGTH = 298


def line_segments(line: str) -> list[tuple[str, str, int]]:
    """(kind, value, offset) of one line; neighbouring words merge into one TEXT."""
    out: list[tuple[str, str, int]] = []
    words: list[str] = []
    start = 0
    for m in TOKEN.finditer(line):
        if m.lastgroup == "WORD":
            if not words:
                start = m.start()
            words.append(m.group())
            continue
        if words:
            out.append(("TEXT", " ".join(words), start))
            words = []
        value = m.group()
        for piece in CUT[m.lastgroup]:
            value = value.replace(piece, "")
        out.append((m.lastgroup, value, m.start()))
    if words:
        out.append(("TEXT", " ".join(words), start))
    return out or [("TEXT", "", 0)]


def _display(value: str) -> str:
    if "<<" in value and ">>" in value:
        prefix, key = value.rsplit("<<", 1)
        return prefix + key[:-2].strip()
    if "<" in value and ">" in value:
        return value.rsplit("<", 1)[0].strip()
    return value


def render(text: str, page: str | None = None) -> str:
    """Plain text of a post: roles by their display part, one line each, then the page mark."""
    out = []
    for line in text.split("\n"):
        space = ""
        for kind, value, _ in line_segments(line):
            if kind == "TEXT":
                out.append(value if value.startswith((",", ".")) else space + value)
                space = " "
                continue
            shown = {"TAG": value, "MENTION": "@" + value}.get(kind) or _display(value)
            if shown:
                out.append(space + shown)
                space = " "
        if space:
            out.append("\n")
    return "".join(out) + (f"{page}/" if page else "")


def segment_posts(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per segment: (key, line, pos, kind, value, offset). Narrow, Arrow batches."""
    schema = T.StructType(
        [
            df.schema[key],
            T.StructField("line", T.IntegerType()),
            T.StructField("pos", T.IntegerType()),
            T.StructField("kind", T.StringType()),
            T.StructField("value", T.StringType()),
            T.StructField("offset", T.IntegerType()),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (k, i, j, *segment)
                for k, t in zip(batch[key], batch[text])
                for i, line in enumerate((t or "").split("\n"))
                for j, segment in enumerate(line_segments(line))
            ]
            yield pd.DataFrame(rows, columns=schema.names)

    return df.select(key, text).mapInPandas(run, schema)


def story_text(df: DataFrame, text: str = "text", page: str | None = None) -> DataFrame:
    """Adds `story`, `length` and `too_long`. `page` names a column with the page number."""

    @F.pandas_udf("string")
    def rendered(texts: pd.Series, pages: pd.Series) -> pd.Series:
        return pd.Series([render(t or "", p) for t, p in zip(texts, pages)], dtype="object")

    number = F.col(page).cast("string") if page else F.lit(None).cast("string")
    out = df.withColumn("story", rendered(F.col(text), number))
    return out.withColumn("length", F.length("story")).withColumn("too_long", F.length("story") > MAX_LENGTH)


def chunks(text: str, size: int = 4000) -> list[str]:
    """Pieces of at most `size` characters, cut after newlines, else sentences, else words.
    Joined they are the text again."""
    out: list[str] = []
    start = 0
    while len(text) - start > size:
        window = text[start : start + size]
        cut = max(window.rfind("\n"), -1) + 1
        for mark in (".", " "):
            if not cut:
                cut = window.rfind(mark) + 1
        start += cut or size
        out.append(window[: cut or size])
    if start < len(text):
        out.append(text[start:])
    return out


def chunk_documents(df: DataFrame, key: str, text: str = "text", size: int = 4000) -> DataFrame:
    """One row per chunk: (key, chunk_no, chunk)."""
    schema = T.StructType(
        [df.schema[key], T.StructField("chunk_no", T.IntegerType()), T.StructField("chunk", T.StringType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (k, i, piece)
                for k, t in zip(batch[key], batch[text])
                for i, piece in enumerate(chunks(t or "", size))
            ]
            yield pd.DataFrame(rows, columns=schema.names)

    return df.select(key, text).mapInPandas(run, schema)


def register_functions(spark: SparkSession) -> None:
    """SQL table functions `segment_post(text)` and `chunk_text(text, size)`."""

    @F.udtf(returnType="line int, pos int, kind string, value string, offset int")
    class SegmentPost:
        def eval(self, text: str):
            for i, line in enumerate((text or "").split("\n")):
                for j, segment in enumerate(line_segments(line)):
                    yield (i, j, *segment)

    @F.udtf(returnType="chunk_no int, chunk string")
    class ChunkText:
        def eval(self, text: str, size: int):
            yield from enumerate(chunks(text or "", size))

    spark.udtf.register("segment_post", SegmentPost)
    spark.udtf.register("chunk_text", ChunkText)
