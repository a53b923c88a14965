"""Sources: plain text, HTML and DOCX files to one text each, routed by MIME type, and chunks of texts.

A file that no extractor takes, or that one fails on, comes out with ``status`` FAILED and its error instead of a text.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from itertools import accumulate, pairwise
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKIPPED_TAGS = ("script", "style", "nav", "footer", "header")  # fixed values


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in SKIPPED_TAGS

    def handle_endtag(self, tag):
        self.depth -= tag in SKIPPED_TAGS and self.depth > 0

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.parts.append(data.strip())


def html_text(data: bytes) -> str:
    """SRC-03: text nodes outside of the skipped subtrees, joined by blank lines."""
    parser = _Text()
    parser.feed(data.decode("utf-8", "ignore"))
    parser.close()
    return "\n\n".join(parser.parts)


def docx_text(data: bytes) -> str:
    """SRC-02: paragraphs with text, joined by blank lines."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))
    return "\n\n".join(p for p in paragraphs if p.strip())


def plain_text(data: bytes) -> str:
    """SRC-04: UTF-8, other bytes left out."""
    return data.decode("utf-8", "ignore")


# SRC-05: a PDF extractor can be added under application/pdf
EXTRACTORS: dict[str, Callable[[bytes], str]] = {
    "text/html": html_text,
    "text/plain": plain_text,
    "text/markdown": plain_text,
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": docx_text,
}


def mime_type(path: Column) -> Column:
    """MIME type by file ending."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    known = {"html": "text/html", "htm": "text/html", "txt": "text/plain", "md": "text/markdown", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "pdf": "application/pdf"}
    return F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), ending)


def extract(files: DataFrame, content: str, mime: str, fallback_plain: bool = False, extractors: dict | None = None) -> DataFrame:
    """``files`` with ``text``, ``status`` (PARSED or FAILED) and ``error`` (at most 4000 characters)."""
    table = dict(EXTRACTORS if extractors is None else extractors)
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])

    @F.pandas_udf(schema)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for data, kinds in batches:
            rows = []
            for d, k in zip(data, kinds):
                f = table.get(k) or (plain_text if fallback_plain else None)
                try:
                    if d is None or f is None:
                        raise ValueError(f"no extractor for {k}" if d is not None else "no content")
                    rows.append((f(bytes(d)), None))
                except Exception as e:  # whatever a broken file raises ends up with the file
                    rows.append((None, str(e)[:4000]))
            yield pd.DataFrame(rows, columns=["text", "error"])

    done = files.withColumn("_x", run(F.col(content), F.col(mime)))
    return done.withColumn("text", F.col("_x.text")).withColumn("error", F.col("_x.error")).drop("_x").withColumn("status", F.when(F.col("error").isNull(), "PARSED").otherwise("FAILED"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """All files of a folder as texts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return extract(files.select("path", mime_type(F.col("path")).alias("mime_type"), "content"), "content", "mime_type").drop("content")


def safe_name(name: Column) -> Column:
    """SRC-09 / TXT-27: file name of letters, digits, dots, dashes and underscores."""
    return F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"[^a-zA-Z0-9._\-\p{L}]", "_")


CHUNKS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))


def _sentence_runs(paragraph: str, limit: int) -> Iterator[tuple[int, str]]:
    """(place, text) of the longest runs of sentences within ``limit``; every sentence counts with a blank behind it."""
    parts = re.split(r"(?<=[.!?])\s+", paragraph)
    spaced, ends = " ".join(parts), list(accumulate(len(p) + 1 for p in parts))
    firsts, base = [0], 0
    for before, end in pairwise(ends):
        if end - base > limit:
            firsts.append(base := before)
    for begin, end in zip(firsts, [*firsts[1:], len(spaced)]):
        yield begin, spaced[begin:end].strip()


def pack(text: str, limit: int) -> list[tuple[str, int, int]]:
    """TXT-02: paragraphs, long ones as runs of sentences; (text, start, stop).

    Offsets count stripped paragraphs with two characters between them, and sentences with one, whatever stands there.
    """
    paragraphs = [p.strip() for p in re.split(r"\n{2,}", text)]
    places = accumulate((len(p) + 2 for p in paragraphs), initial=0)
    found = ((place + at, run) for place, p in zip(places, paragraphs) for at, run in (_sentence_runs(p, limit) if len(p) > limit else [(0, p)]))
    return [(run, at, at + len(run)) for at, run in found if run]


def merge_short(chunks: list[tuple[str, int, int]], limit: int, least: int) -> list[tuple[str, int, int]]:
    """TXT-03: a chunk joins its predecessor if one of them is short and both fit."""
    out: list[tuple[str, int, int]] = []
    for text, start, stop in chunks:
        if out and min(len(out[-1][0]), len(text)) < max(1, least) and len(out[-1][0]) + 1 + len(text) <= limit:
            out[-1] = (f"{out[-1][0]} {text}", out[-1][1], stop)
        else:
            out.append((text, start, stop))
    return out


def chunk_texts(df: DataFrame, text: str, limit: int = 1000, least: int = 80) -> DataFrame:
    """``df`` exploded to ``chunk_index``, ``chunk``, ``char_start``, ``char_end``; a null or blank text has no chunk."""
    @F.pandas_udf(CHUNKS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"text": t, "start": a, "stop": b} for t, a, b in merge_short(pack(x, limit), limit, least)] if isinstance(x, str) else [] for x in texts], dtype=object)

    rows = df.select(*[c for c in df.columns if c != text], F.posexplode(run(F.col(text))).alias("chunk_index", "_c"))
    return rows.select("*", F.col("_c.text").alias("chunk"), F.col("_c.start").alias("char_start"), F.col("_c.stop").alias("char_end")).drop("_c")
