"""Files to documents: text, HTML, DOCX, PDF text, images and attachments.

Files are read by Spark's ``binaryFile`` source, so any file system works; parsers are Arrow-batched. A PDF reader is not
part of the standard library: ``pdf_documents`` takes pages of text and applies the stages after it.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.operators.hooks import Ocr, ocr_column

PAGE_MARK = "\n\n--- 页面 {n} ---\n\n"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, modificationTime, length, content of the files below a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


class _BodyText(HTMLParser):
    SKIP = frozenset({"script", "style", "head", "template", "noscript"})
    BREAK = frozenset("p div br li tr h1 h2 h3 h4 h5 h6 table section article ul ol blockquote pre hr td th".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.SKIP
        if tag in self.BREAK:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.depth -= tag in self.SKIP and self.depth > 0
        if tag in self.BREAK:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def html_text(html: str | None) -> str | None:
    """The visible text of a page, a line a block."""
    if html is None:
        return None
    parser = _BodyText()
    parser.feed(html)
    parser.close()
    lines = (" ".join(x.split()) for x in "".join(parser.parts).split("\n"))
    return "\n".join(x for x in lines if x)


def docx_text(data: bytes, tables: bool = True, headers: bool = False, footers: bool = False, comments: bool = False) -> dict[str, str]:
    """Sections of a DOCX file: main text, and on request tables, headers, footers and comments."""
    out: dict[str, list[str]] = {"main": []}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        wanted = {"word/document.xml": "main"}
        for name in z.namelist():
            for kind, want in (("header", headers), ("footer", footers), ("comments", comments)):
                if want and name.startswith(f"word/{kind}"):
                    wanted[name] = kind
        for name, section in wanted.items():
            if name not in z.namelist():
                continue
            root = ElementTree.fromstring(z.read(name))
            inside = {p for t in root.iter(f"{_W}tbl") for p in t.iter(f"{_W}p")} if section == "main" else set()
            for p in root.iter(f"{_W}p"):
                text = "".join(t.text or "" for t in p.iter(f"{_W}t"))
                if text and p not in inside:
                    out.setdefault(section, []).append(text)
            if tables and section == "main":
                for t in root.iter(f"{_W}tbl"):
                    rows = [" | ".join("".join(x.text or "" for x in c.iter(f"{_W}t")) for c in r.iter(f"{_W}tc")) for r in t.iter(f"{_W}tr")]
                    out.setdefault("tables", []).append("\n".join(rows))
    return {k: "\n".join(v) for k, v in out.items() if v}


def decoded(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def parse_file(kind: str, data: bytes) -> str:
    if kind in ("html", "htm"):
        return html_text(decoded(data)) or ""
    if kind == "docx":
        return "\n".join(docx_text(data).values())
    return decoded(data)


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """id, content, metadata of the files below a folder, routed by extension; blank ones and PDF are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["content"] = [parse_file(k, d) for k, d in zip(batch["kind"], batch["content"], strict=True)]
            yield batch

    raw = files(spark, path).select("path", extension(F.col("path")).alias("kind"), "content").where("kind != 'pdf'")
    found = raw.mapInPandas(run, "path string, kind string, content string").where(F.trim("content") != "")
    meta = F.to_json(F.struct(file_name(F.col("path")).alias("filename"), F.concat(F.lit("."), F.col("kind")).alias("filetype")))
    return found.select(X.stable_id(F.col("path"), F.col("content")).alias("id"), "content", meta.alias("metadata"))


def pdf_documents(pages: DataFrame, to_pages: bool = True, min_bytes: int = 100, keep_letters: bool = False) -> DataFrame:
    """From (path, page_no, text): cleaned pages, short ones dropped; a row a page, or a row a file with page marks."""
    clean = X.normalize_space(X.valid_characters(F.col("text"), keep_letters))
    rows = pages.withColumn("text", clean).where(F.octet_length("text") >= min_bytes)
    if to_pages:
        return rows.select(X.stable_id(F.col("path"), F.col("page_no"), F.col("text")).alias("id"), F.col("text").alias("content"), F.to_json(F.struct("path", F.col("page_no").alias("page"))).alias("metadata"))
    before, after = PAGE_MARK.split("{n}")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: F.concat(F.lit(before), x.page_no.cast("string"), F.lit(after), x.text))
    return rows.groupBy("path").agg(F.array_join(parts, "").alias("content")).select(X.stable_id(F.col("path"), F.col("content")).alias("id"), "content", F.to_json(F.struct("path")).alias("metadata"))


def image_size(data: bytes) -> tuple[int, int, str] | None:
    """Width, height and format of a PNG or JPEG, from its header."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return *struct.unpack(">II", data[16:24]), "png"
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            return None
        kind = data[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height, "jpeg"
        at += 2 + (0 if kind == 0xFF else struct.unpack(">H", data[at + 2 : at + 4])[0])
    return None


def html_column(html: Column) -> Column:
    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pages.map(html_text)

    return text(html)


def images(df: DataFrame, ocr: Ocr | None = None) -> DataFrame:
    """path, width, height, format, size and OCR text (null without an OCR) of image files."""

    @F.pandas_udf("width int, height int, format string")
    def _image_info(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([image_size(c) or (None, None, None) for c in content], columns=["width", "height", "format"])

    rows = df.select("path", F.col("length").alias("size"), _image_info(F.col("content")).alias("i"), ocr_column(ocr)(F.col("content")).alias("ocr_text"))
    return rows.select("path", "i.width", "i.height", "i.format", "size", "ocr_text")


def report(docs: DataFrame, title: str, path: str, order: str = "id") -> None:
    """A Markdown file of documents, one section each, in one task: a report of a bounded result."""
    lines = docs.select(F.lit(1).alias("part"), F.col(order).alias("at"), F.concat(F.lit("## "), F.col("id").cast("string"), F.lit("\n\n"), F.coalesce("content", F.lit(""))).alias("value"))
    head = docs.sparkSession.createDataFrame([(0, f"# {title}")], "part int, value string").withColumn("at", F.lit(None).cast(lines.schema["at"].dataType))
    whole = head.unionByName(lines).repartition(1).sortWithinPartitions("part", "at").select("value")
    whole.write.mode("overwrite").option("lineSep", "\n\n").text(path)
