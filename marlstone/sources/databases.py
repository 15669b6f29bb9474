"""Tables inside files: SQLite databases and workbooks, read by tasks from any file system that Spark knows."""

from __future__ import annotations

import io
import re
import sqlite3
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = 10_000
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_CELL = re.compile(r"([A-Z]+)(\d+)")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def sqlite_table(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """A table of each SQLite database under a path, its columns as the schema (DDL) names and types them, and the file's ``path``.

    A database is a task's, and at most 2 GB; a file that is no database, or has no such table, is an error.
    """
    fields = T._parse_datatype_string(schema).fields
    named = ", ".join('"' + f.name.replace('"', '""') + '"' for f in fields)
    statement = f'SELECT {named} FROM "{table.replace(chr(34), chr(34) * 2)}"'
    loose = ", ".join(f"`{f.name}` string" for f in fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                con = sqlite3.connect(":memory:")
                con.deserialize(content)
                cursor = con.execute(statement)
                while rows := cursor.fetchmany(ROWS):
                    frame = pd.DataFrame([[None if x is None else x.decode("utf-8", "replace") if isinstance(x, bytes) else str(x) for x in r] for r in rows], columns=[f.name for f in fields], dtype=object)
                    frame["path"] = file
                    yield frame
                con.close()

    out = _files(spark, path).mapInPandas(run, f"{loose}, path string")
    return out.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields], "path")


def _column(name: str) -> int:
    """A is 0."""
    n = 0
    for c in name:
        n = 26 * n + ord(c) - 64
    return n - 1


def workbook(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """Sheet, row number and cells of each row with a cell, in the order of sheets."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        strings = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            strings = ["".join(t.text or "" for t in item.iter(f"{_SHEET}t")) for item in root.iter(f"{_SHEET}si")]
        titles = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet")] if "xl/workbook.xml" in names else []
        sheets = sorted((int(m[1]), n) for n in names if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
        for k, (number, name) in enumerate(sheets):
            title = titles[k] if k < len(titles) else f"sheet{number}"
            with z.open(name) as f:
                for _, row in ElementTree.iterparse(f):
                    if row.tag != f"{_SHEET}row":
                        continue
                    cells: dict[int, str | None] = {}
                    for c in row.iter(f"{_SHEET}c"):
                        at = _CELL.match(c.get("r") or "")
                        value = c.find(f"{_SHEET}v")
                        text = value.text if value is not None else "".join(t.text or "" for t in c.iter(f"{_SHEET}t")) or None
                        if c.get("t") == "s" and text is not None:
                            text = strings[int(text)]
                        cells[_column(at[1]) if at else len(cells)] = text
                    if cells:
                        yield title, int(row.get("r") or 0), [cells.get(i) for i in range(max(cells) + 1)]
                    row.clear()


def workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row and cells (texts, null where there is none) of all workbooks under a path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                held = []
                for row in workbook(content):
                    held.append((file, *row))
                    if len(held) == ROWS:
                        yield pd.DataFrame(held, columns=["path", "sheet", "row", "cells"])
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=["path", "sheet", "row", "cells"])

    return _files(spark, path).mapInPandas(run, "path string, sheet string, row int, cells array<string>")
