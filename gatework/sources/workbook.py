"""Workbooks (xlsx): a task a sheet, cells as text.

A workbook comes through Spark's binary file reader, so from any store that Spark reads. Its sheets are listed from a few
small parts, and each is then parsed in a task of its own as a stream of rows; shared strings alone are held as a whole.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatework.functions.text import strip

#: Rows of an Arrow batch.
BATCH = 2000
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def listed(book: zipfile.ZipFile) -> list[tuple[str, str, bool]]:
    """Name and part of each sheet, in order, and whether it is the one that opens."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    active = next((int(e.get("activeTab", 0)) for e in root.iter() if local(e.tag) == "workbookView"), 0)
    sheets = [(e.get("name"), links[e.get(REL) or next(v for k, v in e.attrib.items() if local(k) == "id" and k != "id")]) for e in root.iter() if local(e.tag) == "sheet"]
    return [(name, target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}"), i == active) for i, (name, target) in enumerate(sheets)]


def text_of(element: ElementTree.Element) -> str:
    """The text of a string item, its runs together, without the readings that some scripts add."""
    out = []
    for child in element:
        if local(child.tag) == "t":
            out.append(child.text or "")
        elif local(child.tag) == "r":
            out += [t.text or "" for t in child if local(t.tag) == "t"]
    return "".join(out)


def shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as part:
        for _, e in ElementTree.iterparse(part):
            if local(e.tag) == "si":
                out.append(text_of(e))
                e.clear()
    return out


def number_text(value: str) -> str:
    """A number as it is shown in general: whole ones without a point."""
    n = float(value)
    return str(int(n)) if n.is_integer() and abs(n) < 1e15 else repr(n)


def cell_text(cell: ElementTree.Element, strings: list[str]) -> str | None:
    kind, value = cell.get("t", "n"), None
    for child in cell:
        if local(child.tag) == "v":
            value = child.text
        elif local(child.tag) == "is":
            return text_of(child)
    if value is None or kind == "e":
        return None
    if kind == "s":
        return strings[int(value)]
    return {"b": lambda: "TRUE" if value == "1" else "FALSE", "n": lambda: number_text(value)}.get(kind, lambda: value)()


def column_of(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def rows_of(book: zipfile.ZipFile, part: str) -> Iterator[tuple[int, list[str | None]]]:
    """Number, from 1, and cells of the sheet's rows; missing cells are null, rows without any are left out."""
    strings, number = shared_strings(book), 0
    with book.open(part) as sheet:
        for _, e in ElementTree.iterparse(sheet):
            if local(e.tag) != "row":
                continue
            number = int(e.get("r", number + 1))
            cells: list[str | None] = []
            for cell in e:
                at = column_of(cell.get("r")) if cell.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                cells[at] = cell_text(cell, strings)
            e.clear()
            if any(c is not None for c in cells):
                yield number, cells


def read_workbooks(spark: SparkSession, path: str, sheet: str | None = None, active: bool = False) -> DataFrame:
    """(file, sheet, n, cells) of all rows of the workbooks under a path; of one sheet, or of those that open, if so asked."""

    def sheets(batches):
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                names = [s for s in listed(zipfile.ZipFile(io.BytesIO(content.as_py()))) if (sheet is None or s[0] == sheet) and (s[2] or not active)]
                for name, part, _ in names:
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([name]), pa.array([part]), pa.array([content])], ["file", "sheet", "part", "content"])

    def rows(batches):
        for batch in batches:
            for file, name, part, content in zip(*(batch.column(c).to_pylist() for c in ("file", "sheet", "part", "content")), strict=True):
                held = []
                for row in rows_of(zipfile.ZipFile(io.BytesIO(content)), part):
                    held.append(row)
                    if len(held) == BATCH:
                        yield from of(file, name, held)
                        held = []
                yield from of(file, name, held)

    def of(file, name, held):
        if held:
            yield pa.RecordBatch.from_pydict({"file": [file] * len(held), "sheet": [name] * len(held), "n": pa.array([n for n, _ in held], pa.int32()), "cells": pa.array([c for _, c in held], pa.list_(pa.string()))})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    each = files.mapInArrow(sheets, "file string, sheet string, part string, content binary").repartition("file", "sheet")
    return each.mapInArrow(rows, "file string, sheet string, n int, cells array<string>")


def cell(i: int) -> Column:
    """The cell of a column, counted from 0 (A); null beyond a row's end."""
    return F.try_element_at("cells", F.lit(i + 1))


def with_header(rows: DataFrame, columns: list[str], skip: int = 0) -> DataFrame:
    """rows (of read_workbooks) behind each sheet's heading, the first row after `skip` ones, with the columns by the names
    that stand there; the first of equal names counts, and one that a sheet lacks is null."""
    heads = rows.where(F.col("n") > skip).groupBy("file", "sheet").agg(F.min_by(F.struct("n", "cells"), "n").alias("head"))
    df = rows.join(heads, ["file", "sheet"]).where(F.col("n") > F.col("head.n"))
    at = {c: F.array_position("head.cells", c).cast("int") for c in columns}
    return df.select("file", "sheet", "n", *[F.when(p > 0, F.try_element_at("cells", p)).alias(c) for c, p in at.items()])


def code_lists(spark: SparkSession, paths: list[str], first_row: int = 2) -> DataFrame:
    """(code, title, vintage, ord) of code lists, one workbook a vintage, oldest first: the columns B and C of the sheet that
    opens. What is a code, and which title counts, is up to lookup.valid_codes, first_titles, last_titles, keyword_index."""
    out = None
    for vintage, path in enumerate(paths):
        rows = read_workbooks(spark, path, active=True).where(F.col("n") >= first_row)
        part = rows.select(strip(cell(1)).alias("code"), strip(cell(2)).alias("title"), F.lit(vintage).alias("vintage"), F.col("n").cast("long").alias("ord")).where("coalesce(code, '') <> ''")
        out = part if out is None else out.unionByName(part)
    return out


def rate_list(spark: SparkSession, path: str, first_row: int = 3) -> DataFrame:
    """(code, rate, ord) of a rate table, the columns B and D of the sheet that opens, for lookup.rates."""
    rows = read_workbooks(spark, path, active=True).where(F.col("n") >= first_row)
    return rows.select(cell(1).alias("code"), cell(3).alias("rate"), F.col("n").cast("long").alias("ord")).where("code is not null and rate is not null")


def reviewed(spark: SparkSession, path: str) -> DataFrame:
    """All tabs of a review workbook, the tab being the stratum."""
    columns = ["id", "reviewer_naics", "reported_naics", "suggested_naics", "reviewer_notes"]
    return with_header(read_workbooks(spark, path), columns).withColumnRenamed("sheet", "stratum").drop("file", "n")
