"""Excel workbooks (.xlsx) as a batch source, large sheets in parts.

A sheet's XML is one compressed stream, so one task unpacks it; it only looks
for the ends of rows and hands on ranges of rows, and other tasks parse those.
Shared strings are a table that cells are joined with.  A column's type follows
from the kinds of its cells: a date is what a cell's style shows as one.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.core.scan import attach_measured
from tabweave.session import cut_lineage
from tabweave.sources.files import MISSING_TOKENS

CELLS = "path string, sheet string, row long, col int, kind string, value string"
PARTS = "path string, sheet string, start long, root binary, rows binary, dates array<boolean>, late boolean"
STRINGS = "path string, number long, text string"
# bytes of a sheet's XML that one task parses at a time
PART_BYTES = 2 << 20
# Built-in number formats that show a date or time.
DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _text(node) -> str:
    """Text of a shared or inline string, phonetic notes left out."""
    return "".join(t.text or "" for part in node if part.tag != f"{MAIN}rPh"
                   for t in part.iter(f"{MAIN}t"))


def _date_styles(book: zipfile.ZipFile) -> list[bool]:
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{MAIN}numFmt")}
    styles = root.find(f"{MAIN}cellXfs")
    bare = lambda code: re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code).lower()
    return [(k := int(x.get("numFmtId", 0))) in DATE_FORMATS or bool(re.search(r"[ymdhs]", bare(custom.get(k, ""))))
            for x in (styles if styles is not None else [])]


def _sheet(book: zipfile.ZipFile, wanted: str) -> tuple[str, str, bool]:
    """Name and place of the named, or else the first, sheet, and whether dates count from 1904."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    setting = root.find(f"{MAIN}workbookPr")
    late = setting is not None and setting.get("date1904") in ("1", "true")
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = [(s.get("name"), links[s.get(RELATION)]) for s in root.iter(f"{MAIN}sheet")]
    chosen = next((s for s in sheets if s[0] == wanted), None) if wanted else sheets[0]
    if chosen is None:
        raise ValueError(f"no sheet named '{wanted}'; found {[s[0] for s in sheets]}")
    target = chosen[1].lstrip("/")
    return chosen[0], target if target.startswith("xl/") else f"xl/{target}", late


_ROW_END = re.compile(rb"</(?:\w+:)?row>")
_ROW = re.compile(rb"<(?:\w+:)?row(?=[\s/>])[^>]*>")
_ROW_NUMBER = re.compile(rb"""\sr=["'](\d+)""")
_DATA = re.compile(rb"<(?:\w+:)?sheetData[^>]*>")
_ROOT = re.compile(rb"<((?:\w+:)?worksheet)[\s>][^>]*>|<((?:\w+:)?worksheet)>")


def sheet_parts(content: bytes, wanted: str = "", size: int | None = None) -> Iterator[tuple]:
    """(sheet, rows before, root tag, XML of whole rows, date styles, late) of about ``size`` bytes each."""
    size = size or PART_BYTES
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        name, target, late = _sheet(book, wanted)
        dates = _date_styles(book)
        with book.open(target) as stream:
            held = b""
            while not (data := _DATA.search(held)):
                more = stream.read(size)
                if not more:
                    return  # no rows
                held += more
            root = _ROOT.search(held)[0]
            held = held[data.end():]
            row = 0
            while True:
                more = stream.read(size)
                held += more
                end = 0
                for found in _ROW_END.finditer(held):
                    end = found.end()
                if end:
                    rows, held = held[:end], held[end:]
                    yield name, row, root, rows, dates, late
                    for tag in _ROW.findall(rows):
                        number = _ROW_NUMBER.search(tag)
                        row = int(number[1]) if number else row + 1
                if not more:
                    return


def part_cells(start: int, root: bytes, rows: bytes, dates: list[bool], late: bool) -> Iterator[tuple[int, int, str, str]]:
    """(row, column, kind, text) of the filled cells of a part: kinds are n(umber), d(ate), b(oolean), t(ext) and
    s(hared text, by its number)."""
    epoch = datetime(1904, 1, 1) if late else datetime(1899, 12, 30)
    tag = _ROOT.search(root)
    closed = root.removesuffix(b"/>") + b">" if root.endswith(b"/>") else root
    tree = ElementTree.fromstring(closed + rows + b"</" + (tag[1] or tag[2]) + b">")
    row = start
    for node in tree:
        row = int(node.get("r", row + 1))
        col = 0
        for cell in node:
            letters = re.match(r"[A-Z]+", cell.get("r", ""))
            col = sum((ord(ch) - 64) * 26 ** i for i, ch in enumerate(reversed(letters[0]))) if letters else col + 1
            found = _cell(cell, dates, epoch)
            if found is not None:
                yield row, col, *found


def _cell(cell, dates: list[bool], epoch: datetime) -> tuple[str, str] | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        inner = cell.find(f"{MAIN}is")
        return None if inner is None else ("t", _text(inner))
    value = cell.find(f"{MAIN}v")
    if value is None or value.text is None or kind == "e":
        return None
    if kind == "b":
        return "b", "True" if value.text == "1" else "False"
    if kind in ("s", "d"):
        return kind, value.text
    if kind == "str":
        return "t", value.text
    style = int(cell.get("s", 0))
    if style < len(dates) and dates[style]:
        return "d", (epoch + timedelta(days=float(value.text))).isoformat(sep=" ", timespec="microseconds")
    return "n", value.text


def _table(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])


def workbook_cells(files: DataFrame, sheet_name: str = "") -> DataFrame:
    """(path, sheet, row, col, kind, value) of every filled cell of (path, content) rows,
    which have to be the same each time they are read."""
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                for part in sheet_parts(content, sheet_name):
                    yield _table([(path, *part)], PARTS)

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    if "xl/sharedStrings.xml" not in book.namelist():
                        continue
                    with book.open("xl/sharedStrings.xml") as stream:
                        block, number = [], 0
                        for _, node in ElementTree.iterparse(stream):
                            if node.tag == f"{MAIN}si":
                                block.append((path, number, _text(node)))
                                number += 1
                                node.clear()
                                if len(block) == 20_000:
                                    yield _table(block, STRINGS)
                                    block = []
                        yield _table(block, STRINGS)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                cells = part_cells(r.start, r.root, r.rows, list(r.dates), r.late)
                yield _table([(r.path, r.sheet, *cell) for cell in cells], CELLS)

    some = files.select("path", "content")
    parts = some.mapInPandas(split, PARTS).repartition(F.col("path"), F.col("start"))
    cells = parts.mapInPandas(parse, CELLS).withColumn("number", F.when(F.col("kind") == "s", F.col("value").cast("long")))
    joined = attach_measured(cells, some.mapInPandas(strings, STRINGS), ["path", "number"])
    return joined.select("path", "sheet", "row", "col", F.when(F.col("kind") == "s", "t").otherwise(F.col("kind")).alias("kind"),
                         F.coalesce("text", "value").alias("value"))


def header_names(found: dict[int, str], columns: int) -> list[str]:
    """The names of columns 1 to ``columns``: ``Unnamed: k`` (from 0) without a header,
    and ``.1``, ``.2`` ... behind the second and later columns of a name."""
    out: list[str] = []
    for k in range(columns):
        name = found.get(k + 1) or f"Unnamed: {k}"
        taken, n = name, 0
        while taken in out:
            n += 1
            taken = f"{name}.{n}"
        out.append(taken)
    return out


def read_workbooks(files: DataFrame, sheet_name: str = "", infer: bool = True) -> DataFrame:
    """The sheets of (path, content) rows as one table: the first row names
    the columns and has to agree.

    Columns without a header, and repeated headers, are kept under the names
    that ``header_names`` gives.  A column of dates is a timestamp, of numbers a
    long or a double, of booleans a boolean; any other is text, and text that
    stands for a missing value is null.  ``infer=False`` leaves all as text.
    The files are kept once, because sheets and shared strings are read apart
    and have to come from the same bytes, and a plan that writes workbooks may
    order rows anew each time it runs.  The parsed cells are kept once for
    header, types and rows.
    """
    return _read(cut_lineage(files.select("path", "content")), sheet_name, infer)


def _read(files: DataFrame, sheet_name: str, infer: bool) -> DataFrame:
    cells = cut_lineage(workbook_cells(files, sheet_name))
    books, width = cells.agg(F.countDistinct("path"), F.max("col")).first()
    # one row a column
    header = cells.where("row = 1").groupBy("col").agg(
        F.min("value").alias("name"), F.countDistinct("value").alias("kinds"), F.count(F.lit(1)).alias("n")).orderBy("col").collect()
    if not header:
        raise ValueError("no header row found")
    mixed = [r.name for r in header if r.kinds > 1 or r.n < books]
    if mixed:
        raise ValueError(f"workbooks disagree on the header near {mixed}")
    names = header_names({r.col: r.name for r in header}, width)
    missing = (F.col("kind") == "t") & F.col("value").isin(*MISSING_TOKENS)
    below = cells.where("row > 1")
    body = below.groupBy("path", "row").agg(*[
        F.max(F.when((F.col("col") == k + 1) & ~missing, F.col("value"))).alias(f"_c{k}") for k in range(width)])
    whole = F.col("value").try_cast("double") == F.col("value").try_cast("double").try_cast("long")
    kinds = {r.col: r for r in below.where(~missing).groupBy("col").agg(
        F.min("kind").alias("least"), F.max("kind").alias("most"), F.bool_and(F.coalesce(whole, F.lit(False))).alias("whole")).collect()}

    def typed(k: int):
        value, seen = F.col(f"_c{k}"), kinds.get(k + 1)
        kind = None if seen is None or seen.least != seen.most else seen.least
        if not infer or (seen is not None and kind not in ("d", "n", "b")):
            return value
        if kind == "d":
            return F.to_timestamp_ntz(value)
        if kind == "b":
            return value == "True"
        # a column without any value is a double column
        number = value.try_cast("double")
        return number.cast("long") if kind == "n" and seen.whole else number

    return body.select(*[typed(k).alias(n) for k, n in enumerate(names)])


def load_excel(spark: SparkSession, path: str, sheet_name: str = "", infer: bool = True) -> DataFrame:
    """The first or the named sheet of a workbook, a folder or a pattern."""
    # stored files stay as they are, so they are read twice and not copied
    return _read(spark.read.format("binaryFile").load(path), sheet_name, infer)
