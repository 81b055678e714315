"""CSV records with line breaks inside quotes, read in parts.

A range of a file does not know whether it begins inside a quoted value.  So
each range is first read for what it does to either state; these small
functions are composed along the file, which gives every range its true state
at the start.  Then each range cuts its own lines into records, and only the
pieces of records that cross a range's end are brought together.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_RANGE = pa.schema([("file", pa.string()), ("start", pa.int64()), ("from_out", pa.bool_()), ("from_in", pa.bool_())])
_RANGE_SQL = "file string, start long, from_out boolean, from_in boolean"
_PIECE = pa.schema([("file", pa.string()), ("start", pa.int64()), ("opens", pa.bool_()), ("closes", pa.bool_()),
                    ("first", pa.bool_()), ("text", pa.string())])
_PIECE_SQL = "file string, start long, opens boolean, closes boolean, first boolean, text string"
# records that a task gathers before it hands them on
GATHERED = 4096


def ends_inside(line: str, separator: str, inside: bool) -> bool:
    """Whether a line that begins inside a quoted value or not (then with a field) ends inside one.

    A quote opens a value only as the first character of a field; inside, two
    quotes are one, and a single one closes.
    """
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            while at >= 0 and line.startswith('""', at):
                at = line.find('"', at + 2)
            if at < 0:
                return True
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        at = line.find(separator, at)
        if at < 0:
            return False
        inside, at = False, at + len(separator)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines with their file and the start of their range; in order inside a range."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _ranges_inside(lines: DataFrame, separator: str) -> dict[str, set[int]]:
    """Per file the starts of the ranges that begin inside a quoted value: a number for
    each such range of ``spark.sql.files.maxPartitionBytes``, so a few bytes for some 100 MB of input."""
    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, into = None, False, True
        for b in batches:
            for file, start, line in zip(*(x.to_pylist() for x in b.columns)):
                if (file, start) != now:
                    if now:
                        yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((*now, out, into), _RANGE)],
                                                         schema=_RANGE)
                    now, out, into = (file, start), False, True
                if '"' in line:
                    out, into = ends_inside(line, separator, out), ends_inside(line, separator, into)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((*now, out, into), _RANGE)],
                                             schema=_RANGE)

    found: dict[str, set[int]] = {}
    file = state = None
    # one row a range
    for r in lines.mapInArrow(effects, _RANGE_SQL).sort("file", "start").toLocalIterator():
        if r["file"] != file:
            file, state = r["file"], False
        if state:
            found.setdefault(file, set()).add(r["start"])
        state = r["from_in"] if state else r["from_out"]
    return found


def records(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """``file, first, text``: every record of the CSV files, with its line breaks; ``first`` marks a file's first one.

    Line ends are ``\\n`` or ``\\r\\n``; lines of nothing but white space between
    records are no records; a value that is never closed goes to the end of
    its file.  An uncompressed file is read by as many tasks as it has ranges.
    """
    lines = _lines(spark, path)
    inside_at = spark.sparkContext.broadcast(_ranges_inside(lines, separator))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, inside, opens, first = None, [], False, True, False
        out: list[tuple] = []

        def piece(closes: bool) -> None:
            nonlocal held, opens, first
            text = "\n".join(held)
            if not (opens and closes) or text.strip():
                out.append((*now, opens, closes, first, text))
                first = False
            held, opens = [], True

        for b in batches:
            for file, start, line in zip(*(x.to_pylist() for x in b.columns)):
                if (file, start) != now:
                    if held:
                        piece(False)
                    now = (file, start)
                    inside = start in inside_at.value.get(file, ())
                    opens, first = not inside, start == 0
                held.append(line)
                inside = ends_inside(line, separator, inside)
                if not inside:
                    held[-1] = held[-1].removesuffix("\r")
                    piece(True)
                if len(out) >= GATHERED:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), _PIECE)], schema=_PIECE)
                    out = []
        if held:
            piece(False)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), _PIECE)], schema=_PIECE)

    pieces = lines.mapInArrow(cut, _PIECE_SQL)
    whole = pieces.where("opens and closes").select("file", "first", "text")
    # at most two pieces a range: the end of a record from before, then the start of one that goes on
    order = Window.partitionBy("file").orderBy("start", "opens")
    parts = pieces.where("not (opens and closes)").withColumn("record", F.count_if("opens").over(order))
    joined = parts.groupBy("file", "record").agg(F.max("first").alias("first"), F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("start", "opens", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return whole.union(joined.select("file", "first", "text"))


def column_names(header: str, separator: str) -> list[str]:
    """The names in a header record as Spark's reader gives them: the place for an empty name, and behind a repeated one."""
    names = next(csv.reader([header.removeprefix("﻿")], delimiter=separator, doublequote=True, strict=False), [])
    low = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if low.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def read_records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """The fields of all records but the header of each file, as text."""
    found = records(spark, path, separator)
    header = found.where("first").orderBy("file").select("text").first()
    if header is None:
        return spark.createDataFrame([], "_c0 string").drop("_c0")
    names = column_names(header["text"], separator)
    fields = ", ".join(f"_f{i} string" for i in range(len(names)))
    options = {"sep": separator, "quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}
    parsed = found.where("not first").select(F.from_csv("text", fields, options).alias("r"))
    return parsed.select(*[F.col(f"r._f{i}").alias(n) for i, n in enumerate(names)])
