"""Helpers shared by the text operators: bytes of texts, words, Arrow batches."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
# a-z, 0-9 and every byte of a non-ASCII character stay; all else separates
WORD_BYTES = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in ASCII_LOWER)
# Arrow batches are bounded by rows, not bytes; so that a batch of very long
# texts fits, rows per batch go down to this number
BATCH_ROWS = 512


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: str) -> DataFrame:
    """``mapInArrow`` over batches of at most ``BATCH_ROWS`` rows."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """The texts of a string column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def text_words(data: bytes) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, A-Z in lower case."""
    return data.translate(WORD_BYTES).split()


def space_words(data: bytes) -> list[bytes]:
    """Runs between white space (x20, x09-x0D), A-Z in lower case."""
    return data.translate(ASCII_LOWER).split()


def crc_mod(column: Column, m: int) -> Column:
    """crc32 of a value written as text, modulo ``m``; null counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % m


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


def crc_mod_of(value, m: int) -> int:
    return zlib.crc32(("" if value is None else str(value)).encode()) % m


def text_hashes(data: list[bytes]) -> list[int]:
    """Spark's ``xxhash64`` of each text: 64 bits that tell rows of one id apart."""
    import xxhash

    return [h - (1 << 64) if (h := xxhash.xxh64_intdigest(d, 42)) >> 63 else h for d in data]
