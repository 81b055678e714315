"""Token ids in bit-plane shuffled, compressed blocks.

A block of ids is a matrix of bits; it is stored transposed, one bit plane after
another, each compressed with zstandard.  High planes are nearly constant and
shrink to nothing.  The files are written and read by Spark, so any store
that Spark reaches will do:

* ``blocks/``: ``shard, block, n_ids, planes`` (one binary a plane, lowest bit
  first) and the documents in the block, ``docs`` of ``(doc_id, row, doc_start,
  doc_tokens, at, n)``;
* ``index/``: ``shard, block, start`` (ids before the block), ``n_ids,
  plane_bytes`` and ``first_id, last_id``, the documents at its two ends.

Shards are ranges of document ids in ascending order; a shard's blocks are in
order.  The ids before a shard are the sum over the index of those before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabweave.core.checks import c
from tabweave.llm.text import batch, map_batches
from tabweave.llm.tokens import encoder

BLOCK_IDS = 1 << 16
LEVEL = 1

_DOC = pa.struct([("doc_id", pa.int64()), ("row", pa.int64()), ("doc_start", pa.int64()), ("doc_tokens", pa.int64()),
                  ("at", pa.int64()), ("n", pa.int64())])
_BLOCKS = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("n_ids", pa.int64()),
                     ("planes", pa.list_(pa.binary())), ("docs", pa.list_(_DOC))])
_BLOCKS_SQL = ("shard int, block long, n_ids long, planes array<binary>, docs array<struct<doc_id: bigint, row: bigint, "
               "doc_start: bigint, doc_tokens: bigint, at: bigint, n: bigint>>")
_PARTS = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()),
                    ("doc_tokens", pa.int64()), ("doc_start", pa.int64()), ("at", pa.int64()), ("ids", pa.binary())])
_PARTS_SQL = "shard int, block long, doc_id long, row long, doc_tokens long, doc_start long, at long, ids binary"


def to_planes(ids: np.ndarray, level: int = LEVEL) -> list[bytes]:
    """A block of unsigned 32-bit ids as compressed bit planes, lowest first;
    planes above the highest bit in use are left out."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=level).compress
    width = int(ids.max()).bit_length() if len(ids) else 0
    # byte by byte: a bit of a whole array of bytes is packed fastest
    places = np.ascontiguousarray(ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T)
    return [pack(np.packbits(places[k // 8] & np.uint8(1 << k % 8)).tobytes()) for k in range(width)]


class Planes:
    """A block whose planes are decompressed once; any range of its ids can then be read."""

    def __init__(self, planes: list[bytes]):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        self.planes = [np.frombuffer(unpack(plane), np.uint8) for plane in planes]

    def ids(self, start: int, n: int) -> np.ndarray:
        first = start // 8
        skip = start - first * 8
        ids = np.zeros(n, "<u4")
        for k, plane in enumerate(self.planes):
            bits = np.unpackbits(plane[first:-(-(start + n) // 8)], count=skip + n)[skip:]
            ids |= bits.astype("<u4") << np.uint32(k)
        return ids


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    return Planes(planes).ids(0, n)


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, block_ids: int = BLOCK_IDS,
              id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encode whole texts, append ``end_id`` to each, and write blocks and index.

    Ascending ids; a null id comes first; rows with the same id follow each
    other in the order of their texts.  Null and empty texts are the end id alone.  Other
    columns are not read.  An empty table writes empty files.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        data, inside = bytearray(), []
        block = row = 0

        def flush(size: int) -> pa.RecordBatch:
            nonlocal data, inside, block
            ids = np.frombuffer(bytes(data[:size * 4]), "<u4")
            out = batch(_BLOCKS, [shard], [block], [size], [to_planes(ids)], [inside])
            data, inside, block = data[size * 4:], [], block + 1
            return out

        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(),
                                encoder(tokenizer).encode([t or "" for t in b.column(1).to_pylist()])):
                ids += end
                total, done = len(ids) // 4, 0
                while done < total:
                    room = block_ids - len(data) // 4
                    n = min(room, total - done)
                    inside.append({"doc_id": doc, "row": row, "doc_start": done, "doc_tokens": total,
                                   "at": len(data) // 4, "n": n})
                    data += ids[done * 4:(done + n) * 4]
                    done += n
                    if n == room:
                        yield flush(block_ids)
                row += 1
        if data:
            yield flush(len(data) // 4)

    rows = docs.select(c(id_column).cast("long").alias("doc_id"),
                       F.coalesce(c(text_column).cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    blocks = map_batches(ordered, run, _BLOCKS_SQL)
    # planes are compressed already
    blocks.write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    written = docs.sparkSession.read.schema(_BLOCKS_SQL).parquet(f"{folder}/blocks")
    sizes = written.groupBy("shard").agg(F.sum("n_ids").alias("size"))
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # one row a shard
    starts = sizes.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shard_start"))
    written.join(F.broadcast(starts), "shard").select(
        "shard", "block", (F.col("shard_start") + F.col("block") * block_ids).alias("start"), "n_ids",
        F.transform("planes", lambda p: F.octet_length(p)).alias("plane_bytes"),
        F.element_at("docs", 1)["doc_id"].alias("first_id"), F.element_at("docs", -1)["doc_id"].alias("last_id"),
    ).write.parquet(f"{folder}/index")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the files: ``doc_id, start`` (ids of all documents
    before it), ``n_tokens, ids`` (little-endian unsigned 32-bit).

    A document in one block comes straight from it.  Only the documents that
    cross a block's end, two a block at most, have parts to bring together; of
    the blocks nothing but those parts is put together a second time.
    """
    def parts(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    docs = [d for d in r["docs"] if (d["n"] == d["doc_tokens"]) == whole]
                    if docs:
                        block = Planes(r["planes"])
                        # whole documents lie side by side; of the others a block holds its two ends at most
                        first, end = (docs[0]["at"], docs[-1]["at"] + docs[-1]["n"]) if whole else (0, 0)
                        data = block.ids(first, end - first).tobytes()
                        yield batch(_PARTS, [r["shard"]] * len(docs), [r["block"]] * len(docs), *(
                            [d[k] for d in docs] for k in ("doc_id", "row", "doc_tokens", "doc_start", "at")),
                            [data[(d["at"] - first) * 4:(d["at"] - first + d["n"]) * 4] if whole
                             else block.ids(d["at"], d["n"]).tobytes() for d in docs])
        return run

    blocks = spark.read.schema(_BLOCKS_SQL).parquet(f"{folder}/blocks")
    index = spark.read.parquet(f"{folder}/index")
    # one row a shard
    starts = F.broadcast(index.where("block = 0").select("shard", F.col("start").alias("shard_start")))
    block_ids = index.where("block = 0").agg(F.max("n_ids").alias("block_ids"))
    parts_of = lambda whole: (map_batches(blocks, parts(whole), _PARTS_SQL)
                              .join(starts, "shard").join(F.broadcast(block_ids))
                              .withColumn("start", F.col("shard_start") + F.col("block") * F.col("block_ids") + F.col("at")))
    complete = parts_of(True).select("doc_id", "start", F.col("doc_tokens").alias("n_tokens"), "ids")
    joined = parts_of(False).groupBy("shard", "row").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.first("doc_tokens").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("doc_start", "ids"))).alias("parts"))
    return complete.union(joined.select("doc_id", "start", "n_tokens", F.aggregate(
        "parts", F.lit(b""), lambda done, part: F.concat(done, part["ids"])).alias("ids")))
