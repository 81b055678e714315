"""Exact top-k search by inner product: a Voronoi join.

Pivots are a hash-ordered choice of vectors.  Every vector belongs to the cell
of its nearest pivot, and a cell is summed up by its size and radius.  For a
query q and a cell with pivot p and radius r no vector scores above
``q.p + |q| r``.  A query is first solved inside its own cell; its k-th score
there is a bound, and the query then travels only to the cells that may still
beat it.  Cells and queries are dealt out in blocks of bounded size, so a vector
that a third of all rows share fills many blocks, not one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.core.checks import c
from tabweave.llm.text import batch, map_batches
from tabweave.session import cut_lineage

SCALE = 1024
MOST_PIVOTS = 1024
BLOCK_ROWS = (256, 16_384)
QUERY_BLOCK = 16_384

_CELL = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("cell", pa.int32()), ("distance", pa.float64()),
                   ("vector", pa.binary()), ("is_query", pa.bool_())])
_CELL_SQL = "vec_id long, dim int, cell int, distance double, vector binary, is_query boolean"
_SENT = pa.schema([("query_key", pa.int64()), ("query_id", pa.int64()), ("vector", pa.binary()), ("dim", pa.int32()),
                   ("cell", pa.int32())])
_SENT_SQL = "query_key long, query_id long, vector binary, dim int, cell int"
_FOUND = pa.schema([("query_key", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_FOUND_SQL = "query_key long, query_id long, vec_id long, score long"


def pack(values) -> bytes:
    """Whole numbers as 32-bit integers if they fit, else as 64-bit ones."""
    a = np.asarray(values, np.int64)
    return a.astype("<i4" if not len(a) or np.abs(a).max() < 2**31 else "<i8").tobytes()


def matrix(vectors: list[bytes], dim: int) -> np.ndarray:
    rows = np.empty((len(vectors), dim), np.int64)
    for i, v in enumerate(vectors):
        rows[i] = np.frombuffer(v, "<i4" if len(v) == 4 * dim else "<i8")
    return rows


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all pairs of rows."""
    most = lambda m: float(np.abs(m).max()) if m.size else 0.0
    if most(left) * most(right) * max(left.shape[1], 1) < 2.0**53:
        return (left.astype(np.float64) @ right.T.astype(np.float64)).astype(np.int64)
    return left @ right.T


def best_of_block(ids: np.ndarray, scores: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the k best rows but ``own``; ``ids`` ascend, so ties go to
    the smaller id."""
    rest = np.flatnonzero(ids != own)
    s = scores[rest]
    if len(s) > k:
        least = np.partition(s, len(s) - k)[len(s) - k]
        above = np.flatnonzero(s > least)
        level = np.flatnonzero(s == least)[:k - len(above)]
        rest = rest[np.concatenate((above, level))]
    return rest


def _solve(k: int):
    def run(key: tuple[pa.Scalar, ...], data: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if data.num_rows and queries.num_rows:
            dim = data.column("dim")[0].as_py()
            ids = data.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, rows = ids[order], matrix(data.column("vector").to_pylist(), dim)[order]
            keys, names = queries.column("query_key").to_pylist(), queries.column("query_id").to_pylist()
            vectors = queries.column("vector").to_pylist()
            step = max(1, (1 << 21) // max(1, len(ids)))
            for at in range(0, len(keys), step):
                scores = products(matrix(vectors[at:at + step], dim), rows)
                for i, s in enumerate(scores, at):
                    for j in best_of_block(ids, s, names[i], k).tolist():
                        out.append((keys[i], names[i], int(ids[j]), int(s[j])))
        columns = list(zip(*out)) if out else [[], [], [], []]
        return pa.Table.from_arrays([pa.array(x, t.type) for x, t in zip(columns, _FOUND)], schema=_FOUND)
    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_key").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id",
          vector_column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows for each query.

    Components become ``floor(scale * x)``; the score is their integer inner
    product; ties go to the smaller id.  Candidates are all rows but those
    with the query's own id.  Vectors that are null, or hold null or
    non-finite components, and rows with a null id take no part; vectors are
    compared with those of the same length.  Repeated rows are candidates each; a query row that repeats
    with the same vector is asked once.  Other columns are not read.  An empty
    table gives no rows.
    """
    value = F.col("v").cast("array<double>")
    usable = F.col("id").isNotNull() & value.isNotNull() & F.forall(
        value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(c(id_column).cast("long").alias("id"), c(vector_column).alias("v"),
                          F.coalesce(is_query, F.lit(False)).alias("q")).where(usable).select(
        "id", F.transform(value, lambda x: F.floor(x * scale)).alias("v"), "q")
    n = rows.count()
    pivots_wanted = min(MOST_PIVOTS, max(8, math.isqrt(n) // 2))
    pivots: dict[int, list[list[int]]] = {}
    for r in rows.orderBy(F.xxhash64("id"), "id").limit(pivots_wanted).select("v").collect():
        pivots.setdefault(len(r.v), []).append(list(r.v))
    centres = {dim: np.array(p, np.float64).reshape(len(p), dim) for dim, p in pivots.items()}
    spark = vectors.sparkSession

    def centre(dim: int) -> np.ndarray:
        # lengths without a pivot share one cell round the origin
        return centres[dim] if dim in centres else np.zeros((1, dim))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, values, queries = (x.to_pylist() for x in b.columns)
            for dim in {len(v) for v in values}:
                own = [i for i, v in enumerate(values) if len(v) == dim]
                m = np.array([values[i] for i in own], np.float64).reshape(len(own), dim)
                p = centre(dim)
                cell = ((p * p).sum(1)[None, :] - 2 * (m @ p.T)).argmin(1)
                distance = np.sqrt(((m - p[cell]) ** 2).sum(1))
                yield batch(_CELL, [ids[i] for i in own], [dim] * len(own), cell, distance,
                            [pack(values[i]) for i in own], [queries[i] for i in own])

    cells = cut_lineage(map_batches(rows, assign, _CELL_SQL))
    # one row a pivot
    summary = {(r.dim, r.cell): (r.n, r.radius) for r in cells.groupBy("dim", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius")).collect()}
    size = min(BLOCK_ROWS[1], max(BLOCK_ROWS[0], n // 64))
    blocks = {key: -(-held // size) for key, (held, _) in summary.items()}
    asked = cells.where("is_query").select(F.xxhash64("vec_id", "vector").alias("query_key"),
                                           F.col("vec_id").alias("query_id"), "vector", "dim", "cell")
    asked = cut_lineage(asked.dropDuplicates(["query_key"]))
    parts = asked.count() // QUERY_BLOCK + 1
    counts = spark.createDataFrame([(d, p, b) for (d, p), b in blocks.items()], "dim int, cell int, blocks int")

    def local(queries: DataFrame) -> DataFrame:
        """Each query against the whole of the cell it was sent to."""
        data = cells.join(F.broadcast(counts), ["dim", "cell"]).select(
            "vec_id", "vector", "dim", "cell", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"),
            F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        sent = queries.join(F.broadcast(counts), ["dim", "cell"]).select(
            "query_key", "query_id", "vector", "dim", "cell",
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
            F.pmod("query_key", F.lit(parts)).cast("int").alias("part"))
        keys = ["dim", "cell", "block", "part"]
        # both sides come from the same table: aliases tell their columns apart
        sent = sent.select(*[F.col(n).alias(n) for n in sent.columns])
        return data.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(_solve(k), _FOUND_SQL)

    at_home = cut_lineage(_ranked(local(asked), k))
    bounds = at_home.groupBy("query_key").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    bounded = asked.join(bounds, "query_key", "left").select(
        "query_key", "query_id", "vector", "dim", "cell", F.when(F.col("n") >= k, F.col("least")).alias("bound"))
    radius = {dim: np.array([summary.get((dim, i), (0, -np.inf))[1] for i in range(len(centre(dim)))])
              for dim in {d for d, _ in summary}}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, name, vector, dim, home, bound in zip(*(x.to_pylist() for x in b.columns)):
                q = matrix([vector], dim)[0].astype(np.float64)
                r = radius[dim]
                most = centre(dim) @ q + math.sqrt(float(q @ q)) * np.maximum(r, 0)
                # rounding must not lose a cell
                most += 1e-6 * np.abs(most) + 1
                wanted = (r >= 0) & (np.arange(len(r)) != home)
                if bound is not None:
                    wanted &= most >= bound
                out += [(key, name, vector, dim, i) for i in np.flatnonzero(wanted).tolist()]
            yield batch(_SENT, *(zip(*out) if out else [[]] * 5))

    away = local(map_batches(bounded, send, _SENT_SQL))
    best = _ranked(at_home.drop("rank").unionByName(away), k)
    return best.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
