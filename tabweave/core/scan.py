"""Ordered scans (running totals, carried values, row numbers) without a
window over a whole table or over one unbounded key.

Rows are cut into contiguous slots with ``repartitionByRange``.  A slot is read
once, in its order, and the running value is carried from row to row; the
pieces that (slot, key) cut are tied together by one summary row each, and
nothing else moves again.  The slots are frozen with a reliable checkpoint,
because the range bounds are sampled and the two branches must agree on them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from tabweave.core.checks import c
from tabweave.session import cut_lineage

# rows one task may sort and scan without a second thought
SMALL_TABLE = 100_000
# a lookup table within both limits goes to every executor
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
SLOT = "_slot"
SEQ = "_seq"


def range_slots(df: DataFrame, order: Sequence[Column], keep: Sequence[str] | None = None) -> DataFrame:
    """Sort globally; add the slot and the position inside the slot.  ``keep`` names
    the columns that are still needed then, all without it.

    ``monotonically_increasing_id`` numbers the rows of a task in their order:
    the task's index above bit 33, the position below it.
    """
    mark = F.monotonically_increasing_id()
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = ordered.withColumn("_mark", mark)
    return cut_lineage(
        ordered.withColumn(SLOT, F.shiftright("_mark", 33))
        .withColumn(SEQ, F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1)))
        .select(*map(c, df.columns if keep is None else keep), SLOT, SEQ))


def _passes_arrow(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether rows can be read in order by a task: Arrow knows their types, and keys can be compared."""
    if any(isinstance(df.schema[k].dataType, (T.ArrayType, T.StructType, T.MapType)) for k in keys):
        return False
    try:
        to_arrow_schema(df.schema)
    except PySparkException:
        return False
    return True


def _starts(columns: Sequence[pa.Array], n: int) -> np.ndarray:
    """Which of ``n`` rows begin a piece: they differ from the row before in a column.
    The columns hold that row before the first one, too; null and NaN equal themselves."""
    new = np.zeros(n, bool)
    for x in columns:
        a, b = x.slice(0, n), x.slice(1, n)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        if pa.types.is_floating(x.type):
            same = pc.or_(same, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
        new |= ~same.to_numpy(zero_copy_only=False)
    return new


Step = Callable[[pa.RecordBatch, np.ndarray], list[pa.Array]]


def _along(slots: DataFrame, piece: Sequence[str], out: Sequence[T.StructField], new_step: Callable[[], Step]) -> DataFrame:
    """Every slot in its order, with new columns from a step of its own.  The step gets each
    batch and which of its rows begin a piece, and may remember what the next batch needs."""
    schema = T.StructType([*slots.schema.fields, *out])
    at = [slots.columns.index(k) for k in piece]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, last = new_step(), None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            keys = [b.column(i) for i in at]
            before = [x.slice(0, 1) for x in keys] if last is None else last
            new = _starts([pa.concat_arrays([x, y]) for x, y in zip(before, keys)], n)
            new[0] |= last is None
            # a copy, so that no batch stays in memory for one row
            last = [x.take(pa.array([n - 1])) for x in keys]
            yield pa.RecordBatch.from_arrays([*b.columns, *step(b, new)], names=schema.names)

    return slots.mapInArrow(run, schema)


def _sums_before(slots: DataFrame, piece: Sequence[str], sums: Mapping[str, str]) -> DataFrame:
    """``_l_<name>``: the sum of a column over the earlier rows of the piece."""
    typed = slots.select(*[F.sum(c(src)).alias(f"_l_{out}") for out, src in sums.items()]).schema
    if not _passes_arrow(slots, piece) or not all(isinstance(f.dataType, (T.LongType, T.DoubleType)) for f in typed):
        inside = Window.partitionBy(*map(c, piece)).orderBy(SEQ).rowsBetween(Window.unboundedPreceding, -1)
        return slots.withColumns({f"_l_{out}": F.coalesce(F.sum(c(src)).over(inside), F.lit(0)) for out, src in sums.items()})
    kinds = [np.int64 if isinstance(f.dataType, T.LongType) else np.float64 for f in typed]
    names = slots.columns

    def new_step() -> Step:
        so_far = [kind(0) for kind in kinds]

        def step(b: pa.RecordBatch, new: np.ndarray) -> list[pa.Array]:
            number = new.cumsum()
            out = []
            for i, (src, kind) in enumerate(zip(sums.values(), kinds)):
                x = pc.fill_null(b.column(names.index(src)), 0).to_numpy(zero_copy_only=False).astype(kind)
                total = pd.Series(x).groupby(number).cumsum().to_numpy()
                total = np.where(number == 0, total + so_far[i], total)
                before = np.concatenate([[so_far[i]], total[:-1]])
                before[new] = 0
                so_far[i] = total[-1]
                out.append(pa.array(before))
            return out
        return step

    return _along(slots, piece, [T.StructField(f.name, f.dataType) for f in typed], new_step)


def _last_known(slots: DataFrame, piece: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``_f<i>``: a column's value, or where it is null its last one before in the piece."""
    if not _passes_arrow(slots, piece):
        inside = Window.partitionBy(*map(c, piece)).orderBy(SEQ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return slots.withColumns({f"_f{i}": F.last(c(n), ignorenulls=True).over(inside) for i, n in enumerate(columns)})
    names = slots.columns

    def new_step() -> Step:
        held: dict[int, pa.Array] = {}

        def step(b: pa.RecordBatch, new: np.ndarray) -> list[pa.Array]:
            n = len(new)
            piece_start = np.maximum.accumulate(np.where(new, np.arange(1, n + 1), 0))
            out = []
            for i, name in enumerate(columns):
                x = b.column(names.index(name))
                # place 0 is what the piece had last before this batch
                whole = pa.concat_arrays([held.get(i, pa.nulls(1, x.type)), x])
                place = np.maximum.accumulate(np.where(x.is_valid().to_numpy(zero_copy_only=False), np.arange(1, n + 1), 0))
                filled = whole.take(pa.array(place, mask=place < piece_start))
                held[i] = filled.take(pa.array([n - 1]))
                out.append(filled)
            return out
        return step

    return _along(slots, piece, [T.StructField(f"_f{i}", slots.schema[n].dataType) for i, n in enumerate(columns)], new_step)


def attach(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe lookup of ``right``'s other columns; Spark picks the join."""
    renamed = right.select(*[c(n).alias(f"_on{i}") for i, n in enumerate(on)],
                           *[c(n) for n in right.columns if n not in on])
    match = reduce(lambda a, b: a & b, [c(n).eqNullSafe(F.col(f"_on{i}")) for i, n in enumerate(on)])
    return left.join(renamed, match, how).drop(*[f"_on{i}" for i in range(len(on))])


def attach_measured(left: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """``attach`` for an aggregated lookup table of unknown size.

    The planner would shuffle the large side before it knows that the lookup is
    small.  So the lookup is computed once and measured: a small one is
    broadcast, any other is joined by shuffle with hot keys split.
    """
    kept = cut_lineage(lookup)
    text = F.lit(0)
    for f in kept.schema.fields:
        if f.dataType.typeName() in ("string", "binary"):
            text = text + F.coalesce(F.octet_length(c(f.name)), F.lit(0))
    rows, size = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum(text.cast("long")), F.lit(0))).first()
    small = rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES
    return attach(left, F.broadcast(kept) if small else kept, on, how)


def tie_break(df: DataFrame, order: Sequence[Column]) -> tuple[DataFrame, list[Column]]:
    """Make an order total, so that many equal sort keys still spread out."""
    hashable = [c(f.name) for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    out = df.withColumn("_tie1", F.xxhash64(*hashable)).withColumn(
        "_tie2", F.monotonically_increasing_id())
    return out, [*order, F.col("_tie1"), F.col("_tie2")]


def running_totals(df: DataFrame, order: Sequence[str], sums: Mapping[str, str],
                   keys: Sequence[str] = (), descending: bool = False,
                   rows_bound: int | None = None) -> DataFrame:
    """Add, per output name, the sum of a column over all earlier rows of the key.

    ``order`` must be unique inside a key (tables of distinct values are).
    A caller that has counted the rows says so with ``rows_bound``: a small
    table takes one plain window.
    """
    direction = (lambda n: c(n).desc()) if descending else (lambda n: c(n).asc())
    if rows_bound is not None and rows_bound <= SMALL_TABLE:
        before = Window.partitionBy(*(map(c, keys) if keys else [F.lit(0)])).orderBy(
            *[direction(o) for o in order]).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({out: F.coalesce(F.sum(c(src)).over(before), F.lit(0)) for out, src in sums.items()})
    slots = range_slots(df, [*[c(k).asc() for k in keys], *[direction(o) for o in order]])
    piece = [SLOT, *keys]
    summary = slots.groupBy(*map(c, piece)).agg(
        *[F.sum(c(src)).alias(f"_t_{out}") for out, src in sums.items()])
    earlier = Window.partitionBy(*(map(c, keys) if keys else [F.lit(0)])).orderBy(SLOT).rowsBetween(
        Window.unboundedPreceding, -1)
    # a slot border cuts one key at most, so fewer rows than slots have something to carry
    carry = summary.select(*map(c, piece), F.count(F.lit(1)).over(earlier).alias("_before"), *[
        F.sum(c(f"_t_{out}")).over(earlier).alias(f"_c_{out}") for out in sums]).where("_before > 0").drop("_before")
    local = _sums_before(slots, piece, sums)
    joined = attach(local, F.broadcast(carry), piece)
    return joined.withColumns({
        out: c(f"_l_{out}") + F.coalesce(c(f"_c_{out}"), F.lit(0)) for out in sums
    }).drop(SLOT, SEQ, *[f"_l_{o}" for o in sums], *[f"_c_{o}" for o in sums])


def row_numbers(df: DataFrame, order: Sequence[Column], name: str, start: int = 0) -> DataFrame:
    """Consecutive numbers in a global order."""
    tied, total_order = tie_break(df, order)
    slots = range_slots(tied, total_order)
    sizes = slots.groupBy(SLOT).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(F.lit(0)).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(SLOT, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_off"))
    # one row per slot
    out = attach(slots, F.broadcast(offsets), [SLOT]).withColumn(
        "_number", (F.col("_off") + F.col(SEQ) + F.lit(start)).cast("long"))
    kept = [n for n in df.columns if n != name]
    return out.select(*map(c, kept), F.col("_number").alias(name))


def carry_forward(df: DataFrame, columns: Sequence[str], order: Sequence[Column],
                  keys: Sequence[str] = ()) -> DataFrame:
    """Replace nulls by the last earlier non-null value of the same key.

    ``order`` gives the direction: reversed sort columns fill backwards.
    """
    tied, total_order = tie_break(df, [*[c(k).asc() for k in keys], *order])
    slots = range_slots(tied, total_order)
    piece = [SLOT, *keys]
    # per piece: the last non-null value, kept beside its position
    summary = slots.groupBy(*map(c, piece)).agg(*[
        F.max_by(c(n), F.when(c(n).isNotNull(), F.col(SEQ))).alias(f"_s{i}")
        for i, n in enumerate(columns)])
    earlier = Window.partitionBy(*(map(c, keys) if keys else [F.lit(0)])).orderBy(SLOT).rowsBetween(
        Window.unboundedPreceding, -1)
    carry = summary.select(*map(c, piece), F.count(F.lit(1)).over(earlier).alias("_before"), *[
        F.last(f"_s{i}", ignorenulls=True).over(earlier).alias(f"_k{i}") for i in range(len(columns))
    ]).where("_before > 0").drop("_before")
    local = _last_known(slots, piece, columns)
    joined = attach(local, F.broadcast(carry), piece)
    return joined.select(*[
        F.coalesce(f"_f{list(columns).index(n)}", f"_k{list(columns).index(n)}").alias(n)
        if n in columns else c(n) for n in df.columns])
