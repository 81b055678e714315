"""Exact density clustering (DBSCAN) as joins on a grid.

The grid's cells have the diagonal eps, so two points of one cell are always
neighbours.  Three facts keep the work near the number of points, also where
one cell or one coordinate holds a third of the table:

* equal coordinates are one weighted point;
* the points of a cell with min_samples or more are core points without any
  comparison, and sparse cells hold fewer than min_samples points each;
* two cells are linked by comparing boxes, halved again and again, instead of
  comparing their points with each other.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.core.checks import as_list, c
from tabweave.core.scan import attach, row_numbers
from tabweave.functions.transforms import fit_scaling
from tabweave.session import cut_lineage

NOISE = -1
MAX_DIMENSIONS = 4
MAX_HALVINGS = 16
# point pairs of two boxes that are compared without further halving
FEW_COMPARISONS = 64


def dbscan_cluster(df: DataFrame, columns: Sequence[str], eps: float = 0.5, min_samples: int = 5,
                   cluster_column: str = "cluster") -> DataFrame:
    """Add cluster numbers 0, 1, ...; noise is -1.  Columns are standardised.

    Clusters are numbered by their first grid cell.  A border point between
    clusters joins the one with the lower number.
    """
    names = as_list(columns)
    d = len(names)
    if not 1 <= d <= MAX_DIMENSIONS:
        raise ValueError(f"between 1 and {MAX_DIMENSIONS} columns can be clustered on a grid")
    if eps <= 0 or min_samples < 1:
        raise ValueError("eps and min_samples must be positive")
    scaling = fit_scaling(df, names, "standard", fill=0.0)
    # adding zero turns -0.0 into 0.0, so that equal points have equal keys
    coordinates = {f"_x{i}": scaling.column(n, fill=0.0) + F.lit(0.0) for i, n in enumerate(names)}
    rows = df.withColumns(coordinates)
    labels = _point_labels(rows.select(*coordinates), d, float(eps), min_samples)
    joined = attach(rows, labels, list(coordinates))
    kept = [n for n in df.columns if n != cluster_column]
    return joined.select(*map(c, kept), F.coalesce("_label", F.lit(NOISE)).cast("int").alias(cluster_column))


def _xs(d: int, prefix: str = "") -> list[str]:
    return [f"{prefix}_x{i}" for i in range(d)]


def _distance2(d: int, a: str, b: str) -> Column:
    total = F.lit(0.0)
    for i in range(d):
        gap = F.col(f"{a}_x{i}") - F.col(f"{b}_x{i}")
        total = total + gap * gap
    return total


def _offsets(d: int, side: float, eps: float) -> list[tuple[int, ...]]:
    """Steps to all cells that can hold a neighbour."""
    reach = int(eps / side) + 1
    near = lambda step: sum(max(abs(k) - 1, 0) ** 2 for k in step) * side * side <= eps * eps * (1 + 1e-9)
    return [step for step in product(range(-reach, reach + 1), repeat=d) if near(step)]


def _shifted(cell: Sequence[Column], steps: Sequence[tuple[int, ...]], name: str) -> Column:
    """Array of neighbouring cell keys."""
    return F.array(*[F.struct(*[(x + F.lit(k)).alias(f"k{i}") for i, (x, k) in enumerate(zip(cell, step))])
                     for step in steps]).alias(name)


def _point_labels(points: DataFrame, d: int, eps: float, min_samples: int) -> DataFrame:
    """(coordinates, _label) of all points that belong to a cluster."""
    side = eps / sqrt(d) * (1 - 1e-9)
    steps = _offsets(d, side, eps)
    cell = F.struct(*[F.floor(F.col(f"_x{i}") / F.lit(side)).alias(f"k{i}") for i in range(d)])
    weighted = points.groupBy(*_xs(d)).agg(F.count(F.lit(1)).alias("w")).withColumn("cell", cell)
    weights = weighted.groupBy("cell").agg(F.sum("w").alias("cell_w"))
    sized = cut_lineage(attach(weighted, weights, ["cell"]))
    sparse = sized.where(F.col("cell_w") < min_samples)
    keys = [F.col(f"cell.k{i}") for i in range(d)]
    # neighbours of the points in sparse cells, counted with their weight
    asking = sparse.select(*[F.col(x).alias(f"q{x}") for x in _xs(d)],
                           F.explode(_shifted(keys, steps, "near")).alias("cell"))
    near = asking.join(sized.select(*_xs(d), "cell", "w"), "cell").where(_distance2(d, "q", "") <= eps * eps)
    degree = near.groupBy(*_xs(d, "q")).agg(F.sum("w").alias("degree")).where(F.col("degree") >= min_samples)
    dense_core = sized.where(F.col("cell_w") >= min_samples).select(*_xs(d), "cell")
    sparse_core = attach(sparse, degree.select(*[F.col(f"q{x}").alias(x) for x in _xs(d)], F.lit(1).alias("hit")),
                         _xs(d), "inner").select(*_xs(d), "cell")
    core = cut_lineage(dense_core.unionByName(sparse_core))
    ids = row_numbers(core.select("cell").distinct(), [F.col("cell").asc()], "id")
    links = _cell_links(core, ids, d, side, eps, steps)
    component = connected_components(ids.select("id"), links)
    numbers = row_numbers(component.select("comp").distinct(), [F.col("comp").asc()], "_label")
    cell_label = attach(attach(ids, component, ["id"]), numbers, ["comp"]).select("cell", "_label")
    core_label = attach(core, cell_label, ["cell"]).select(*_xs(d), "cell", "_label")
    # border points: sparse points that are no core point, near some core point
    others = sparse.select(*_xs(d), "cell").join(sparse_core.select(*_xs(d)), _xs(d), "left_anti")
    asking = others.select(*[F.col(x).alias(f"q{x}") for x in _xs(d)],
                           F.explode(_shifted(keys, steps, "near")).alias("cell"))
    border = asking.join(core_label, "cell").where(_distance2(d, "q", "") <= eps * eps).groupBy(
        *_xs(d, "q")).agg(F.min("_label").alias("_label"))
    return core_label.select(*_xs(d), "_label").unionByName(
        border.select(*[F.col(f"q{x}").alias(x) for x in _xs(d)], "_label"))


def _piece(d: int, side: float, level: int) -> Column:
    """Part of a cell, the cell's side halved ``level`` times."""
    return F.struct(*[F.floor(F.col(f"_x{i}") / F.lit(side / 2 ** level)).alias(f"k{i}") for i in range(d)])


def _boxes(core: DataFrame, d: int, side: float, level: int, halvings: int) -> DataFrame:
    """Size, bounding box and one member of each part of a cell, and the part
    it was halved from."""
    boxes = core.withColumn("piece", _piece(d, side, level)).groupBy("id", "piece").agg(
        F.count(F.lit(1)).alias("n"), *[F.min(x).alias(f"lo{x}") for x in _xs(d)],
        *[F.max(x).alias(f"hi{x}") for x in _xs(d)], F.min(F.struct(*_xs(d))).alias("member"))
    return boxes.withColumn("parent", F.struct(*[
        F.shiftright(F.col(f"piece.k{i}"), halvings).alias(f"k{i}") for i in range(d)]))


def _judge(pairs: DataFrame, d: int, eps: float) -> DataFrame:
    """Keep box pairs that may hold a neighbour pair; mark those that do, and
    those with so few points that comparing them is cheap."""
    nearest, furthest, members = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for x in _xs(d):
        gap = F.greatest(F.col(f"a_lo{x}") - F.col(f"b_hi{x}"), F.col(f"b_lo{x}") - F.col(f"a_hi{x}"), F.lit(0.0))
        span = F.greatest(F.col(f"a_hi{x}") - F.col(f"b_lo{x}"), F.col(f"b_hi{x}") - F.col(f"a_lo{x}"))
        apart = F.col(f"a_member.{x}") - F.col(f"b_member.{x}")
        nearest, furthest, members = nearest + gap * gap, furthest + span * span, members + apart * apart
    limit = eps * eps
    return pairs.where(nearest <= limit).select(
        "a_id", "b_id", "a_piece", "b_piece", ((members <= limit) | (furthest <= limit)).alias("linked"),
        (F.col("a_n") * F.col("b_n") <= FEW_COMPARISONS).alias("few"))


def _cell_links(core: DataFrame, ids: DataFrame, d: int, side: float, eps: float,
                steps: Sequence[tuple[int, ...]]) -> DataFrame:
    """(a, b) ids of cells that hold two core points within eps."""
    core = cut_lineage(attach(core, ids, ["cell"]))
    half = [s for s in steps if s > tuple([0] * d)]
    keys = [F.col(f"cell.k{i}") for i in range(d)]
    pending = ids.select(F.col("id").alias("a_id"), F.explode(_shifted(keys, half, "near")).alias("cell")).join(
        ids.select("cell", F.col("id").alias("b_id")), "cell").select("a_id", "b_id")
    halvings = 2 if d <= 2 else 1
    links, points, on = None, core, ([], [])
    for level in range(0, MAX_HALVINGS + 1, halvings):
        boxes = _boxes(points, d, side, level, halvings)
        if level:
            boxes = cut_lineage(boxes)
        a = boxes.select(*[F.col(n).alias(f"a_{n}") for n in boxes.columns])
        b = boxes.select(*[F.col(n).alias(f"b_{n}") for n in boxes.columns])
        judged = cut_lineage(_judge(pending.join(a, ["a_id", *on[0]]).join(b, ["b_id", *on[1]]), d, eps))
        found = judged.where("linked").select("a_id", "b_id").distinct()
        unclear = judged.where("not linked").join(found, ["a_id", "b_id"], "left_anti")
        # few points, or boxes that differ from eps by less than their own size
        close = unclear.where("few") if level < MAX_HALVINGS else unclear
        member = core.withColumn("piece", _piece(d, side, level))
        of = lambda s: member.select(F.col("id").alias(f"{s}_id"), F.col("piece").alias(f"{s}_piece"),
                                     *[F.col(x).alias(f"{s}{x}") for x in _xs(d)])
        compared = close.join(of("a"), ["a_id", "a_piece"]).join(of("b"), ["b_id", "b_piece"]).where(
            _distance2(d, "a", "b") <= eps * eps).select("a_id", "b_id")
        links = found.unionByName(compared) if links is None else links.unionByName(found).unionByName(compared)
        rest = unclear.where("not few")
        if level == MAX_HALVINGS or rest.isEmpty():
            break
        pending = rest.select("a_id", "b_id", F.col("a_piece").alias("a_parent"), F.col("b_piece").alias("b_parent"))
        on = (["a_parent"], ["b_parent"])
        involved = rest.select(F.col("a_id").alias("id")).union(rest.select("b_id")).distinct()
        points = core.join(involved, "id", "left_semi")
    return links.distinct()


def connected_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, comp): the least id of each component.

    Links are rewired towards the least neighbour, alternately for all and for
    the smaller neighbours, until every node points at its component's least
    node; long chains shrink by halves.
    """
    pairs = links.toDF("a", "b")
    edges = cut_lineage(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(
        "u <> v").distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        wide = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = wide.groupBy("u").agg(F.min("v").alias("m"))
        down = wide.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                          F.col("m").alias("v"))
        edges = cut_lineage(down.where("u <> v").distinct())
        found = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == mark:
            break
        mark = found
    stars = edges.groupBy("u").agg(F.min("v").alias("comp"))
    return attach(nodes, stars.select(F.col("u").alias("id"), "comp"), ["id"]).select(
        "id", F.coalesce("comp", "id").alias("comp"))
