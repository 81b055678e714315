"""k-means for many starts and numbers of clusters at once.

A problem is a start with its number of clusters.  All problems share every
scan of the points: a task holds all centres, adds up its points' clusters, and
hands on one row per centre; Spark adds those rows.  So a scan costs one job,
however many starts there are, and a problem that has settled takes no part.

Points lie in blocks of near points with their box and sums.  A block whose box
is on one centre's side of all others is added whole; only blocks on a border
between clusters are opened, so a step does not compare most of the points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 2  # of oversampling
OVERSAMPLE = 2  # candidates a round, in multiples of the number of clusters
MOST_STEPS = 50
MOVED = 1e-4  # a problem has settled once no centre moves further
# distances that a task holds at once
HELD_DISTANCES = 4_000_000
# cells a unit, of the first columns that points are put together by
CELLS, CELL_COLUMNS = 16, 3
# a block ends at the end of a cell once it has so many points, and anywhere at the most
LEAST_BLOCK, MOST_BLOCK = 64, 512
BLOCK_SCHEMA = "n int, w double, scatter double, mean array<double>, low array<double>, high array<double>, data binary"


@dataclass(frozen=True)
class Problem:
    k: int
    seed: int


def _uniform(h: np.ndarray, seed: int) -> np.ndarray:
    """A number in (0, 1) for each hash, the same wherever the point lies."""
    with np.errstate(over="ignore"):
        x = h.view(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / 2.0 ** 53


def _ends(x: np.ndarray) -> list[int]:
    """Where the blocks of sorted points end."""
    cells = np.floor(x[:, :CELL_COLUMNS] * CELLS)
    ends, start = [], 0
    for end in [*(np.flatnonzero((cells[1:] != cells[:-1]).any(1)) + 1).tolist(), len(x)]:
        while end - start > MOST_BLOCK:
            start += MOST_BLOCK
            ends.append(start)
        if end - start >= LEAST_BLOCK or end == len(x):
            start = end
            ends.append(end)
    return ends


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        w, h = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
        rows, start = [], 0
        for end in _ends(x):
            v, u = x[start:end], w[start:end]
            mean = (v * u[:, None]).sum(0) / u.sum()
            scatter = (u * ((v - mean) ** 2).sum(1)).sum()
            data = np.ascontiguousarray(v).tobytes() + u.tobytes() + h[start:end].tobytes()
            rows.append((end - start, u.sum(), scatter, mean.tolist(), v.min(0).tolist(), v.max(0).tolist(), data))
            start = end
        kinds = [pa.int32(), pa.float64(), pa.float64(), *[pa.list_(pa.float64())] * 3, pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                         names=[f.split()[0] for f in BLOCK_SCHEMA.split(", ")])


def packed(points: DataFrame, dims: int) -> DataFrame:
    """Blocks of near points from ``x array<double>, w double, h long``: distinct points, their
    weights, and a hash that random draws go by."""
    near = [F.floor(F.col("x")[i] * CELLS) for i in range(min(dims, CELL_COLUMNS))]
    # the points themselves too, so that a crowded cell is dealt to several tasks
    order = [*near, F.col("x")]
    return points.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pack, BLOCK_SCHEMA)


def _unpacked(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points, weights and hashes (``x, w, h``) of a batch of blocks."""
    xs, ws, hs = [], [], []
    for n, data in zip(b.column("n").to_pylist(), b.column("data")):
        held = np.frombuffer(data.as_buffer(), np.float64)
        at = len(held) - 2 * n
        xs.append(held[:at].reshape(n, -1))
        ws.append(held[at:at + n])
        hs.append(held[at + n:].view(np.int64))
    return np.concatenate(xs), np.concatenate(ws), np.concatenate(hs)


def _blocks(b: pa.RecordBatch, centres: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All points of a batch in parts whose distances fit."""
    x, w, h = _unpacked(b)
    rows = max(1, HELD_DISTANCES // max(1, centres))
    for at in range(0, len(x), rows):
        yield x[at:at + rows], w[at:at + rows], h[at:at + rows]


def _owners(mean: np.ndarray, low: np.ndarray, high: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centre next to each block's mean, and whether it is the nearest one of the whole box."""
    own = ((mean[:, None] - c) ** 2).sum(2).argmin(1)
    square = (c * c).sum(1)
    apart = c - c[own][:, None]
    # how much nearer another centre is than the block's own, at the corner where it is nearest
    parts = 2 * np.maximum(low[:, None] * apart, high[:, None] * apart).sum(2)
    lead = parts + square[own][:, None] - square
    size = np.abs(parts) + square[own][:, None] + square
    lead[np.arange(len(own)), own] = -np.inf
    return own, (lead < -1e-12 * size).all(1)


def _nearest(x: np.ndarray, centres: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per problem the nearest centre of each point and the squared distance to it."""
    every = np.concatenate(centres)
    # without the points' own squares; a row a centre, so that whole rows are compared
    rough = (every * every).sum(1)[:, None] - 2 * every @ x.T
    square = (x * x).sum(1)
    at = 0
    for c in centres:
        least, label = rough[at].copy(), np.zeros(len(x), np.int64)
        for i in range(1, len(c)):
            nearer = rough[at + i] < least
            label[nearer] = i
            np.minimum(least, rough[at + i], out=least)
        at += len(c)
        yield label, np.maximum(least + square, 0)


def _gathered(points: DataFrame, schema: str, work: Callable[[Iterator[pa.RecordBatch]], list[tuple]]) -> DataFrame:
    """A row or more for each task from all of its points."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = work(b for b in batches if b.num_rows)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=[f.split()[0] for f in schema.split(", ")])
    return points.mapInArrow(run, schema)


def _sums(points: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Per problem and centre: weight, cost and coordinate sums of its points."""
    numbers = list(centres)
    held = [centres[p] for p in numbers]
    dims = held[0].shape[1]

    def work(batches) -> list[tuple]:
        total = [np.zeros((len(c), dims + 2)) for c in held]
        seen = False
        for b in batches:
            seen = True
            x, w, _ = _unpacked(b)
            n, weight, scatter = (b.column(k).to_numpy(zero_copy_only=False) for k in ("n", "w", "scatter"))
            mean, low, high = (b.column(k).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) for k in ("mean", "low", "high"))
            for t, c in zip(total, held):
                own, whole = _owners(mean, low, high, c)
                o, m = own[whole], mean[whole]
                cost = scatter[whole] + weight[whole] * ((m - c[o]) ** 2).sum(1)
                for j, v in enumerate((weight[whole], cost, *(m * weight[whole][:, None]).T)):
                    t[:, j] += np.bincount(o, v, len(t))
                opened = np.repeat(~whole, n)
                y, u = x[opened], w[opened]
                rows = max(1, HELD_DISTANCES // len(c))
                for at in range(0, len(y), rows):
                    z, s = y[at:at + rows], u[at:at + rows]
                    label, cost = next(_nearest(z, [c]))
                    for j, v in enumerate((s, s * cost, *(z * s[:, None]).T)):
                        t[:, j] += np.bincount(label, v, len(t))
        return [(p, i, row.tolist()) for p, t in zip(numbers, total) for i, row in enumerate(t)] if seen else []

    rows = _gathered(points, "problem long, centre long, v array<double>", work).groupBy("problem", "centre").agg(
        *[F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(dims + 2)]).collect()
    out = {p: np.zeros((len(c), dims + 2)) for p, c in centres.items()}
    for r in rows:  # one row a centre
        out[r["problem"]][r["centre"]] = r[2:]
    return out


def _first_points(points: DataFrame, problems: list[Problem]) -> dict[int, np.ndarray]:
    """A point for each problem, drawn by weight."""
    def work(batches) -> list[tuple]:
        best: dict[int, tuple] = {}
        for b in batches:
            for x, w, h in _blocks(b, 1):
                for p, problem in enumerate(problems):
                    key = -np.log(_uniform(h, problem.seed)) / w
                    i = key.argmin()
                    best[p] = min(best.get(p, (np.inf, [])), (float(key[i]), x[i].tolist()))
        return [(p, *v) for p, v in best.items()]

    rows = _gathered(points, "problem long, key double, x array<double>", work).groupBy("problem").agg(
        F.min(F.struct("key", "x")).alias("m")).collect()
    return {r["problem"]: np.array([r["m"]["x"]]) for r in rows}


def _further_points(points: DataFrame, problems: list[Problem], centres: dict[int, np.ndarray], costs: dict[int, float],
                    turn: int) -> dict[int, np.ndarray]:
    """Some ``OVERSAMPLE * k`` points a problem, drawn by weight and squared distance to the centres."""
    numbers = [p for p in centres if costs[p] > 0]
    if not numbers:
        return centres
    held = [centres[p] for p in numbers]
    sizes = sum(map(len, held))

    def work(batches) -> list[tuple]:
        out = []
        for b in batches:
            for x, w, h in _blocks(b, sizes):
                for p, (_, cost) in zip(numbers, _nearest(x, held)):
                    share = OVERSAMPLE * problems[p].k * w * cost / costs[p]
                    out += [(p, v) for v in x[_uniform(h, problems[p].seed * 64 + turn) < share].tolist()]
        return out

    rows = _gathered(points, "problem long, x array<double>", work).collect()
    out = dict(centres)
    for p in numbers:
        found = sorted(r["x"] for r in rows if r["problem"] == p)
        if found:
            out[p] = np.concatenate([centres[p], np.array(found)])
    return out


def _chosen(candidates: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` of the candidates by weighted k-means++, then settled among the candidates; fewer if they are fewer."""
    r = np.random.default_rng(seed)
    used = weights > 0
    x, w = candidates[used], weights[used]
    if len(x) <= k:
        return x
    centres = x[[r.choice(len(x), p=w / w.sum())]]
    far = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k and (w * far).sum() > 0:
        centres = np.concatenate([centres, x[[r.choice(len(x), p=w * far / (w * far).sum())]]])
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(1))
    for _ in range(30):
        label, _ = next(_nearest(x, [centres]))
        size = np.bincount(label, w, len(centres))
        moved = np.stack([np.bincount(label, w * v, len(centres)) for v in x.T], 1) / np.maximum(size, 1e-300)[:, None]
        centres = np.where(size[:, None] > 0, moved, centres)
    return centres


def solve(points: DataFrame, problems: list[Problem]) -> list[tuple[float, np.ndarray]]:
    """Cost and centres of each problem over ``packed`` points.  No points, no centres."""
    centres = _first_points(points, problems)
    if not centres:
        return [(0.0, np.zeros((0, 0))) for _ in problems]
    for turn in range(1, ROUNDS + 1):
        costs = {p: float(s[:, 1].sum()) for p, s in _sums(points, centres).items()}
        centres = _further_points(points, problems, centres, costs, turn)
    weights = _sums(points, centres)
    centres = {p: _chosen(centres[p], weights[p][:, 0], problems[p].k, problems[p].seed) for p in centres}
    active = set(centres)
    costs: dict[int, float] = {}
    for _ in range(MOST_STEPS):
        for p, s in _sums(points, {p: centres[p] for p in active}).items():
            costs[p] = float(s[:, 1].sum())
            moved = np.where(s[:, :1] > 0, s[:, 2:] / np.maximum(s[:, :1], 1e-300), centres[p])
            far = float(((moved - centres[p]) ** 2).sum(1).max())
            if far <= MOVED ** 2:
                active.discard(p)
            else:
                centres[p] = moved
        if not active:
            break
    if active:
        for p, s in _sums(points, {p: centres[p] for p in active}).items():
            costs[p] = float(s[:, 1].sum())
    return [(costs[p], centres[p]) for p in range(len(problems))]
