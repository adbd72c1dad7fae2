"""K-means for many models at once: every pass over the rows moves the centres of all of them.

A model is one start of one k on one part of the rows (a quarter, say).  Tasks
add up the rows nearest to each centre; the sums of the tasks are added per
model, and only centres reach the driver.  Starts are k-means++ draws from one
bounded hash sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salestide.session import durable

#: rows of a part from which the starts are drawn
SEED_ROWS = 4096
_TOLERANCE = 1e-4
#: rows of a block, and distances held at a time
_BLOCK = 1 << 11
_CACHED = 1 << 16


@dataclass
class Model:
    part: int
    k: int
    start: int
    centers: np.ndarray
    cost: float = float("inf")
    done: bool = False
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0))


def _squares(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(axis=1)[None, :], 0.0)


def _plus_plus(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k centres drawn from the rows, each by its squared distance to those before."""
    chosen = [int(rng.integers(len(x)))]
    near = _squares(x, x[chosen])[:, 0]
    while len(chosen) < k:
        whole = near.sum()
        weights = near / whole if whole > 0 else np.full(len(x), 1 / len(x))
        chosen.append(int(rng.choice(len(x), p=weights)))
        near = np.minimum(near, _squares(x, x[chosen[-1:]])[:, 0])
    return x[chosen].copy()


def _rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, rows) of the batches of a task, packed or not, in blocks that bound the distances held at a time."""
    for batch in batches:
        parts = batch.column("part").to_numpy()
        if "body" in batch.schema.names:
            for part, body in zip(parts, batch.column("body")):
                yield int(part), np.frombuffer(body.as_buffer()).reshape(-1, width)
            continue
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        for part in np.unique(parts):
            own = x[parts == part]
            for at in range(0, len(own), _BLOCK):
                yield int(part), own[at : at + _BLOCK]


def _packed(narrow: DataFrame, width: int) -> DataFrame:
    """Rows of a part side by side in one value of up to ``_BLOCK`` rows, so that a pass does not convert them again."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _rows(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["part", "body"])

    return durable(narrow.mapInArrow(packed, "part int, body binary"))


class _Stack:
    """The models of a part with their centres below each other, those of one k in a run: one product gives all distances."""

    def __init__(self, models: list[tuple[int, np.ndarray]], width: int):
        models = sorted(models, key=lambda m: len(m[1]))
        self.models = [i for i, _ in models]
        self.counts = [len(c) for _, c in models]
        centers = np.vstack([c for _, c in models])
        # [x, 1, |x|²] times this is |x - c|²
        self.far = np.column_stack([-2 * centers, (centers * centers).sum(axis=1), np.ones(len(centers))])
        self.sums = np.zeros((len(centers), width + 2))
        self.cost = np.zeros(len(models))
        self.distances = np.zeros(len(centers))

    def add(self, x: np.ndarray, distances: bool) -> None:
        wide = np.column_stack([x, np.ones(len(x)), (x * x).sum(axis=1)])
        step = max(32, _CACHED // len(self.far))
        for at in range(0, len(wide), step):
            rows = wide[at : at + step]
            far = self.far @ rows.T
            np.maximum(far, 0.0, out=far)
            hot = np.empty(far.shape)
            first = centre = 0
            while first < len(self.counts):
                k = self.counts[first]
                same = self.counts.count(k)
                cells = slice(centre, centre + same * k)
                cube = far[cells].reshape(same, k, -1)
                least = cube.min(axis=1)
                near = cube == least[:, None, :]
                if np.count_nonzero(near) != least.size:  # equally near centres: the first takes the row
                    near = np.arange(k)[None, :, None] == cube.argmin(axis=1)[:, None, :]
                hot[cells] = near.reshape(same * k, -1)
                self.cost[first : first + same] += least.sum(axis=1)
                if distances:
                    self.distances[cells] += (near * np.sqrt(least)[:, None, :]).sum(axis=2).ravel()
                first, centre = first + same, cells.stop
            self.sums += hot @ rows

    def totals(self) -> Iterator[tuple[int, bytes]]:
        """(model, sums of rows, sizes, cost on its first centre, distances, squared norms)."""
        centre = 0
        for i, k, cost in zip(self.models, self.counts, self.cost):
            cells = slice(centre, centre := centre + k)
            costs = np.zeros(k)
            costs[0] = cost
            yield i, np.column_stack([self.sums[cells, :-1], costs, self.distances[cells], self.sums[cells, -1]]).tobytes()


def _summed(
    narrow: DataFrame, models: list[Model], width: int, distances: bool = False
) -> dict[int, tuple[np.ndarray, np.ndarray, float, np.ndarray, np.ndarray]]:
    """Per model: sizes, sums of rows, cost, and of each cluster the sum of distances (if asked for) and of squared norms."""
    # a few hundred centres at most
    shared = narrow.sparkSession.sparkContext.broadcast([(m.part, m.centers) for m in models])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        stacks = {p: _Stack([(i, c) for i, (own, c) in enumerate(known) if own == p], width) for p in {own for own, _ in known}}
        for part, x in _rows(batches, width):
            if part in stacks:
                stacks[part].add(x, distances)
        found = [t for stack in stacks.values() for t in stack.totals()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([t for _, t in found], pa.binary())], names=["model", "body"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies: dict[int, np.ndarray] = {}
        for batch in batches:
            for model, body in zip(batch.column("model").to_pylist(), batch.column("body")):
                bodies[model] = bodies.get(model, 0.0) + np.frombuffer(body.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array(list(bodies), pa.int64()), pa.array([b.tobytes() for b in bodies.values()], pa.binary())], names=["model", "body"])

    types = "model long, body binary"
    found = {}
    for r in narrow.mapInArrow(added, types).repartition("model").mapInArrow(merged, types).collect():
        t = np.frombuffer(bytes(r["body"])).reshape(-1, width + 4)
        found[r["model"]] = (t[:, width], t[:, :width], float(t[:, width + 1].sum()), t[:, width + 2], t[:, width + 3])
    return found


def fit(narrow: DataFrame, wanted: list[tuple[int, int]], starts: int, seed: int = 42, most: int = 300) -> list[Model]:
    """All ``starts`` of every (part, k) of ``wanted`` on durable rows ``narrow`` (part, x), moved together to rest."""
    told = {r["part"]: r for r in narrow.groupBy("part").agg(
        F.count("*").alias("n"), F.max(F.size("x")).alias("width"),
    ).collect()}
    if not told:
        return []
    width = next(iter(told.values()))["width"]
    share = F.create_map(*[F.lit(v) for p, r in told.items() for v in (p, min(1.0, 2 * SEED_ROWS / r["n"]))])
    luck = F.pmod(F.xxhash64("x", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    chances = narrow.where(luck < share[F.col("part")])
    samples = {p: np.array([r["x"] for r in chances.where(F.col("part") == p).limit(SEED_ROWS).collect()]) for p in told}
    samples = {p: s[np.lexsort(s.T)] for p, s in samples.items() if len(s)}
    models = [
        Model(p, k, s, _plus_plus(samples[p], k, np.random.default_rng([seed, p, k, s]))) for p, k in wanted for s in range(starts)
    ]
    spreads = {p: float(s.var(axis=0).mean()) for p, s in samples.items()}
    packed = _packed(narrow, width)
    for _ in range(most):
        moving = [m for m in models if not m.done]
        if not moving:
            break
        found = _summed(packed, moving, width)
        for i, m in enumerate(moving):
            sizes, sums, cost, *_ = found[i]
            # a centre that lost all its rows stays
            new = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], m.centers)
            shift = float(((new - m.centers) ** 2).sum())
            m.cost, m.done = cost, shift <= _TOLERANCE * spreads[m.part]
            m.centers = new
    return models


def best(models: list[Model]) -> dict[tuple[int, int], Model]:
    """The tightest start of every (part, k)."""
    found: dict[tuple[int, int], Model] = {}
    for m in models:
        if (m.part, m.k) not in found or m.cost < found[m.part, m.k].cost:
            found[m.part, m.k] = m
    return found


def scores(narrow: DataFrame, models: list[Model]) -> list[dict[str, float]]:
    """Silhouette (squared distances), inertia, Davies-Bouldin and Calinski-Harabasz of every model, in two passes."""
    width = models[0].centers.shape[1]
    told = _summed(narrow, models, width, True)
    shared = narrow.sparkSession.sparkContext.broadcast([(m.part, m.centers, *told[i]) for i, m in enumerate(models)])

    def silhouettes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        totals = np.zeros(len(known))
        for part, x in _rows(batches, width):
            norms = (x * x).sum(axis=1)
            for i, (own, centers, sizes, sums, _, _, squares) in enumerate(known):
                if own != part or len(centers) < 2:
                    continue
                near = _squares(x, centers).argmin(axis=1)
                n = np.maximum(sizes, 1)
                # mean squared distance to the rows of every cluster
                mean = np.maximum(norms[:, None] + (squares / n)[None, :] - 2 * x @ (sums / n[:, None]).T, 0.0)
                mean[:, sizes == 0] = np.inf
                rows = np.arange(len(x))
                inside = mean[rows, near] * sizes[near] / np.maximum(sizes[near] - 1, 1)
                mean[rows, near] = np.inf
                beside = mean.min(axis=1)
                most = np.maximum(inside, beside)
                value = np.divide(beside - inside, most, out=np.zeros(len(x)), where=(most > 0) & np.isfinite(most))
                totals[i] += np.where(sizes[near] > 1, value, 0.0).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(known))), pa.array(totals)], names=["model", "total"])

    sums = {r["model"]: r["total"] for r in narrow.mapInArrow(silhouettes, "model long, total double").groupBy("model").agg(F.sum("total").alias("total")).collect()}
    return [_score(m, *told[i], sums[i]) for i, m in enumerate(models)]


def _score(model: Model, sizes: np.ndarray, sums: np.ndarray, cost: float, distances: np.ndarray, _: np.ndarray, total: float) -> dict[str, float]:
    full = sizes > 0
    n, k = float(sizes.sum()), int(full.sum())
    centers, counts = model.centers[full], sizes[full]
    middle = sums.sum(axis=0) / n
    between = float((counts * ((centers - middle) ** 2).sum(axis=1)).sum())
    spread = distances[full] / counts
    worst = [0.0]
    if k > 1:
        apart = np.sqrt(_squares(centers, centers))
        ratio = (spread[:, None] + spread[None, :]) / np.maximum(apart, 1e-12)
        np.fill_diagonal(ratio, -np.inf)
        worst = ratio.max(axis=1)
    ch = (between / (k - 1)) / (cost / (n - k)) if k > 1 and n > k and cost > 0 else float("nan")
    return {"k": model.k, "silhouette": total / n, "inertia": cost, "davies_bouldin": float(np.mean(worst)), "calinski_harabasz": ch}


def nearest(x: Column, models: dict[int, np.ndarray], part: Column) -> Column:
    """Number of the nearest centre of the row's part."""

    @F.pandas_udf("int")
    def found(parts: pd.Series, rows: pd.Series) -> pd.Series:
        out = np.zeros(len(rows), np.int32)
        for p in parts.unique():
            own = (parts == p).to_numpy()
            out[own] = _squares(np.stack(rows[own].to_numpy()), models[int(p)]).argmin(axis=1)
        return pd.Series(out)

    return found(part, x)
