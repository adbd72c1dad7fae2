"""Approximate nearest neighbours: hierarchical k-means with best-bin-first search.

A k-means tree is fitted on a bounded sample; every vector descends it to its
leaf.  A query walks the tree with a priority queue: of all open nodes the one
whose centre has the largest inner product is opened next, and leaves are
visited in that order.  How many leaves a query visits is calibrated: for a
bounded set of queries the exact neighbours are found by brute force, and the
visits are widened until the mean recall reaches ``RECALL``.

Leaves meet their queries in Spark, by (leaf, chunk of rows, chunk of queries),
so neither a leaf with a third of all rows nor one that all queries visit makes
a large group.  Every group returns its best few, a window per query the rest.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salestide.session import durable, spread

NEIGHBOURS = 20
SAMPLE_ROWS = 20_000
SAMPLE_VALUES = 4_000_000
BRANCHES = 8
LEAVES = 64
ROUNDS = 8
RECALL = 0.95
CALIBRATION_QUERIES = 200
CHUNK_ROWS = 4096
CHUNK_QUERIES = 256
#: share of |q| |p| per component that a matrix product may be off; far wider than its rounding
ROUNDING = 1e-15
SEED = 5


def usable(vector: Column) -> Column:
    """Neither null nor zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _split(points: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Centres and nearest centre of every point; fewer than ``k`` where points coincide."""
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(ROUNDS):
        centres = np.unique(centres, axis=0)
        near = nearest(points, centres)
        used = np.unique(near)
        centres = np.stack([points[near == c].mean(axis=0) for c in used])
    return centres, nearest(points, centres)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * points @ centres.T, axis=1)


class Tree:
    """``children[node]`` are the node's children (none: a leaf), ``centres[node]`` its centre; node 0 is the root."""

    def __init__(self, sample: np.ndarray, leaf_sample: int) -> None:
        self.centres, self.children = [sample.mean(axis=0)], [[]]
        rng = np.random.default_rng(SEED)
        open_nodes = [(0, sample)]
        while open_nodes:
            node, points = open_nodes.pop()
            if len(points) <= leaf_sample:
                continue
            k = max(2, min(BRANCHES, math.ceil(len(points) / leaf_sample)))
            centres, near = _split(points, k, rng)
            if len(centres) < 2:
                continue
            for c, centre in enumerate(centres):
                self.children[node].append(len(self.centres))
                self.centres.append(centre)
                self.children.append([])
                open_nodes.append((len(self.centres) - 1, points[near == c]))

    @property
    def leaves(self) -> list[int]:
        return [n for n, c in enumerate(self.children) if not c]

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64)
        open_nodes = [(0, np.arange(len(points)))]
        while open_nodes:
            node, rows = open_nodes.pop()
            kids = self.children[node]
            if not kids or not len(rows):
                at[rows] = node
                continue
            near = nearest(points[rows], np.stack([self.centres[c] for c in kids]))
            open_nodes += [(c, rows[near == k]) for k, c in enumerate(kids)]
        return at

    def visits(self, query: np.ndarray, sizes: dict[int, int], leaves: int, least_rows: int) -> Iterator[int]:
        """Leaves in best-bin-first order: ``leaves`` of them, more until they hold ``least_rows`` rows."""
        queue = [(0.0, 0)]
        seen = rows = 0
        while queue and (seen < leaves or rows < least_rows):
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if kids:
                for c in kids:
                    heapq.heappush(queue, (-float(query @ self.centres[c]), c))
            elif sizes.get(node):
                seen, rows = seen + 1, rows + sizes[node]
                yield node


def best(query_ids, queries: np.ndarray, ids, points: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` best points for every query but itself, ties to the smaller id.

    A matrix product with a bound of its rounding finds the candidates; their
    scores are summed again from the first component to the last, so that every
    pair is summed alike.  Products out of range are candidates always; sums
    may be infinite, and one that is no number comes last.
    """
    ids, query_ids = np.asarray(ids), np.asarray(query_ids)
    other = query_ids[:, None] != ids[None, :]
    with np.errstate(all="ignore"):
        table = queries @ points.T
        if len(ids) > k:
            sizes = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(points, axis=1)[None, :]
            off = ROUNDING * queries.shape[1] * sizes
            known = np.isfinite(table) & np.isfinite(off)
            least = np.where(known & other, table - off, -np.inf)
            line = np.partition(least, len(ids) - k, axis=1)[:, len(ids) - k]
            other &= ~known | (table + off >= line[:, None])
        at, place = np.nonzero(other)
        score = np.zeros(len(at))
        for d in range(queries.shape[1]):
            score += queries[at, d] * points[place, d]
    order = np.lexsort((ids[place], np.where(np.isnan(score), np.inf, -score), at))
    at, place, score = at[order], place[order], score[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    keep = rank < k
    return pd.DataFrame({"query_id": query_ids[at[keep]], "vec_id": ids[place[keep]], "score": score[keep], "place": place[keep]})


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), np.float64)


def prepared(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vec) of the rows that take part: with an id and a usable vector; shorter ones end in zeros."""
    rows = vectors.where(F.col(key).isNotNull() & usable(F.col(vector))).select(
        F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec")
    )
    most = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    zeros = F.array_repeat(F.lit(0.0), F.lit(most) - F.size("vec"))
    return rows.select("vec_id", F.when(F.size("vec") < most, F.concat("vec", zeros)).otherwise(F.col("vec")).alias("vec"))


def index(rows: DataFrame) -> tuple[DataFrame, Tree | None, dict[int, int]]:
    """(vec_id, vec, leaf) of every row, the tree, and the rows of every leaf."""
    n = rows.count()
    if n == 0:
        return rows.withColumn("leaf", F.lit(0).cast("long")), None, {}
    dimension = len(rows.select("vec").first().vec)
    wanted = min(SAMPLE_ROWS, max(1, SAMPLE_VALUES // dimension))
    place = F.xxhash64("vec_id", "vec", F.lit(SEED))
    # of small tables all rows; rows that repeat don't make the sample larger
    near = rows if n <= 2 * wanted else rows.where(F.pmod(place, F.lit(1_000_000)) < int(2 * wanted / n * 1_000_000))
    sample = rows if n <= wanted else near.orderBy(place, "vec_id").limit(wanted)
    points = _stacked(sample.orderBy("vec_id", "vec").toPandas()["vec"])
    # too few sampled rows for a leaf would make its centre noise
    tree = Tree(points, max(8, len(points) // LEAVES))

    def place_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(leaf=tree.leaf_of(_stacked(batch["vec"])) if len(batch) else [])

    indexed = durable(rows.mapInPandas(place_rows, "vec_id long, vec array<double>, leaf long"))
    # one row per leaf
    return indexed, tree, {r.leaf: r.n for r in indexed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}


def _exact(indexed: DataFrame, query_ids: list[int], queries: np.ndarray, k: int) -> pd.DataFrame:
    """Exact neighbours of a bounded set of queries, with their leaves."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), CHUNK_ROWS):
                part = batch.iloc[at : at + CHUNK_ROWS]
                found = best(query_ids, queries, part["vec_id"], _stacked(part["vec"]), k)
                yield found.assign(leaf=part["leaf"].to_numpy()[found["place"]])[["query_id", "vec_id", "score", "leaf"]]

    found = indexed.mapInPandas(scan, "query_id long, vec_id long, score double, leaf long")
    return _first(found, k).toPandas()


def _first(found: DataFrame, k: int) -> DataFrame:
    lost = F.isnan("score")
    order = Window.partitionBy("query_id").orderBy(lost, F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def calibrated(indexed: DataFrame, tree: Tree, sizes: dict[int, int], queries: DataFrame, k: int, recall: float = RECALL) -> int:
    """The number of leaves to visit for the wanted mean recall on a bounded set of queries."""
    sample = queries.orderBy(F.xxhash64("query_id", F.lit(SEED)), "query_id").limit(CALIBRATION_QUERIES).toPandas()
    if not len(sample):
        return 1
    vectors = _stacked(sample["vec"])
    exact = _exact(indexed, sample["query_id"].tolist(), vectors, k)
    if not len(exact):
        return 1
    orders = {q: {leaf: at for at, leaf in enumerate(tree.visits(v, sizes, len(sizes), 0), 1)} for q, v in zip(sample["query_id"], vectors)}
    needed = np.array([orders[q][leaf] for q, leaf in zip(exact["query_id"], exact["leaf"])])
    visited = 1
    while (needed <= visited).mean() < recall:
        visited += 1
    return visited


def search(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS,
           recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every query row, by largest inner product.

    Rows without an id or with a null, zero or non-finite vector take no part;
    a shorter vector is read with zeros behind it.  A query never finds rows of
    its own id; rows that repeat an id are one query, of their smallest vector,
    and stay several candidates.  Ties go to the smaller id.
    """
    rows = prepared(vectors, key, vector)
    schema = "query_id long, rank int, vec_id long, score double"
    indexed, tree, sizes = index(rows)
    if tree is None:
        return rows.sparkSession.createDataFrame([], schema)
    asked = durable(indexed.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vec").alias("vec")))
    width = calibrated(indexed, tree, sizes, asked, k, recall)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q, v in zip(batch["query_id"], batch["vec"]):
                found = list(tree.visits(np.array(v, np.float64), sizes, width, k + 1))
                yield pd.DataFrame({"query_id": q, "leaf": found})

    visits = durable(spread(asked, "query_id").mapInPandas(walk, "query_id long, leaf long"))
    # one row per leaf
    loads = visits.groupBy("leaf").agg(F.count(F.lit(1)).alias("asked")).collect()
    chunks = rows.sparkSession.createDataFrame(
        [(r.leaf, math.ceil(sizes[r.leaf] / CHUNK_ROWS), math.ceil(r.asked / CHUNK_QUERIES)) for r in loads], "leaf long, row_chunks int, query_chunks int"
    )
    chunks = F.broadcast(chunks)
    own = lambda column, n: F.pmod(F.xxhash64(column, F.lit(SEED)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = indexed.join(chunks, "leaf").select("leaf", own("vec_id", "row_chunks").alias("a"), every("query_chunks").alias("b"), "vec_id", "vec")
    right = visits.join(asked, "query_id").join(chunks, "leaf").select("leaf", every("row_chunks").alias("a"), own("query_id", "query_chunks").alias("b"), "query_id", "vec")

    def meet(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        return best(queries["query_id"], _stacked(queries["vec"]), points["vec_id"], _stacked(points["vec"]), k)[["query_id", "vec_id", "score"]]

    by = ["leaf", "a", "b"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(meet, "query_id long, vec_id long, score double")
    return _first(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
