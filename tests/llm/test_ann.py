"""Nearest neighbours: recall against brute force, exact scores, odd vectors."""

import numpy as np
from pyspark.sql import functions as F

from salestide.llm import ann


def dot(a, b):
    # sum() corrects its rounding; plain double precision does not
    total = 0.0
    for x, y in zip(a.tolist(), b.tolist()):
        total += x * y
    return total


def test_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16)) * rng.uniform(0.5, 2, size=(3000, 1))
    x[1000:2000] = x[1000]  # a third of the rows are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(3020, None), (3040, [0.0] * 16), (3060, [float("nan")] * 16), (3080, [float("inf")] + [1.0] * 15), (3100, [None] + [1.0] * 15), (3121, [1e-9] * 3),
           (None, [1.0] * 16)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(range(0, 3000, 20))
    hit = 0
    for q, found in got.items():
        found.sort(key=lambda r: r["rank"])
        exact = sorted((-dot(x[q], x[j]), j) for j in range(3000) if j != q)[:20]
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        for r in found:
            assert r.score == dot(x[q], x[r.vec_id])
        hit += len({j for _, j in exact} & {r.vec_id for r in found})
    assert hit / (20 * len(got)) >= 0.9


def test_few_rows_give_all_candidates(spark):
    rows = [(i, [1.0, i + 1.0]) for i in range(0, 12)] + [(5, [1.0, 6.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [11, 10, 9, 8, 7, 6, 5, 5, 4, 3, 2, 1]


def test_empty_and_unusable_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert ann.search(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(spark.createDataFrame([(0, None), (20, [0.0])], schema), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(spark.createDataFrame([(0, [1.0])], schema), F.col("vec_id") % 20 == 0).count() == 0


def sequential(queries, points, k, own):
    """Top k by sums from the first component on, no number last."""
    out = {}
    with np.errstate(all="ignore"):
        for i, q in enumerate(queries):
            scores = [(dot(q, p), j) for j, p in enumerate(points) if j != own[i]]
            out[i] = [j for s, j in sorted(scores, key=lambda x: (x[0] != x[0], -x[0] if x[0] == x[0] else 0, x[1]))[:k]]
    return out


def test_cancelling_and_infinite_products():
    rng = np.random.default_rng(4)
    for trial in range(30):
        points = rng.normal(size=(200, 16)) * 1e8
        points[:, 8:] = -points[:, :8] + rng.normal(size=(200, 8)) * 1e-6
        queries = np.hstack([np.ones((3, 8)) * 1e8, np.ones((3, 8)) * 1e8])
        got = ann.best([0, 1, 2], queries, np.arange(200), points, 20)
        want = sequential(queries, points, 20, [0, 1, 2])
        assert {q: found["vec_id"].tolist() for q, found in got.groupby("query_id")} == want
    huge = np.array([[1e200, 1.0], [1e200, 2.0], [-1e200, 1.0], [1.0, 1.0]])
    got = ann.best([0], huge[:1], np.arange(4), huge, 3)
    assert got["vec_id"].tolist() == [1, 3, 2] and got["score"].tolist() == [float("inf"), 1e200, -float("inf")]
    mixed = np.array([[1e200, -1e200], [1e200, 1e200], [1.0, 1.0]])
    assert ann.best([0], mixed[:1], np.arange(3), mixed, 3)["vec_id"].tolist() == [2, 1]


def test_shorter_vectors_and_clashing_columns(spark):
    rows = [(0, [1.0, 2.0, 3.0], 1.0), (1, [5.0], 2.0), (2, [1.0, 1.0, 1.0], 3.0), (3, [0.0, 9.0], 4.0)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double").withColumn("leaf", F.lit("x")), F.col("vec_id") == 0).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(3, 18.0), (2, 6.0), (1, 5.0)]
