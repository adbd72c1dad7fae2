"""Batched K-means against plain Lloyd steps and plain scores."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from salestide.functions import kmeans
from salestide.operators import cluster


def blobs(seed=1, n=60):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(c, 0.4, (n, 3)) for c in ([0, 0, 0], [5, 5, 0], [0, 6, 6])])


def frame(spark, x, part=0):
    return spark.createDataFrame([(part, row.tolist()) for row in x], "part int, x array<double>").repartition(5)


def plain_silhouette(x, labels):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    out = []
    for i in range(len(x)):
        own = labels == labels[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == c].mean() for c in set(labels) if c != labels[i])
        out.append((b - a) / max(a, b))
    return np.mean(out)


def test_models_are_at_rest_and_scored(spark):
    x = blobs()
    narrow = frame(spark, x)
    models = kmeans.fit(narrow, [(0, 2), (0, 3), (0, 5)], starts=4)
    assert len(models) == 12 and all(m.done for m in models)
    found = kmeans.best(models)
    for (_, k), m in found.items():
        labels = ((x[:, None, :] - m.centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([x[labels == c].mean(axis=0) for c in range(k)])
        assert np.allclose(moved, m.centers, atol=1e-1)
        (score,) = kmeans.scores(narrow, [m])
        assert score["silhouette"] == pytest.approx(plain_silhouette(x, labels))
        assert score["inertia"] == pytest.approx(((x - m.centers[labels]) ** 2).sum())
    assert found[0, 3].cost < 0.5 * found[0, 2].cost
    # the same seed gives the same centres
    again = kmeans.best(kmeans.fit(narrow, [(0, 3)], starts=4))
    assert np.allclose(again[0, 3].centers, found[0, 3].centers)


def test_parts_have_models_of_their_own(spark):
    one, two = blobs(2), blobs(3) + 100
    both = frame(spark, one).union(frame(spark, two, 1))
    found = kmeans.best(kmeans.fit(both, [(0, 3), (1, 3)], starts=3))
    assert found[0, 3].centers.max() < 50 < found[1, 3].centers.min()
    apart = kmeans.best(kmeans.fit(frame(spark, two, 1), [(1, 3)], starts=3))
    assert np.allclose(np.sort(apart[1, 3].centers, axis=0), np.sort(found[1, 3].centers, axis=0), atol=1e-6)


def test_repeated_rows_and_choice_of_k(spark):
    same = np.ones((30, 2))
    (m,) = kmeans.fit(frame(spark, same), [(0, 3)], starts=1)
    assert m.cost == 0 and (m.centers == 1).all()
    vectors = spark.createDataFrame([(str(i), Vectors.dense(row)) for i, row in enumerate(blobs())], ["client_id", "vector"])
    searched = cluster.search_k(vectors, 2, 6, starts=3)
    assert searched.where("is_best").first()["k"] == 3 and searched.count() == 5
    assigned, scores = cluster.cluster_clients(vectors, low=2, high=5, starts=3)
    sizes = sorted(r["count"] for r in assigned.groupBy("cluster").count().collect())
    assert sizes == [60, 60, 60] and scores.first()["k"] == 3
    with pytest.raises(ValueError):
        cluster.search_k(vectors.limit(2))


def test_one_pass_moves_all_models_as_plain_steps_do(spark):
    rng = np.random.default_rng(5)
    one, two = rng.normal(size=(5000, 3)), rng.normal(size=(700, 3))
    both = frame(spark, one).union(frame(spark, two, 1))
    models = []
    for part, x in ((0, one), (1, two)):
        for k in (4, 2, 3, 2):
            models.append(kmeans.Model(part, k, 0, x[rng.integers(0, len(x), k)].copy()))
    models[2].centers[1] = models[2].centers[0]  # of equally near centres the first takes the row
    packed = kmeans._packed(both, 3)
    assert packed.count() < 30
    for source in (both, packed):
        found = kmeans._summed(source, models, 3, True)
        for i, m in enumerate(models):
            x = one if m.part == 0 else two
            far = ((x[:, None, :] - m.centers[None]) ** 2).sum(axis=2)
            labels = far.argmin(axis=1)
            sizes, sums, cost, distances, squares = found[i]
            own = [labels == c for c in range(m.k)]
            assert sizes.tolist() == [o.sum() for o in own] and cost == pytest.approx(far.min(axis=1).sum())
            assert np.allclose(sums, [x[o].sum(axis=0) for o in own])
            assert np.allclose(distances, [np.sqrt(far[o, c]).sum() for c, o in enumerate(own)], atol=1e-5)
            assert np.allclose(squares, [(x[o] ** 2).sum() for o in own])
