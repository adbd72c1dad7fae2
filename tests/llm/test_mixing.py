"""Mixing against a plain version, and its SQL on the test data."""

import math
import random
from collections import Counter

import pytest

from salestide.llm import mixing
from salestide.llm.queries import ORACLES, QUERIES
from tests.check_oracles import compare, oracle_connection

FOLDER = "/root/testdata/sf0.001"


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Targets by resharing the excess until none is above its bound."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / free for s in order}
        above = {s for s in order if s not in full and target[s] > most * sizes[s]}
        if not above:
            return target
        full |= above


def rows():
    rnd = random.Random(4)
    out = []
    for i in range(3000):
        source = rnd.choice(["hot"] * 10 + ["a", "b", "é", None, "tiny"] if i % 40 else ["empty"])
        if source == "tiny" and i % 7:
            source = "hot"
        out.append((i, None if source == "empty" else " ".join(["w"] * rnd.randrange(0, 200)), source, rnd.random()))
    return out + [out[5], out[5], (None, "x y", "a", None), (None, None, None, None)]


def test_targets_and_taken_words(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, size double")
    got = mixing.planned(docs).collect()
    assert len(got) == len(data)
    sizes = Counter()
    for _, t, s, _ in data:
        sizes[s] += len((t or "").split())
    target = plain_targets(sizes)
    taken = Counter()
    for r in got:
        assert r.size == len((r.row.text or "").split()) and r.source_size == sizes[r.row.source]
        assert math.isclose(r.target, target[r.row.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.copies <= 3
        taken[r.row.source] += r.copies * r.size
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(600, 0.02 * target[s])
    again = mixing.planned(docs.repartition(5)).collect()
    assert sorted((str(r.row), r.copies) for r in got) == sorted((str(r.row), r.copies) for r in again)


def test_mixture_has_its_copies(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string, size double")
    plan = Counter({r.row.doc_id: 0 for r in mixing.planned(docs).collect()})
    for r in mixing.planned(docs).collect():
        plan[r.row.doc_id] += r.copies
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == +plan


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


@pytest.mark.parametrize("name", ["op8_source_mixing", "op9_decontamination", "op6_repeated_passages"])
def test_query_matches_sql(spark, name):
    result = compare(QUERIES[name](spark, FOLDER), oracle_connection(FOLDER), ORACLES[name])
    assert result is None, result
