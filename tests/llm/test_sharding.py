"""Shards against a plain walk around the ring."""

import random
from collections import Counter

from salestide.llm import sharding


def rows():
    rnd = random.Random(6)
    out = [(i, "copy of one text " * 3 if i % 3 == 0 else "".join(rnd.choice("abé ") for _ in range(rnd.randrange(0, 300))), i) for i in range(6000)]
    return out + [(6001, None, 1), (6002, "", 2), (None, "null key", 3), (None, None, 4), out[7], out[7]]


def test_loads_slots_and_groups(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, shard long")
    got = sharding.dealt(sharding.narrow_rows(docs)).select("row.*", "shard", "slot").collect()
    assert len(got) == len(data)
    loads, counts, by_text = Counter(), Counter(), {}
    for r in got:
        loads[r.shard] += r.size
        counts[r.shard] += 1
        by_text.setdefault(r.text_crc32, set()).add(r.shard)
    mean = sum(loads.values()) / 16
    assert set(loads) == set(range(16)) and max(loads.values()) <= 1.01 * mean and min(loads.values()) >= 0.9 * mean
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    # only the group of a third of all rows is dealt out
    assert sum(len(s) > 1 for s in by_text.values()) == 1
    assert sum(r.size for r in got) == sum(len((t or "").encode()) + 1 for _, t, _ in data)


def test_walk_is_clockwise_and_moves_little():
    rnd = random.Random(2)
    pieces = [(p, -1, rnd.randrange(1, 50)) for p in range(0, sharding.PLACES, 7)]
    now = sharding.walk(pieces, 16)
    at, owners = sharding.ring(16)
    most = (1 + sharding.SLACK) * sum(x[2] for x in pieces) / 16
    loads = [0] * 16
    for place, part, load in sorted(pieces, key=lambda x: (-x[2], x[0], x[1])):
        clockwise = [s for p, s in zip(at, owners) if p >= place] + owners
        want = next((s for s in clockwise if loads[s] + load <= most), None)
        want = min(range(16), key=lambda s: (loads[s], s)) if want is None else want
        assert now[place, part] == want
        loads[want] += load
    grown = sharding.walk(pieces, 17)
    assert sum(grown[k] != now[k] for k in now) / len(now) < 0.35


def test_rows_keep_their_columns(spark):
    docs = spark.createDataFrame(rows()[:50], "doc_id long, text string, shard long")
    got = sharding.shard(docs)
    assert got.columns == ["doc_id", "text", "shard", "shard_", "slot"] and got.count() == 50
    assert sharding.shard(docs.where("doc_id < 0")).count() == 0


def test_rows_that_repeat_id_and_text_are_split(spark):
    rnd = random.Random(7)
    data = [(i, "".join(rnd.choice("ab ") for _ in range(200))) for i in range(2000)] + [(7, "the same row " * 15)] * 1000 + [(None, "no id " * 33)] * 1000
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    for got in (sharding.dealt(sharding.narrow_rows(docs)).select("row.size", "shard", "slot").collect(), sharding.shard(docs).selectExpr("length(text) + 1 size", "shard", "slot").collect()):
        loads = Counter()
        for r in got:
            loads[r.shard] += r["size"]
        mean = sum(loads.values()) / 16
        assert len(got) == len(data) and max(loads.values()) <= 1.01 * mean and min(loads.values()) >= 0.9 * mean
        for s in range(16):
            slots = sorted(r.slot for r in got if r.shard == s)
            assert slots == list(range(len(slots)))
