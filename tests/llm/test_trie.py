"""The conversation trie against a plain one, and its list ranking against a walk."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from salestide.llm import queries_trie, trie
from salestide.session import durable

SCHEMA = "conv_id long, turn long, role string, text string, conv string, at string, key_1 string"


def plain_rebuilt(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [(r, t) for *_, r, t in sorted(x, key=lambda y: y[:2])] for c, x in convs.items()}
    out = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = said.get(c - c % 5, [])[:h] + own[h:]
    return out


def plain_nodes(rebuilt):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(rebuilt.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for n in members:
        if n:
            children[n[:-1]].append(n)
    leaves, saved = defaultdict(int), defaultdict(int)
    for n in members:
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0
    return {
        (
            min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n],
            hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest(),
        )
        for n, m in members.items()
    }


def conversations():
    rnd = random.Random(11)
    rows = []
    for c in range(0, 800):
        if c % 7 == 5:
            continue
        for t in range(rnd.randrange(1, 8)):
            # few different texts, so that paths meet; half of the conversations are one and the same
            text = f"é{t}" if c % 2 else rnd.choice(["a", "bb", "", None])
            rows.append((c, t, "user" if t % 2 == 0 else None, text))
    rows += [(4000, None, None, None), (4000, 3, "user", "x" * 100_000), (None, 1, "user", "nobody's")]
    # one long conversation, repeated rows, and ids far apart
    rows += [(5000, t, "user", f"turn {t}") for t in range(150)]
    rows += [(10**12, 1, "user", "same")] * 3
    return rows


def frame(spark, rows):
    # names of the operator's own columns do no harm
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def answer(spark, tmp_path, rows):
    frame(spark, rows).repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries_trie.op11_conversation_trie(spark, str(tmp_path))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return [tuple(r[c] for c in names) for r in got.collect()]


def test_nodes_match_a_plain_trie(spark, tmp_path, monkeypatch):
    # small blocks, so that fragments meet in several rounds
    monkeypatch.setattr(trie, "CONVERSATION_BITS", 4)
    monkeypatch.setattr(trie, "DEPTH_BITS", 4)
    rows = conversations()
    got = answer(spark, tmp_path, rows)
    want = plain_nodes(plain_rebuilt(rows))
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)], [(3, None, None, None)], [(7, 0, "user", "short")] * 2])
def test_small_tables(spark, tmp_path, rows):
    assert sorted(answer(spark, tmp_path, rows)) == sorted(plain_nodes(plain_rebuilt(rows)))


def test_ranks_do_not_depend_on_what_lies_together(spark, monkeypatch):
    rnd = random.Random(1)
    order = rnd.sample(range(500), 500)
    links = [(a, b, rnd.randrange(40), 0) for a, b in zip(order, order[1:] + [trie.END])]
    got = {r.arc: r.to_end for r in trie.ranks(spark.createDataFrame(links, "arc long, next long, block long, spread long")).collect()}
    assert got == {a: 500 - i for i, a in enumerate(order)}


def test_tour_nests_and_turns_are_carried(spark):
    rows = [r for r in conversations() if r[0] is not None and r[0] < 300]
    nodes = durable(trie.shared(frame(spark, rows)))
    below = nodes.where("depth > 0").collect()
    places = sorted([r.enter for r in below] + [r.exit for r in below])
    assert places == list(range(2 * len(below)))
    said = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in _by_conversation(rows).items()}
    for r in below:
        assert (r.role, r.text) == said[r.conv_id][r.depth - 1]
    # an inner interval lies wholly inside an outer one
    for a, b in zip(sorted(below, key=lambda r: r.enter), sorted(below, key=lambda r: r.enter)[1:]):
        assert b.enter > a.exit or b.exit < a.exit
    assert nodes.where(F.col("depth") == 0).select("enter").first().enter is None


def _by_conversation(rows):
    found = defaultdict(list)
    for c, turn, role, text in rows:
        found[c].append((turn, role or "", text or ""))
    return found
