"""Near copies against a plain all-pairs version."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from salestide.llm import simhash
from salestide.llm.components import components


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(keys, fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, k in enumerate(keys):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [least.get(find(i)) for i in range(len(fps))]


def texts():
    rnd = random.Random(5)
    words = ["Alpha", "béta", "gamma", "DELTA", "eps", "zeta", "ÉTA", "theta"]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 400))) for _ in range(60)]
    near = [" ".join(b.split()[:-1] + ["changed"]) for b in base]
    return [None, "", " \t\n", "one", "one two", "A\x0bB\x0cC", *base, *near, *base[:10]]


def test_fingerprint_follows_its_definition():
    for text in texts():
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(str(i % 97) for i in range(1000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_BLOCK", 7)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text)


def test_groups_match_all_pairs(spark):
    rows = [(i if i % 17 else None, t, i) for i, t in enumerate(texts())]
    rows += [rows[20], rows[20], (20, "other text", 1)]
    got = simhash.groups(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    want = sorted((d, f, c) for (d, _, _), f, c in zip(rows, fps, plain_components([r[0] for r in rows], fps)) if d is not None)
    assert sorted((r.doc, r.fp % 2**64, r.component) for r in got if r.doc is not None) == want
    assert len(got) == len(rows)


def test_hot_segments_lose_no_pair(spark):
    rnd = random.Random(1)
    base = rnd.getrandbits(64)
    fps = {base}
    while len(fps) < 400:
        f = rnd.choice([base, base, rnd.getrandbits(32) << 32 | base & 0xFFFFFFFF, base & ~0xFFFFFFFF | rnd.getrandbits(32)])
        for _ in range(rnd.randrange(4)):
            f ^= 1 << rnd.randrange(64)
        fps.add(f)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    got = {(r.a, r.b) for r in simhash.near_pairs(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a > b and ((a ^ b) % 2**64).bit_count() <= 2}
    assert got == want


def test_one_row_per_group(spark):
    rows = [(3, "a b c d", 1), (2, "a b c d", 2), (2, "a b c d", 2), (7, "quite another text here", None), (None, None, 5), (None, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root int")
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.groups(docs).count() == 0
    assert simhash.one_per_group(docs).count() == 0


@pytest.mark.parametrize("chain", [2, 30])
def test_chain_of_links(spark, chain):
    links = spark.range(chain).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {(r.node, r.root) for r in components(links).collect()} == {(i, 0) for i in range(chain + 1)}
