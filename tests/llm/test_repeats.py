"""Repeated passages against a plain count of all windows."""

import random
from collections import Counter

import numpy as np
import pytest

from salestide.llm import repeats

LENGTH = 40


def plain(texts, length=LENGTH):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        cover = np.zeros(len(d), bool)
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                cover[p : p + length] = True
        out.append(bytes(np.frombuffer(d, np.uint8)[~cover]))
    return out


def texts():
    rnd = random.Random(8)

    def word():
        return "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 6)))

    passage = [" ".join(word() for _ in range(30)) for _ in range(4)]
    out = [None, "", "short", "x" * 200, "ab" * 60, "ab" * 60 + "c", "y" * (LENGTH + 1)]
    for i in range(60):
        parts = [" ".join(word() for _ in range(rnd.randrange(0, 40)))]
        for _ in range(rnd.randrange(0, 3)):
            p = rnd.choice(passage)
            cut = rnd.randrange(0, 30)
            parts += [p[cut : len(p) - rnd.randrange(0, 30)], word()]
        out.append(" ".join(parts))
    return out + [out[9], out[9], out[12][:-1] + "z", out[3]]


def test_matches_plain_windows(spark):
    rows = [(i if i % 11 else None, t, b"kept") for i, t in enumerate(texts())]
    rows += [rows[20], rows[20]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept binary")
    got = repeats.without_repeats(docs, length=LENGTH).collect()
    want = Counter(zip([r[1] for r in rows], plain([r[1] for r in rows])))
    assert Counter((r.row.text, bytes(r.kept)) for r in got) == want
    assert all(r.n_bytes == len((r.row.text or "").encode()) for r in got)
    assert all(r.n_bytes - sum(s.stop - s.start for s in r.spans) == len(r.kept) for r in got)


@pytest.mark.parametrize("length", [1, 2, 3, 7, 8, 13])
def test_names_are_equal_for_equal_bytes(length):
    data = np.frombuffer(bytes(random.Random(1).choices(b"ab", k=300)), np.uint8)
    names = repeats.names(data, length)
    by_bytes = {}
    for p, name in enumerate(names.tolist()):
        by_bytes.setdefault(data[p : p + length].tobytes(), set()).add(name)
    assert all(len(v) == 1 for v in by_bytes.values())
    assert len({n for v in by_bytes.values() for n in v}) == len(by_bytes)


def test_empty_table(spark):
    assert repeats.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_passages_of_over_fifty_words(spark):
    rnd = random.Random(3)

    def words(n, size):
        return " ".join("".join(rnd.choice("abcdefghij") for _ in range(size)) for _ in range(n))

    long, short = words(60, 7), words(55, 4)
    assert len(long) > 400 > len(short)
    rows = [(f"a{i}", f"{words(40, 5)} {long} {words(40, 5)}") for i in range(3)] + [(f"b{i}", f"{words(40, 5)} {short} {words(40, 5)}") for i in range(3)]
    rows += [(f"c{i}", words(200, 5)) for i in range(3)] + [(None, "no id"), ("a0", rows[0][1])]
    got = repeats.without_repeats(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    cut = {}
    for r in got:
        cut.setdefault(r.row.doc_id, []).append(r.n_bytes - len(r.kept))
    # 400 equal bytes decide, however many words they are; ids need not be numbers
    assert all(min(cut[f"a{i}"]) >= len(long) for i in range(3)) and cut["a0"] == [len(rows[0][1])] * 2
    assert all(cut[f"{k}{i}"] == [0] for k in "bc" for i in range(3)) and cut[None] == [0]
