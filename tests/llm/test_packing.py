"""Packing against the tokenizer itself and a plain best fit."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from salestide.llm import packing, queries_packing, tokens

SCHEMA = "doc_id long, text string, piece string, ids string, sequence_id long"


def texts():
    rnd = random.Random(12)
    words = ["Été", "don't", "<|endoftext|>", "12345", "ab cd", "éx", "\x1c", "\x85", "Σas", "ǅ", "日本語", "x" * 60, "...", "a\tb", "c\r\nd"]
    out = [None, "", " ", "\n\n", "one", "long " * 9000, "<|startoftext|>" * 3, "y" * 30000, "Á ́b"]
    out += [" ".join(rnd.choice(words) + rnd.choice(["", "s", "'ll"]) for _ in range(rnd.randrange(1, 1500))) for _ in range(120)]
    return out + ["copy of one text"] * 60


def plain_ids(text):
    encoder = Tokenizer.from_file(tokens.vocabulary(packing.VOCABULARY))
    encoder.encode_special_tokens = True
    return encoder.encode(text or "", add_special_tokens=False).ids + [1]


def rows():
    out = [(i, t, "x", "y", 3) for i, t in enumerate(texts())]
    return out + [(None, "null key", "x", "y", 3), out[5], out[5]]


def test_pieces_and_sequences(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries_packing.op12_best_fit_packing(spark, str(tmp_path)).collect()
    want = []
    for key, text, *_ in rows():
        ids = plain_ids(text)
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((key, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 4096) + 2


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame(rows()[:40], SCHEMA)
    full = packing.packed(packing.pieces(docs))
    got = {r.sequence_id: r for r in packing.sequences(full).collect()}
    assert sum(r.n_tokens for r in got.values()) == sum(len(plain_ids(t)) for _, t, *_ in rows()[:40])
    for r in full.collect():
        whole = bytes(got[r.sequence_id].ids)
        assert whole[4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)


def plain_bins(sizes, length, most):
    """Open bins in a plain list; the sizes in each bin, as closed and then as left open."""
    open_, closed = [], []
    for size in sizes:
        fitting = [b for b in open_ if sum(b) + size <= length]
        if fitting:
            chosen = max(fitting, key=sum)
        else:
            if len(open_) == most:
                fullest = max(open_, key=sum)
                open_ = [b for b in open_ if b is not fullest]
                closed.append(fullest)
            chosen = []
            open_.append(chosen)
        chosen.append(size)
        if sum(chosen) == length:
            open_ = [b for b in open_ if b is not chosen]
            closed.append(chosen)
    return closed, open_


@pytest.mark.parametrize("most", [1, 4, 50])
def test_best_fit_is_the_plain_one(most):
    rnd = random.Random(most)
    sizes = [rnd.choice([1, 7, 40, 64, rnd.randrange(1, 65)]) for _ in range(600)]
    at, offsets = packing.best_fit(np.array(sizes), 64, most, last=False)
    closed, open_ = plain_bins(sizes, 64, most)
    got = defaultdict(list)
    for i, b in enumerate(at):
        got[b].append(sizes[i])
    # equally full bins may change places, so loads are compared
    assert sorted(sum(x) for b, x in got.items() if b >= 0) == sorted(map(sum, closed))
    assert sum(got.get(-1, [])) == sum(map(sum, open_))


def test_rounds_merge_open_bins(spark):
    rnd = random.Random(5)
    sizes = [rnd.choice([rnd.randrange(1, 200), rnd.randrange(1, 1001)]) for _ in range(8000)]
    sized = spark.createDataFrame(list(enumerate(sizes)), "id long, length long").repartition(3)
    got = packing.assigned(sized, 1000, most=16, rows_per_task=300).collect()
    loads = defaultdict(int)
    for r in got:
        loads[r.sequence_id] += sizes[r.id]
    assert sorted(r.id for r in got) == list(range(8000))
    assert max(loads.values()) <= 1000 and len(loads) <= 1.01 * sum(sizes) / 1000 + 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    full = packing.packed(packing.pieces(docs))
    assert full.count() == 0 and packing.sequences(full).count() == 0
