"""Alignment of two tokenizers by merge-path partitioning.

Both tokenizers cover the same bytes, so the ends of their tokens are two
sorted lists.  Byte offsets that stand in both cut the tokens into groups.  The
lists of a batch of texts are merged as one: diagonals of the merge, found by
binary search in all at once, cut it into pieces of equal work whatever the
texts are; every piece finds the ends that overlap in it on its own, and a group
that goes on over a piece's border is stitched from its parts.

Tokens of a group are linked, each A with each B.  Links are kept per document
as distinct id pairs with their number; counts of documents per pair join back
to them, pairs that are frequent by a broadcast and rare ones by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from salestide.llm import tokens
from salestide.llm.common import MOST_BROADCAST_KEYS, written
from salestide.session import durable

FIRST = "byte_bpe_50k.json"
#: the same vocabulary as ranks
FIRST_RANKS = "byte_bpe_50k.tiktoken"
SECOND = "piece_bpe_32k.model"
#: merged ends of one piece
WORK = 1 << 16
#: characters that are encoded at once; a token takes some 500 bytes while it is aligned
CHARACTERS = 1 << 17
#: id pairs that are expanded at once
LINKS = 1 << 19
#: a pair that stands in more documents is not joined by a shuffle
LEAST_FREQUENT = 10_000
_PAIR_BITS = 32
_loaded: dict[tuple[str, str, str | None], "Encoders"] = {}


def byte_alphabet() -> dict[str, int]:
    """Byte of every character of byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + n): b for n, b in enumerate(rest)}


def _decimal(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of 0 .. size - 1, left-aligned with room for a separator, and their number."""
    width = len(str(size - 1))
    digits = np.zeros((size, width + 1), np.uint8)
    lengths = np.ones(size, np.int64)
    for n in range(size):
        text = str(n).encode()
        digits[n, : len(text)] = list(text)
        lengths[n] = len(text)
    return digits, lengths


class Encoders:
    """Both tokenizers of a worker and the bytes of their tokens."""

    def __init__(self, first: str, second: str, ranks: str | None):
        import sentencepiece

        self.first = tokens.ByteIds(first, ranks)
        self.a = self.first.encoder
        self.b = sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary(second))
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, n in vocabulary.items():
            # an added token is plain text, not written in the alphabet
            known = all(c in alphabet for c in entry)
            self.a_bytes[n] = bytes(alphabet[c] for c in entry) if known else entry.encode()
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(n) else b"" if self.b.is_control(n) or self.b.is_unknown(n) else p.replace("▁", " ").encode()
            for n, p in enumerate(self.b.id_to_piece(list(range(self.b.get_piece_size()))))
        ]
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        self.digits, self.lengths = _decimal(max(len(self.a_bytes), len(self.b_bytes)))

    def encode(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for every text; none where the joined bytes of one are not a blank and the text."""
        a, b = [[] for _ in texts], [[] for _ in texts]
        full = [i for i, t in enumerate(texts) if t]
        one = self.first.of([" " + texts[i] for i in full])
        two = self.b.encode([texts[i] for i in full], num_threads=1)
        for i, ids, y in zip(full, one, two):
            want = b" " + texts[i].encode()
            if b"".join([self.a_bytes[n] for n in ids]) == want == b"".join([self.b_bytes[n] for n in y]):
                a[i], b[i] = ids, y
        return a, b


def encoders(first: str = FIRST, second: str = SECOND, ranks: str | None = FIRST_RANKS) -> Encoders:
    if (first, second, ranks) not in _loaded:
        _loaded[first, second, ranks] = Encoders(first, second, ranks)
    return _loaded[first, second, ranks]


def diagonals(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) in the sorted ends ``a`` and ``b`` that cut their merge every ``work`` elements; equal ends stay together."""
    whole = len(a) + len(b)
    at = np.minimum(np.arange(0, whole + work, work), whole)
    low, high = np.maximum(at - len(b), 0), np.minimum(at, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        other = at - middle - 1
        open_ = low < high
        # an end of a goes before an equal one of b
        goes = np.zeros(len(at), bool)
        goes[open_] = a[middle[open_]] <= b[other[open_]]
        low = np.where(open_ & goes, middle + 1, low)
        high = np.where(open_ & ~goes, middle, high)
    i, j = low, at - low
    split = (i > 0) & (j < len(b))
    split[split] = a[i[split] - 1] == b[j[split]]
    return i, j + split


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of the ends that stand in both."""
    if not len(a) or not len(b):
        none = np.zeros(0, np.int64)
        return none, none
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    same = np.flatnonzero(b[at] == a)
    return same, at[same]


def cuts(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of tokens of both up to every common end, in order: the ends of the groups.

    Pieces are independent of each other; a group whose end is found in a later
    piece than its start has its tokens in all pieces between.
    """
    i, j = diagonals(a, b, work)
    found = [overlaps(a[i[k] : i[k + 1]], b[j[k] : j[k + 1]]) for k in range(len(i) - 1)]
    ends_a = np.concatenate([x + i[k] for k, (x, _) in enumerate(found)] or [np.zeros(0, np.int64)]) + 1
    ends_b = np.concatenate([y + j[k] for k, (_, y) in enumerate(found)] or [np.zeros(0, np.int64)]) + 1
    return ends_a.astype(np.int64), ends_b.astype(np.int64)


def _spans(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of groups from their ends."""
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if len(ends) else ends
    return starts, ends - starts


def _sums(keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys, numbers = keys[order], numbers[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(numbers, first) if len(first) else numbers


def links(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, owner: np.ndarray, most: int = LINKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, pair, number) of the distinct id pairs linked in groups, by ``owner`` (of the groups, ascending) and pair.

    At most about ``most`` links are expanded at a time; a larger group gives its
    distinct ids times their numbers.
    """
    start_a, size_a = _spans(ends_a)
    start_b, size_b = _spans(ends_b)
    works = size_a * size_b
    owners, pairs, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    width = int(b.max()) + 1 if len(b) else 1
    span = (int(a.max()) + 1 if len(a) else 1) * width

    def keep(keys: np.ndarray, counts: np.ndarray) -> None:
        own, code = np.divmod(keys, span)
        owners.append(own)
        pairs.append(((code // width) << _PAIR_BITS) | code % width)
        numbers.append(counts)

    small = np.flatnonzero(works <= most)
    parts = np.cumsum(works[small]) // most
    for part in np.split(small, np.flatnonzero(np.diff(parts)) + 1) if len(small) else []:
        # link number -> group -> place among its A and B tokens
        group = np.repeat(part, works[part])
        at = np.arange(len(group)) - np.repeat(np.cumsum(works[part]) - works[part], works[part])
        x, y = np.divmod(at, size_b[group])
        keys = owner[group] * span + a[start_a[group] + x] * width + b[start_b[group] + y]
        keep(*_sums(keys, np.ones(len(keys), np.int64)))
    for group in np.flatnonzero(works > most):
        one, n = np.unique(a[start_a[group] : ends_a[group]], return_counts=True)
        two, m = np.unique(b[start_b[group] : ends_b[group]], return_counts=True)
        step = max(1, most // len(two))
        for k in range(0, len(one), step):
            keys = owner[group] * span + (one[k : k + step, None] * width + two[None, :]).ravel()
            keep(keys, (n[k : k + step, None] * m[None, :]).ravel())
    who, pair, number = np.concatenate(owners), np.concatenate(pairs), np.concatenate(numbers)
    # parts share owners only at their borders; large groups stand apart
    order = np.lexsort((pair, who))
    who, pair, number = who[order], pair[order], number[order]
    first = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (pair[1:] != pair[:-1])])) if len(who) else np.zeros(0, np.int64)
    return who[first], pair[first], np.add.reduceat(number, first) if len(first) else number


def written_groups(enc: Encoders, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, owner: np.ndarray, owners: int) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of every owner's groups."""
    n = len(a) + len(b)
    if not n:
        return [""] * owners
    start_a, size_a = _spans(ends_a)
    start_b, size_b = _spans(ends_b)
    # A tokens of a group, then its B tokens
    place_a = np.arange(len(a)) + np.repeat(start_b, size_a)
    place_b = np.arange(len(b)) + np.repeat(ends_a, size_b)
    ids = np.empty(n, np.int64)
    ids[place_a], ids[place_b] = a, b
    after = np.full(n, ord(","), np.uint8)
    after[ends_a + start_b - 1] = ord("|")
    after[ends_a + ends_b - 1] = ord(";")
    rows, sizes = enc.digits[ids], enc.lengths[ids]
    rows[np.arange(n), sizes] = after
    flat = rows[np.arange(rows.shape[1])[None, :] <= sizes[:, None]].tobytes()
    ends = np.cumsum(sizes + 1)[ends_a + ends_b - 1]
    last = np.zeros(owners, np.int64)
    np.maximum.at(last, owner, ends)
    found, before = [], 0
    for end in last.tolist():
        found.append(flat[before : end - 1].decode() if end else "")
        before = max(before, end)
    return found


def align(enc: Encoders, texts: list[str | None], work: int = WORK) -> dict[str, object]:
    """Columns of ``aligned`` for a list of texts."""
    ids_a, ids_b = enc.encode(texts)
    n_a, n_b = [np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b)]
    a, b = [np.fromiter(chain.from_iterable(ids), np.int64, n.sum()) for ids, n in ((ids_a, n_a), (ids_b, n_b))]
    ends_a, ends_b = cuts(np.cumsum(enc.a_sizes[a]), np.cumsum(enc.b_sizes[b]), work)
    # every text ends at a common end, so a group has one owner
    owner = np.searchsorted(np.cumsum(n_a), ends_a, side="left")
    works = _spans(ends_a)[1] * _spans(ends_b)[1]
    who, pair, number = links(a, b, ends_a, ends_b, owner)
    count = len(texts)
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": np.bincount(owner, minlength=count), "n_links": np.bincount(owner, works, count).astype(np.int64),
        "groups": written_groups(enc, a, b, ends_a, ends_b, owner, count),
        "offsets": np.concatenate([[0], np.cumsum(np.bincount(who, minlength=count))]), "pairs": pair, "numbers": number,
    }


def aligned(docs: DataFrame, key: str = "doc_id", text: str = "text", first: str = FIRST, second: str = SECOND, ranks: str | None = FIRST_RANKS) -> DataFrame:
    """(doc, n_a, n_b, n_groups, n_links, groups, pairs, numbers): one row per row of ``docs``.

    ``pairs`` are the distinct linked id pairs, A in the upper 32 bits, and
    ``numbers`` how often each is linked.  Null and empty texts, and texts that
    one of the tokenizers doesn't give back byte by byte, have no tokens: zeros,
    an empty string and no pairs.  Null keys and repeated rows are rows like
    others; other columns are left out.  ``ranks`` names the vocabulary of
    ``first`` as ranks, if there is one.
    """
    read = docs.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("text"))
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    types = StructType([
        StructField("doc", read.schema["doc"].dataType), *[StructField(n, LongType()) for n in numbers], StructField("groups", StringType()),
        StructField("pairs", ArrayType(LongType())), StructField("numbers", ArrayType(LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoders(first, second, ranks)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for x, y in tokens.slices(texts, CHARACTERS):
                found = align(enc, texts[x:y])
                offsets = pa.array(found["offsets"], pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(found[n], pa.int64())) for n in ("pairs", "numbers")]
                plain = [pa.array(found[n], pa.int64()) for n in numbers]
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(x, y - x), *plain, pa.array(found["groups"], pa.string()), *lists], names=types.names)

    return read.mapInArrow(run, types)


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, count, best): documents that hold a pair, and whether it is the most frequent one of its A id (ties are)."""
    counts = durable(linked.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count")))
    first = F.shiftright("pair", _PAIR_BITS)
    most = counts.groupBy(first.alias("first")).agg(F.max("count").alias("most"))
    return durable(counts.join(most, first == most["first"]).select("pair", "count", (F.col("count") == F.col("most")).alias("best")))


def scored(found: DataFrame, most_broadcast: int = MOST_BROADCAST_KEYS, least_frequent: int = LEAST_FREQUENT) -> DataFrame:
    """``found`` (with pairs and numbers, as ``aligned`` gives them) with n_best and count_sum in place of both."""
    # every row gets a number, so the rows are a table first
    rows = written(found.drop("n_best", "count_sum", "_id").withColumn("_id", F.monotonically_increasing_id()))
    counts = pair_counts(rows)
    single = rows.select("_id", F.explode(F.arrays_zip("pairs", "numbers")).alias("x")).select("_id", F.col("x.pairs").alias("pair"), F.col("x.numbers").alias("number"))
    if counts.count() <= most_broadcast:
        met = single.join(F.broadcast(counts), "pair")
    else:
        total = counts.agg(F.sum("count").alias("n")).first().n
        # at most total / limit pairs are above the limit
        limit = max(least_frequent, total // most_broadcast)
        often, rare = counts.where(F.col("count") > limit), counts.where(F.col("count") <= limit)
        looked = durable(single.join(F.broadcast(often), "pair", "left"))
        met = looked.where("count is not null").unionByName(looked.where("count is null").drop("count", "best").join(rare, "pair"))
    sums = met.groupBy("_id").agg(
        F.sum(F.when(F.col("best"), F.col("number")).otherwise(0)).alias("n_best"), F.sum(F.col("number") * F.col("count")).alias("count_sum")
    )
    zero = F.lit(0).cast("long")
    return rows.drop("pairs", "numbers").join(sums, "_id", "left").withColumns({c: F.coalesce(c, zero) for c in ("n_best", "count_sum")}).drop("_id")
