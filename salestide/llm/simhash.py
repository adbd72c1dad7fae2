"""Near copies by SimHash with multi-index hashing.

A fingerprint has 64 bits over three-word shingles.  Equal fingerprints are
merged first.  Distinct ones are found by multi-index hashing for distance 2
over two 32-bit segments: two fingerprints at distance 2 or less agree in the
low segment, or differ in at most one bit of the high one.  So every
fingerprint looks up its exact low segment and the ball of 33 values around its
high segment, and the full distance of each match is verified.

A segment shared by many fingerprints would give quadratic candidates.  Such a
hot segment is split by the same rule once more: the other segment, on which
distance 2 is left (or 1, after a differing bit), is halved into 16-bit parts,
of which one must agree exactly or within one bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from salestide.llm.common import packed, row_key, rows_without
from salestide.llm.components import components
from salestide.session import durable

SHINGLE = 3
RADIUS = 2
SEED = 42
HOT_SEGMENT = 64
_BLOCK = 1 << 15


def fingerprint(text: str | None) -> int:
    """The SimHash of one text; 0 without words."""
    # on bytes, lower() changes A-Z only and split() parts at the six ASCII white-space bytes
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    count = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, count, _BLOCK):
        part = words[start : start + _BLOCK + SHINGLE - 1]
        shingles = zip(*(part[k:] for k in range(SHINGLE))) if len(words) >= SHINGLE else [part]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, shingles), repeat(SEED)), np.uint64)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > count).astype(np.uint8), bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series(np.fromiter((fingerprint(t) for t in batch), np.uint64, len(batch)).view(np.int64))


def fingerprints(text: Column) -> Column:
    """Fingerprint of a text column as a signed 64-bit number."""
    return _fingerprints(text)


def _ball(part: Column, bits: int) -> Column:
    """A segment's value and all values one bit away."""
    return F.array(part, *[part.bitwiseXOR(F.lit(1 << k).cast("long")) for k in range(bits)])


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _high(fp: Column) -> Column:
    return F.shiftrightunsigned(fp, 32)


def _low(fp: Column) -> Column:
    return fp.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def _keyed(fps: DataFrame, probe: bool) -> DataFrame:
    """Keys (side, key) of every fingerprint; a probe also asks for the ball of its high segment."""
    high = _ball(_high(F.col("fp")), 32) if probe else F.array(_high(F.col("fp")))
    sides = F.array(
        F.struct(F.lit(0).alias("side"), high.alias("keys"), _low(F.col("fp")).alias("rest")),
        F.struct(F.lit(1).alias("side"), F.array(_low(F.col("fp"))).alias("keys"), _high(F.col("fp")).alias("rest")),
    )
    return fps.select("fp", F.explode(sides).alias("s")).select("fp", "s.side", "s.rest", F.explode("s.keys").alias("key"))


def _split(keyed: DataFrame, probe: bool) -> DataFrame:
    """The rest of a hot segment's fingerprints as two 16-bit parts."""
    upper, lower = F.shiftrightunsigned(F.col("rest"), 16), F.col("rest").bitwiseAND(F.lit(0xFFFF).cast("long"))
    parts = F.array(
        F.struct(F.lit(0).alias("half"), (_ball(upper, 16) if probe else F.array(upper)).alias("subs")),
        F.struct(F.lit(1).alias("half"), F.array(lower).alias("subs")),
    )
    return keyed.select("fp", "side", "key", F.explode(parts).alias("h")).select("fp", "side", "key", "h.half", F.explode("h.subs").alias("sub"))


def near_pairs(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints ``fp`` at most two bits apart, a > b."""
    index = _keyed(fps, probe=False)
    hot = durable(index.groupBy("side", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_SEGMENT).drop("n"))
    probes = _keyed(fps, probe=True)
    where = ["side", "key"]
    near = (_distance("a", "b") <= RADIUS) & (F.col("a") > F.col("b"))

    def matched(table: DataFrame, asked: DataFrame, on: list[str]) -> DataFrame:
        one = asked.select(F.col("fp").alias("a"), *on).alias("p")
        two = table.select(F.col("fp").alias("b"), *on).alias("t")
        same = [F.col(f"p.{c}") == F.col(f"t.{c}") for c in on]
        condition = near
        for c in same:
            condition = condition & c
        return one.join(two, condition).select("a", "b")

    # a pair is found from both ends, so one order of the two loses none
    plain = matched(index.join(hot, where, "left_anti"), probes, where)
    if hot.isEmpty():
        return plain.distinct()
    fine = where + ["half", "sub"]
    dense = matched(_split(index.join(hot, where, "left_semi"), False), _split(probes.join(hot, where, "left_semi"), True), fine)
    return plain.union(dense).distinct()


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, row_key, fp, root, component): one row per document.

    ``root`` is the smallest fingerprint that links of two bits or fewer reach,
    ``component`` the smallest key among its documents.  Null and blank texts
    have fingerprint zero, which links like any other.  Null keys name a
    component only where it has no other.  Repeated rows stay, each with the
    same answer.
    """
    read = docs.select(F.col(key).alias("doc"), row_key(docs).alias("row_key"), F.col(text).alias("text"))
    narrow = durable(read.select("doc", "row_key", fingerprints(F.col("text")).alias("fp")))
    distinct = durable(narrow.groupBy("fp").agg(F.min("doc").alias("first")))
    roots = components(near_pairs(distinct.select("fp")))
    members = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = members.groupBy("root").agg(F.min("first").alias("component"))
    answer = members.join(named, "root").select("fp", "root", "component")
    return narrow.join(answer, "fp").select("doc", "row_key", "fp", "root", "component")


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of every group, with the columns of ``docs``."""
    return one_of_each(docs, groups(docs, key, text), key)


def one_of_each(docs: DataFrame, grouped: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row of every root of ``grouped`` (doc, row_key, root): the smallest key (nulls last), then the smallest row
    hash; of equal rows, one."""
    cells = durable(grouped.groupBy("root", "doc", "row_key").agg(F.count(F.lit(1)).alias("equal")))
    order = F.struct(F.col("doc").isNull().alias("late"), "doc", "row_key")
    # a table of its own, so that a join with a hot root can be split
    best = durable(cells.groupBy("root").agg(F.min(order).alias("best")))
    gone = durable(cells.join(best, "root").where(order != F.col("best")).select("doc", "row_key"))
    kept = rows_without(docs, key, row_key(docs), gone)
    repeated = durable(cells.where("equal > 1").join(gone.select(F.col("row_key").alias("gone_key")), F.col("row_key") == F.col("gone_key"), "left_anti").select("doc", "row_key"))
    if repeated.isEmpty():
        return kept
    once = rows_without(kept, key, row_key(kept), repeated)
    rows = kept.select(packed(kept).alias("row"), row_key(kept).alias("own_key"))
    several = rows.join(repeated.select("row_key"), rows["own_key"] == repeated["row_key"], "left_semi").dropDuplicates(["own_key"])
    return once.union(several.select("row.*"))
