"""Shards from a consistent-hash ring with virtual nodes and bounded loads.

Texts hash to one of 65,536 places on a ring; each shard owns the arcs before
its virtual nodes.  A shard takes no more than ``(1 + SLACK)`` times the mean
bytes: what does not fit continues clockwise to the next shard with room.  As
loads are bounded, shards are near equal in bytes whatever the texts are, and
another shard count moves only what the arcs and the overflow make move.

The walk needs the load of every place, one grouped sum of at most 65,536 rows.
Equal texts share a place and so a shard.  A place too heavy for that, such as a
group of copies that is a third of the table, is dealt to 256 parts by document
id first, and its parts walk on their own.  A part that is too heavy still,
because rows repeat id and text, is dealt to 256 slices by the rows' numbers.
"""

from __future__ import annotations

import bisect
import math

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salestide.llm.common import packed
from salestide.session import durable

SHARDS = 16
VIRTUAL_NODES = 128
SLACK = 0.002
PLACES = 1 << 16
PARTS = 256
#: a place heavier than this share of a shard is dealt to parts
HEAVY = 1 / 16
ROWS_PER_GROUP = 20_000
LAW = "bytes"


def text_size(text: Column) -> Column:
    """Bytes of the text and one more; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def place_of(text: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(PLACES)).cast("int")


def part_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(PARTS)).cast("int")


def ring(shards: int = SHARDS, nodes: int = VIRTUAL_NODES) -> tuple[list[int], list[int]]:
    """Places of the virtual nodes in order and their shards."""
    points = sorted((xxhash.xxh64_intdigest(f"{s}:{v}") % PLACES, s) for s in range(shards) for v in range(nodes))
    return [p for p, _ in points], [s for _, s in points]


def walk(pieces: list[tuple], shards: int = SHARDS, slack: float = SLACK) -> dict[tuple, int]:
    """Shard of every piece (place, part, .., load): the first one clockwise with room for it.

    Heavy pieces go first, so that the light ones fill what is left; a piece
    that fits nowhere goes to the lightest shard.
    """
    at, owners = ring(shards)
    most = (1 + slack) * sum(x[-1] for x in pieces) / shards
    loads = [0] * shards
    found = {}
    for *name, load in sorted(pieces, key=lambda x: (-x[-1], *x[:-1])):
        place = name[0]
        start, shard, tried = bisect.bisect_left(at, place), None, set()
        for step in range(len(owners)):
            s = owners[(start + step) % len(owners)]
            if loads[s] + load <= most:
                shard = s
                break
            tried.add(s)
            if len(tried) == shards:
                break
        if shard is None:
            shard = min(range(shards), key=lambda s: (loads[s], s))
        loads[shard] += load
        found[tuple(name)] = shard
    return found


def _pieces(rows: DataFrame, shards: int) -> tuple[list[tuple[int, int, int, int]], int, DataFrame | None]:
    """All pieces (place, part, slice, load) of the ring, the number of rows, and the rows that are sliced, if any.

    At most 65,536 places, 256 parts of 16 x ``shards`` heavy ones and 256 slices
    of as many heavy parts come to the driver.
    """
    loads = rows.groupBy("place").agg(F.sum("size").alias("load"), F.count(F.lit(1)).alias("n")).collect()
    limit = HEAVY * sum(r.load for r in loads) / shards
    heavy = [r.place for r in loads if r.load > limit]
    pieces = [(r.place, -1, -1, r.load) for r in loads if r.load <= limit]
    sliced = None
    if heavy:
        parts = rows.where(F.col("place").isin(heavy)).groupBy("place", "part").agg(F.sum("size").alias("load"), F.count(F.lit(1)).alias("n")).collect()
        whole = [r for r in parts if r.load <= limit or r.n == 1]
        pieces += [(r.place, r.part, -1, r.load) for r in whole]
        if rest := [(r.place, r.part) for r in parts if r.load > limit and r.n > 1]:
            named = F.broadcast(rows.sparkSession.createDataFrame(rest, "place int, part int"))
            # rows are numbered once, then kept
            sliced = durable(rows.join(named, ["place", "part"], "left_semi").withColumn("slice", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int")))
            pieces += [(r.place, r.part, r.slice, r.load) for r in sliced.groupBy("place", "part", "slice").agg(F.sum("size").alias("load")).collect()]
    return pieces, sum(r.n for r in loads), sliced


def dealt(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``row``, shard, slot from rows of (row, size, place, part, order); slots count from 0 without gaps."""
    pieces, n, sliced = _pieces(rows, shards)
    plan = rows.sparkSession.createDataFrame([(*name, s) for name, s in walk(pieces, shards).items()], "place int, own_part int, own_slice int, shard int")
    # bounded: one row per piece
    whole = F.broadcast(plan.where("own_part < 0").select("place", "shard"))
    split = F.broadcast(plan.where("own_part >= 0 and own_slice < 0").select("place", F.col("own_part").alias("part"), F.col("shard").alias("part_shard")))
    joined = rows.join(whole, "place", "left").join(split, ["place", "part"], "left").withColumn("shard", F.coalesce("shard", "part_shard"))
    sharded = joined.select("row", "shard", "order", F.lit(0).alias("slice"))
    if sliced is not None:
        fine = F.broadcast(plan.where("own_slice >= 0").select("place", F.col("own_part").alias("part"), F.col("own_slice").alias("slice"), "shard"))
        sharded = sharded.where("shard is not null").unionByName(sliced.join(fine, ["place", "part", "slice"]).select("row", "shard", "order", "slice"))
    groups = max(1, math.ceil(n / (shards * ROWS_PER_GROUP)))
    sharded = sharded.select("row", "shard", "order", "slice", F.pmod(F.xxhash64("order", "slice", F.lit(2)), F.lit(groups)).alias("group"))
    counts = sharded.groupBy("shard", "group").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "group", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = Window.partitionBy("shard", "group").orderBy("order", "slice")
    return sharded.withColumn("at", F.row_number().over(own)).join(starts, ["shard", "group"]).select(
        "row", "shard", (F.col("before") + F.col("at") - 1).alias("slot")
    )


def narrow_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows for ``dealt`` that carry (doc_id, size, text_crc32) only, made durable: the texts are read once.

    Null texts count as empty; null keys are dealt like others.  Repeated rows
    have slots of their own.
    """
    body = F.col(text)
    read = docs.select(
        F.struct(F.col(key).alias("doc_id"), text_size(body).alias("size"), F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32")).alias("row"),
        text_size(body).alias("size"), place_of(body).alias("place"), part_of(F.col(key)).alias("part"), F.xxhash64(F.col(key), body).alias("order"),
    )
    return durable(read)


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """The rows of ``docs`` with shard and slot; names that ``docs`` has already get a trailing underscore."""
    body = F.col("row")[text]
    rows = docs.select(packed(docs).alias("row")).select(
        "row", text_size(body).alias("size"), place_of(body).alias("place"), part_of(F.col("row")[key]).alias("part"), F.xxhash64("row").alias("order")
    )
    free = lambda name: name if name not in docs.columns else free(name + "_")
    return dealt(rows, shards).select("row.*", F.col("shard").alias(free("shard")), F.col("slot").alias(free("slot")))
