"""Prefix trie of conversations by the Euler-tour technique.

A node is a distinct sequence of first turns; its key is 128 bits, the XOR of
the hashes of (position, role, text), so that a prefix's key is a running XOR
and needs no walk.  Every node but the root has two arcs, in and out of it.  An
arc knows the one that follows it from the first child, the next sibling or the
parent, so that all arcs form one list.  The list is ranked in two steps: tasks
join the arcs of neighbouring conversations to fragments, and pointer jumping
ranks the fragments, one join a round.  What a subtree holds is then the
difference of two prefix sums, at the arcs out of and into its top.

Siblings stand in the order of their smallest member.  A conversation with a
third of all turns, a first turn that a third of the conversations share, and a
root with as many children as there are conversations are all split over ranges
of a sort.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salestide.llm import scans
from salestide.llm.common import MOST_BROADCAST_KEYS
from salestide.session import durable

#: neighbouring conversations and depths whose arcs are joined in one task
CONVERSATION_BITS = 10
DEPTH_BITS = 12
#: ends of one node are joined to texts of at most so many ids
END_BITS = 9
#: what follows the last arc
END = -1


def turn_keys(role: Column, text: Column) -> list[Column]:
    """Two 64-bit hashes of one turn; null and empty are the same."""
    both = [F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))]
    return [F.xxhash64(*both), F.xxhash64(F.lit(1), *both)]


def placed(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, at, key_1, key_2, bytes): a row per turn with its place from 1 in its conversation.

    Null turns come first; rows of one turn stand in the order of their hashes,
    and rows that repeat are turns of their own.  Rows without a conversation's
    id take no part.
    """
    key_1, key_2 = turn_keys(F.col(role), F.col(text))
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), key_1.alias("key_1"), key_2.alias("key_2"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), F.lit(1).cast("long").alias("one"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("key_1"), F.col("key_2")]
    return scans.running(rows, "conv", order, {"at": ("one", "sum")}).select("conv", "at", "key_1", "key_2", "bytes")


def regrafted(turns: DataFrame, family: int = 5, shares: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns come from the first one of their family: (conv, length), and turns as ``placed``.

    Conversation c takes the first h turns of conversation c - c % family (all
    it has, if fewer), h = crc32(decimal c) % shares, then its own turns after
    its first h.  At most ``shares`` - 1 turns of a conversation are copied, to
    at most 2 x ``family`` - 1 others.
    """
    lengths = durable(turns.groupBy("conv").agg(F.max("at").alias("own")))
    heads = lengths.withColumn("share", (F.crc32(F.col("conv").cast("string").cast("binary")) % shares).cast("long")).withColumn("base", F.col("conv") - F.col("conv") % family)
    base = lengths.select(F.col("conv").alias("base"), F.least("own", F.lit(shares - 1)).alias("base_own"))
    known = durable(heads.join(base, "base", "left").select(
        "conv", "base", "share", F.least("share", F.coalesce("base_own", F.lit(0))).alias("taken"), F.greatest(F.col("own") - F.col("share"), F.lit(0)).alias("rest")
    ))
    first = turns.where(F.col("at") < shares).withColumnRenamed("conv", "base")
    copied = known.where("taken > 0").join(first, "base").where("at <= taken").select("conv", "at", "key_1", "key_2", "bytes")
    # the share follows from the id alone; what was taken is joined only where it may differ from the share
    less = known.where("taken < share and rest > 0").select("conv", (F.col("share") - F.col("taken")).alias("less"))
    share = (F.crc32(F.col("conv").cast("string").cast("binary")) % shares).cast("long")
    own = turns.where(F.col("at") > share).join(less, "conv", "left").select("conv", (F.col("at") - F.coalesce("less", F.lit(0))).alias("at"), "key_1", "key_2", "bytes")
    return known.select("conv", (F.col("taken") + F.col("rest")).alias("length")), copied.union(own)


def _paths(lengths: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv, depth, key_1, key_2, up_1, up_2, bytes): every conversation's nodes, the root among them."""
    salted = turns.select("conv", F.col("at").alias("depth"), "bytes", *[F.xxhash64("at", f"key_{k}").alias(f"turn_{k}") for k in (1, 2)])
    keyed = scans.running(salted, "conv", [F.col("depth")], {f"key_{k}": (f"turn_{k}", "xor") for k in (1, 2)})
    below = keyed.select("conv", "depth", "key_1", "key_2", *[F.col(f"key_{k}").bitwiseXOR(F.col(f"turn_{k}")).alias(f"up_{k}") for k in (1, 2)], "bytes")
    zero = F.lit(0).cast("long")
    root = lengths.select("conv", zero.alias("depth"), zero, zero, zero, zero, zero)
    return below.union(root)


def _digests(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (key_1, key_2, band, ids) sorted by node and band to (key_1, key_2, ends_sha256); a node may go on in the next batch."""
    node, state = None, None
    for part in parts:
        found = []
        for k1, k2, ids in zip(part.key_1.to_numpy(), part.key_2.to_numpy(), part.ids):
            if (k1, k2) == node:
                state.update(b"," + ids.encode())
                continue
            if node is not None:
                found.append((*node, state.hexdigest()))
            node, state = (k1, k2), hashlib.sha256(ids.encode())
        yield pd.DataFrame(found, columns=["key_1", "key_2", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(*node, state.hexdigest())], columns=["key_1", "key_2", "ends_sha256"])


def _ends(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """(key_1, key_2, ends_sha256) of the nodes where a conversation ends."""
    last = paths.join(lengths.withColumnRenamed("length", "depth"), ["conv", "depth"])
    # a band holds different ids of one range, so its text is bounded; only these texts meet in a node's task
    bands = last.groupBy("key_1", "key_2", F.shiftright("conv", END_BITS).alias("band")).agg(F.array_join(F.array_sort(F.collect_list("conv")), ",").alias("ids"))
    whole = bands.repartition("key_1", "key_2").sortWithinPartitions("key_1", "key_2", "band")
    return whole.mapInPandas(_digests, "key_1 long, key_2 long, ends_sha256 string")


def _numbered(nodes: DataFrame) -> DataFrame:
    """Nodes with ``number`` (1, 2, ... in the order of parent and smallest member, so siblings are neighbours; root 0),
    ``n_children``, ``child`` (the first one's number), ``parent`` and ``parent_conv`` and ``last`` (no sibling follows)."""
    below = scans.ranged(nodes.where("depth > 0"), [F.col("up_1"), F.col("up_2"), F.col("conv_id")])
    below = durable(scans.numbered(below, "place").select("*", (F.col("place") + 1).alias("number")).drop("_part", "_at", "place"))
    root = nodes.where("depth = 0").select("*", F.lit(0).cast("long").alias("number"))
    every = below.unionByName(root)
    children = below.groupBy(F.col("up_1").alias("key_1"), F.col("up_2").alias("key_2")).agg(F.min("number").alias("child"), F.count(F.lit(1)).alias("n_children"))
    known = durable(every.join(children, ["key_1", "key_2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    ups = durable(known.where("n_children > 0").select(
        F.col("key_1").alias("up_1"), F.col("key_2").alias("up_2"), F.col("number").alias("parent"), F.col("conv_id").alias("parent_conv"),
        (F.col("child") + F.col("n_children") - 1).alias("last_child"),
    ))
    # both sides are tables of their own, so that a parent with very many children can be split
    side = F.broadcast(ups) if ups.count() <= MOST_BROADCAST_KEYS else ups
    met = known.where("depth > 0").join(side, ["up_1", "up_2"]).withColumn("last", F.col("number") == F.col("last_child")).drop("last_child")
    null = F.lit(None).cast("long")
    return durable(met.unionByName(known.where("depth = 0").withColumns({"parent": null, "parent_conv": null, "last": F.lit(True)})))


def arcs(tree: DataFrame) -> DataFrame:
    """(arc, next, block, spread) of ``_numbered`` nodes: 2 x number leads into a node, 2 x number + 1 out of it."""
    into = F.struct(
        (F.col("number") * 2).alias("arc"),
        F.when(F.col("n_children") > 0, F.col("child") * 2).otherwise(F.col("number") * 2 + 1).alias("next"),
    )
    out = F.struct(
        (F.col("number") * 2 + 1).alias("arc"),
        F.when(~F.col("last"), F.col("number") * 2 + 2).when(F.col("parent") > 0, F.col("parent") * 2 + 1).otherwise(F.lit(END)).alias("next"),
    )
    return tree.where("number > 0").select(
        F.shiftright("conv_id", CONVERSATION_BITS).alias("block"), F.shiftright("depth", DEPTH_BITS).alias("spread"), F.explode(F.array(into, out)).alias("x")
    ).select("x.arc", "x.next", "block", "spread")


def _fragments(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All rows (arc, next) of a task to (arc, next, steps, head): ``next`` is the first arc of the list beyond the task, ``steps``
    away; ``head`` tells that no row of the task leads to the arc."""
    read = list(parts)
    if not read:
        return
    whole = pd.concat(read)
    ids = whole.arc.to_numpy(np.int64)
    order = np.argsort(ids)
    ids, nexts = ids[order], whole.next.to_numpy(np.int64)[order]
    at = np.minimum(np.searchsorted(ids, nexts), len(ids) - 1)
    own = np.arange(len(ids))
    here = ids[at] == nexts
    head = np.ones(len(ids), bool)
    head[at[here]] = False
    tail, steps = np.where(here, at, own), here.astype(np.int64)
    while True:
        further = tail[tail]
        if (further == tail).all():
            break
        steps, tail = steps + steps[tail], further
    yield pd.DataFrame({"arc": ids, "next": nexts[tail], "steps": steps + 1, "head": head})


def ranks(listed: DataFrame) -> DataFrame:
    """(arc, to_end): arcs from each one to the end of the list, itself included, of ``listed`` (arc, next, block, spread).

    Arcs of one (block, spread) are joined first.  Their number of rows is
    bounded by the ids of a block and the depths of a spread; a wrong guess of
    what lies together costs rounds, not correctness.
    """
    joined = durable(listed.repartition("block", "spread").select("arc", "next").mapInPandas(_fragments, "arc long, next long, steps long, head boolean"))
    now = durable(joined.where("head").select("arc", "next", "steps"))
    while not now.where("next >= 0").isEmpty():
        done, open_ = now.where("next < 0"), now.where("next >= 0")
        ahead = now.select(F.col("arc").alias("next"), F.col("next").alias("beyond"), F.col("steps").alias("more"))
        jumped = open_.join(ahead, "next").select("arc", F.col("beyond").alias("next"), (F.col("steps") + F.col("more")).alias("steps"))
        now = durable(done.unionByName(jumped))
    ahead = now.select(F.col("arc").alias("next"), F.col("steps").alias("more"))
    side = F.broadcast(ahead) if ahead.count() <= MOST_BROADCAST_KEYS else ahead
    return joined.join(side, "next", "left").select("arc", (F.col("steps") + F.coalesce("more", F.lit(0))).alias("to_end"))


def trie(lengths: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node of the conversations ``lengths`` (conv, length) with ``turns`` (conv, at, key_1, key_2, bytes).

    conv_id (smallest member), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves, saved (bytes of the subtree's last turns times
    members less one), ends_sha256 (of the ids that end here, ascending),
    enter and exit (places of the node's arcs in the tour, null for the root),
    key_1 and key_2.  No conversations, no nodes.
    """
    paths = durable(_paths(lengths, turns))
    nodes = paths.groupBy("key_1", "key_2").agg(
        F.min("depth").alias("depth"), F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.min("up_1").alias("up_1"), F.min("up_2").alias("up_2"), F.max("bytes").alias("bytes"),
    )
    tree = _numbered(durable(nodes))
    ranked = durable(ranks(arcs(tree)))
    tour = ranked.select("arc", (F.lit(ranked.count()) - F.col("to_end")).alias("place"))
    own = tree.select(
        (F.col("number") * 2).alias("arc"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")
    ).where("arc > 0")
    weighed = tour.join(own, "arc", "left").fillna(0, ["leaf", "saved"])
    sums = scans.prefix_sums(weighed, "place", ["leaf", "saved"])
    into, out = F.col("arc") % 2 == 0, F.col("arc") % 2 == 1
    inside = sums.groupBy(F.shiftright("arc", 1).alias("number")).agg(
        *[F.sum(F.when(out, F.col(f"{v}_to")).otherwise(F.col(v) - F.col(f"{v}_to"))).alias(f"in_{v}") for v in ("leaf", "saved")],
        F.max(F.when(into, F.col("place"))).alias("enter"), F.max(F.when(out, F.col("place"))).alias("exit"),
    )
    # the root has no arcs: its subtree is the whole tour
    whole = own.agg(F.coalesce(F.sum("leaf"), F.lit(0)).alias("leaf"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"))
    null = F.lit(None).cast("long")
    totals = whole.select(F.lit(0).cast("long").alias("number"), F.greatest("leaf", F.lit(1)).alias("in_leaf"), F.col("saved").alias("in_saved"), null.alias("enter"), null.alias("exit"))
    measured = tree.join(inside.unionByName(totals), "number")
    return measured.join(_ends(paths, lengths), ["key_1", "key_2"], "left").select(
        "conv_id", "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", F.col("in_leaf").alias("n_leaves"),
        F.col("in_saved").alias("saved"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "enter", "exit", "key_1", "key_2",
    )


def shared(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of ``conversations`` as they are, with ``role`` and ``text`` of every node's last turn."""
    turns = durable(placed(conversations, conv, turn, role, text))
    nodes = trie(turns.groupBy("conv").agg(F.max("at").alias("length")), turns)
    key_1, key_2 = turn_keys(F.col(role), F.col(text))
    said = conversations.select(key_1.alias("said_1"), key_2.alias("said_2"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).dropDuplicates(["said_1", "said_2"])
    at = turns.select(F.col("conv").alias("conv_id"), F.col("at").alias("depth"), F.col("key_1").alias("said_1"), F.col("key_2").alias("said_2"))
    return nodes.join(at, ["conv_id", "depth"], "left").join(said, ["said_1", "said_2"], "left").drop("said_1", "said_2")
