"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salestide.session import durable


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Move every node's larger (or smaller) neighbours to its smallest neighbour."""
    down = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    up = links.select(F.col("b").alias("node"), F.col("a").alias("other"))
    around = down.union(up) if large else down
    least = around.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root"))
    moved = around.join(least, "node")
    if large:
        return moved.where("other > node").select(F.col("other").alias("a"), F.col("root").alias("b")).distinct()
    hung = moved.where("other != root").select(F.col("other").alias("a"), F.col("root").alias("b"))
    return hung.union(least.select(F.col("node").alias("a"), F.col("root").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the component's smallest node.

    Links only shrink toward the smallest node of each component; the loop ends
    when a round of both stars leaves the table as it was.  Each round is a
    checkpoint.  Self-links and repeated links do no harm.
    """
    now = durable(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == seen:
            break
        seen = mark
        now = durable(_stars(_stars(now, large=True), large=False))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
