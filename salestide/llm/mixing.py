"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, target over
source size.  The documents of a source stand in one fixed order (size band,
hash of the id, hash of the row); the running sum of expected copies, shifted
by one random offset per source, emits a document once for each integer it
crosses.  Size bands keep the words taken close to the target.

No source is ordered in one task: rows are numbered inside (source, band, hash
prefix), and the numbers of earlier groups come from a table of group counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salestide.llm.common import WORD, packed

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
SEED = "mix-1"
ROWS_PER_GROUP = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_band(size: Column) -> Column:
    """Four bands per doubling, as text that sorts like the size."""
    bits = F.bin(size)
    return F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(bits, 1, 3))


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size) to targets: weights repeat in code-point order, null last; all shares sum to the total
    size; no target exceeds ``most`` times its source, the excess going to the others by weight.

    One row per source stands in one task here.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(listed, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    by_room = Window.orderBy("room", F.col("source").asc_nulls_last())
    before, every = by_room.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    tried = ranked.withColumn("room", most * F.col("source_size") / F.col("weight")).select(
        "*",
        (
            (F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
            / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        ).alias("level"),
    )
    # the sources before the first whose room holds the level are full
    level = F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "source", "level"))).over(every)["level"]
    return tried.select(
        "source", "source_size", F.least((most * F.col("source_size")).cast("double"), level * F.col("weight")).alias("target")
    )


def planned(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
            weights=WEIGHTS, most: int = MOST_COPIES, seed: str = SEED, counted: bool = False) -> DataFrame:
    """``row`` (the document), size, source_size, target, copies for every document.

    With ``counted`` the column named by ``text`` already holds the number of words.

    A null text has size 0; a null source is a source of its own, the last.  A
    source without words has target 0 and gives no copies.  Ties in the order
    are broken by a hash of the whole row, so reruns agree; equal rows may each
    get their own number of copies.
    """
    digits = max(1, min(6, math.ceil(math.log(max(docs.count(), 1) / (10 * ROWS_PER_GROUP) + 1, 16))))
    mark = F.md5(F.coalesce(F.col("row")[key].cast("string"), F.lit("")))
    rows = docs.select(packed(docs).alias("row")).select(
        "row", F.coalesce(F.concat(F.lit("="), F.col("row")[source]), F.lit("")).alias("source_key"),
        (F.col("row")[text] if counted else word_count(F.col("row")[text])).alias("size"), mark.alias("mark"), F.xxhash64("row").alias("tie"),
    ).withColumns({"band": size_band(F.col("size")), "part": F.substring("mark", 1, digits)})
    groups = rows.groupBy("source_key", "band", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    sources = groups.groupBy("source_key").agg(F.sum("words").alias("source_size"))
    named = sources.select(
        F.when(F.col("source_key") != "", F.expr("substring(source_key, 2)")).alias("source"), "source_size"
    )
    chance = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("source_key"))), 1, 5), 16, 10).cast("double") / 2**20
    targets = source_targets(named, weights, most).withColumn(
        "source_key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    ).select("source_key", "source_size", "target", F.when(
        F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))
    ).otherwise(0.0).alias("rate"), chance.alias("offset"))
    earlier = Window.partitionBy("source_key").orderBy("band", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(targets, "source_key").drop("n", "words")
    numbered = rows.withColumn(
        "at", F.row_number().over(Window.partitionBy("source_key", "band", "part").orderBy("mark", "tie"))
    ).join(starts, ["source_key", "band", "part"])
    last = (F.col("before") + F.col("at")).cast("double")
    crossed = F.floor(last * F.col("rate") + F.col("offset")) - F.floor((last - 1) * F.col("rate") + F.col("offset"))
    return numbered.select("row", "size", "source_size", "target", crossed.cast("int").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: the columns of ``docs``, each document as often as the sample takes it."""
    taken = planned(docs, **options).where("copies > 0")
    return taken.select("row", F.explode(F.expr("sequence(1, copies)")).alias("copy")).select("row.*")
