"""Query of the sharding operator."""

from pyspark.sql import functions as F

from salestide.llm import sharding
from salestide.llm.common import table


def op3_ring_sharding(spark, folder):
    rows = sharding.narrow_rows(table(spark, folder, "documents"))
    return sharding.dealt(rows).select(
        "row.*", F.lit(sharding.LAW).alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op3_ring_sharding": op3_ring_sharding}

# the walk around the ring can't be stated in SQL; the tests repeat it plainly
ORACLES = {}
