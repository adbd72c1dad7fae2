"""Query of the near-copy operator."""

from pyspark.sql import functions as F

from salestide.llm import simhash
from salestide.llm.common import table


def op2_simhash_near_dedup(spark, folder):
    found = simhash.groups(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


QUERIES = {"op2_simhash_near_dedup": op2_simhash_near_dedup}

# DuckDB has no XXH64; the tests compare with a plain version
ORACLES = {}
