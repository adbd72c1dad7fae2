"""Query of the licence operator."""

from pyspark.sql import functions as F

from salestide.llm import licences
from salestide.llm.common import table


def op4_licence_scan(spark, folder):
    found = licences.by_document(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(F.col("doc").alias("doc_id"), F.array_join("licences", ",").alias("licences"), "notices", "unknown")


QUERIES = {"op4_licence_scan": op4_licence_scan}

# a trained classifier can't be stated in SQL; the tests measure held-out accuracy
ORACLES = {}
