"""Query of the personal-data operator."""

from pyspark.sql import functions as F

from salestide.llm import pii
from salestide.llm.common import table


def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _of_kind(spans, kind):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_personal_data(spark, folder):
    found = pii.find(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), *[_of_kind("base", k) for k in pii.KINDS],
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
    )


QUERIES = {"op1_personal_data": op1_personal_data}

# boosted trees can't be stated in SQL; the tests hold the base rules against plain patterns
ORACLES = {}
