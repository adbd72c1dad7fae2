"""Query of language identification, over documents and pages."""

from pyspark.sql import functions as F

from salestide.llm import langid
from salestide.llm.common import table


def op5_language_id(spark, folder):
    docs, pages = table(spark, folder, "documents"), table(spark, folder, "pages")
    none = F.lit(None).cast("long")
    rows = langid.document_rows(docs, F.struct(F.col("doc_id"), none.alias("page_id"))).union(
        langid.page_rows(pages, F.struct(none.alias("doc_id"), F.col("page_id")))
    )
    return langid.fused(rows, langid.fit(docs)).select("row.*", "language", F.round("posterior", 6).alias("posterior"), "rejected")


QUERIES = {"op5_language_id": op5_language_id}

# trained likelihoods can't be stated in SQL; the tests hold accuracy and the fusion against plain versions
ORACLES = {}
