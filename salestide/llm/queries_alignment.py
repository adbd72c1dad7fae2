"""Query of the cross-tokenizer alignment."""

from pyspark.sql import functions as F

from salestide.llm import alignment
from salestide.llm.common import table


def op13_tokenizer_alignment(spark, folder):
    found = alignment.aligned(table(spark, folder, "documents").select("doc_id", "text"))
    # the written groups are digested before the rows become a table
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    narrow = found.select(F.col("doc").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "pairs", "numbers", digest.alias("groups_sha256"))
    return alignment.scored(narrow)


QUERIES = {"op13_tokenizer_alignment": op13_tokenizer_alignment}

# DuckDB has no tokenizers; the tests compare with a plain version
ORACLES = {}
