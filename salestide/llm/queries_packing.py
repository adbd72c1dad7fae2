"""Query of the packing operator."""

from pyspark.sql import functions as F

from salestide.llm import packing
from salestide.llm.common import table


def op12_best_fit_packing(spark, folder):
    cut = packing.pieces(table(spark, folder, "documents").select("doc_id", "text"))
    # the digest is taken while the ids are at hand; the pieces that are packed are narrow
    narrow = cut.select(F.col("doc").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.packed(narrow)


QUERIES = {"op12_best_fit_packing": op12_best_fit_packing}

# DuckDB has no tokenizer; the tests compare with the tokenizer itself and a plain best fit
ORACLES = {}
