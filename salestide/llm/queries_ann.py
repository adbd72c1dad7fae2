"""Query of the nearest-neighbour operator."""

from pyspark.sql import functions as F

from salestide.llm import ann
from salestide.llm.common import table


def op10_nearest_neighbours(spark, folder):
    return ann.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op10_nearest_neighbours": op10_nearest_neighbours}

# the search is approximate; the tests measure recall against brute force
ORACLES = {}
