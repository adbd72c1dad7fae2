"""Query of the page-text operator."""

from pyspark.sql import functions as F

from salestide.llm import pages
from salestide.llm.common import table


def op7_page_text(spark, folder):
    found = pages.extract(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op7_page_text": op7_page_text}

# marginals of a trained tree can't be stated in SQL; the tests compare with the pages' own articles
ORACLES = {}
