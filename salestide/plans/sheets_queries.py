from pyspark.sql import functions as F

from salestide.operators import text as txt
from salestide.plans.recipes_queries import rquery
from salestide.plans.registry import query
from salestide.sources.views import read_table, sheet_view

# The sheets are written from the recipe table, so parsing them must give its values back.
_PROTEIN = "case when protein_source is null then '' else lower(protein_source) end"


def _sheets(spark, d):
    return sheet_view(spark, d)


def _docs(spark, d):
    return txt.documents(_sheets(spark, d))


def _corpus(spark, d):
    return read_table(spark, d, "documents").select("doc_id", "text")


@rquery(
    "txt_01_sections",
    """select source_file, ingredients_raw||' (sugar, salt 2%), '||coalesce(protein_source,'water')||'; cocoa and vanilla 3%.'||chr(10)||chr(10)||'Farine, sucre.' ingredients,
     coalesce(allergens,'none')||' (see in bold). Manufactured on shared equipment' allergens from rv""",
)
def _(spark, d):
    t = F.col("text")
    return _docs(spark, d).select(
        "source_file", txt.section(t, "ingredients", "allergens").alias("ingredients"), txt.section(t, "allergens", "claims").alias("allergens")
    )


@rquery(
    "txt_02_english_paragraph",
    "select source_file, ingredients_raw||' (sugar, salt 2%), '||coalesce(protein_source,'water')||'; cocoa and vanilla 3%.' paragraph from rv",
)
def _(spark, d):
    part = txt.section(F.col("text"), "ingredients", "allergens")
    return _docs(spark, d).select("source_file", txt.english_paragraph(part).alias("paragraph"))


@query("txt_02_english_paragraph_corpus")
def _(spark, d):
    return _corpus(spark, d).select("doc_id", txt.english_paragraph(F.col("text")).alias("paragraph"))


@query("txt_03_keywords_corpus")
def _(spark, d):
    words = _corpus(spark, d).select("doc_id", txt.keyword_list("text").alias("w"))
    return words.select("doc_id", F.size("w").alias("n_keywords"), F.array_join("w", "|").alias("keywords"))


@rquery("txt_04_portion_size", "select source_file, (portion_size[:-3])||'.5 g' portion_size from rv")
def _(spark, d):
    return _docs(spark, d).select("source_file", txt.portion_size(F.col("text")).alias("portion_size"))


@query(
    "txt_04_portion_size_corpus",
    r"""with g as (select doc_id, text, '(?i)(\d+(?:[,.]\d+)?)\s*g(?:[^A-Za-z]|$)' pattern from documents),
     l as (select doc_id, pattern, unnest(string_split_regex(text, '\r\n|\r|\n')) line, generate_subscripts(string_split_regex(text, '\r\n|\r|\n'), 1) pos from g),
     p as (select doc_id, arg_min(regexp_extract_all(line, pattern, 1)[-1], pos) size from l
       where regexp_matches(line, '(?i)\b(Portion|Serving\s*size)\b') and len(regexp_extract_all(line, pattern, 1))>0 group by doc_id)
     select doc_id, coalesce(replace(coalesce(size, regexp_extract_all(text, pattern, 1)[-1]), ',', '.')||' g', '') portion_size from g left join p using (doc_id)""",
    base="",
)
def _(spark, d):
    return _corpus(spark, d).select("doc_id", txt.portion_size(F.col("text")).alias("portion_size"))


@rquery("txt_05_header", "select source_file, product_id, product_name from rv")
def _(spark, d):
    head = txt.header_fields(F.col("first_page"), F.col("text"))
    return _docs(spark, d).withColumn("h", head).select(
        "source_file", F.col("h.id").alias("product_id"), F.col("h.name").alias("product_name")
    )


@rquery("txt_06_allergen_sentence", "select source_file, regexp_replace(coalesce(allergens,'none'), '[ .;,-]+$', '') allergens from rv")
def _(spark, d):
    part = txt.section(F.col("text"), "allergens", "claims")
    return _docs(spark, d).select("source_file", txt.allergen_sentence(part).alias("allergens"))


@rquery("txt_07_nutrients", "select source_file, " + ",".join(txt.NUTRIENTS) + " from rv")
def _(spark, d):
    table = txt.inline_text(txt.section(F.col("text"), "nutrition", "ingredients"))
    return _docs(spark, d).withColumn("_t", table).select(
        "source_file", *[txt.nutrient(F.col("_t"), p).alias(c) for c, p in txt.NUTRIENTS.items()]
    )


@rquery("txt_08_protein_source", f"select source_file, {_PROTEIN} protein_source from rv")
def _(spark, d):
    return txt.parse_sheets(_sheets(spark, d)).select("source_file", "protein_source")


@rquery(
    "txt_09_records",
    f"""select source_file, product_id, product_name, (portion_size[:-3])||'.5 g' portion_size, {_PROTEIN} protein_source, kcal_100g, sel_100g, 0 n_errors,
      case when protein_source is null then 'No protein source identified' else '' end warnings from rv""",
)
def _(spark, d):
    r = txt.parse_sheets(_sheets(spark, d))
    return r.select(
        "source_file", "product_id", "product_name", "portion_size", "protein_source", "kcal_100g", "sel_100g",
        F.size("errors").alias("n_errors"), F.array_join("warnings", "|").alias("warnings"),
    )


@rquery("txt_09_status", "select case when protein_source is null then 'warning' else 'ok' end status, count(*) sheets from rv group by 1")
def _(spark, d):
    return txt.sheet_status(txt.parse_sheets(_sheets(spark, d)))


@rquery(
    "txt_10_batch_quality",
    "select count(*) tested, count(protein_source) successful, count(*)-count(protein_source) with_warnings, 0::bigint with_errors, count(protein_source)*100.0/count(*) success_rate from rv",
    floats="success_rate",
)
def _(spark, d):
    return txt.batch_quality(txt.parse_sheets(_sheets(spark, d)))
