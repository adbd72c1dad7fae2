"""Product sheet text to recipe rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from salestide.functions.keywords import keywords as _keywords
from salestide.functions.numeric import pct

# Heading variants, lower case.
HEADINGS = {
    "ingredients": ["ingredients / ingrédients", "ingredients list / liste des ingrédients", "ingredients", "ingrédients", "liste des ingrédients"],
    "allergens": ["allergens / allergènes", "allergens list / liste des allergènes", "allergens", "allergènes", "liste des allergènes"],
    "claims": ["claims / allégations", "claims", "allégations"],
    "nutrition": ["average nutritional values / valeurs nutritionnelles moyennes", "average nutrition declaration / déclaration nutritionnelle moyennes",
                  "nutrition declaration / déclaration nutritionnelle", "valeurs nutritionnelles moyennes", "nutrition"],
    "food_category": ["food category / catégorie de denrées alimentaires", "food category", "catégorie de denrées alimentaires"],
}
# Letters and words that mark French text.
FRENCH_LETTERS = "éèêëàâîïôöùûüçœÉÈÊËÀÂÎÏÔÖÙÛÜÇŒ"
FRENCH_WORDS = [
    "de", "des", "du", "et", "aux?", "lait", "soja", r"fruits?\s+à\s+coques", "édulcorant", "émulsifiant",
    r"correcteurs?\s+d'acidité", "harômes?",
]
# Product id pattern, nutrient label patterns.
ID_PATTERN = r"(?<![A-Za-z0-9])[A-Z]\d{3}[A-Z]\d{2}V\d{1,2}(?![A-Za-z0-9])"
NUTRIENTS = {
    "kcal_100g": "kcal", "kj_100g": r"(?:k[\s\-]?j(?:oules)?|kilojoules)", "matieres_grasses_100g": r"Mati[eè]res?\s+grasses?\s*\(g\)",
    "lipides_100g": r"Lipides?\s*\(g\)", "acides_gras_satures_100g": r"dont\s+acides?\s+gras\s+satur[eé]s?\s*\(g\)",
    "glucides_100g": r"Glucides?\s*\(g\)", "sucres_100g": r"dont\s+sucres?\s*\(g\)", "amidon_100g": r"dont\s+amidon\s*\(g\)",
    "fibres_100g": r"Fibres?\s+alimentaires?\s*\(g\)", "proteines_100g": r"Prot[eé]ines?\s*\(g\)", "sel_100g": r"Sel\s*\(g\)",
}

# A weight in grams, portion lines, notes in allergen sentences, protein mentions.
GRAMS = r"(?i)(\d+(?:[,.]\d+)?)\s*g(?![A-Za-z])"
PORTION_LINE = r"(?i)\b(Portion|Serving\s*size)\b"
BOLD_NOTE = r"(?i)\s*\(?\bsee\s+in\s+bold\b\)?\s*"
EQUIPMENT_NOTE = r"(?is)\bmanufactured\s+on\b.*"
SENTENCE_END = r"[ .;,\-]+$"
PROTEIN_BEFORE = r"(?U)\b(\w+\s+proteins?)\b"
PROTEIN_AFTER = r"(?U)\b(proteins?\s+\w+)\b"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, although ``body`` uses it several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def inline_text(c: Column) -> Column:
    """Runs of blanks to one space, ends trimmed; line breaks stay."""
    return strip(F.regexp_replace(F.replace(c, F.lit(" "), F.lit(" ")), r"[ \t]+", " "))


def _any_of(variants: list[str]) -> str:
    return "(?iu)" + "|".join(sorted(variants, key=len, reverse=True))


def _first_of(text: Column, variants: list[str]) -> Column:
    """Earliest 1-based position of any variant, in any case, null when absent."""
    return F.nullif(F.regexp_instr(text, F.lit(_any_of(variants))), F.lit(0))


def section(text: Column, heading: str, following: str) -> Column:
    """Text from the line after the first heading to the next heading or the end; empty without heading."""
    def body(tail: Column) -> Column:
        stop = _first_of(tail, HEADINGS[following])
        return strip(let(stop, lambda s: F.when(s.isNotNull(), F.substr(tail, F.lit(1), s - 1)).otherwise(tail)))

    def after(start: Column) -> Column:
        newline = F.position(F.lit("\n"), text, start)
        # the longest variant that begins there
        length = F.length(F.regexp_substr(F.substr(text, start, F.lit(100)), F.lit(_any_of(HEADINGS[heading]))))
        tail = F.substr(text, F.when(newline > 0, newline + 1).otherwise(start + length))
        return F.when(start.isNull(), F.lit("")).otherwise(let(tail, body))

    return let(_first_of(text, HEADINGS[heading]), after)


def english_paragraph(c: Column) -> Column:
    """The first paragraph; a single one is cut at the first French letter or word."""
    def single(text: Column) -> Column:
        letter = F.regexp_instr(text, F.lit(f"[{FRENCH_LETTERS}]"))
        word = F.regexp_instr(F.lower(text), F.lit(r"(?U)\b(?:" + "|".join(FRENCH_WORDS) + r")\b"))
        cut = F.least(F.nullif(letter, F.lit(0)), F.nullif(word, F.lit(0)))
        return let(strip(F.substr(text, F.lit(1), cut - 1)), lambda head: F.when(head != "", head).otherwise(text))

    def first(parts: Column) -> Column:
        return F.when(F.size(parts) >= 2, F.element_at(parts, 1)).otherwise(single(F.element_at(parts, 1)))

    paragraphs = F.split(strip(F.replace(c, F.lit("\r"), F.lit(""))), r"\n\s*\n")
    return F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(inline_text(let(paragraphs, first)))


@F.pandas_udf(ArrayType(StringType()))
def keyword_list(texts: pd.Series) -> pd.Series:
    """Keywords of a paragraph; brackets nest, which the built-in split cannot follow."""
    return pd.Series([_keywords(t) for t in texts], dtype=object)


def portion_size(text: Column) -> Column:
    """Last ``n g`` on the first portion line that has one, else the last in the text."""
    clean = F.regexp_replace(text, "[  ]", " ")
    last = lambda s: F.try_element_at(F.regexp_extract_all(s, F.lit(GRAMS), F.lit(1)), F.lit(-1))
    lines = F.filter(F.split(clean, r"\r\n|\r|\n"), lambda s: s.rlike(PORTION_LINE))
    best = F.coalesce(F.try_element_at(F.array_compact(F.transform(lines, last)), F.lit(1)), last(clean))
    return F.coalesce(F.concat(F.replace(best, F.lit(","), F.lit(".")), F.lit(" g")), F.lit(""))


def _id_text(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit(" "), F.lit(" ")), "[–—]", "-")


def header_fields(first_page: Column, text: Column) -> Column:
    """(id, name): the id of the first line that holds one, and the nearest unaccented line above it."""
    def named(lines: Column, at: Column) -> Column:
        def pick(above: Column) -> Column:
            plain = F.filter(above, lambda s: ~s.rlike(f"[{FRENCH_LETTERS}]"))
            return F.coalesce(F.try_element_at(plain, F.lit(-1)), F.try_element_at(above, F.lit(-1)))

        found = F.regexp_extract(_id_text(F.try_element_at(lines, at)), f"({ID_PATTERN})", 1)
        above = F.slice(lines, F.lit(1), F.greatest(at - 1, F.lit(0)))
        anywhere = F.regexp_extract(_id_text(text), f"({ID_PATTERN})", 1)
        return F.struct(
            F.when(at > 0, found).otherwise(anywhere).alias("id"), F.when(at > 0, let(above, pick)).alias("name")
        )

    def search(lines: Column) -> Column:
        at = F.array_position(F.transform(lines, lambda s: _id_text(s).rlike(ID_PATTERN)), True).cast("int")
        return let(at, lambda i: named(lines, i))

    return let(F.filter(F.transform(F.split(first_page, "\n"), strip), lambda s: s != ""), search)


def allergen_sentence(c: Column) -> Column:
    """Without the note on bold print and the part on shared equipment."""
    t = F.regexp_replace(c, BOLD_NOTE, " ")
    t = F.regexp_replace(t, EQUIPMENT_NOTE, "")
    return F.regexp_replace(strip(F.regexp_replace(t, r"\s{2,}", " ")), SENTENCE_END, "")


def nutrient(table: Column, pattern: str) -> Column:
    """First of the two numbers behind a label, as decimal."""
    found = F.regexp_extract(table, rf"(?i){pattern}\s+([\d.,]+)\s+([\d.,]+)", 1)
    return F.replace(found, F.lit(","), F.lit(".")).try_cast("decimal(8,2)")



def protein_source(items: Column) -> Column:
    """Protein mentions of the ingredients, distinct, in order."""
    def mentions(item: Column) -> Column:
        low = F.lower(item)
        before = F.regexp_extract_all(low, F.lit(PROTEIN_BEFORE), F.lit(1))
        return F.when(F.size(before) > 0, before).otherwise(F.regexp_extract_all(low, F.lit(PROTEIN_AFTER), F.lit(1)))

    return F.array_join(F.array_distinct(F.flatten(F.transform(items, mentions))), "; ")


def without_protein(items: Column) -> Column:
    return F.filter(items, lambda s: ~F.lower(s).rlike(PROTEIN_BEFORE) & ~F.lower(s).rlike(PROTEIN_AFTER))


def documents(pages: DataFrame) -> DataFrame:
    """One row per file: first page and full text, pages in order (bounded by the pages of a file)."""
    sheets = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.groupBy("source_file").agg(sheets.alias("_p")).select(
        "source_file", F.element_at("_p", 1)["text"].alias("first_page"),
        F.array_join(F.transform("_p", lambda p: p["text"]), "\n").alias("text"),
    )


def parse_sheets(pages: DataFrame) -> DataFrame:
    """Recipe record per file with its errors and warnings."""
    t = F.col("text")
    allergens = F.when(
        _first_of(t, HEADINGS["claims"]).isNotNull(), section(t, "allergens", "claims")
    ).otherwise(section(t, "allergens", "food_category"))
    table = inline_text(section(t, "nutrition", "ingredients"))
    d = documents(pages).withColumns(
        {"ingredients_raw": english_paragraph(section(t, "ingredients", "allergens")), "_allergens": allergen_sentence(english_paragraph(allergens)),
         "_table": table, "portion_size": F.nullif(portion_size(t), F.lit("")), "_head": header_fields(F.col("first_page"), t)}
    ).withColumns({"product_id": F.col("_head.id"), "product_name": F.coalesce("_head.name", F.lit(""))}).drop("_head", "text", "first_page")
    # a generator of one row: the optimizer would merge the lists into lambdas, where Python can't run
    words = F.struct(keyword_list("ingredients_raw").alias("items"), keyword_list("_allergens").alias("words"))
    d = d.select("*", F.explode(F.array(words)).alias("_lists")).withColumns(
        {"_items": F.col("_lists.items"), "allergens": F.array_join("_lists.words", "; ")}
    )
    d = d.withColumns({c: nutrient(F.col("_table"), p) for c, p in NUTRIENTS.items()}).withColumns(
        {"protein_source": protein_source(F.col("_items")), "ingredients_list": without_protein(F.col("_items"))}
    )
    any_nutrient = F.coalesce(*[F.col(c).cast("string") for c in NUTRIENTS]).isNotNull()
    warnings = F.array_compact(
        F.array(
            F.when(F.col("portion_size").isNull(), "No portion size found"),
            F.when(F.col("protein_source") == "", "No protein source identified"),
            F.when(~any_nutrient, "No nutrition information found"), F.when(F.col("product_name") == "", "No product name found"),
        )
    )
    errors = F.array_compact(F.array(F.when(F.col("product_id") == "", "No product ID found - this is required for processing")))
    return d.withColumns({"errors": errors, "warnings": warnings}).select(
        "source_file", "product_id", "product_name", "portion_size", "ingredients_raw", "ingredients_list", "allergens",
        "protein_source", *NUTRIENTS, "errors", "warnings",
    )


def sheet_status(records: DataFrame) -> DataFrame:
    status = F.when(F.size("errors") > 0, "error").when(F.size("warnings") > 0, "warning").otherwise("ok")
    return records.groupBy(status.alias("status")).agg(F.count("*").alias("sheets"))


def batch_quality(records: DataFrame) -> DataFrame:
    bad, warned = F.size("errors") > 0, F.size("warnings") > 0
    return records.agg(
        F.count("*").alias("tested"), F.count_if(~bad & ~warned).alias("successful"),
        F.count_if(~bad & warned).alias("with_warnings"), F.count_if(bad).alias("with_errors"),
    ).withColumn("success_rate", F.coalesce(pct("successful", "tested"), F.lit(0.0)))
