"""Search, tags and summaries over the recipe table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salestide.functions.numeric import any_of, ratio
from salestide.functions.ordering import globally_ranked

NUTRIENTS = [
    "kcal_100g", "kj_100g", "matieres_grasses_100g", "lipides_100g", "acides_gras_satures_100g", "glucides_100g",
    "sucres_100g", "amidon_100g", "fibres_100g", "proteines_100g", "sel_100g",
]
# Tag rules; in each list the first rule whose words occur gives the tag.
NAME_TAGS = [
    [("Soup", ["soup", "broth"]), ("Dessert", ["pudding", "mousse", "dessert"]), ("Beverage", ["drink", "milkshake", "beverage"]),
     ("Main Dish", ["dish", "meal", "parmentier"]), ("Snack", ["bar", "biscuit", "cookie"])],
    [("Chocolate", ["chocolate", "cocoa"]), ("Vanilla", ["vanilla"]), ("Coffee", ["coffee", "cappuccino"]), ("Berry", ["strawberry", "berry"]),
     ("Citrus", ["lemon", "citrus"]), ("Caramel", ["caramel"]), ("Savory", ["onion"])],
    [("Crunchy", ["croutons", "toasted"]), ("Cold", ["cold"]), ("Hot", ["hot", "warm"])],
]
PROTEIN_TAGS = [
    ("Soy Protein", ["soy"]), ("Dairy Protein", ["milk", "dairy"]), ("Whey Protein", ["whey"]), ("Pea Protein", ["pea"]),
    ("Plant Protein", ["plant", "vegetable"]),
]
# Allergen entries that are no allergens.
NO_ALLERGENS = ["contient", "none", "none contain", "no contain", "no contains", "contain", "contains", ". contient"]
LIST_FIELDS = {"ingredients": ["ingredients_raw", "ingredients_list"], "tags": ["tags"]}


def _first_rule(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    out = F
    for tag, words in rules:
        out = out.when(any_of([F.contains(text, F.lit(w)) for w in words]), F.lit(tag))
    return out


def recipe_tags() -> Column:
    name, protein = F.lower("product_name"), F.lower("protein_source")
    p, k, f = (F.nullif(F.col(c), F.lit(0)) for c in ("proteines_100g", "kcal_100g", "lipides_100g"))
    tags = [_first_rule(name, rules) for rules in NAME_TAGS] + [
        _first_rule(protein, PROTEIN_TAGS),
        F.when(p >= 20, "High Protein").when(p >= 15, "Medium Protein"),
        F.when(k <= 100, "Low Calorie").when(k >= 400, "High Calorie"),
        F.when(f <= 3, "Low Fat").when(f >= 15, "High Fat"),
    ]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*tags))))


def with_tags(df: DataFrame) -> DataFrame:
    """Derived tags; a recipe for which no rule fires keeps its own."""
    derived = recipe_tags()
    old = F.col("tags") if "tags" in df.columns else F.array().cast("array<string>")
    return df.withColumn("tags", F.when(F.size(derived) > 0, derived).otherwise(old))


def _holds(field: str, text: str) -> Column:
    """Case-insensitive containment in a string, or in any entry of a list."""
    wanted = F.lit(text.strip().lower())
    if field in ("ingredients_list", "tags"):
        return F.coalesce(F.exists(field, lambda s: F.contains(F.lower(s), wanted)), F.lit(False))
    return F.coalesce(F.contains(F.lower(F.col(field)), wanted), F.lit(False))


def search(df: DataFrame, any_values: dict[str, list[str]] | None = None, exclude_ingredients: list[str] = (),
           ranges: dict[str, tuple[float | None, float | None]] | None = None) -> DataFrame:
    """OR between the values of a field, AND between fields; ranges on nutrients are inclusive.

    ``ingredients`` looks into the raw text and the list; a free-text keyword
    is a field with one value.
    """
    out = df
    for field, values in (any_values or {}).items():
        wanted = [v for v in values if v.strip()]
        if wanted:
            out = out.where(any_of([_holds(c, v) for v in wanted for c in LIST_FIELDS.get(field, [field])]))
    for item in exclude_ingredients:
        if item.strip():
            out = out.where(~any_of([_holds(c, item) for c in LIST_FIELDS["ingredients"]]))
    for field, (low, high) in (ranges or {}).items():
        if low is not None:
            out = out.where(F.col(field) >= F.lit(low))
        if high is not None:
            out = out.where(F.col(field) <= F.lit(high))
    return out


def grouped_pages(df: DataFrame, size: int = 24) -> DataFrame:
    """Leading tag (``Other`` without tags) and the page each recipe stands on, by product id."""
    group = F.coalesce(F.try_element_at("tags", F.lit(1)), F.lit("Other"))
    ranked = globally_ranked(
        df.select("product_id", "source_file", group.alias("tag_group")), [F.col("product_id"), F.col("source_file")], "position"
    )
    return ranked.withColumn("page", F.ceil(F.col("position") / size).cast("int"))


def distinct_tags(df: DataFrame) -> DataFrame:
    return df.select(F.explode("tags").alias("tag")).distinct()


def distinct_ingredients(df: DataFrame) -> DataFrame:
    return df.select(F.explode("ingredients_list").alias("i")).select(
        F.trim(F.replace("i", F.lit("&"), F.lit(""))).alias("ingredient")
    ).where("ingredient <> ''").distinct()


def _sentence_case(c: Column) -> Column:
    low = F.lower(c)
    return F.concat(F.upper(F.substring(low, 1, 1)), F.substr(low, F.lit(2)))


def _entries(df: DataFrame, column: str) -> DataFrame:
    parts = F.split(F.col(column), "[;,]")
    return df.where(F.coalesce(F.col(column), F.lit("")) != "").select(F.explode(parts).alias("e")).select(
        F.trim("e").alias("e")
    ).where("e <> ''").distinct()


def distinct_allergens(df: DataFrame) -> DataFrame:
    """Entries without trailing remarks, without noise words, in sentence case."""
    e = F.trim(F.regexp_replace(F.regexp_replace("e", r"(?i)\s*\.\s*contient.*$", ""), r"(?i)\s*\.\s*gluten.*$", ""))
    return _entries(df, "allergens").select(e.alias("e")).where(
        (F.col("e") != "") & ~F.lower("e").isin(NO_ALLERGENS)
    ).select(_sentence_case(F.col("e")).alias("allergen")).distinct()


def distinct_proteins(df: DataFrame) -> DataFrame:
    """Entries with plurals folded; the singular spelling is preferred."""
    low = F.lower("e")
    key = F.when(low.endswith("s") & (F.length(low) > 3), F.expr("substr(lower(e), 1, length(e) - 1)")).otherwise(low)
    return _entries(df, "protein_source").groupBy(key.alias("k")).agg(
        F.min_by(_sentence_case(F.col("e")), F.struct(low.endswith("s"), low)).alias("protein_source")
    ).select("protein_source")


def valid_product_ids(df: DataFrame) -> DataFrame:
    pid = F.col("product_id")
    return df.where((F.length(pid) >= 3) & ~F.contains(pid, F.lit("/"))).select("product_id").distinct()


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.coalesce(F.col(column), F.lit("")) != "").select(column).distinct()


def nutrition_stats(df: DataFrame, fields: list[str] = NUTRIENTS) -> DataFrame:
    """Mean, minimum and maximum per nutrient from one aggregate."""
    one = df.agg(
        *[F.struct(ratio(F.sum(c), F.count(c)).alias("mean"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")).alias(c)
          for c in fields]
    )
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("nutrient"), F.col(c).alias("s")) for c in fields]))).select("nutrient", "s.*")


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """Most frequent values of a column or of the entries of a list column."""
    is_list = df.schema[column].dataType.typeName() == "array"
    values = df.select((F.explode(column) if is_list else F.col(column)).alias("value"))
    return values.where(F.coalesce(F.col("value"), F.lit("")) != "").groupBy("value").agg(
        F.count("*").alias("recipes")
    ).orderBy(F.desc("recipes"), "value").limit(n)


def macro_rows(df: DataFrame, n: int | None = 20) -> DataFrame:
    """Recipes with all four macronutrients, by product id."""
    cols = ["proteines_100g", "glucides_100g", "lipides_100g", "kcal_100g"]
    out = df.na.drop(subset=cols).select("product_id", "source_file", *cols)
    return out if n is None else out.orderBy("product_id", "source_file").limit(n)


def quality_scores(df: DataFrame) -> DataFrame:
    """2 points for protein > 10, 2 for fibre > 3, 1 for sugar < 5 (and not 0)."""
    full = df.na.drop(subset=["kcal_100g", "proteines_100g", "fibres_100g", "sucres_100g"])
    score = (
        F.when(F.col("proteines_100g") > 10, 2).otherwise(0) + F.when(F.col("fibres_100g") > 3, 2).otherwise(0)
        + F.when((F.col("sucres_100g") < 5) & (F.col("sucres_100g") != 0), 1).otherwise(0)
    )
    return full.select("product_id", "source_file", score.alias("quality_score"), "kcal_100g")


def scale_portion(df: DataFrame, grams: float) -> DataFrame:
    """Nutrients of a portion of ``grams``."""
    return df.select("source_file", *[(F.col(c).cast("double") * grams / 100.0).alias(c.replace("_100g", "_portion")) for c in NUTRIENTS])


def portion_for_energy(df: DataFrame, kcal: float) -> DataFrame:
    """Grams that hold the wanted energy, null without an energy value."""
    return df.select("source_file", (ratio(F.lit(kcal), "kcal_100g") * 100.0).alias("grams"))


def activity(df: DataFrame, now: Column) -> DataFrame:
    """All recipes, and those updated in the 24 hours before ``now``."""
    return df.agg(
        F.count("*").alias("recipes"), F.count_if(F.col("updated_at") >= now - F.expr("INTERVAL 24 HOURS")).alias("recent")
    )


