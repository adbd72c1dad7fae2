"""Canonical tables built over a TPC-H-like star schema.

``sales_view`` joins only the tables that the requested columns need, so a
query over products does not shuffle orders.  Join strategies are left to the
optimizer, which broadcasts by measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salestide.functions import calendar as cal

# Country code per nation key, currency per region key.
NATION_CODES = [
    "FR", "BE", "DE", "NL", "LU", "GB", "DK", "SE", "NO", "IE", "ES", "IT", "PT",
    "GR", "PL", "CZ", "AT", "CH", "HU", "AE", "AU", "BR", "CA", "IN", "SA",
]
REGION_CURRENCIES = ["ZAR", "USD", "JPY", "EUR", "AED"]


def _pick(values: list[str], key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), key + 1)


def _d(name: str) -> Column:
    return F.to_date(name)


_LINE, _ORDER, _CUSTOMER, _NATION, _PART = "lineitem", "orders", "customer", "nation", "part"


def _columns() -> dict[str, tuple[set[str], Column]]:
    invoice, order = _d("l_shipdate"), _d("o_orderdate")
    planned = F.date_add(order, F.substring("o_orderpriority", 1, 1).cast("int") * 15)
    lead = F.date_diff(invoice, order)
    plan = F.date_diff(planned, order)
    line, both = {_LINE}, {_LINE, _ORDER}
    geo = {_LINE, _ORDER, _CUSTOMER}
    fy, fq = cal.fiscal_year(invoice), cal.fiscal_quarter(invoice)
    fy_label = F.concat(F.lit("FY"), fy.cast("string"))
    return {
        "client_id": (both, F.col("o_custkey").cast("string")),
        "client_name": (geo, F.col("c_name")),
        "order_id": (line, F.col("l_orderkey").cast("string")),
        "order_date": (both, order),
        "invoice_date": (line, invoice),
        "ship_date": (line, invoice),
        "planned_date": (both, planned),
        "family": ({_LINE, _PART}, F.col("p_type")),
        "recipe_code": (line, F.col("l_partkey").cast("string")),
        "label_1": ({_LINE, _PART}, F.col("p_name")),
        "label_2": ({_LINE, _PART}, F.col("p_brand")),
        "country": (geo, _pick(NATION_CODES, F.col("c_nationkey"))),
        "currency": (geo | {_NATION}, _pick(REGION_CURRENCIES, F.col("n_regionkey"))),
        "amount": (line, F.col("l_extendedprice").cast("decimal(18,2)")),
        "qty": (line, F.col("l_quantity")),
        "unit_price": (line, F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))),
        "year": (line, F.year(invoice)),
        "month": (line, cal.month_label(invoice)),
        "fiscal_year": (line, fy),
        "fiscal_year_label": (line, fy_label),
        "fiscal_quarter_num": (line, fq),
        "fiscal_quarter_code": (line, cal.period_label(invoice, "quarter")),
        "fiscal_quarter_label": (line, F.concat(cal.quarter_words(fq), F.lit(" "), fy_label)),
        "weekday": (line, F.weekday(invoice)),
        "lead_time_days": (both, lead),
        "planned_days": (both, plan),
        "lead_time_deviation": (both, lead - plan),
    }


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def sales_view(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Cleaned invoice lines; pass the columns the query uses."""
    known = _columns()
    wanted = list(columns) or list(known)
    needs = set().union(*[known[c][0] for c in wanted])
    out = read_table(spark, folder, _LINE)
    if _ORDER in needs:
        out = out.join(read_table(spark, folder, _ORDER), F.col("l_orderkey") == F.col("o_orderkey"))
    if _CUSTOMER in needs:
        out = out.join(
            read_table(spark, folder, _CUSTOMER), F.col("o_custkey") == F.col("c_custkey")
        )
    if _NATION in needs:
        out = out.join(
            read_table(spark, folder, _NATION), F.col("c_nationkey") == F.col("n_nationkey")
        )
    if _PART in needs:
        out = out.join(read_table(spark, folder, _PART), F.col("l_partkey") == F.col("p_partkey"))
    return out.select(*[known[c][1].alias(c) for c in wanted])


def raw_view(spark: SparkSession, folder: str) -> DataFrame:
    """Uncleaned invoice lines, all strings, with source headers.

    The dirt follows the data: returned lines carry negative quantities, open
    lines with a high discount carry a negative amount, untaxed lines have no
    price, and heavily discounted large lines have an amount in thousands.
    """
    s = (
        read_table(spark, folder, "lineitem")
        .join(read_table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(read_table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(read_table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    iso = _pick(NATION_CODES, F.col("c_nationkey"))
    prefix = (
        F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("13"))
        .when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit("ZZ"))
        .otherwise(iso)
    )
    client = F.concat(prefix, F.col("o_custkey").cast("string"))
    code = F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0")
    article = F.when(
        F.col("p_size") > 25, F.concat(F.lit("BX L"), code, F.lit("T"), code)
    ).otherwise(F.concat(F.lit("L"), code))
    qty = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    price = F.when(F.col("l_tax") > 0, F.col("p_retailprice"))
    gross = F.col("l_quantity") * F.col("p_retailprice")
    amount = (
        F.when((F.col("l_linestatus") == "O") & (F.col("l_discount") >= 0.09), -gross)
        .when((F.col("l_discount") >= 0.09) & (F.col("l_quantity") > 25), gross / 1000)
        .otherwise(gross)
    )
    planned = F.date_add(
        F.to_date("o_orderdate"), F.substring("o_orderpriority", 1, 1).cast("int") * 15
    )
    dmy = lambda c: F.date_format(c, "dd/MM/yyyy")
    return s.select(
        client.alias("Cpt Client"),
        F.col("c_name").alias("Intitulé"),
        F.when(F.col("l_discount") == 0, F.lit("xx")).otherwise(dmy("l_shipdate")).alias("Date Fact."),
        dmy("o_orderdate").alias("Date Cde"),
        dmy("l_shipdate").alias("Date Exp."),
        dmy(planned).alias("Delai Prev"),
        article.alias("Code Artic"),
        F.col("p_name").alias("Libelle 1"),
        F.col("p_brand").alias("Libelle 2"),
        F.col("p_type").alias("Famille"),
        amount.cast("decimal(18,2)").cast("string").alias("Montant"),
        qty.cast("string").alias("Quantité"),
        price.cast("string").alias("PU Net"),
        F.concat(F.lit(" "), F.lower(F.col("o_orderstatus"))).alias("Nom Devise"),
        F.col("l_orderkey").cast("string").alias("N° Bon"),
        F.col("o_orderpriority").alias("Code Group"),
        F.col("l_linestatus").alias("Cpt Compta"),
        F.col("l_returnflag").alias("Cpte vente"),
    )


def recipe_view(spark: SparkSession, folder: str) -> DataFrame:
    """One product sheet row per part, with nutrients derived from its columns."""
    p = read_table(spark, folder, "part")
    key, size, price = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice")
    words = F.split("p_name", " ")

    def dec(c: Column) -> Column:
        return c.cast("decimal(8,2)")

    product_id = F.concat(
        F.lit("R"), F.lpad((F.floor(key / 100) % 1000).cast("string"), 3, "0"), F.lit("S"),
        F.lpad((key % 100).cast("string"), 2, "0"), F.lit("V"), (size % 10).cast("string"),
    )
    protein = F.when(size > 40, F.lit("milk proteins")).when(size > 25, F.lit("Soy protein")).when(
        size > 12, F.lit("soy proteins")
    )
    allergen = F.when(
        size > 30, F.concat(F.lit("contains milk, "), F.element_at(words, 1), F.lit(" and traces of nuts"))
    ).when(size > 10, F.lit("Gluten; soy."))
    fat = dec(size / 2.0)
    return p.select(
        product_id.alias("product_id"),
        F.concat_ws(" ", F.col("p_name"), F.lower("p_type")).alias("product_name"),
        F.concat((size + 10).cast("string"), F.lit(" g")).alias("portion_size"),
        F.concat_ws(", ", words).alias("ingredients_raw"),
        F.array_append(words, F.lower("p_type")).alias("ingredients_list"),
        allergen.alias("allergens"),
        protein.alias("protein_source"),
        F.concat(F.lit("sheet_"), key.cast("string"), F.lit(".txt")).alias("source_file"),
        F.when(size > 5, dec(price / 5)).alias("kcal_100g"),
        F.when(size > 5, dec(price * 4 / 5)).alias("kj_100g"),
        fat.alias("matieres_grasses_100g"),
        fat.alias("lipides_100g"),
        dec(size / 6.0).alias("acides_gras_satures_100g"),
        dec(size * 1.2).alias("glucides_100g"),
        F.when(size > 3, dec(size / 4.0)).alias("sucres_100g"),
        dec(size * 0.3).alias("amidon_100g"),
        dec((50 - size) / 10.0).alias("fibres_100g"),
        F.when(size < 48, dec((50 - size) / 2.0)).alias("proteines_100g"),
        dec(size / 50.0).alias("sel_100g"),
        F.timestamp_add("HOUR", -size, F.lit("2024-01-31 00:00:00").cast("timestamp")).alias("updated_at"),
    )


def sheet_view(spark: SparkSession, folder: str) -> DataFrame:
    """Sheet text per product: the values of ``recipe_view`` written out as a two-page document."""
    r = recipe_view(spark, folder)

    def line(label: str, c: str) -> Column:
        number = F.replace(F.col(c).cast("string"), F.lit("."), F.lit(","))
        return F.concat(F.lit(f"{label} "), number, F.lit(" "), number)  # null values leave no line

    first = F.concat_ws(
        "\n",
        F.lit("TECHNICAL DATA SHEET / FICHE TECHNIQUE"),
        F.col("product_name"),
        F.lit("Préparation hyperprotéinée"),
        F.col("product_id"),
        F.concat(F.lit("Serving size : 1 packet = 2 wafers : "), F.regexp_replace("portion_size", " g", ",5 g.")),
        F.lit("AVERAGE NUTRITIONAL VALUES / VALEURS NUTRITIONNELLES MOYENNES"),
        line("Kcal", "kcal_100g"), line("KJ", "kj_100g"),
        line("Matières grasses (g)", "matieres_grasses_100g"), line("Lipides (g)", "lipides_100g"),
        line("dont acides gras saturés (g)", "acides_gras_satures_100g"),
        line("Glucides (g)", "glucides_100g"), line("dont sucres (g)", "sucres_100g"),
        line("dont amidon (g)", "amidon_100g"), line("Fibres alimentaires (g)", "fibres_100g"),
        line("Protéines (g)", "proteines_100g"), line("Sel (g)", "sel_100g"),
    )
    second = F.concat_ws(
        "\n",
        F.lit("INGREDIENTS / INGRÉDIENTS"),
        F.concat(F.col("ingredients_raw"), F.lit(" (sugar, salt 2%), "), F.coalesce("protein_source", F.lit("water")),
                 F.lit("; cocoa and vanilla 3%.")),
        F.lit(""),
        F.lit("Farine, sucre."),
        F.lit("ALLERGENS / ALLERGÈNES"),
        F.concat(F.coalesce("allergens", F.lit("none")), F.lit(" (see in bold). Manufactured on shared equipment")),
        F.lit("CLAIMS / ALLÉGATIONS"),
        F.lit("High protein"),
    )
    pages = F.array(F.struct(F.lit(1).alias("page"), first.alias("text")), F.struct(F.lit(2).alias("page"), second.alias("text")))
    return r.select("source_file", F.inline(pages))
