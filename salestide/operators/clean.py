"""Cleaning of raw invoice lines: parse, filter, derive, repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salestide.functions.calendar import with_fiscal_calendar
from salestide.functions.numeric import total
from salestide.functions.ordering import exact_percentiles
from salestide.session import durable
from salestide.sources.schema import CLEAN_COLUMNS, HEADER_CANDIDATES, resolve_columns

# Two-letter client prefixes that are countries; two digits mean FR.
COUNTRY_PREFIXES = [
    "AE", "AT", "AU", "BE", "BG", "BR", "CA", "CH", "CL", "CR", "CZ", "DE", "DK", "ES", "GB", "GR", "HR",
    "HU", "IE", "IN", "IT", "LT", "LU", "MK", "NL", "NO", "PL", "PT", "RO", "RS", "SA", "SE", "SK", "UY",
]
# Accounting columns that are not kept, families that are not sales.
ACCOUNTING_COLUMNS = ["Code Group", "Cpt Compta", "Cpte vente"]
EXCLUDED_FAMILIES = ["LIQ", "DEVL", "ZDIV"]
# Accepted date shapes, year first or day first, with an optional time.
TIME_PART = r"(?:[T ]+\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?\s*(?:Z|[+-]\d{2}:?\d{2})?)?"
DATE_PART = rf"^\s*(\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}|\d{{1,2}}[-/.]\d{{1,2}}[-/.](?:\d{{4}}|\d{{2}})){TIME_PART}\s*$"
DATES = ["invoice_date", "order_date", "ship_date", "planned_date"]
NUMBERS = ["qty", "amount", "unit_price"]
#: rows of a broadcast table of articles, some 100 bytes each
MOST_BROADCAST = 500_000


def country_of(client_id: Column) -> Column:
    prefix = F.substring(client_id, 1, 2)
    return (
        F.when(prefix.rlike("^[0-9]{1,2}$"), "FR").when(prefix.isin(COUNTRY_PREFIXES), prefix).otherwise("Unknown")
    )


def parse_date(c: Column) -> Column:
    """Date of a text, year first (ISO) or day first, with or without a time; null for anything else.

    Two-digit years from 69 on belong to the last century.
    """
    none = F.lit(0)

    def read(parts: Column) -> Column:
        # a first part of four digits is a year
        first, middle, last = [F.get(parts, F.lit(k)).try_cast("int") for k in range(3)]
        iso, short = F.length(F.get(parts, F.lit(0))) == 4, F.length(F.get(parts, F.lit(2))) == 2
        century = F.when(short, F.when(last < 69, 2000).otherwise(1900)).otherwise(0)
        return F.try_make_timestamp(F.when(iso, first).otherwise(last + century), middle, F.when(iso, last).otherwise(first), none, none, none)

    # one look at the text; its parts are named once
    written = F.array(F.split(F.regexp_extract(c, DATE_PART, 1), "[-/.]"))
    return F.to_date(F.element_at(F.transform(written, read), 1))


def unparsed_dates(raw: DataFrame) -> DataFrame:
    """(column, texts, unparsed): how many texts of each date column are no date; blank ones don't count."""
    named = _named(raw)
    known = [c for c in DATES if c in named.columns]
    told = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != ""
    one = named.agg(*[F.struct(F.lit(c).alias("column"), F.count_if(told(c)).alias("texts"),
                               F.count_if(told(c) & parse_date(F.col(c).cast("string")).isNull()).alias("unparsed")).alias(c) for c in known])
    return one.select(F.inline(F.array(*known)))


def parse_types(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {**{c: parse_date(F.col(c)) for c in DATES if c in df.columns},
         **{c: F.col(c).try_cast("double") for c in NUMBERS if c in df.columns}}
    )


def drop_accounting(df: DataFrame) -> DataFrame:
    return df.drop(*ACCOUNTING_COLUMNS)


def recipe_code(article: Column) -> Column:
    """The second ``letter + 3 digits`` group of an article code, else the first."""
    codes = F.regexp_extract_all(article, F.lit("[A-Z][0-9]{3}"), F.lit(0))
    return F.coalesce(F.try_element_at(codes, F.lit(2)), F.try_element_at(codes, F.lit(1)))


def with_article_label(df: DataFrame) -> DataFrame:
    """``label_1`` as first recorded for the article, by order date (undated orders last)."""
    named = F.when(
        F.col("label_1").isNotNull(), F.struct(F.col("order_date").isNull(), F.col("order_date"), F.col("label_1"))
    )
    first = df.where(F.col("article_code").isNotNull()).groupBy("article_code").agg(
        F.min_by("label_1", named).alias("_label")
    )
    return df.join(first, "article_code", "left").withColumn("label_1", F.col("_label")).drop("_label")


def exclude_families(df: DataFrame, families: list[str] | None = None) -> DataFrame:
    unwanted = F.col("family").isin(EXCLUDED_FAMILIES if families is None else families)
    return df.where(~F.coalesce(unwanted, F.lit(False)))


def drop_undated(df: DataFrame) -> DataFrame:
    return df.where(F.col("invoice_date").isNotNull())


def duplicate_count(df: DataFrame) -> DataFrame:
    """Surplus copies of identical rows."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("c")).agg(
        F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicates")
    )


def with_lead_times(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"lead_time_days": F.date_diff("ship_date", "order_date"), "planned_days": F.date_diff("planned_date", "order_date")}
    ).withColumn("lead_time_deviation", F.col("lead_time_days") - F.col("planned_days"))


def with_reference_price(df: DataFrame) -> DataFrame:
    """Median positive price of the article, else of the family."""
    # one scan gives the counts that both medians start from
    priced = durable(
        df.where(F.col("unit_price") > 0).groupBy("article_code", "family", "unit_price").agg(F.count("*").alias("n"))
    )
    median = lambda key, name: exact_percentiles(
        priced.where(F.col(key).isNotNull()), [key], "unit_price", {name: 0.5}, weight="n"
    )
    # the lines meet one small table per (article, family): the family's price travels with it
    pairs = df.select("article_code", "family").distinct()
    prices = pairs.join(median("article_code", "_pa"), "article_code", "left").join(median("family", "_pf"), "family", "left").select(
        F.coalesce("article_code", F.lit("")).alias("_a"), F.coalesce("family", F.lit("")).alias("_f"), F.coalesce("_pa", "_pf").alias("reference_price"),
        F.col("article_code").isNull().alias("_na"), F.col("family").isNull().alias("_nf"),
    )
    keyed = df.withColumns({
        "_a": F.coalesce("article_code", F.lit("")), "_f": F.coalesce("family", F.lit("")),
        "_na": F.col("article_code").isNull(), "_nf": F.col("family").isNull(),
    })
    return keyed.join(prices, ["_a", "_f", "_na", "_nf"], "left").drop("_a", "_f", "_na", "_nf")


def repair_negatives(df: DataFrame) -> DataFrame:
    """A negative quantity, amount or price is rebuilt from the other two, in this order."""
    q, a, p = F.col("qty"), F.col("amount"), F.col("unit_price")
    return (
        df.withColumn("qty", F.when((q < 0) & (a >= 0) & (p > 0), F.try_divide(a, p)).otherwise(q))
        .withColumn("amount", F.when((a < 0) & (q >= 0) & (p >= 0), q * p).otherwise(a))
        .withColumn("unit_price", F.when((p < 0) & (a >= 0) & (q > 0), F.try_divide(a, q)).otherwise(p))
    )


def drop_negatives(df: DataFrame) -> DataFrame:
    bad = lambda c: F.coalesce(F.col(c) < 0, F.lit(False))
    return df.where(~bad("qty") & ~bad("amount"))


def settle_price(df: DataFrame) -> DataFrame:
    """Price from amount and quantity when missing, negative, or when that is ten times nearer the reference."""
    q, a, p, ref = F.col("qty"), F.col("amount"), F.col("unit_price"), F.col("reference_price")
    implied = F.try_divide(a, q)
    now, then = F.abs(p - ref), F.abs(implied - ref)
    nearer = ref.isNotNull() & then.isNotNull() & (now.isNull() | (then + 0.05 < now * 0.1))
    wrong = (a >= 0) & (q > 0) & (p.isNull() | (p < 0) | nearer)
    return df.withColumn("unit_price", F.when(wrong, implied).otherwise(p))


def settle_amount(df: DataFrame) -> DataFrame:
    """Amount from quantity and price when missing, negative, not close, or more than 1 % off."""
    q, a, p = F.col("qty"), F.col("amount"), F.col("unit_price")
    due = q * p
    gap = F.abs(a - due)
    off = (gap > 0.05 + 1e-6 * F.abs(due)) | (F.try_divide(gap, F.greatest(F.abs(due), F.lit(1.0))) > 0.01)
    wrong = (q > 0) & (p > 0) & (a.isNull() | (a < 0) | off)
    return df.withColumn("amount", F.when(wrong, due).otherwise(a))


def settle_quantity(df: DataFrame) -> DataFrame:
    q, a, p = F.col("qty"), F.col("amount"), F.col("unit_price")
    wrong = (a >= 0) & (p > 0) & (q.isNull() | (q < 0))
    return df.withColumn("qty", F.when(wrong, F.try_divide(a, p)).otherwise(q))


def final_columns(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in CLEAN_COLUMNS if c in df.columns])


def _named(raw: DataFrame) -> DataFrame:
    headers = {k: v for k, v in HEADER_CANDIDATES.items() if k != "country"}
    return resolve_columns(drop_accounting(raw), headers)


def prepare(raw: DataFrame) -> DataFrame:
    """Names, types, country and recipe code; no row is dropped yet."""
    return (
        parse_types(_named(raw))
        .withColumn("country", country_of(F.col("client_id")))
        .withColumn("recipe_code", recipe_code(F.col("article_code")))
    )


def article_table(df: DataFrame, kept: Column) -> DataFrame:
    """(article_code, family, lines, label, reference_price): what ``with_article_label`` finds on all rows and
    ``with_reference_price`` on those ``kept``, from one scan.

    The scan leaves one row per article, family and price, with the first label
    and the number of lines; all else is folded from those.
    """
    named = F.when(F.col("label_1").isNotNull(), F.struct(F.col("order_date").isNull().alias("late"), "order_date", F.col("label_1").alias("name")))
    priced = kept & F.coalesce(F.col("unit_price") > 0, F.lit(False))
    states = durable(
        df.select("article_code", "family", F.when(priced, F.col("unit_price")).alias("unit_price"), named.alias("first"), kept.alias("kept"))
        .groupBy("article_code", "family", "unit_price").agg(F.min("first").alias("first"), F.count_if("kept").alias("n"))
    )
    labels = states.where("article_code is not null").groupBy("article_code").agg(F.min("first")["name"].alias("label"))
    counts = states.where("unit_price is not null")
    median = lambda key, name: exact_percentiles(counts.where(F.col(key).isNotNull()), [key], "unit_price", {name: 0.5}, weight="n")
    pairs = states.groupBy("article_code", "family").agg(F.sum("n").alias("lines")).where("lines > 0")
    return pairs.join(labels, "article_code", "left").join(median("article_code", "_pa"), "article_code", "left").join(
        median("family", "_pf"), "family", "left"
    ).select("article_code", "family", "lines", "label", F.coalesce("_pa", "_pf").alias("reference_price"))


def with_article_table(df: DataFrame, table: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``df`` with the label and the reference price of its (article, family).

    A table of at most ``most`` rows is broadcast; of a larger one only the
    pairs that stand on most lines, so that none of the rest is hot when it is
    joined by a shuffle.
    """
    table = durable(table)
    side = table.select(
        F.col("article_code").alias("_a"), F.col("family").alias("_f"), "lines", F.struct("label", "reference_price").alias("_t")
    )
    rows = df.drop("label_1")
    match = lambda t: F.col("article_code").eqNullSafe(t["_a"]) & F.col("family").eqNullSafe(t["_f"])
    told = table.agg(F.count("*").alias("n"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines")).first()
    if told["n"] <= most:
        met = rows.join(F.broadcast(side.drop("lines")), match(side), "left").drop("_a", "_f")
    else:
        limit = told["lines"] // most + 1
        often, rare = side.where(F.col("lines") > limit).drop("lines"), side.where(F.col("lines") <= limit).drop("lines")
        looked = rows.join(F.broadcast(often), match(often), "left").drop("_a", "_f")
        rest = looked.where("_t is null").drop("_t")
        met = looked.where("_t is not null").unionByName(rest.join(rare, match(rare), "left").drop("_a", "_f"))
    return met.withColumns({"label_1": F.col("_t.label"), "reference_price": F.col("_t.reference_price")}).drop("_t")


def clean(raw: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """The whole pipeline from raw headers to the canonical table; the input is read twice."""
    d = prepare(raw)
    unwanted = F.col("family").isin(EXCLUDED_FAMILIES if excluded is None else excluded)
    kept = ~F.coalesce(unwanted, F.lit(False)) & F.col("invoice_date").isNotNull()
    return (
        d.where(kept)
        .withColumn("ref_date", F.col("invoice_date"))
        .transform(with_fiscal_calendar)
        .transform(with_lead_times)
        .transform(with_article_table, article_table(d, kept))
        .transform(repair_negatives)
        .transform(drop_negatives)
        .transform(settle_price)
        .transform(settle_amount)
        .transform(settle_quantity)
        .transform(final_columns)
    )


def step_log(raw: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """Rows before and after each dropping step, from one pass over the data."""
    d = repair_negatives(prepare(raw))
    family = ~F.coalesce(F.col("family").isin(EXCLUDED_FAMILIES if excluded is None else excluded), F.lit(False))
    dated = family & F.col("invoice_date").isNotNull()
    kept = dated & ~F.coalesce((F.col("qty") < 0) | (F.col("amount") < 0), F.lit(False))
    counted = d.agg(F.count("*").alias("n0"), F.count_if(family).alias("n1"), F.count_if(dated).alias("n2"), F.count_if(kept).alias("n3"))
    steps = F.array(
        *[F.struct(F.lit(i).alias("position"), F.lit(s).alias("step"), F.col(f"n{i - 1}").alias("before"), F.col(f"n{i}").alias("after"),
                   (F.col(f"n{i}") - F.col(f"n{i - 1}")).alias("delta")) for i, s in ((1, "families"), (2, "undated"), (3, "negatives"))]
    )
    return counted.select(F.inline(steps))


def sign_profile(df: DataFrame, columns: list[str] = tuple(NUMBERS)) -> DataFrame:
    """Null, negative, zero and positive counts of the money columns."""
    one = df.agg(
        *[F.struct(F.count_if(F.col(c).isNull()).alias("nulls"), F.count_if(F.col(c) < 0).alias("negatives"),
                   F.count_if(F.col(c) == 0).alias("zeros"), F.count_if(F.col(c) > 0).alias("positives")).alias(c) for c in columns]
    )
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns])
    return one.select(F.inline(rows)).select("column", "s.*")


def ratio_examples(df: DataFrame) -> DataFrame:
    """Lines with all three money values usable, and amount over quantity × price."""
    return df.where("amount >= 0 and qty > 0 and unit_price > 0").withColumn(
        "theoretical", F.col("qty") * F.col("unit_price")
    ).withColumn("ratio", F.try_divide("amount", "theoretical"))


def ratio_signatures(df: DataFrame) -> DataFrame:
    """Lines per signature: about 1, about 0.001, other; and how many are below 0.01."""
    near = lambda x, tol: F.abs(F.col("ratio") - x) <= tol + 1e-5 * x
    signature = F.when(near(0.001, 0.0002), "~0.001").when(near(1.0, 0.01), "~1").otherwise("other")
    return ratio_examples(df).groupBy(signature.alias("signature")).agg(
        F.count("*").alias("lines"), F.count_if(F.col("ratio") < 0.01).alias("suspicious")
    )


def changed_rows(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows whose values differ between two versions, by unique row key."""
    b = before.select(key, *[F.col(c).alias(f"{c}_before") for c in columns])
    a = after.select(key, *[F.col(c).alias(f"{c}_after") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"{c}_before").eqNullSafe(F.col(f"{c}_after"))
    return b.join(a, key, "left").where(~same)


def settle_totals(df: DataFrame) -> DataFrame:
    """Amount before and after the coherence steps, and the sum of quantity × price after them."""
    d = df.withColumn("_before", F.col("amount"))
    after = settle_quantity(settle_amount(settle_price(d)))
    return after.agg(
        total("_before").alias("amount_before"), total("amount").alias("amount_after"),
        total(F.col("qty") * F.col("unit_price")).alias("theoretical"),
    )
