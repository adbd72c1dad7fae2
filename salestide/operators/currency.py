"""Exposure to foreign currencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salestide.functions.numeric import pct, ratio, total
from salestide.functions.ordering import globally_ranked
from salestide.session import durable

# Spellings folded into one code.
CURRENCY_FOLDS = {"€": "EUR", "EURO": "EUR", "EUROS": "EUR", "NAN": "UNKNOWN", "NONE": "UNKNOWN"}


def normal_currency(c: Column) -> Column:
    folded = F.upper(F.trim(c))
    out = F.when(folded.isNull(), F.lit("UNKNOWN"))
    for spelling, code in CURRENCY_FOLDS.items():
        out = out.when(folded == spelling, F.lit(code))
    return out.otherwise(folded)


def positive_lines(df: DataFrame) -> DataFrame:
    """Normalised currency, lines with a positive amount only."""
    return df.withColumn("currency", normal_currency(F.col("currency"))).where(F.col("amount") > 0)


def _foreign(home: str) -> Column:
    return F.col("currency") != home


def _foreign_sum(home: str) -> Column:
    return F.coalesce(F.sum(F.when(_foreign(home), F.col("amount"))).cast("double"), F.lit(0.0))


def currency_kpis(df: DataFrame, home: str = "EUR") -> DataFrame:
    """Total, sorted currency list, foreign amount and share.  The list is one entry per currency."""
    return df.agg(
        total("amount").alias("revenue"),
        F.array_join(F.array_sort(F.collect_set("currency")), ",").alias("currencies"),
        _foreign_sum(home).alias("foreign_amount"),
    ).withColumn("foreign_pct", F.coalesce(pct("foreign_amount", "revenue"), F.lit(0.0)))


def _by_currency(df: DataFrame) -> DataFrame:
    return df.groupBy("currency").agg(total("amount").alias("amount"))


def top_currencies(df: DataFrame, n: int = 5, home: str = "EUR") -> DataFrame:
    w = Window.partitionBy(F.lit(1))
    foreign = F.when(_foreign(home), F.col("amount"))
    return (
        _by_currency(df)
        .withColumns(
            {
                "pct_total": pct("amount", F.sum("amount").over(w)),
                "pct_foreign": F.when(
                    _foreign(home), F.coalesce(pct("amount", F.sum(foreign).over(w)), F.lit(0.0))
                ).otherwise(F.lit(0.0)),
            }
        )
        .orderBy(F.desc("amount"), "currency")
        .limit(n)
    )


def currency_hhi(df: DataFrame, scale: float = 10000) -> DataFrame:
    share = ratio("amount", F.sum("amount").over(Window.partitionBy(F.lit(1))))
    return _by_currency(df).withColumn("s", share).agg(
        (F.sum(F.col("s") * F.col("s")) * scale).alias("hhi")
    )


def top_foreign(df: DataFrame, entity: str, n: int = 5, home: str = "EUR") -> DataFrame:
    """Largest entities on foreign currencies, their share and the combined share."""
    foreign = df.where(_foreign(home))
    whole = foreign.agg(total("amount").alias("t")).scalar()
    top = (
        foreign.where(F.col(entity).isNotNull())
        .groupBy(F.col(entity).alias("entity")).agg(total("amount").alias("amount"))
        .orderBy(F.desc("amount"), "entity").limit(n)
    )
    # the window runs over the n kept rows
    return top.withColumn("pct_foreign", pct("amount", whole)).withColumn(
        "combined_pct", F.sum("pct_foreign").over(Window.partitionBy(F.lit(1)))
    )


def foreign_share(df: DataFrame, keys: list[str], home: str = "EUR") -> DataFrame:
    return (
        df.groupBy(*keys).agg(total("amount").alias("revenue"), _foreign_sum(home).alias("foreign"))
        .withColumn("foreign_pct", F.coalesce(pct("foreign", "revenue"), F.lit(0.0)))
        .drop("foreign")
    )


def foreign_volatility(df: DataFrame, home: str = "EUR") -> DataFrame:
    """Sample std of the monthly foreign share."""
    return foreign_share(df, ["month"], home).agg(F.stddev_samp("foreign_pct").alias("volatility"))


def currency_by_period(df: DataFrame, grain: str, date: str = "invoice_date") -> DataFrame:
    """Revenue per calendar month, quarter or year and currency, zero filled over the currencies."""
    start = F.trunc(F.col(date), {"month": "month", "quarter": "quarter", "year": "year"}[grain])
    sums = df.groupBy(start.alias("period_start"), "currency").agg(total("amount").alias("revenue"))
    codes = sums.agg(F.collect_set("currency").alias("c")).scalar()
    grid = sums.select("period_start").distinct().select("period_start", F.explode(codes).alias("currency"))
    return grid.join(sums, ["period_start", "currency"], "left").withColumn(
        "revenue", F.coalesce("revenue", F.lit(0.0))
    )


def country_currency_mix(df: DataFrame, top: int = 15) -> DataFrame:
    """Share of each currency within the largest countries."""
    sums = df.groupBy("country", "currency").agg(total("amount").alias("revenue"))
    country = sums.groupBy("country").agg(F.sum("revenue").alias("country_revenue"))
    largest = country.orderBy(F.desc("country_revenue"), "country").limit(top)
    return sums.join(largest, "country").select(
        "country", "currency", pct("revenue", "country_revenue").alias("share_pct")
    )


def foreign_client_pareto(df: DataFrame, home: str = "EUR") -> DataFrame:
    """Clients by foreign revenue with the cumulative share."""
    foreign = df.where(_foreign(home) & F.col("client_name").isNotNull())
    per = foreign.groupBy("client_name").agg(F.sum("amount").alias("amount"))
    curve = globally_ranked(per, [F.desc("amount"), F.asc("client_name")], "rank", {"running": "amount"})
    whole = curve.agg(F.sum("amount").alias("t")).scalar()
    return curve.select(
        "client_name", "rank", F.col("amount").cast("double").alias("amount"),
        pct("running", whole).alias("cum_pct"),
    )


def clients_to_80(df: DataFrame, home: str = "EUR", level: float = 80) -> DataFrame:
    """How many clients make up 80 % of the foreign revenue."""
    hit = F.when(F.col("cum_pct") >= level, F.struct("rank", "cum_pct"))
    return foreign_client_pareto(df, home).agg(F.min(hit).alias("h")).select(
        F.col("h.rank").alias("n80"), F.col("h.cum_pct").alias("n80_pct")
    )


def currency_report(df: DataFrame, home: str = "EUR") -> DataFrame:
    """Clean, then the indicators as one row.

    All are sums, so the lines are read once and merged by what the sums run
    over: a row per (currency, country, month) and one per foreign client.
    Clients times months are as many rows as lines and are not needed.
    """
    lines = positive_lines(df).withColumn("client_name", F.when(_foreign(home), F.col("client_name")))
    sets = [["currency", "country", "month"], ["currency", "client_name"]]
    sums = durable(
        lines.groupingSets(sets, "currency", "country", "month", "client_name")
        .agg(F.sum("amount").alias("amount"), F.grouping("client_name").alias("_cell"))
    )
    clean, clients = sums.where("_cell = 1"), sums.where("_cell = 0")
    return currency_kpis(clean, home).withColumns(
        {
            "hhi": currency_hhi(clean).scalar(),
            "volatility": foreign_volatility(clean, home).scalar(),
            "top5_clients_pct": top_foreign(clients, "client_name", 5, home).agg(F.max("combined_pct")).scalar(),
            "top5_countries_pct": top_foreign(clean, "country", 5, home).agg(F.max("combined_pct")).scalar(),
        }
    )
