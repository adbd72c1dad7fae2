"""The full client profile, computed for all clients at once.

Every block returns rows keyed by ``client_id``; a single client is a filter on
the result or on the input (``one_client``).  Orders are the unit of most
blocks: ``client_orders`` builds them once.  Windows run over the calendar of a
client (days or periods), never over its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salestide.functions.calendar import period_ordinal, with_period
from salestide.functions.numeric import pct, ratio, total, weighted_price
from salestide.functions.ordering import day_percentiles, exact_percentiles
from salestide.session import durable

OTHERS = "Autres"
MISSING = "Non renseigné"
DATE = "order_date"


def one_client(df: DataFrame, client_id: str, families: list[str] | None = None) -> DataFrame:
    out = df.where(F.col("client_id") == client_id)
    return out.where(F.col("family").isin(families)) if families else out


def with_order_key(df: DataFrame, row_key: str | None = None) -> DataFrame:
    """Order id, or a key of the line itself when the id is blank.

    Without ``row_key`` the key is a hash of the line's columns, the same in
    every branch and every retry; lines that are equal in all columns are then
    one order.
    """
    given = F.nullif(F.trim("order_id"), F.lit(""))
    own = F.col(row_key).cast("string") if row_key else F.hex(F.xxhash64(*[x for c in df.columns for x in (F.col(c).isNull(), F.col(c))]))
    return df.withColumn("order_key", F.coalesce(given, F.concat(F.lit("line:"), own)))


def _late(df: DataFrame) -> Column:
    """Late mark of a line by the first source present: flag, else deviation > 0."""
    if "late_flag" in df.columns:
        return F.col("late_flag").cast("int")
    if "lead_time_deviation" in df.columns:
        return F.coalesce((F.col("lead_time_deviation") > 0).cast("int"), F.lit(0))
    return F.lit(None).cast("int")


def _lead(df: DataFrame) -> Column:
    if "lead_time_days" in df.columns:
        return F.col("lead_time_days")
    return F.date_diff("delivery_date", DATE)


def client_orders(df: DataFrame) -> DataFrame:
    """One row per (client, order): revenue, first date, median lead time, late mark.

    The median runs over the lines of one order.  Without a flag or deviation
    the order is late when its lead time exceeds its target.
    """
    d = df if "order_key" in df.columns else with_order_key(df)
    target = (
        F.median("lead_time_target") if "lead_time_target" in d.columns else F.lit(None).cast("double")
    )
    out = (
        d.withColumns({"_late": _late(d), "_lead": _lead(d)})
        .groupBy("client_id", "order_key")
        .agg(
            F.coalesce(F.sum("amount"), F.lit(0)).alias("amount"), F.count("*").alias("lines"),
            F.min(DATE).alias("order_date"), F.median("_lead").alias("lead_time"),
            F.max("_late").alias("_late"), target.alias("_target"),
        )
    )
    by_target = F.when(
        F.col("lead_time").isNotNull() & (F.col("_target") > 0),
        (F.col("lead_time") > F.col("_target")).cast("int"),
    )
    return out.withColumn("late", F.coalesce("_late", by_target)).drop("_late", "_target")


def order_measures(orders: DataFrame) -> DataFrame:
    """All measures of a client that are plain aggregates of its orders, from one grouping."""
    told = orders.agg(F.struct(F.sum("amount").alias("amount"), F.max("order_date").alias("day")).alias("s"))
    whole, last_day = told.select("s.amount").scalar(), told.select("s.day").scalar()
    return orders.groupBy("client_id").agg(
        total("amount").alias("revenue"), F.sum("lines").alias("lines"), F.count("*").alias("orders"),
        F.min("order_date").alias("first_date"), F.max("order_date").alias("last_date"), F.avg("late").alias("late_rate"),
    ).withColumns(
        {"weight_pct": pct("revenue", whole), "revenue_per_order": ratio("revenue", "orders"), "mean_line": ratio("revenue", "lines"),
         "recency_days": F.date_diff(last_day, "last_date"), "lifetime_days": F.date_diff("last_date", "first_date")}
    ).drop("first_date", "last_date")


def base_kpis(orders: DataFrame) -> DataFrame:
    """Revenue, weight in the total, lines, orders, revenue per order, mean line."""
    return order_measures(orders).drop("late_rate", "recency_days", "lifetime_days")


def recency(orders: DataFrame) -> DataFrame:
    return order_measures(orders).select("client_id", "recency_days", "lifetime_days")


def _order_days(orders: DataFrame) -> DataFrame:
    """(client, day, number of orders): at most one row per calendar day."""
    return orders.where("order_date is not null").groupBy("client_id", "order_date").agg(
        F.count("*").alias("n")
    )


def order_rhythm(orders: DataFrame, grain: str = "month") -> DataFrame:
    """Orders per spanned period, median and P90 of the days between orders (whole days).

    Orders of one day are 0 days apart, so gaps come from the day counts.
    """
    days = _order_days(orders)
    w = Window.partitionBy("client_id").orderBy("order_date")
    gaps = days.withColumn("gap", F.date_diff("order_date", F.lag("order_date").over(w)))
    weighted = gaps.select(
        "client_id", F.inline(F.array(
            F.struct(F.lit(0).alias("gap"), (F.col("n") - 1).alias("c")),
            F.struct(F.col("gap").alias("gap"), F.lit(1).cast("long").alias("c")),
        ))
    ).where("gap is not null and c > 0").groupBy("client_id", "gap").agg(F.sum("c").alias("c"))
    spread = weighted.groupBy("client_id").agg(
        F.floor(F.round(F.percentile("gap", F.lit(0.5), F.col("c")), 6)).alias("median_gap"),
        F.floor(F.round(F.percentile("gap", F.lit(0.9), F.col("c")), 6)).alias("p90_gap"),
    )
    span = (
        period_ordinal(F.max("order_date"), grain) - period_ordinal(F.min("order_date"), grain) + 1
    )
    per = days.groupBy("client_id").agg(ratio(F.sum("n"), span).alias("orders_per_period"))
    return per.join(spread, "client_id", "left")


def lead_times(orders: DataFrame) -> DataFrame:
    """Median and P90 (two orders needed) of the lead times of the orders."""
    p = day_percentiles(
        orders, ["client_id"], {"lead_time_median": ("lead_time", 0.5), "lead_time_p90": ("lead_time", 0.9)}
    )
    n = orders.groupBy("client_id").agg(F.count("lead_time").alias("_n"))
    return n.join(p, "client_id", "left").select(
        "client_id", "lead_time_median", F.when(F.col("_n") >= 2, F.col("lead_time_p90")).alias("lead_time_p90")
    )


def late_rate(orders: DataFrame) -> DataFrame:
    return order_measures(orders).select("client_id", "late_rate")


def main_country(df: DataFrame) -> DataFrame:
    """Most frequent country of each client; ties go to the first name."""
    return (
        df.where("country is not null").groupBy("client_id", "country").agg(F.count("*").alias("n"))
        .groupBy("client_id").agg(F.min_by("country", F.struct(-F.col("n"), F.col("country"))).alias("country"))
    )


def _shares(df: DataFrame, entity: Column, n: int | None, name: str) -> DataFrame:
    """Entities of each client with revenue, rank and share of the client's total."""
    sums = df.groupBy("client_id", entity.alias(name)).agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("_v"))
    whole = sums.groupBy("client_id").agg(F.sum("_v").alias("_t"))
    w = Window.partitionBy("client_id").orderBy(F.desc("_v"), name)
    ranked = sums.withColumn("rank", F.row_number().over(w))
    if n is not None:
        ranked = ranked.where(F.col("rank") <= n)
    return ranked.join(whole, "client_id").select(
        "client_id", name, "rank", F.col("_v").cast("double").alias("revenue"),
        pct("_v", F.nullif("_t", F.lit(0))).alias("share_pct"),
    )


def currency_mix(df: DataFrame, n: int = 10) -> DataFrame:
    return _shares(df.where("currency is not null"), F.col("currency"), n, "currency")


def pricing(df: DataFrame) -> DataFrame:
    """Quantity-weighted mean, exact median and variation of the unit price."""
    p = F.col("unit_price")
    base = df.groupBy("client_id").agg(
        weighted_price().alias("price_weighted"), F.avg(p).alias("_mean"), F.stddev_samp(p).alias("_std"),
        F.count(p).alias("_n"),
    )
    cv = F.when(
        (F.col("_n") >= 2) & (F.col("price_weighted") != 0), ratio("_std", F.abs("_mean"))
    )
    median = exact_percentiles(df, ["client_id"], "unit_price", {"price_median": 0.5})
    return base.withColumn("price_cv", cv).drop("_mean", "_std", "_n").join(median, "client_id", "left")


def family_portfolio(df: DataFrame, n: int = 8) -> DataFrame:
    """The n leading families of each client and one row for the rest (if it sold anything)."""
    family = F.coalesce("family", F.lit(MISSING))
    sums = df.groupBy("client_id", family.alias("family")).agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("_v"))
    w = Window.partitionBy("client_id").orderBy(F.desc("_v"), "family")
    place = F.least(F.row_number().over(w), F.lit(n + 1))
    bucketed = sums.withColumn("rank", place).groupBy("client_id", "rank").agg(
        F.sum("_v").alias("_v"), F.min("family").alias("_f")
    )
    whole = sums.groupBy("client_id").agg(F.sum("_v").alias("_t"))
    return bucketed.where((F.col("rank") <= n) | (F.col("_v") > 0)).join(whole, "client_id").select(
        "client_id", "rank", F.when(F.col("rank") > n, OTHERS).otherwise(F.col("_f")).alias("family"),
        F.col("_v").cast("double").alias("revenue"), pct("_v", F.nullif("_t", F.lit(0))).alias("share_pct"),
    )


def family_concentration(df: DataFrame, scale: float = 1.0) -> DataFrame:
    """Number of families, share of the first and concentration index over all of them."""
    sums = df.groupBy("client_id", F.coalesce("family", F.lit(MISSING)).alias("family")).agg(
        F.coalesce(F.sum("amount"), F.lit(0)).cast("double").alias("v")
    )
    # sum of squared shares = sum of squares over squared sum: one aggregate, no join
    return sums.groupBy("client_id").agg(
        F.count("*").alias("families"), pct(F.max("v"), F.sum("v")).alias("top1_share_pct"),
        (ratio(F.sum(F.col("v") * F.col("v")), F.sum("v") * F.sum("v")) * scale).alias("hhi"),
    )


def family_mix(df: DataFrame, grain: str, n: int = 8) -> DataFrame:
    """Revenue per period of the client's n leading families, the rest as one bucket, with shares."""
    d = with_period(df, grain, DATE).withColumn("family", F.coalesce("family", F.lit(MISSING)))
    sums = d.groupBy("client_id", "period", "period_index", "family").agg(F.sum("amount").alias("_v"))
    top = sums.groupBy("client_id", "family").agg(F.sum("_v").alias("_t"))
    w = Window.partitionBy("client_id").orderBy(F.desc("_t"), "family")
    leading = top.withColumn("_p", F.row_number().over(w)).where(F.col("_p") <= n).select("client_id", "family", "_p")
    bucket = F.when(F.col("_p").isNull(), OTHERS).otherwise(F.col("family"))
    mixed = sums.join(leading, ["client_id", "family"], "left").groupBy(
        "client_id", "period", "period_index", bucket.alias("family")
    ).agg(total("_v").alias("revenue"))
    # at most n + 1 rows per client and period
    whole = F.sum("revenue").over(Window.partitionBy("client_id", "period"))
    return mixed.withColumn("share_pct", pct("revenue", whole))


def top_products(df: DataFrame, product: str = "recipe_code", n: int = 10) -> DataFrame:
    return _shares(df, F.coalesce(F.col(product), F.lit(MISSING)), n, "product")


def product_lead_times(df: DataFrame, orders: DataFrame, product: str = "recipe_code", n: int = 10) -> DataFrame:
    """Orders, lead time (weighted by lines), late share and revenue per product; the n best by revenue."""
    lines = with_order_key(df) if "order_key" not in df.columns else df
    # lines of one order and product are merged before they meet the orders
    pairs = lines.groupBy(
        "client_id", "order_key", F.coalesce(F.col(product), F.lit(MISSING)).alias("product")
    ).agg(F.count("*").alias("c"), F.sum("amount").alias("_v"))
    joined = pairs.join(orders.select("client_id", "order_key", "lead_time", "late"), ["client_id", "order_key"])
    known = F.col("lead_time").isNotNull()
    base = joined.groupBy("client_id", "product").agg(
        F.count_if(known).alias("orders"), (F.avg(F.when(known, F.col("late"))) * 100).alias("late_pct"),
        total("_v").alias("revenue"), F.sum(F.when(known, F.col("c"))).alias("_lines"),
    ).where("orders > 0")
    spread = (
        joined.where(known).groupBy("client_id", "product", "lead_time").agg(F.sum("c").alias("c"))
        .groupBy("client_id", "product")
        .agg(F.percentile("lead_time", F.lit(0.5), F.col("c")).alias("lead_time_median"),
             F.percentile("lead_time", F.lit(0.9), F.col("c")).alias("_p90"))
    )
    w = Window.partitionBy("client_id").orderBy(F.desc("revenue"), "product")
    best = base.withColumn("_p", F.row_number().over(w)).where(F.col("_p") <= n)
    return best.join(spread, ["client_id", "product"]).select(
        "client_id", "product", "orders", "lead_time_median",
        F.when(F.col("_lines") >= 2, F.col("_p90")).alias("lead_time_p90"), "late_pct", "revenue",
    )


def period_summary(df: DataFrame, orders: DataFrame, grain: str) -> DataFrame:
    """Revenue, orders, weighted price, and lead times of the orders that start in the period."""
    lines = with_order_key(df) if "order_key" not in df.columns else df
    keys = ["client_id", "period", "period_index"]
    d = with_period(lines, grain, DATE)
    sums = d.groupBy(*keys).agg(total("amount").alias("revenue"), weighted_price().alias("price_weighted"),
                                F.count_distinct("order_key").alias("orders"))
    o = with_period(orders, grain, "order_date")
    spread = day_percentiles(
        o, keys, {"median_lead_time": ("lead_time", 0.5), "p90_lead_time": ("lead_time", 0.9)}
    ).join(o.groupBy(*keys).agg(F.count("lead_time").alias("_n")), keys).withColumn(
        "p90_lead_time", F.when(F.col("_n") >= 2, F.col("p90_lead_time"))
    ).drop("_n")
    return sums.join(spread, keys, "left")


def family_prices(df: DataFrame, grain: str) -> DataFrame:
    """Weighted price and revenue by family and period over lines with price and quantity."""
    d = with_period(df, grain, DATE).where("unit_price is not null and qty > 0")
    return d.groupBy(
        "client_id", "period", "period_index", F.coalesce("family", F.lit(MISSING)).alias("family")
    ).agg(weighted_price().alias("price_weighted"), total("amount").alias("revenue"))


def gap_after_lead_time(orders: DataFrame) -> DataFrame:
    """Days to the next order after slow orders (lead time >= P75) against the others.

    Needs 4 orders; orders of one day follow each other in key order, so all
    but the last of a day have a gap of 0.
    """
    o = orders.where("order_date is not null and lead_time is not null")
    days = o.groupBy("client_id", "order_date").agg(F.max("order_key").alias("_last"))
    following = F.lead("order_date").over(Window.partitionBy("client_id").orderBy("order_date"))
    days = days.withColumn("_next", following)
    gap = F.when(F.col("order_key") < F.col("_last"), F.lit(0)).otherwise(F.date_diff("_next", "order_date"))
    withgap = (
        o.join(days, ["client_id", "order_date"]).withColumn("gap", gap).where("gap is not null")
        .groupBy("client_id", "lead_time", "gap").agg(F.count("*").alias("c"))
    )
    bounds = withgap.groupBy("client_id").agg(
        F.percentile("lead_time", F.lit(0.75), F.col("c")).alias("high_threshold"), F.sum("c").alias("_n"),
        (F.min("lead_time") < F.max("lead_time")).alias("_varied"),
    ).where("_n >= 3 and _varied")
    high = F.col("lead_time") >= F.col("high_threshold")

    def half(mask: Column, name: str) -> list[Column]:
        n = F.coalesce(F.sum(F.when(mask, F.col("c"))), F.lit(0))
        middle = F.percentile(F.when(mask, F.col("gap")), F.lit(0.5), F.col("c"))
        return [n.alias(f"orders_{name}"), F.when(n >= 2, middle).alias(f"gap_{name}")]

    return (
        withgap.join(bounds, "client_id").groupBy("client_id", "high_threshold")
        .agg(*half(high, "high"), *half(~high, "low"))
        .withColumn("gap_delta", F.col("gap_high") - F.col("gap_low"))
    )


def recent_drop(df: DataFrame, grain: str) -> DataFrame:
    """Clients with six periods whose last three made at most 70 % of the three before."""
    sums = with_period(df, grain, DATE).groupBy("client_id", "period_index").agg(F.sum("amount").alias("v"))
    back = F.row_number().over(Window.partitionBy("client_id").orderBy(F.desc("period_index")))
    last = F.sum(F.when(F.col("_b") <= 3, F.col("v"))).cast("double")
    prev = F.sum(F.when(F.col("_b").between(4, 6), F.col("v"))).cast("double")
    return sums.withColumn("_b", back).groupBy("client_id").agg(
        ((F.count("*") >= 6) & F.coalesce((prev > 0) & (F.try_divide(last, prev) <= 0.70), F.lit(False))).alias("is_dropping")
    )


def kpi_pack(df: DataFrame, grain: str = "month") -> DataFrame:
    """All indicators of a client as one row.

    All parts are keyed by client, so the joins share one partitioning.
    """
    # every part reads the lines or the orders, so both are tables of their own
    lines = durable(with_order_key(df))
    orders = durable(client_orders(lines))
    parts = [
        order_rhythm(orders, grain), lead_times(orders), main_country(lines), pricing(lines), family_concentration(lines),
        gap_after_lead_time(orders), recent_drop(lines, grain),
    ]
    out = order_measures(orders)
    for part in parts:
        out = out.join(part, "client_id", "left")
    return out


def alerts(pack: DataFrame) -> DataFrame:
    """Alert codes per client: concentration, dormant, price, lead time, late, drop."""
    rules = {
        "concentration": F.col("top1_share_pct") >= 70, "dormant": F.col("recency_days") >= 90,
        "unstable_price": F.col("price_cv") >= 0.30, "slow": F.col("lead_time_p90") >= 30,
        "late": F.col("late_rate") >= 0.20, "dropping": F.col("is_dropping"),
    }
    codes = F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules.items()]))
    return pack.select("client_id", F.array_join(codes, ",").alias("alerts"), F.size(codes).alias("n_alerts"))


def product_label(df: DataFrame, product: str = "recipe_code") -> Column:
    extra = F.nullif(F.trim(F.coalesce("label_2", F.lit(""))), F.lit(""))
    return F.trim(F.concat_ws(" — ", F.col(product), extra))


def product_years(df: DataFrame, product: str = "recipe_code") -> DataFrame:
    """Revenue and quantity by product label and fiscal year, with totals (level tells which).

    Levels: cell, product (all years), year (all products), client.
    """
    cells = df.groupBy("client_id", product_label(df, product).alias("product"), "fiscal_year").agg(
        F.sum("amount").alias("_v"), F.sum("qty").alias("_q")
    )
    c = [F.col("client_id"), F.col("product"), F.col("fiscal_year")]
    level = (
        F.when((F.grouping("product") == 0) & (F.grouping("fiscal_year") == 0), "cell")
        .when(F.grouping("product") == 0, "product").when(F.grouping("fiscal_year") == 0, "year")
        .otherwise("client")
    )
    return cells.groupingSets([c, c[:2], [c[0], c[2]], c[:1]], *c).agg(
        total("_v").alias("revenue"), total("_q").alias("qty"), level.alias("level")
    )


def product_status(df: DataFrame, product: str = "recipe_code", value: str = "amount") -> DataFrame:
    """Change of each product between the client's last two fiscal years with sales."""
    cells = df.groupBy("client_id", product_label(df, product).alias("product"), "fiscal_year").agg(
        F.sum(value).alias("_v")
    )
    years = cells.groupBy("client_id", "fiscal_year").agg(F.lit(1).alias("_one"))
    back = F.row_number().over(Window.partitionBy("client_id").orderBy(F.desc("fiscal_year")))
    last_two = years.withColumn("_b", back).groupBy("client_id").agg(
        F.max(F.when(F.col("_b") == 1, F.col("fiscal_year"))).alias("_y1"),
        F.max(F.when(F.col("_b") == 2, F.col("fiscal_year"))).alias("_y2"),
    ).where("_y2 is not null")
    pick = lambda y: F.coalesce(F.sum(F.when(F.col("fiscal_year") == F.col(y), F.col("_v"))).cast("double"), F.lit(0.0))
    per = cells.join(last_two, "client_id").groupBy("client_id", "product").agg(
        pick("_y2").alias("previous"), pick("_y1").alias("last")
    )
    change = F.col("last") - F.col("previous")
    status = (
        F.when((F.col("previous") == 0) & (F.col("last") > 0), "new")
        .when((F.col("previous") > 0) & (F.col("last") == 0), "stopped")
        .when(change > 0, "increasing").when(change < 0, "declining").otherwise("unchanged")
    )
    return per.withColumns({"change": change, "change_pct": pct(change, "previous"), "status": status})


def quarter_matrix(df: DataFrame, item: str) -> DataFrame:
    """Fiscal year-quarter × item: revenue, quantity, weighted price, and a row for the whole quarter."""
    efq = F.concat(F.col("fiscal_year").cast("string"), F.lit("-Q"), F.col("fiscal_quarter_num").cast("string"))
    ok = F.col("unit_price").isNotNull() & (F.col("qty") > 0)
    cells = df.where(F.col(item).isNotNull()).groupBy("client_id", efq.alias("efq"), F.col(item).alias("item")).agg(
        F.sum("amount").alias("_v"), F.sum("qty").alias("_q"),
        F.sum(F.when(ok, F.col("unit_price") * F.col("qty"))).alias("_px"), F.sum(F.when(ok, F.col("qty"))).alias("_pq"),
    )
    c = [F.col("client_id"), F.col("efq"), F.col("item")]
    return cells.groupingSets([c, c[:2]], *c).agg(
        (F.grouping("item") == 1).alias("is_total"), total("_v").alias("revenue"), total("_q").alias("qty"),
        F.when(F.grouping("item") == 0, ratio(F.sum("_px"), F.sum("_pq"))).alias("price_weighted"),
    )


def product_price_trend(df: DataFrame, grain: str, product: str = "recipe_code", n: int = 20) -> DataFrame:
    """Mean of the period prices and first-to-last change per product; the n dearest per client."""
    d = with_period(df, grain, DATE).where("unit_price is not null and qty > 0")
    per = d.groupBy("client_id", product_label(d, product).alias("product"), "period_index").agg(
        weighted_price().alias("p")
    )
    positive = F.when(F.col("p") > 0, F.col("period_index"))
    out = per.groupBy("client_id", "product").agg(
        F.avg("p").alias("mean_price"), F.count(positive).alias("periods"),
        F.min_by("p", positive).alias("_first"), F.max_by("p", positive).alias("_last"),
    ).withColumn(
        "change_pct", F.when(F.col("periods") >= 2, pct(F.col("_last") - F.col("_first"), "_first"))
    )
    w = Window.partitionBy("client_id").orderBy(F.desc("mean_price"), "product")
    return out.withColumn("_p", F.row_number().over(w)).where(F.col("_p") <= n).select(
        "client_id", "product", "mean_price", "periods", "change_pct"
    )


def product_prices_over_time(df: DataFrame, product: str = "recipe_code", n: int = 6, by: str = "revenue") -> DataFrame:
    """Weighted monthly price of each client's n leading products (by revenue or by active months)."""
    d = with_period(df, "month", DATE).where("unit_price is not null and qty > 0")
    per = d.groupBy("client_id", F.col(product).alias("product"), "period", "period_index").agg(
        weighted_price().alias("price_weighted"), F.sum("amount").alias("_v")
    )
    rank_value = F.sum("_v") if by == "revenue" else F.count("*")
    top = per.groupBy("client_id", "product").agg(rank_value.alias("_s"))
    w = Window.partitionBy("client_id").orderBy(F.desc("_s"), "product")
    kept = top.withColumn("_p", F.row_number().over(w)).where(F.col("_p") <= n).select("client_id", "product")
    return per.join(kept, ["client_id", "product"], "left_semi").select(
        "client_id", "product", "period", "period_index", "price_weighted", F.col("_v").cast("double").alias("revenue")
    )

