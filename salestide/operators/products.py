"""Family and product analyses: ranking, ABC, segments, scores, grids, prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salestide.functions.calendar import with_period
from salestide.functions.numeric import banded, minmax, pct, ratio, revenue_per_unit, total
from salestide.functions.ordering import exact_percentiles, globally_ranked
from salestide.functions.quantiles import exact_quantiles
from salestide.session import durable

OTHERS = "Others"
# Cumulative share bounds of the ABC classes.
ABC_BOUNDS = [(80, "A"), (95, "B")]
# Weights of the global score.
SCORE_WEIGHTS = {"revenue": 0.45, "qty": 0.20, "price": 0.20, "service": 0.15}


def abc_class(cum_pct: Column) -> Column:
    return banded(cum_pct, ABC_BOUNDS, "C", "le")


def _measured(df: DataFrame, keys: list[str], extra: list[Column] = ()) -> DataFrame:
    """Measures per group; the keys are not null.

    Sums and day percentiles (their states hold equal values once) are one row
    per group and task before the shuffle.  Distinct counts are an aggregate of
    their own: neither sums nor states travel through its per-value groups.
    """
    late = F.coalesce((F.col("lead_time_deviation") > 0).cast("int"), F.lit(0))
    days = lambda c, p: F.percentile(F.col(c).cast("double"), F.lit(p))
    sums = df.groupBy(*keys).agg(
        total("amount").alias("revenue"), total("qty").alias("qty"), (F.avg(late) * 100).alias("late_pct"), *extra,
        days("lead_time_days", 0.5).alias("median_lead_time"), days("lead_time_deviation", 0.9).alias("p90_deviation"),
    )
    counts = df.groupBy(*keys).agg(F.count_distinct("order_id").alias("orders"), F.count_distinct("client_id").alias("clients"))
    return sums.join(counts, keys).withColumn("price", revenue_per_unit())


def _items(df: DataFrame, item: str) -> DataFrame:
    return df.where(F.col(item).isNotNull()).withColumn("item", F.col(item))


def item_stats(df: DataFrame, item: str = "family") -> DataFrame:
    """Measures per family or product with the quantity-weighted price."""
    return _measured(_items(df, item), ["item"])


def item_ranking(df: DataFrame, item: str = "family") -> DataFrame:
    """Measures with share, cumulative share, rank and ABC class."""
    exact = _measured(_items(df, item), ["item"], [F.coalesce(F.sum("amount"), F.lit(0)).alias("_exact")])
    ranked = globally_ranked(exact, [F.desc("_exact"), F.asc("item")], "rank", {"_run": "_exact"})
    whole = ranked.agg(F.sum("_exact").alias("t")).scalar()
    return (
        ranked.withColumn("share_pct", F.coalesce(pct("_exact", whole), F.lit(0.0)))
        .withColumn("cum_pct", F.coalesce(pct("_run", whole), F.lit(0.0)))
        .withColumn("abc", abc_class(F.col("cum_pct")))
        .drop("_exact", "_run")
    )


def abc_summary(ranking: DataFrame, shown: int = 20) -> DataFrame:
    """Class totals, and the totals of the first ``shown`` items listed per class."""
    position = F.row_number().over(Window.partitionBy("abc").orderBy("rank"))
    totals = ranking.groupBy("abc").agg(
        F.sum("revenue").alias("revenue"), F.count("*").alias("items"), F.sum("share_pct").alias("share_pct")
    )
    listed = (
        ranking.withColumn("_p", position).where(F.col("_p") <= shown).groupBy("abc").agg(
            F.sum("revenue").alias("shown_revenue"), F.sum("share_pct").alias("shown_share_pct")
        )
    )
    return totals.join(listed, "abc")


def price_volume_segments(df: DataFrame, item: str = "family") -> DataFrame:
    """Quadrants by the median quantity and price of the items (one value per item)."""
    stats = durable(item_stats(df, item))
    middle = exact_quantiles(stats, [], {"qty_mid": ("qty", 0.5), "price_mid": ("price", 0.5)})
    qty_mid, price_mid = [middle.select(c).scalar() for c in middle.columns]
    segment = F.concat(
        F.when(F.col("qty") >= F.col("_qm"), "HighVolume").otherwise("LowVolume"), F.lit(" x "),
        F.when(F.col("price") >= F.col("_pm"), "HighPrice").otherwise("LowPrice"),
    )
    known = F.col("qty").isNotNull() & F.col("price").isNotNull() & F.col("_pm").isNotNull()
    return (
        stats.withColumns({"_qm": qty_mid, "_pm": price_mid})
        .withColumn("segment", F.when(known, segment).otherwise("Unknown"))
        .select("item", "revenue", "qty", "price", "segment")
    )


def segment_summary(df: DataFrame, item: str = "family", preview: int = 8) -> DataFrame:
    """Segment totals with the leading items written out, the rest as a count."""
    seg = price_volume_segments(df, item)
    sums = seg.groupBy("segment").agg(F.sum("revenue").alias("revenue"), F.count("*").alias("items"))
    position = F.row_number().over(Window.partitionBy("segment").orderBy(F.desc("revenue"), "item"))
    leading = (
        seg.withColumn("_p", position).where(F.col("_p") <= preview).groupBy("segment").agg(
            F.array_sort(F.collect_list(F.struct("_p", "item"))).alias("_l")
        )
    )
    text = F.array_join(F.transform("_l", lambda s: s["item"]), ", ")
    rest = F.when(
        F.col("items") > preview,
        F.concat(F.lit("… (+"), (F.col("items") - preview).cast("string"), F.lit(")")),
    ).otherwise("")
    return sums.join(leading, "segment").select(
        "segment", "revenue", "items", F.concat(text, rest).alias("preview")
    )


def global_score(df: DataFrame, item: str = "family", n: int = 20) -> DataFrame:
    """Weighted min-max score 0..100 with its dense rank; the n best."""
    stats = durable(item_stats(df, item))
    names = ["revenue", "qty", "price", "late_pct"]
    bounds = stats.agg(
        F.struct(*[f(c).alias(f"{k}_{c}") for c in names for k, f in (("lo", F.min), ("hi", F.max))])
    ).scalar()
    b = stats.withColumn("_b", bounds)
    scaled = {c: minmax(F.col(c), F.col(f"_b.lo_{c}"), F.col(f"_b.hi_{c}")) for c in names}
    scaled["service"] = F.coalesce(1 - scaled.pop("late_pct"), F.lit(0.5))
    score = sum((F.lit(w) * scaled[k] for k, w in SCORE_WEIGHTS.items()), F.lit(0.0)) * 100
    scored = b.withColumn("score", F.round(score, 2)).drop("_b")
    # at most 10001 distinct scores
    ranks = scored.select("score").distinct().withColumn(
        "score_rank", F.dense_rank().over(Window.orderBy(F.desc("score")))
    )
    return (
        scored.join(ranks, "score").orderBy(F.desc("score"), F.desc("revenue"), "item").limit(n)
        .select("item", "revenue", "qty", "price", "late_pct", "score", "score_rank")
    )


def leaders(df: DataFrame) -> DataFrame:
    """Best family by revenue, quantity, price, worst delay, and its leading country."""
    stats = durable(item_stats(df, "family"))
    best = lambda c: F.min_by("item", F.when(F.col(c).isNotNull(), F.struct(-F.col(c), F.col("item"))))
    top = stats.agg(
        best("revenue").alias("top_revenue"), best("qty").alias("top_qty"), best("price").alias("top_price"),
        best("p90_deviation").alias("worst_delay"),
    )
    country = (
        df.where(F.col("family") == stats.agg(best("revenue")).scalar())
        .groupBy("country").agg(total("amount").alias("v"))
        .agg(F.min_by("country", F.struct(-F.col("v"), F.col("country")))).scalar()
    )
    return top.withColumn("dominant_country", country)


def item_series(df: DataFrame, item: str, grain: str) -> DataFrame:
    """Measures per item and period."""
    return _measured(_items(with_period(df, grain), item), ["item", "period", "period_index"])


def family_periods(df: DataFrame, grain: str) -> DataFrame:
    return (
        with_period(df, grain).where(F.col("family").isNotNull())
        .groupBy("period", "period_index", "family")
        .agg(total("amount").alias("revenue"), total("qty").alias("qty"))
        .withColumn("price", revenue_per_unit())
    )


def item_options(df: DataFrame, item: str, n: int) -> DataFrame:
    return (
        df.where(F.col(item).isNotNull()).groupBy(F.col(item).alias("item"))
        .agg(total("amount").alias("revenue")).orderBy(F.desc("revenue"), "item").limit(n)
    )


def compare_items(
    df: DataFrame, item: str, chosen: list[str], metric: str, grain: str, most: int = 5
) -> DataFrame:
    """One metric over time for the first distinct choices."""
    picked = list(dict.fromkeys(c.strip() for c in chosen if c.strip()))[:most]
    sub = df.where(F.col(item).isin(picked))
    return item_series(sub, item, grain).select(
        "item", "period", "period_index", F.col(metric).alias("value")
    )


def abc_by_period(df: DataFrame, grain: str, n: int = 25, others: str = "Autres") -> DataFrame:
    """Per period: n best families and one row for the rest, cumulated and classed.

    The windows run over the families of one period.
    """
    sums = with_period(df, grain).groupBy("period", "period_index", F.col("family")).agg(
        F.coalesce(F.sum("amount"), F.lit(0)).alias("v")
    )
    place = F.row_number().over(
        Window.partitionBy("period").orderBy(F.desc("v"), "family")
    )
    bucketed = (
        sums.withColumn("_p", place)
        .groupBy(
            "period", "period_index", F.least(F.col("_p"), F.lit(n + 1)).alias("rank"),
        )
        .agg(F.sum("v").alias("v"), F.min("family").alias("_f"))
    )
    run = Window.partitionBy("period").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("v").over(Window.partitionBy("period"))
    return (
        bucketed.withColumn("cum_pct", F.coalesce(pct(F.sum("v").over(run), whole), F.lit(0.0)))
        .withColumn("share_pct", F.coalesce(pct("v", whole), F.lit(0.0)))
        .select(
            "period", "period_index", "rank",
            F.when(F.col("rank") > n, F.lit(others)).otherwise(F.col("_f")).alias("family"),
            F.col("v").cast("double").alias("revenue"), "share_pct", "cum_pct",
            abc_class(F.col("cum_pct")).alias("abc"),
        )
    )


def _leading(df: DataFrame, entity: str, n: int, metric: Column | None = None) -> DataFrame:
    value = metric if metric is not None else total("amount")
    return df.groupBy(entity).agg(value.alias("_v")).orderBy(F.desc("_v"), entity).limit(n).select(entity)


def period_family_grid(df: DataFrame, grain: str, n: int = 15) -> DataFrame:
    """Every period × the n leading families, zero where nothing was sold."""
    sums = family_periods(df, grain)
    names = _leading(df.where(F.col("family").isNotNull()), "family", n).agg(
        F.array_sort(F.collect_list("family"))
    ).scalar()
    grid = sums.select("period", "period_index").distinct().withColumn("family", F.explode(names))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return grid.join(sums, ["period", "period_index", "family"], "left").select(
        "period", "period_index", "family", zero("revenue"), zero("qty"), zero("price")
    )


def value_volume_grid(df: DataFrame, grain: str, n: int = 15) -> DataFrame:
    """The grid with the ABC class of the family within the period (C when absent)."""
    sums = family_periods(df, grain)
    order = Window.partitionBy("period").orderBy(F.desc("revenue"), "family")
    run = F.sum("revenue").over(order.rowsBetween(Window.unboundedPreceding, 0))
    classes = sums.select(
        "period", "family",
        abc_class(pct(run, F.sum("revenue").over(Window.partitionBy("period")))).alias("abc"),
    )
    return period_family_grid(df, grain, n).join(classes, ["period", "family"], "left").withColumn(
        "abc", F.coalesce("abc", F.lit("C"))
    )


def family_country_matrix(
    df: DataFrame, families: int = 12, countries: int = 10, grain: str | None = None
) -> DataFrame:
    """Revenue of the leading families in the leading countries, long form, optionally per period."""
    d = with_period(df, grain) if grain else df
    keys = ["period", "period_index"] if grain else []
    sums = d.where("family is not null and country is not null").groupBy(
        *keys, "family", "country"
    ).agg(F.sum("amount").alias("amount"))
    kept = sums.join(_leading(sums, "family", families), "family", "left_semi").join(
        _leading(sums, "country", countries), "country", "left_semi"
    )
    return kept.select(*keys, "family", "country", F.col("amount").cast("double").alias("revenue"))


def top_and_others(df: DataFrame, grain: str, n: int = 5) -> DataFrame:
    """Revenue per period of the n leading families, the rest summed up as Others."""
    sums = with_period(df, grain).groupBy("period", "period_index", "family").agg(
        F.sum("amount").alias("amount")
    )
    top = _leading(sums, "family", n).withColumn("_top", F.lit(True))
    group = F.when(F.col("_top"), F.col("family")).otherwise(F.lit(OTHERS))
    return sums.join(top, "family", "left").groupBy("period", "period_index", group.alias("family")).agg(
        total("amount").alias("revenue")
    )


def recent_bands(df: DataFrame, item: str, grain: str, size: int = 6) -> DataFrame:
    """(item, period_index, band): 1 for the last ``size`` periods of the item, 2 for those before."""
    periods = with_period(df, grain).select(F.col(item).alias("item"), "period_index").distinct()
    back = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("period_index")))
    return periods.withColumn("band", F.ceil(back / size).cast("int")).where("band <= 2")


def price_distribution(df: DataFrame, item: str = "recipe_code", grain: str = "month",
                       size: int = 6, cap: float = 0.98) -> DataFrame:
    """Per product: revenue, quantity and price by client over its last periods.

    Only strictly positive quantity and price are kept (log axes); the bubble
    size is capped at the given quantile of the product's revenues.
    """
    sums = (
        with_period(df, grain)
        .groupBy(F.col(item).alias("item"), "client_id", "country", "period_index")
        .agg(F.sum("amount").alias("amount"), F.sum("qty").alias("qty"))
    )
    recent = recent_bands(df, item, grain, size).where("band = 1")
    per = (
        sums.join(recent, ["item", "period_index"])
        .groupBy("item", "client_id", "country")
        .agg(total("amount").alias("revenue"), total("qty").alias("qty"))
        .withColumn("price", revenue_per_unit())
        .where("revenue >= 0 and qty > 0 and price > 0")
    )
    # the caps read it twice, the points once more
    per = durable(per)
    caps = exact_percentiles(per, ["item"], "revenue", {"cap": cap})
    return per.join(caps, "item").withColumn(
        "bubble", F.when(F.col("cap") > 0, F.least("revenue", "cap")).otherwise(F.col("revenue"))
    ).drop("cap")


def price_labels(points: DataFrame, n: int = 6, outliers: int = 1) -> DataFrame:
    """Points to label per product: best revenues, highest price, highest quantity."""
    points, picked = durable(points), None
    for column, most in (("revenue", n), ("price", outliers), ("qty", outliers)):
        place = F.row_number().over(
            Window.partitionBy("item").orderBy(F.desc(column), "client_id", "country")
        )
        part = points.withColumn("_p", place).where(F.col("_p") <= most).drop("_p")
        picked = part if picked is None else picked.unionByName(part)
    return picked.select("item", "client_id", "country", "revenue", "qty", "price").distinct()


def price_impact(df: DataFrame, item: str = "recipe_code", grain: str = "month",
                 size: int = 6, least: float = 0.001) -> DataFrame:
    """Per product and client: % change of price and quantity, last against previous periods.

    Products need twice ``size`` periods; price changes below ``least`` are left out.
    """
    bands = recent_bands(df, item, grain, size)
    enough = bands.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") == 2 * size)
    kept = bands.join(enough.select("item"), "item", "left_semi")
    sums = (
        with_period(df, grain)
        .groupBy(F.col(item).alias("item"), "client_id", "period_index")
        .agg(F.sum("amount").alias("amount"), F.sum("qty").alias("qty"))
    )
    both = sums.join(kept, ["item", "period_index"]).groupBy("item", "client_id").agg(
        *[
            F.sum(F.when(F.col("band") == b, F.col(c))).cast("double").alias(f"{c}_{name}")
            for b, name in ((1, "last"), (2, "prev")) for c in ("amount", "qty")
        ]
    )
    out = both.withColumns(
        {f"price_{p}": F.when(F.col(f"qty_{p}") > 0, ratio(f"amount_{p}", f"qty_{p}")) for p in ("last", "prev")}
    ).withColumns(
        {f"{c}_change": ratio(F.col(f"{c}_last") - F.col(f"{c}_prev"), f"{c}_prev") for c in ("price", "qty")}
    )
    return out.where(F.col("qty_change").isNotNull() & (F.abs("price_change") >= least)).select(
        "item", "client_id", F.col("amount_prev").alias("revenue_prev"),
        F.col("amount_last").alias("revenue_last"), "price_change", "qty_change",
    )
