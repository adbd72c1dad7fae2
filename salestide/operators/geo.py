"""Country and zone statistics, scores and classes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salestide.functions.numeric import banded, mean, pct, ratio, total
from salestide.functions.quantiles import exact_quantiles

# Sales zones by ISO-2 country code; all others are "Autres".
ZONES = {
    "Europe Ouest": ["FR", "BE", "DE", "NL", "LU"],
    "Europe Nord": ["GB", "DK", "SE", "NO", "IE"],
    "Europe Sud": ["ES", "IT", "PT", "GR"],
    "Europe Est": ["PL", "CZ", "AT", "CH", "HU", "SK", "RO", "HR", "BG", "RS", "MK", "LT"],
}
OTHER_ZONE = "Autres"
# Score classes with their lower bounds.
SCORE_CLASSES = [(70, "Excellence"), (50, "Performant"), (30, "Moyen")]
LOWEST_CLASS = "À Développer"
# ISO-2 code, ISO-3 code, display name (the code where no name is defined).
COUNTRY_CODES = [
    ("AE", "ARE", "Émirats Arabes Unis"), ("AT", "AUT", "Autriche"), ("AU", "AUS", "Australie"),
    ("BE", "BEL", "Belgique"), ("BG", "BGR", "Bulgarie"), ("BR", "BRA", "Brésil"),
    ("CA", "CAN", "Canada"), ("CH", "CHE", "Suisse"), ("CL", "CHL", "CL"),
    ("CR", "CRI", "CR"), ("CZ", "CZE", "Tchéquie"), ("DE", "DEU", "Allemagne"),
    ("DK", "DNK", "Danemark"), ("ES", "ESP", "Espagne"), ("FR", "FRA", "France"),
    ("GB", "GBR", "Royaume-Uni"), ("GR", "GRC", "Grèce"), ("HR", "HRV", "Croatie"),
    ("HU", "HUN", "Hongrie"), ("IE", "IRL", "Irlande"), ("IN", "IND", "Inde"),
    ("IT", "ITA", "Italie"), ("LT", "LTU", "Lituanie"), ("LU", "LUX", "Luxembourg"),
    ("MK", "MKD", "Macédoine"), ("NL", "NLD", "Pays-Bas"), ("NO", "NOR", "Norvège"),
    ("PL", "POL", "Pologne"), ("PT", "PRT", "Portugal"), ("RO", "ROU", "Roumanie"),
    ("RS", "SRB", "Serbie"), ("SA", "SAU", "Arabie Saoudite"), ("SE", "SWE", "Suède"),
    ("SK", "SVK", "Slovaquie"), ("UY", "URY", "UY"),
]


def zone_of(country: Column, zones: dict[str, list[str]] | None = None) -> Column:
    out = F
    for zone, codes in (zones or ZONES).items():
        out = out.when(country.isin(codes), F.lit(zone))
    return out.otherwise(F.lit(OTHER_ZONE))


def _all() -> Window:
    # only used on one row per country or zone
    return Window.partitionBy(F.lit(1))


def country_stats(df: DataFrame) -> DataFrame:
    """Twelve measures per country with share, rank, penetration and zone."""
    d = df.where(F.col("country").isNotNull())
    base = d.groupBy("country").agg(
        total("amount").alias("revenue"), mean("amount").alias("mean_line"),
        F.stddev_samp(F.col("amount").cast("double")).alias("std_line"),
        F.count("amount").alias("sales"), total("qty").alias("qty"), F.avg("qty").alias("mean_qty"),
        F.avg("unit_price").alias("mean_price"), F.count_distinct("client_id").alias("clients"),
        F.count_distinct("order_id").alias("orders"), F.count_distinct("family").alias("families"),
    )
    medians = exact_quantiles(d, ["country"], {"median_line": ("amount", 0.5), "median_price": ("unit_price", 0.5)})
    order = Window.orderBy(F.desc("revenue"), "country")
    return (
        base.join(medians, "country", "left")
        .withColumns(
            {
                "share_pct": pct("revenue", F.sum("revenue").over(_all())),
                "rank": F.row_number().over(order),
                "revenue_per_client": ratio("revenue", "clients"),
                "basket": ratio("revenue", "orders"),
                "penetration_pct": pct("clients", F.sum("clients").over(_all())),
                "zone": zone_of(F.col("country")),
            }
        )
    )


def zone_stats(df: DataFrame, zones: dict[str, list[str]] | None = None) -> DataFrame:
    return (
        df.where(F.col("country").isNotNull())
        .groupBy(zone_of(F.col("country"), zones).alias("zone"))
        .agg(
            total("amount").alias("revenue"), mean("amount").alias("mean_line"),
            F.count_distinct("client_id").alias("clients"), F.count_distinct("order_id").alias("orders"),
            F.count_distinct("country").alias("countries"),
        )
        .withColumns(
            {"share_pct": pct("revenue", F.sum("revenue").over(_all())),
             "basket": ratio("revenue", "orders")}
        )
    )


def country_scores(df: DataFrame) -> DataFrame:
    """Revenue, basket and clients as % of the best country, mixed 50/30/20, with a class."""
    base = (
        df.where(F.col("country").isNotNull()).groupBy("country").agg(
            total("amount").alias("revenue"), F.count_distinct("client_id").alias("clients"),
            F.count_distinct("order_id").alias("orders"),
        ).withColumn("basket", ratio("revenue", "orders"))
    )
    scored = base.withColumns(
        {f"score_{c}": pct(c, F.max(c).over(_all())) for c in ("revenue", "basket", "clients")}
    )
    score = F.col("score_revenue") * 0.5 + F.col("score_basket") * 0.3 + F.col("score_clients") * 0.2
    return scored.withColumn("score", score).withColumn(
        "score_class", banded(F.col("score"), SCORE_CLASSES, LOWEST_CLASS)
    )


def best_scores(df: DataFrame, n: int = 10) -> DataFrame:
    return country_scores(df).orderBy(F.desc("score"), "country").limit(n)


def class_summary(df: DataFrame) -> DataFrame:
    """Revenue, countries and mean score of all four classes, empty ones as 0."""
    found = country_scores(df).groupBy("score_class").agg(
        F.sum("revenue").alias("revenue"), F.count("*").alias("countries"), F.avg("score").alias("mean_score")
    )
    names = [c for _, c in SCORE_CLASSES] + [LOWEST_CLASS]
    classes = df.sparkSession.createDataFrame([(n,) for n in names], "score_class string")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (
        classes.join(found, "score_class", "left")
        .select("score_class", zero("revenue"), zero("countries"), zero("mean_score"))
        .withColumn("share_pct", pct("revenue", F.sum("revenue").over(_all())))
    )


def map_rows(df: DataFrame) -> DataFrame:
    """Country revenue with ISO-3 code and display name; unknown codes are left out."""
    iso3 = F.create_map(*chain.from_iterable((F.lit(a), F.lit(b)) for a, b, _ in COUNTRY_CODES))
    names = F.create_map(*chain.from_iterable((F.lit(a), F.lit(c)) for a, _, c in COUNTRY_CODES))
    return (
        df.groupBy("country").agg(total("amount").alias("revenue"))
        .select("country", iso3[F.col("country")].alias("iso3"), names[F.col("country")].alias("name"), "revenue")
        .where("iso3 is not null")
    )


def class_counts(df: DataFrame) -> DataFrame:
    return country_scores(df).groupBy("score_class").agg(F.count("*").alias("countries"))
