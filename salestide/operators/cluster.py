"""Client clusters over a period and over the quarters of a year."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salestide.functions import kmeans
from salestide.functions.numeric import pct, ratio, ratio_or_zero, total
from salestide.operators.kpi import top_n
from salestide.operators.periods import business_days, quarter_open_days
from salestide.session import durable

LOGGED = [
    "revenue_per_day", "qty_per_day", "orders_per_day", "mean_line", "basket", "qty_per_order", "revenue_per_qty",
]
PROFILE = ["revenue", "qty", "orders", "basket", "mean_planned", "families"]


def leading_families(df: DataFrame, n: int = 30) -> list[str]:
    """Names of the n best families by revenue (at most n values reach the driver)."""
    return [r["label"] for r in top_n(df, "family", n=n).collect()]


def _per_family(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, family): sums, mean price, and the mean days between consecutive lines.

    The gaps of a sorted series add up to last − first, so no window is needed.
    """
    span = F.date_diff(F.max("order_date"), F.min("order_date"))
    return df.groupBy(*keys, "family").agg(
        F.sum("amount").alias("_v"), F.avg("unit_price").alias("price"), F.try_divide(span, F.count("*") - 1).alias("gap")
    )


def client_features(df: DataFrame, families: list[str], keys: list[str] = ("client_id",), open_days: Column | None = None) -> DataFrame:
    """Totals, intensities per open day, ratios, logs, family prices, shares and rhythms, country, diversity.

    ``open_days`` defaults to the weekdays between the first and the last order date.
    """
    keys = list(keys)
    d = df.where("order_date is not null")
    base = d.where(F.col("client_id").isNotNull()).groupBy(*keys).agg(
        total("amount").alias("revenue"), ratio(F.sum("amount"), F.count("amount")).alias("mean_line"), total("qty").alias("qty"),
        F.count_distinct("order_id").alias("orders"), F.coalesce(F.avg("planned_days"), F.lit(0.0)).alias("mean_planned"),
        F.coalesce(F.min_by("country", F.when(F.col("country").isNotNull(), F.struct("order_date", "country"))), F.lit("UNKNOWN")).alias("country"),
    )
    pick = lambda f, c: F.coalesce(F.max(F.when(F.col("family") == f, F.col(c))), F.lit(0)).cast("double")
    wide = _per_family(d, keys).groupBy(*keys).agg(
        F.count("family").alias("families"),
        *[pick(f, "price").alias(f"price_{f}") for f in families], *[pick(f, "_v").alias(f"revenue_{f}") for f in families],
        *[pick(f, "gap").alias(f"gap_{f}") for f in families],
    )
    if open_days is None:
        open_days = d.agg(business_days(F.min("order_date"), F.max("order_date"))).scalar()
    out = base.join(wide, keys).withColumn("_days", open_days).withColumns(
        {
            **{f"{c}_per_day": ratio(c, "_days") for c in ("revenue", "qty", "orders")},
            "basket": ratio_or_zero("revenue", "orders"), "qty_per_order": ratio_or_zero("qty", "orders"),
            "revenue_per_qty": ratio_or_zero("revenue", "qty"),
            **{f"share_{f}": ratio_or_zero(f"revenue_{f}", "revenue") for f in families},
        }
    )
    return out.withColumns({f"log_{c}": F.log1p(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))) for c in LOGGED}).drop("_days")


def with_country_code(features: DataFrame) -> DataFrame:
    """Position of the country in name order; one row per country is ranked."""
    codes = features.select("country").distinct().withColumn("country_code", F.row_number().over(Window.orderBy("country")) - 1)
    return features.join(codes, "country")


def feature_names(families: list[str], columns: list[str]) -> list[str]:
    wanted = [f"log_{c}" for c in LOGGED] + ["country_code", "families", "mean_planned"]
    wanted += [f"{p}_{f}" for p in ("price", "share", "gap") for f in families]
    return [c for c in wanted if c in columns]


def with_vector(features: DataFrame, names: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Standardised feature vector (mean 0, deviation 1), scaled by the rows of ``fit_on``."""
    assembler = VectorAssembler(inputCols=names, outputCol="_raw")
    scaler = StandardScaler(inputCol="_raw", outputCol="vector", withMean=True, withStd=True)
    model = scaler.fit(assembler.transform(fit_on if fit_on is not None else features))
    return model.transform(assembler.transform(features)).drop("_raw")


# Starts for the choice of k, for the final clusters, and for a quarter.
STARTS, FINAL_STARTS, QUARTER_STARTS = 10, 20, 10
_SCORE_SCHEMA = "k int, silhouette double, inertia double, davies_bouldin double, calinski_harabasz double"


def _narrow(vectors: DataFrame, part: Column | None = None) -> DataFrame:
    """(part, x) of the vectors, a table that every pass reads."""
    return durable(vectors.select((F.lit(0) if part is None else part).cast("int").alias("part"), vector_to_array("vector").alias("x")))


def _score_rows(vectors: DataFrame, rows: list[dict[str, float]]) -> DataFrame:
    return vectors.sparkSession.createDataFrame([tuple(r.values()) for r in rows], _SCORE_SCHEMA)


def search_k(vectors: DataFrame, low: int = 2, high: int = 10, seed: int = 42, starts: int = STARTS) -> DataFrame:
    """Scores of every k below the number of rows; the best silhouette is marked.  All k and starts move in the same passes."""
    narrow = _narrow(vectors)
    models = kmeans.best(kmeans.fit(narrow, [(0, k) for k in range(low, min(high, narrow.count() - 1) + 1)], starts, seed))
    if not models:
        raise ValueError("too few rows to cluster")
    rows = kmeans.scores(narrow, [models[key] for key in sorted(models)])
    best = max(rows, key=lambda r: r["silhouette"])["k"]
    return _score_rows(vectors, rows).withColumn("is_best", F.col("k") == best)


def cluster_clients(vectors: DataFrame, k: int | None = None, low: int = 2, high: int = 10, seed: int = 42, starts: int = FINAL_STARTS) -> tuple[DataFrame, DataFrame]:
    """(clients with their cluster, one row of scores); k by silhouette unless given."""
    if k is None:
        k = search_k(vectors, low, high, seed).where("is_best").first()["k"]
    narrow = _narrow(vectors)
    model = kmeans.best(kmeans.fit(narrow, [(0, k)], starts, seed, 500))[0, k]
    assigned = durable(vectors.withColumn("cluster", kmeans.nearest(vector_to_array("vector"), {0: model.centers}, F.lit(0))))
    return assigned, _score_rows(vectors, kmeans.scores(narrow, [model]))


def cluster_profiles(assigned: DataFrame) -> DataFrame:
    whole = assigned.agg(F.count("*")).scalar()
    return assigned.groupBy("cluster").agg(
        F.count("*").alias("clients"), F.sum("revenue").alias("total_revenue"), *[F.avg(c).alias(f"mean_{c}") for c in PROFILE]
    ).withColumn("pct", pct("clients", whole))


def cluster_families(assigned: DataFrame, families: list[str], n: int = 5) -> DataFrame:
    """Leading families of each cluster by mean revenue."""
    means = assigned.groupBy("cluster").agg(*[F.avg(f"revenue_{f}").alias(f) for f in families])
    long = means.unpivot(["cluster"], families, "family", "mean_revenue").where("mean_revenue > 0")
    w = Window.partitionBy("cluster").orderBy(F.desc("mean_revenue"), "family")
    return long.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def cluster_countries(assigned: DataFrame, n: int = 3) -> DataFrame:
    counts = assigned.groupBy("cluster", "country").agg(F.count("*").alias("clients"))
    sizes = counts.groupBy("cluster").agg(F.sum("clients").alias("_n"))
    w = Window.partitionBy("cluster").orderBy(F.desc("clients"), "country")
    return (
        counts.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n).join(sizes, "cluster")
        .withColumn("pct", pct("clients", "_n")).drop("_n")
    )


def plane(assigned: DataFrame) -> DataFrame:
    """First two principal components of the centred vectors and their share of the variance."""
    model = PCA(k=2, inputCol="vector", outputCol="_p").fit(assigned)
    share = [float(x) for x in model.explainedVariance.toArray()]
    p = vector_to_array("_p")
    return model.transform(assigned).select(
        "client_id", "cluster", p[0].alias("x"), p[1].alias("y"), F.lit(share[0]).alias("x_share"), F.lit(share[1]).alias("y_share")
    )


# ── quarters of a year ──


def year_lines(df: DataFrame, year: int) -> DataFrame:
    """Lines ordered in the year, with their calendar quarter; an absent year is an error."""
    d = df.where(F.year("order_date") == year).withColumn(
        "quarter", F.concat(F.year("order_date").cast("string"), F.lit("Q"), F.quarter("order_date").cast("string"))
    )
    if d.isEmpty():
        raise ValueError(f"no orders in year {year}")
    return d


def quarter_panel(lines: DataFrame) -> DataFrame:
    """Every client of the year in every quarter that has orders, with the active mark."""
    active = lines.where(F.col("client_id").isNotNull()).select("client_id", "quarter").distinct()
    quarters = active.agg(F.array_sort(F.collect_set("quarter"))).scalar()  # at most four
    grid = active.select("client_id").distinct().withColumn("quarter", F.explode(quarters))
    return grid.join(active.withColumn("_a", F.lit(True)), ["client_id", "quarter"], "left").select(
        "client_id", "quarter", F.coalesce("_a", F.lit(False)).alias("is_active")
    )


def quarter_features(lines: DataFrame, families: list[str], closures: dict | None = None) -> DataFrame:
    """``client_features`` per (client, quarter) with the open days of that quarter."""
    days = quarter_open_days(lines, closures).select("quarter", "open_days")
    table = days.agg(F.map_from_entries(F.collect_list(F.struct("quarter", "open_days")))).scalar()  # at most four
    return client_features(lines, families, ["client_id", "quarter"], F.try_element_at(table, F.col("quarter")))


def quarter_summary(lines: DataFrame, closures: dict | None = None) -> DataFrame:
    """Lines, open days, clients of the year and clients active in the quarter."""
    whole = lines.agg(F.count_distinct("client_id")).scalar()
    return lines.groupBy("quarter").agg(F.count("*").alias("lines"), F.count_distinct("client_id").alias("active_clients")).join(
        quarter_open_days(lines, closures).select("quarter", "open_days"), "quarter"
    ).withColumn("clients", whole)


def _quarters(vectors: DataFrame) -> list[str]:
    return [r["quarter"] for r in vectors.select("quarter").distinct().orderBy("quarter").collect()]


def _number(quarters: list[str]) -> Column:
    """Place of the row's quarter in the list (at most four)."""
    return F.array_position(F.array(*[F.lit(q) for q in quarters]), F.col("quarter")) - 1


def shared_k(vectors: DataFrame, low: int = 2, high: int = 10, seed: int = 42, starts: int = QUARTER_STARTS) -> DataFrame:
    """Mean silhouette of each k over the quarters; every quarter needs more than k rows."""
    quarters = _quarters(vectors)
    least = vectors.groupBy("quarter").count().agg(F.min("count")).first()[0] or 0
    ks = range(low, min(high, least - 1) + 1)
    if not ks:
        raise ValueError("too few active clients per quarter")
    narrow = _narrow(vectors, _number(quarters))
    models = kmeans.best(kmeans.fit(narrow, [(p, k) for p in range(len(quarters)) for k in ks], starts, seed))
    keys = sorted(models)
    found = dict(zip(keys, (r["silhouette"] for r in kmeans.scores(narrow, [models[x] for x in keys]))))
    rows = [(k, sum(found[p, k] for p in range(len(quarters))) / len(quarters)) for k in ks]
    best = max(rows, key=lambda r: r[1])[0]
    return vectors.sparkSession.createDataFrame(rows, "k int, silhouette double").withColumn("is_best", F.col("k") == best)


def matching(reference: list[np.ndarray], new: list[np.ndarray]) -> list[int]:
    """Reference label for each new label at least total centre distance (exact, over subsets of ≤ 12 labels)."""
    k = len(reference)
    cost = [[float(np.linalg.norm(r - c)) for r in reference] for c in new]
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (spent, labels) in best.items():
            for j in range(k):
                if not used >> j & 1:
                    entry = (spent + row[j], [*labels, j])
                    if used | 1 << j not in step or entry[0] < step[used | 1 << j][0]:
                        step[used | 1 << j] = entry
        best = step
    return min(best.values())[1]


def cluster_quarters(vectors: DataFrame, k: int, seed: int = 42, starts: int = QUARTER_STARTS) -> DataFrame:
    """K-means per quarter, labels aligned with those of the first quarter."""
    quarters = _quarters(vectors)
    models = kmeans.best(kmeans.fit(_narrow(vectors, _number(quarters)), [(p, k) for p in range(len(quarters))], starts, seed))
    centers = {p: models[p, k].centers for p in range(len(quarters))}
    for p in range(1, len(quarters)):
        labels = matching(list(centers[0]), list(centers[p]))
        centers[p] = centers[p][np.argsort(labels)]
    return durable(vectors.withColumn("cluster", kmeans.nearest(vector_to_array("vector"), centers, _number(quarters))))


def quarter_distribution(panel: DataFrame, assigned: DataFrame) -> DataFrame:
    """Clients per quarter and cluster; inactive clients are cluster -1."""
    all_rows = panel.join(assigned.select("client_id", "quarter", "cluster"), ["client_id", "quarter"], "left")
    counts = all_rows.groupBy("quarter", F.coalesce("cluster", F.lit(-1)).alias("cluster")).agg(F.count("*").alias("clients"))
    return counts.withColumn("pct", pct("clients", F.sum("clients").over(Window.partitionBy("quarter"))))


def first_two(assigned: DataFrame) -> DataFrame:
    """Means of four indicators for clusters 0 and 1 per quarter, side by side."""
    long = assigned.where("cluster in (0, 1)").select(
        "quarter", "cluster", "revenue", "qty", F.col("orders").cast("double").alias("orders"), "basket"
    ).unpivot(["quarter", "cluster"], ["revenue", "qty", "orders", "basket"], "indicator", "value")
    wide = long.groupBy("quarter", "indicator").pivot("cluster", [0, 1]).agg(F.avg("value"))
    return wide.withColumnsRenamed({"0": "cluster_0", "1": "cluster_1"})


def transitions(panel: DataFrame, assigned: DataFrame) -> DataFrame:
    """Moves between consecutive quarters: counts and row shares, inactive as -1."""
    state = panel.join(assigned.select("client_id", "quarter", "cluster"), ["client_id", "quarter"], "left").withColumn(
        "cluster", F.coalesce("cluster", F.lit(-1))
    )
    # four rows per client: the next quarter by window instead of a self join
    w = Window.partitionBy("client_id").orderBy("quarter")
    moves = state.withColumns({"to_quarter": F.lead("quarter").over(w), "to_cluster": F.lead("cluster").over(w)}).where("to_quarter is not null")
    counts = moves.groupBy(
        F.col("quarter").alias("from_quarter"), "to_quarter", F.col("cluster").alias("from_cluster"), "to_cluster"
    ).agg(F.count("*").alias("clients"))
    return counts.withColumns(
        {"row_pct": pct("clients", F.sum("clients").over(Window.partitionBy("from_quarter", "from_cluster"))),
         "is_stable": F.col("from_cluster") == F.col("to_cluster")}
    )
