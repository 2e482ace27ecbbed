"""Reports around the panel, the features and the groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwise import settings as S
from shelfwise.functions.ordered import exact_quantiles, position_by
from shelfwise.operators.features import weekly_view
from shelfwise.sources.staging import stage


def subcategory_profile(raw: DataFrame) -> DataFrame:
    """Rows, products and revenue (millions) per subcategory."""
    return (
        raw.groupBy("subcategory_nm")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_distinct(S.KEY).alias("products"),
            (F.sum("total_sales") / 1e6).alias("revenue_m"),
        )
        .orderBy(F.desc("rows"), "subcategory_nm")
    )


def price_band(features: DataFrame) -> DataFrame:
    """Value, mid or premium third of the price tier, right-closed; blank stays blank."""
    tier = F.col("price_tier")
    band = (
        F.when((tier >= 0) & (tier <= 1 / 3), "value")
        .when((tier > 1 / 3) & (tier <= 2 / 3), "mid")
        .when((tier > 2 / 3) & (tier <= 1), "premium")
    )
    return features.withColumn("band", band)


def group_profile(grouped: DataFrame, group: str = "group") -> DataFrame:
    """Mean of the ten features per group."""
    return grouped.groupBy(group).agg(*[F.avg(c).alias(c) for c in S.FEATURES])


def group_revenue_share(grouped: DataFrame, group: str = "group") -> DataFrame:
    """Products and percent of revenue per group."""
    shares = grouped.groupBy(group).agg(
        F.count(F.lit(1)).alias("products"), F.sum("total_revenue").alias("revenue")
    )
    whole = grouped.agg(F.sum("total_revenue").alias("revenue")).scalar()
    return shares.select(
        group, "products", (F.try_divide(F.col("revenue"), whole) * 100).alias("revenue_pct")
    )


def group_mix(grouped: DataFrame, attribute: str, group: str = "group") -> DataFrame:
    """Percent of each group's products per attribute value, in long form.

    Combinations are counted first; the window runs over one row per (group, value).
    """
    counts = (
        grouped.where(F.col(group).isNotNull() & F.col(attribute).isNotNull())
        .groupBy(group, attribute)
        .agg(F.count(F.lit(1)).alias("products"))
    )
    whole = F.sum("products").over(Window.partitionBy(group))
    return counts.select(group, attribute, (F.col("products") / whole * 100).alias("pct"))


BANDS = ["value", "mid", "premium"]


def coverage_grid(features: DataFrame, form: str = "format") -> DataFrame:
    """Format by price band: products and revenue (millions), zero where nothing is sold."""
    wide = (
        price_band(features)
        .where(F.col(form).isNotNull())
        .groupBy(form)
        .pivot("band", BANDS)
        .agg(
            F.count(F.lit(1)).alias("products"),
            (F.sum("total_revenue") / 1e6).alias("revenue_m"),
        )
    )
    return wide.na.fill(0)


def thin_cells(features: DataFrame, form: str = "format", at_most: int = 2) -> DataFrame:
    """Cells of the coverage grid with few or no products, empty ones included."""
    grid = coverage_grid(features, form)
    cells = F.array(
        *[F.struct(F.lit(b).alias("band"), F.col(f"{b}_products").alias("products")) for b in BANDS]
    )
    return grid.select(form, F.inline(cells)).where(F.col("products") <= at_most)


def mechanic_mix(sales: DataFrame, groups: DataFrame, group: str = "group") -> DataFrame:
    """Mean over products of their mean promotion mechanics, with the sum of the rounded means."""
    per_product = sales.groupBy(S.KEY).agg(*[F.avg(c).alias(c) for c in S.PROMO_MECHANICS])
    means = (
        per_product.join(groups.select(S.KEY, group), S.KEY)
        .groupBy(group)
        .agg(*[F.round(F.avg(c), 2).alias(c) for c in S.PROMO_MECHANICS])
    )
    cells = [F.coalesce(F.col(c), F.lit(0.0)) for c in S.PROMO_MECHANICS]
    total = cells[0] + cells[1] + cells[2] + cells[3]
    return means.withColumn("total_promo_acv", F.round(total, 1))


def retailer_codes(sales: DataFrame) -> DataFrame:
    """R1, R2, ... by revenue."""
    revenue = stage(
        sales.groupBy("retailer_nm").agg(F.sum("total_sales").alias("revenue")), "retailer-revenue"
    )
    return position_by(revenue, "revenue", "retailer_nm", "place").select(
        F.concat(F.lit("R"), F.col("place").cast("string")).alias("code"), "retailer_nm"
    )


def retailer_profile(sales: DataFrame) -> DataFrame:
    """Revenue, range, median shelf, mean promotion and promoted revenue share per retailer."""
    per_retailer = sales.groupBy("retailer_nm").agg(
        F.sum("total_sales").alias("revenue"),
        F.count_distinct(S.KEY).alias("products"),
        F.avg("any_promo_acv_pct").alias("avg_promo_acv"),
        F.try_divide(F.sum("any_promo_amt"), F.sum("total_sales")).alias("promo_rev_share"),
    )
    sums = stage(per_retailer, "retailer-sums")
    medians = exact_quantiles(sales, "acv_pct", {"median_shelf": 0.5}, ["retailer_nm"])
    placed = position_by(sums, "revenue", "retailer_nm", "place")
    return placed.join(medians, "retailer_nm", "left").select(
        F.concat(F.lit("R"), F.col("place").cast("string")).alias("code"),
        "retailer_nm",
        (F.col("revenue") / 1e6).alias("revenue_m"),
        "products",
        "median_shelf",
        "avg_promo_acv",
        "promo_rev_share",
    )


def odd_retailer(sales: DataFrame) -> DataFrame:
    """The retailer with the lowest median shelf."""
    medians = exact_quantiles(sales, "acv_pct", {"median_shelf": 0.5}, ["retailer_nm"])
    return medians.orderBy("median_shelf", "retailer_nm").limit(1)


def exclusive_retailer_share(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Share of ``products`` sold in the odd retailer and nowhere else.

    A product's set of retailers equals the odd one when both its smallest and its largest
    retailer name do.
    """
    odd = odd_retailer(sales).select("retailer_nm").scalar()
    stores = sales.select(S.KEY, "retailer_nm").distinct()
    spans = (
        stores.join(products.select(S.KEY).distinct(), S.KEY, "left_semi")
        .groupBy(S.KEY)
        .agg(F.min("retailer_nm").alias("first"), F.max("retailer_nm").alias("last"))
    )
    only = (F.col("first") == odd) & (F.col("last") == odd)
    return spans.agg(
        F.max(odd).alias("odd_retailer"),
        F.count(F.lit(1)).alias("products"),
        F.avg(F.when(only, 1.0).otherwise(0.0)).alias("share_exclusive"),
    )


def layer_profile(layered: DataFrame, layer: str = "sub") -> DataFrame:
    """Size, mean shelf, promotion and bumpiness, and revenue per layer of a group."""
    return layered.groupBy(layer).agg(
        F.count(F.lit(1)).alias("products"),
        F.avg("shelf_presence").alias("shelf"),
        F.avg("promo_activity").alias("promo"),
        F.avg("bumpiness").alias("bumpiness"),
        (F.sum("total_revenue") / 1e6).alias("revenue_m"),
    )


def product_format(raw: DataFrame, column: str = "attribute_1", name: str = "format") -> DataFrame:
    """One catalogue attribute per product."""
    pairs = raw.select(S.KEY, column).distinct()
    return pairs.groupBy(S.KEY).agg(F.min(column).alias(name))


def pareto(sales: DataFrame) -> DataFrame:
    """Products by revenue with their place and cumulative share of it."""
    revenue = stage(
        sales.groupBy(S.KEY).agg(F.sum("total_sales").alias("revenue")), "product-revenue"
    )
    whole = revenue.agg(F.sum("revenue")).scalar()
    placed = position_by(revenue, "revenue", S.KEY, "place", "running")
    return placed.select(
        S.KEY, "place", "revenue", F.try_divide(F.col("running"), whole).alias("cum_share")
    )


def pareto_summary(curve: DataFrame, top: float = 0.03, most: float = 0.80) -> DataFrame:
    """Share of the top products, products needed for most revenue, share of the bottom half.

    ``curve`` is read twice; counts of products follow the curve's own length.
    """
    n = curve.agg(F.count(F.lit(1)).alias("n")).scalar()
    top_k = F.greatest(F.lit(1), F.bround(F.lit(top) * n).cast("int"))
    head_half = n - F.floor(n / 2)
    return curve.agg(
        F.count(F.lit(1)).alias("products"),
        F.max(F.when(F.col("place") == top_k, F.col("cum_share"))).alias("top_share"),
        F.min(F.when(F.col("cum_share") >= most, F.col("place"))).alias("products_for_most"),
        (1 - F.max(F.when(F.col("place") == head_half, F.col("cum_share")))).alias(
            "bottom_half_share"
        ),
    )


def category_decomposition(
    sales: DataFrame, width: int = S.LONG_CYCLE, min_weeks: int = 26
) -> DataFrame:
    """Weekly revenue split into a centred moving trend, a week-of-year season and the leftover.

    The windows run over one row per calendar week.
    """
    weekly = sales.groupBy("period_id").agg((F.sum("total_sales") / 1e6).alias("revenue_m"))
    ahead = (width - 1) // 2
    near = Window.orderBy("period_id").rowsBetween(ahead + 1 - width, ahead)
    trend = F.when(F.count("revenue_m").over(near) >= min_weeks, F.avg("revenue_m").over(near))
    detrended = weekly.withColumn("trend", trend).select(
        "*",
        (F.col("revenue_m") - F.col("trend")).alias("detrended"),
        F.weekofyear("period_id").alias("week_of_year"),
    )
    season = F.avg("detrended").over(Window.partitionBy("week_of_year"))
    return detrended.withColumn("season", season).withColumn(
        "leftover", F.col("detrended") - F.col("season")
    )


def decomposition_summary(parts: DataFrame) -> DataFrame:
    """Variance shares of trend, season and leftover, and the peak and trough months."""
    shares = parts.agg(
        F.var_samp("revenue_m").alias("whole"),
        F.var_samp("trend").alias("trend"),
        F.var_samp("season").alias("season"),
        F.var_samp("leftover").alias("leftover"),
        F.avg("revenue_m").alias("avg_week_m"),
    )
    months = parts.groupBy(F.month("period_id").alias("month")).agg(F.avg("season").alias("mean"))
    ends = months.where(F.col("mean").isNotNull()).agg(
        F.struct(
            F.max_by("month", F.struct("mean", -F.col("month"))).alias("peak"),
            F.max("mean").alias("peak_mean"),
            F.min_by("month", F.struct("mean", "month")).alias("trough"),
            F.min("mean").alias("trough_mean"),
        ).alias("e")
    ).scalar()

    def month_name(field: str) -> Column:
        day = F.make_date(F.lit(2000), ends.getField(field), F.lit(1))
        return F.date_format(day, "MMMM")

    def share(part: str) -> Column:
        return F.try_divide(F.col(part), F.col("whole")).alias(f"{part}_share")

    return shares.select(
        share("trend"),
        share("season"),
        share("leftover"),
        month_name("peak").alias("peak_month"),
        ends.getField("peak_mean").alias("peak_m"),
        month_name("trough").alias("trough_month"),
        ends.getField("trough_mean").alias("trough_m"),
        "avg_week_m",
    )


def period_halves(sales: DataFrame) -> DataFrame:
    """Mean promotion per product up to and after the median row date, where both exist."""
    days = sales.withColumn("_day", F.unix_date("period_id"))
    middle = exact_quantiles(days, "_day", {"mid": 0.5}).scalar()
    early = F.col("_day") <= middle
    return (
        days.groupBy(S.KEY)
        .agg(
            F.avg(F.when(early, F.col("any_promo_acv_pct"))).alias("half1"),
            F.avg(F.when(~early, F.col("any_promo_acv_pct"))).alias("half2"),
        )
        .where(F.col("half1").isNotNull() & F.col("half2").isNotNull())
    )


def promo_drift(sales: DataFrame) -> DataFrame:
    """Mean absolute change of promotion between the two halves of the history."""
    return period_halves(sales).agg(
        F.avg(F.abs(F.col("half2") - F.col("half1"))).alias("mean_abs_change"),
        F.count(F.lit(1)).alias("products"),
    )


def growth_flip(sales: DataFrame, moves: DataFrame) -> DataFrame:
    """Products whose growth changes sign between raw units and the sales rate.

    ``moves`` carries growth and shelf trend; an agreeing flip has the raw slope pointing the same
    way as the shelf.
    """
    order = Window.partitionBy(S.KEY).orderBy("period_id")
    raw_slope = (
        weekly_view(sales)
        .withColumn("x", F.row_number().over(order) - 1)
        .groupBy(S.KEY)
        .agg(F.regr_slope(F.log1p("units"), F.col("x")).alias("raw_growth"))
    )
    both = raw_slope.join(moves, S.KEY).where(
        F.col("growth").isNotNull() & F.col("raw_growth").isNotNull()
    )
    flipped = F.signum("raw_growth") != F.signum("growth")
    agrees = F.signum("raw_growth") == F.signum("shelf_trend")
    return both.agg(
        F.count(F.lit(1)).alias("products"),
        F.count_if(flipped).alias("flipped"),
        F.avg(F.when(flipped, F.when(agrees, 1.0).otherwise(0.0))).alias("agree_share"),
    )


def size_rank_ids(top: DataFrame, by: str = "units", prefix: str = "D") -> DataFrame:
    """D01, D02, ... by ``by`` descending."""
    placed = position_by(top.select(S.KEY, by), by, S.KEY, "place")
    return placed.select(F.format_string(f"{prefix}%02d", "place").alias("id"), S.KEY)
