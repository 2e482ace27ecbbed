"""Data-quality audits of the raw panel and of the feature table."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise import settings as S
from shelfwise.functions.ordered import exact_quantiles
from shelfwise.functions.stats import pair_corr
from shelfwise.operators.clean import drop_placeholders, price_per_pack


def panel_shape(raw: DataFrame) -> DataFrame:
    """Rows, products, retailers, weeks, first and last week."""
    return raw.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(S.KEY).alias("products"),
        F.count_distinct("retailer_nm").alias("retailers"),
        F.count_distinct("period_id").alias("weeks"),
        F.min("period_id").alias("first_week"),
        F.max("period_id").alias("last_week"),
    )


def _as_rows(df: DataFrame, columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Long form: one row per input row and column."""
    return df.unpivot([], list(columns), name, value)


def constant_columns(
    raw: DataFrame, columns: Sequence[str] = ("category", "cmu", "channel_nm")
) -> DataFrame:
    """The distinct values of columns that should hold one value."""
    return raw.select(*columns).distinct().unpivot([], list(columns), "column", "value").distinct()


def attribute_constancy(raw: DataFrame, columns: Sequence[str] = tuple(S.META_COLS)) -> DataFrame:
    """Per attribute, products that carry exactly one value of it."""
    spans = (
        raw.select(S.KEY, *columns)
        .distinct()
        .groupBy(S.KEY)
        .agg(*[(F.min(c) == F.max(c)).alias(c) for c in columns])
    )
    counts = spans.agg(*[F.count_if(F.col(c)).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "attribute", "constant_products")


def promo_parts_check(raw: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Do the four promotion mechanics add up to the promoted share?"""
    parts = [F.coalesce(F.col(c), F.lit(0.0)) for c in S.PROMO_MECHANICS]
    total = parts[0] + parts[1] + parts[2] + parts[3]
    whole = F.col("any_promo_acv_pct")
    close = F.abs(total - whole) <= tolerance + 1e-5 * F.abs(whole)
    return raw.agg(
        F.avg(F.when(close, 1.0).otherwise(0.0)).alias("share_close"),
        pair_corr(total, whole).alias("corr"),
        F.count_if(total > 100).alias("rows_over_100"),
    )


def promo_bounds_check(raw: DataFrame) -> DataFrame:
    """Shares of rows whose promoted units and money stay within the totals (NULL is a no)."""

    def share(ok: Column) -> Column:
        return F.avg(F.when(ok, 1.0).otherwise(0.0))

    return raw.agg(
        share(F.col("any_promo_units") <= F.col("total_units")).alias("units_within"),
        share(F.col("any_promo_amt") <= F.col("total_sales") + 1e-6).alias("money_within"),
    )


def _volume_rows(raw: DataFrame, price_floor: float) -> DataFrame:
    return drop_placeholders(raw, price_floor).withColumn(
        "vpu", F.try_divide(F.col("total_volume"), F.col("total_units"))
    )


def volume_consistency(raw: DataFrame, price_floor: float = S.PRICE_FLOOR) -> DataFrame:
    """Median over products of the variation of volume per unit within the product."""
    spread = (
        _volume_rows(raw, price_floor)
        .groupBy(S.KEY)
        .agg(F.stddev_samp("vpu").alias("sd"), F.avg("vpu").alias("mean"))
        .select(F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")).alias("cv"))
    )
    return exact_quantiles(spread, "cv", {"median_cv": 0.5})


def volume_by_retailer(
    raw: DataFrame, subcategory: str | Column, price_floor: float = S.PRICE_FLOOR
) -> DataFrame:
    """Median volume per unit by retailer for the subcategory's most frequent product."""
    rows = _volume_rows(raw.where(F.col("subcategory_nm") == subcategory), price_floor)
    busiest = (
        rows.groupBy(S.KEY)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), S.KEY)
        .limit(1)
        .select(S.KEY)
    )
    return exact_quantiles(
        rows.join(busiest, S.KEY, "left_semi"), "vpu", {"median_vpu": 0.5}, [S.KEY, "retailer_nm"]
    )


def id_fanout(raw: DataFrame) -> DataFrame:
    """Distinct barcodes, and the barcode that stands for most products."""
    fanout = raw.groupBy("product_id").agg(F.count_distinct(S.KEY).alias("n"))
    worst = F.max_by("product_id", F.struct(F.col("n"), F.col("product_id")))
    return fanout.agg(
        F.count(F.lit(1)).alias("distinct_ids"),
        worst.alias("worst_id"),
        F.max("n").alias("worst_products"),
    )


def placeholder_signature(raw: DataFrame, price_floor: float = S.PRICE_FLOOR) -> DataFrame:
    """Rows, median price, median shelf and revenue share below the floor and in the rest."""
    flagged = raw.select(
        F.coalesce(price_per_pack() < price_floor, F.lit(False)).alias("below_floor"),
        price_per_pack().alias("price"),
        "acv_pct",
        "total_sales",
    )
    sums = flagged.groupBy("below_floor").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("total_sales").alias("revenue")
    )
    whole = flagged.agg(F.sum("total_sales").alias("all_revenue")).scalar()
    long = flagged.select(
        "below_floor",
        F.explode(
            F.array(
                F.struct(F.lit("price").alias("what"), F.col("price").alias("v")),
                F.struct(F.lit("shelf").alias("what"), F.col("acv_pct").alias("v")),
            )
        ).alias("m"),
    ).select("below_floor", "m.what", "m.v")
    medians = (
        exact_quantiles(long, "v", {"median": 0.5}, ["below_floor", "what"])
        .groupBy("below_floor")
        .agg(
            F.max(F.when(F.col("what") == "price", F.col("median"))).alias("median_price"),
            F.max(F.when(F.col("what") == "shelf", F.col("median"))).alias("median_shelf"),
        )
    )
    return sums.join(medians, "below_floor", "left").select(
        "below_floor",
        "rows",
        "median_price",
        "median_shelf",
        F.try_divide(F.col("revenue"), whole).alias("revenue_share"),
    )


def price_histogram(raw: DataFrame, bins: int = 80) -> DataFrame:
    """Rows per equal-width bin of log10(price), empty bins too; the last bin includes the maximum."""
    logs = raw.where(price_per_pack() > 0).select(F.log10(price_per_pack()).alias("lp"))
    ends = logs.agg(F.struct(F.min("lp").alias("lo"), F.max("lp").alias("hi")).alias("e")).scalar()
    lo, hi = ends.getField("lo"), ends.getField("hi")
    slot = F.least(
        F.lit(bins - 1),
        F.coalesce(F.floor(F.try_divide((F.col("lp") - lo) * bins, hi - lo)), F.lit(0)),
    ).cast("int")
    counts = logs.groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    every = raw.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin",
        (lo + F.col("bin") * (hi - lo) / bins).alias("left_edge"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
    )


def _duplicate_keys(raw: DataFrame, *aggregates: Column) -> DataFrame:
    """Grain keys that occur more than once, by a partial aggregation rather than a window."""
    keys = raw.groupBy(*S.GRAIN).agg(F.count(F.lit(1)).alias("n"), *aggregates)
    return keys.where(F.col("n") > 1)


def duplicate_audit(raw: DataFrame) -> DataFrame:
    """Rows sharing a grain key, their share of all rows, and the number of such keys."""
    keys = raw.groupBy(*S.GRAIN).agg(F.count(F.lit(1)).alias("n"))
    again = F.col("n") > 1
    return keys.agg(
        F.coalesce(F.sum(F.when(again, F.col("n"))), F.lit(0)).alias("duplicate_rows"),
        F.try_divide(
            F.coalesce(F.sum(F.when(again, F.col("n"))), F.lit(0)), F.sum("n")
        ).alias("duplicate_share"),
        F.count_if(again).alias("duplicate_keys"),
    )


def duplicate_differs(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column, the share of duplicate keys in which it takes more than one value.

    More than one value means minimum below maximum, so no distinct counting is needed. Text is
    compared through 64-bit hashes, which keeps the aggregation hash-based; NULLs do not count.
    """
    types = dict(raw.dtypes)
    numbers = [c for c in columns if types[c] != "string"]
    texts = [c for c in columns if types[c] == "string"]
    spread = [(F.min(c) < F.max(c)).alias(c) for c in numbers]

    def code(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.xxhash64(c))

    hashed = [(F.min(code(c)) < F.max(code(c))).alias(c) for c in texts]
    keys = _duplicate_keys(raw, *spread, *hashed)
    shares = keys.agg(
        *[F.avg(F.when(F.col(c), 1.0).otherwise(0.0)).alias(c) for c in columns]
    )
    return shares.unpivot([], list(columns), "column", "share").withColumn(
        "never", F.col("share") == 0
    )


def duplicate_all_real(raw: DataFrame) -> DataFrame:
    """Share of duplicate keys in which every row sold units."""
    keys = _duplicate_keys(
        raw, F.min(F.when(F.col("total_units") > 0, 1).otherwise(0)).alias("all_sold")
    )
    return keys.agg(F.avg(F.col("all_sold").cast("double")).alias("share_all_sold"))


def shelf_units_corr(sales: DataFrame) -> DataFrame:
    """Correlation of log mean shelf with log mean units over products."""
    means = sales.groupBy(S.KEY).agg(
        F.avg("acv_pct").alias("shelf"), F.avg("total_units").alias("units")
    )
    both = means.where(F.col("shelf").isNotNull() & F.col("units").isNotNull())
    shelf = F.log(F.greatest("shelf", F.lit(0.1)))
    units = F.log(F.greatest("units", F.lit(1.0)))
    return both.agg(pair_corr(shelf, units).alias("corr"))


def blank_counts(features: DataFrame) -> DataFrame:
    """Blanks per feature."""
    counts = features.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in S.FEATURES])
    return counts.unpivot([], S.FEATURES, "feature", "blanks")


def feature_correlations(features: DataFrame, strong: float = 0.5) -> DataFrame:
    """Every pair of features with its pairwise-complete correlation, from one aggregation."""
    pairs = list(combinations(S.FEATURES, 2))
    row = features.agg(
        F.array(
            *[
                F.struct(
                    F.lit(a).alias("feature_a"),
                    F.lit(b).alias("feature_b"),
                    pair_corr(F.col(a), F.col(b)).alias("corr"),
                )
                for a, b in pairs
            ]
        ).alias("pairs")
    )
    return row.select(F.inline("pairs")).withColumn("strong", F.abs("corr") > strong)
