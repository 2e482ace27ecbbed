"""The registered queries: every operator over the given tables.

Each takes (session, table folder) and returns a DataFrame. Where an operator takes group labels,
the price band stands in for them (value, mid and premium as 0, 1, 2), so that the result can be
compared exactly; the ``kmeans_*`` and ``*_fit`` queries use fitted groups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise import settings as S
from shelfwise.operators import (
    audit,
    clean,
    cluster,
    features,
    links,
    methods,
    prepare,
    reports,
    rules,
    scores,
)
from shelfwise.plans import pipeline
from shelfwise.sources import pos_csv, publish
from shelfwise.sources.retail_tables import pos_panel
from shelfwise.sources.staging import stage, stage_path

# Parameters of the registered queries on these tables.
FLOOR = 700.0
HARSH_FLOOR = 3500.0
ASIDE_WEEKS = 150
K = 3
# These tables hold no link at the strict bars; the look at single pairs leaves some.
LOOSE = {"alpha": 0.05, "min_effect": 0.10, "per_pair": True}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


# Money and prices have four or more exact decimals, so a decimal cut would fall on ties all the
# time; they are reported in single precision instead.
MONEY = {
    "total_sales",
    "any_promo_amt",
    "price_per_pack",
    "price",
    "price_a",
    "price_b",
    "avg_price",
    "price_swing",
    "revenue",
    "revenue_m",
    "total_revenue",
    "promo_revenue",
    "median_price",
    "value_revenue_m",
    "mid_revenue_m",
    "premium_revenue_m",
}


def tidy(df: DataFrame, default: int = 6, **digits: int) -> DataFrame:
    """Doubles rounded, as float sums differ in their last digits between engines."""

    def column(c: str, t: str):
        if t != "double":
            return F.col(c)
        if c in MONEY:
            return F.col(c).cast("float").cast("double").alias(c)
        return F.round(c, digits.get(c, default)).alias(c)

    return df.select(*[column(c, t) for c, t in df.dtypes])


def _kept(spark: SparkSession, sf: str) -> DataFrame:
    return clean.drop_placeholders(pos_panel(spark, sf), FLOOR)


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    return clean.merge_barcodes(_kept(spark, sf))


def _sales(spark: SparkSession, sf: str, min_weeks: int = S.MIN_WEEKS) -> DataFrame:
    return clean.clean_panel(pos_panel(spark, sf), FLOOR, min_weeks)


def _staged_sales(spark: SparkSession, sf: str) -> DataFrame:
    """The clean panel as a written table, for queries that read it more than once."""
    return stage(_sales(spark, sf), "clean-panel")


def _features(spark: SparkSession, sf: str, floor: float = FLOOR) -> DataFrame:
    return features.features_from_raw(pos_panel(spark, sf), floor)


def _staged_features(spark: SparkSession, sf: str, floor: float = FLOOR) -> DataFrame:
    return stage(_features(spark, sf, floor), "features")


def _with_format(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf).join(
        reports.product_format(pos_panel(spark, sf)), S.KEY, "left"
    )


def _banded(spark: SparkSession, sf: str, floor: float = FLOOR) -> DataFrame:
    """Staged features with the price band as stand-in group 0, 1, 2."""
    banded = reports.price_band(_features(spark, sf, floor))
    group = F.when(F.col("band") == "value", 0).when(F.col("band") == "mid", 1).otherwise(2)
    return stage(banded.withColumn("group", group), "banded")


def _points(spark: SparkSession, sf: str) -> DataFrame:
    table = _staged_features(spark, sf)
    return stage(prepare.fit_preparation(table).transform(table), "points")


def _scaled_banded(spark: SparkSession, sf: str) -> DataFrame:
    """Scaled features as points, with the price band as their only labeling."""
    banded = _banded(spark, sf)
    scaled = prepare.robust_scale(banded, prepare.fit_ranges(banded))
    return stage(
        scaled.join(banded.select(S.KEY, "group"), S.KEY).select(
            S.KEY, F.array(*S.FEATURES).alias("x"), F.array("group").alias("labels")
        ),
        "scaled",
    )


# --- sources, parsing, sinks -------------------------------------------------------------------


@query("load_pos")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = stage_path(spark, "pos-csv")
    text_week = F.date_format("period_id", pos_csv.PERIOD_FORMAT)
    pos_panel(spark, sf).withColumn("period_id", text_week).write.option("header", True).csv(path)
    loaded = pos_csv.read_panel(spark, path)
    return tidy(
        loaded.select(
            S.KEY, "product_id", "retailer_nm", "period_id", "total_units", "total_sales", "acv_pct"
        )
    )


@query("parse_period")
def _(spark: SparkSession, sf: str) -> DataFrame:
    text_week = F.date_format("period_id", pos_csv.PERIOD_FORMAT)
    text = pos_panel(spark, sf).select(text_week.alias("period_id"))
    return pos_csv.parse_period(text).groupBy("period_id").agg(F.count(F.lit(1)).alias("rows"))


@query("cast_measures")
def _(spark: SparkSession, sf: str) -> DataFrame:
    raw = pos_panel(spark, sf)
    measures = [F.col(c).cast("string").alias(c) for c in pos_csv.NUMERIC_COLS]
    text = raw.select("product_id", "retailer_nm", "period_id", *measures)
    return tidy(pos_csv.cast_measures(text))


@query("panel_shape")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return audit.panel_shape(pos_panel(spark, sf))


@query("publish_tables")
def _(spark: SparkSession, sf: str) -> DataFrame:
    groups = _banded(spark, sf).select(S.KEY, "group", F.col("band").alias("group_name"))
    agreement = groups.agg((F.count(F.lit(1)) / F.count(F.lit(1))).alias("agreement"))
    suggestions = groups.select("group_name", F.lit(S.UNDRILLED_ACTION).alias("action")).distinct()
    root = stage_path(spark, "published")
    publish.publish_tables({"groups": groups}, rules.publish_gate(agreement, suggestions), root)
    return publish.load_published(spark, root, "groups")


@query("stage_checkpoint")
def _(spark: SparkSession, sf: str) -> DataFrame:
    sales = _staged_sales(spark, sf)
    return tidy(
        sales.select(*S.GRAIN, "total_units", "total_sales", "acv_pct", "price_per_pack")
    )


@query("load_previous_groups")
def _(spark: SparkSession, sf: str) -> DataFrame:
    groups = _banded(spark, sf, HARSH_FLOOR).select(
        S.KEY, "group", F.col("band").alias("group_name")
    )
    root = stage_path(spark, "published")
    agreement = groups.agg((F.count(F.lit(1)) / F.count(F.lit(1))).alias("agreement"))
    suggestions = groups.select(F.lit(S.UNDRILLED_ACTION).alias("action")).distinct()
    publish.publish_tables({"groups": groups}, rules.publish_gate(agreement, suggestions), root)
    return publish.load_previous_groups(spark, root)


# --- projections and filters -------------------------------------------------------------------


@query("price_per_pack")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(
        clean.with_price(pos_panel(spark, sf)).select(
            S.KEY, "product_id", "retailer_nm", "period_id", "price_per_pack"
        )
    )


@query("drop_placeholders")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(
        _kept(spark, sf).select(
            S.KEY, "product_id", "retailer_nm", "period_id", "total_units", "total_sales"
        )
    )


@query("subcategory_slice")
def _(spark: SparkSession, sf: str) -> DataFrame:
    sliced = links.subcategory_slice(_staged_sales(spark, sf))
    return tidy(sliced.select("subcategory_nm", *S.GRAIN, "total_units", "total_sales"))


@query("top_subcategory")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return links.top_subcategory(_sales(spark, sf))


@query("derived_ratios")
def _(spark: SparkSession, sf: str) -> DataFrame:
    products = features.product_aggregates(_sales(spark, sf))
    return tidy(products.select(S.KEY, "bumpiness", "price_moves", "promo_share"))


@query("price_band")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(reports.price_band(_features(spark, sf)).select(S.KEY, "price_tier", "band"))


# --- joins -------------------------------------------------------------------------------------


@query("attach_product_meta")
def _(spark: SparkSession, sf: str) -> DataFrame:
    kept = _kept(spark, sf)
    panel = clean.attach_product_meta(clean.merge_barcodes(kept), clean.product_meta(kept))
    return panel.select(*S.GRAIN, *S.META_COLS)


@query("qualifying_products")
def _(spark: SparkSession, sf: str) -> DataFrame:
    merged = _merged(spark, sf)
    rows = clean.qualifying_products(merged, clean.history_weeks(_kept(spark, sf)), ASIDE_WEEKS)
    return rows.groupBy(S.KEY).agg(F.count(F.lit(1)).alias("rows"))


@query("features_join_dynamics")
def _(spark: SparkSession, sf: str) -> DataFrame:
    sales = _staged_sales(spark, sf)
    joined = features.features_join_dynamics(
        features.product_aggregates(sales), features.movement(sales)
    )
    columns = [S.KEY, "avg_units", "avg_price", "growth", "shelf_trend", "seasonality", "promo_lift"]
    return tidy(joined.select(*columns))


@query("pair_weeks_selfjoin")
def _(spark: SparkSession, sf: str) -> DataFrame:
    pairs = links.pair_weeks(links.weekly_prices(_sales(spark, sf)))
    return tidy(
        pairs.select(*links.PAIR, "period_id", "units_a", "units_b", "price_a", "price_b")
    )


@query("category_demand_join")
def _(spark: SparkSession, sf: str) -> DataFrame:
    joined = links.category_demand_join(
        stage(links.weekly_prices(_sales(spark, sf)), "product-weeks")
    )
    return joined.select("subcategory_nm", S.KEY, "period_id", "units", "category_units")


@query("runs_compare_join")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rules.runs_compare(_banded(spark, sf), _banded(spark, sf, HARSH_FLOOR))


@query("period_halves_join")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(reports.period_halves(_staged_sales(spark, sf)))


def _loose_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links of every subcategory at bars loose enough to leave some on these tables."""
    sales = _sales(spark, sf)
    return links.all_subcategory_links(sales, **LOOSE)


@query("link_group_lookup")
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = links.link_group_lookup(_loose_links(spark, sf), _banded(spark, sf), "band")
    return found.select(*links.PAIR, "relationship", "group_a", "group_b")


# --- aggregations ------------------------------------------------------------------------------


@query("merge_barcodes")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(_merged(spark, sf))


@query("product_meta")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return clean.product_meta(_kept(spark, sf))


@query("history_weeks")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return clean.history_weeks(_kept(spark, sf))


@query("set_aside")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return clean.set_aside(pos_panel(spark, sf), FLOOR, ASIDE_WEEKS)


@query("product_aggregates")
def _(spark: SparkSession, sf: str) -> DataFrame:
    products = features.product_aggregates(_sales(spark, sf))
    return tidy(
        products.drop("bumpiness", "price_moves", "promo_share")
    )


@query("weekly_view")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(features.weekly_view(_sales(spark, sf)))


@query("weekly_prices")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(links.weekly_prices(_sales(spark, sf)))


@query("subcategory_profile")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(reports.subcategory_profile(pos_panel(spark, sf)))


@query("group_profile")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(reports.group_profile(_banded(spark, sf)))


@query("group_revenue_share")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(reports.group_revenue_share(_banded(spark, sf)))


@query("group_mix")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(reports.group_mix(_banded(spark, sf), "subcategory_nm"))


@query("coverage_grid")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(reports.coverage_grid(_with_format(spark, sf)))


@query("thin_cells")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return reports.thin_cells(_with_format(spark, sf))


@query("mechanic_mix")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(reports.mechanic_mix(_sales(spark, sf), _banded(spark, sf)))


@query("retailer_profile")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(reports.retailer_profile(_staged_sales(spark, sf)))


@query("layer_profile")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(reports.layer_profile(_banded(spark, sf), "group"))


@query("link_group_matrix")
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = links.link_group_lookup(_loose_links(spark, sf), _banded(spark, sf), "band")
    return links.link_group_matrix(found)


@query("node_degree")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return links.node_degree(_loose_links(spark, sf))


@query("node_table")
def _(spark: SparkSession, sf: str) -> DataFrame:
    sales = _staged_sales(spark, sf)
    units = sales.groupBy(S.KEY).agg(F.sum("total_units").alias("units"))
    found = stage(
        links.all_subcategory_links(sales, **LOOSE), "links"
    )
    formats = reports.product_format(pos_panel(spark, sf))
    return tidy(links.node_table(found, sales, formats, reports.size_rank_ids(units)))


@query("link_summary")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return links.link_summary(_loose_links(spark, sf))


# --- windows and ordered series ----------------------------------------------------------------


@query("price_tier")
def _(spark: SparkSession, sf: str) -> DataFrame:
    products = stage(features.product_aggregates(_sales(spark, sf)), "products")
    return tidy(features.price_tier(products).select(S.KEY, "subcategory_nm", "price_tier"))


def _smoothed(spark: SparkSession, sf: str) -> DataFrame:
    return features.smoothed_shelf(features.weekly_view(_sales(spark, sf)))


@query("smoothed_shelf")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(_smoothed(spark, sf).select(S.KEY, "period_id", "steady"))


@query("sales_rate")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(features.sales_rate(_smoothed(spark, sf)).select(S.KEY, "period_id", "log_rate"))


@query("growth")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(features.movement(_sales(spark, sf)).select(S.KEY, "growth"), 9)


@query("shelf_trend")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(features.movement(_sales(spark, sf)).select(S.KEY, "shelf_trend"), 8)


@query("detrended_wobble")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rates = features.sales_rate(_smoothed(spark, sf))
    return tidy(features.detrended_wobble(rates).select(S.KEY, "period_id", "wobble"))


@query("seasonality")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(features.movement(_sales(spark, sf)).select(S.KEY, "seasonality"))


@query("promo_lift")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(features.movement(_sales(spark, sf)).select(S.KEY, "promo_lift"))


@query("movement")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(features.movement(_sales(spark, sf)))


@query("features")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(_features(spark, sf))


@query("pareto")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(reports.pareto(_sales(spark, sf)))


@query("pareto_summary")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(reports.pareto_summary(stage(reports.pareto(_sales(spark, sf)), "pareto")))


@query("category_decomposition")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(reports.category_decomposition(_sales(spark, sf)))


@query("decomposition_summary")
def _(spark: SparkSession, sf: str) -> DataFrame:
    parts = stage(reports.category_decomposition(_sales(spark, sf)), "decomposition")
    return tidy(reports.decomposition_summary(parts))


@query("size_rank_ids")
def _(spark: SparkSession, sf: str) -> DataFrame:
    weekly = links.weekly_prices(links.subcategory_slice(_staged_sales(spark, sf)))
    return reports.size_rank_ids(links.top_n_sellers(weekly), "total_units")


@query("retailer_codes")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return reports.retailer_codes(_sales(spark, sf))


@query("feature_zscores")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(rules.feature_zscores(reports.group_profile(_banded(spark, sf))))


# --- top-k and sets ----------------------------------------------------------------------------


@query("top_n_sellers")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return links.top_n_sellers(links.weekly_prices(_sales(spark, sf)))


@query("strongest_links")
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = stage(_loose_links(spark, sf), "links")
    return tidy(links.strongest_links(found).select(*links.PAIR, "effect", "p"))


@query("suggestions_order")
def _(spark: SparkSession, sf: str) -> DataFrame:
    banded = _banded(spark, sf)
    names = rules.name_groups(reports.group_profile(banded))
    ordered = rules.suggest_actions(banded, names)
    return ordered.select("group_name", "revenue_pct")


@query("common_products")
def _(spark: SparkSession, sf: str) -> DataFrame:
    raw = pos_panel(spark, sf)
    return pipeline.common_products(
        clean.clean_panel(raw, FLOOR, ASIDE_WEEKS), clean.clean_panel(raw, HARSH_FLOOR)
    )


@query("exclusive_retailer_share")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """At barcode grain, where some products do sell in one retailer only."""
    barcodes = _kept(spark, sf).withColumn(S.KEY, F.concat_ws("|", S.KEY, "product_id"))
    weeks = stage(clean.merge_barcodes(barcodes), "barcode-weeks")
    return tidy(reports.exclusive_retailer_share(weeks, weeks))


# --- audits ------------------------------------------------------------------------------------


@query("constant_columns")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return audit.constant_columns(pos_panel(spark, sf))


@query("attribute_constancy")
def _(spark: SparkSession, sf: str) -> DataFrame:
    columns = [*S.META_COLS, "attribute_1"]
    return audit.attribute_constancy(pos_panel(spark, sf), columns)


@query("promo_parts_check")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(audit.promo_parts_check(pos_panel(spark, sf)))


@query("promo_bounds_check")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(audit.promo_bounds_check(pos_panel(spark, sf)))


@query("volume_consistency")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(audit.volume_consistency(pos_panel(spark, sf), FLOOR))


@query("volume_by_retailer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    top = links.top_subcategory(_kept(spark, sf)).select("subcategory_nm").scalar()
    return tidy(audit.volume_by_retailer(pos_panel(spark, sf), top, FLOOR))


@query("id_fanout")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return audit.id_fanout(pos_panel(spark, sf))


@query("placeholder_signature")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(audit.placeholder_signature(pos_panel(spark, sf), FLOOR))


@query("price_histogram")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(audit.price_histogram(pos_panel(spark, sf)))


@query("duplicate_audit")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(audit.duplicate_audit(pos_panel(spark, sf)))


DIFFER_COLUMNS = ["product_id", *S.META_COLS, "total_units", "total_sales", "acv_pct"]


@query("duplicate_differs")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(audit.duplicate_differs(pos_panel(spark, sf), DIFFER_COLUMNS))


@query("duplicate_all_real")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(audit.duplicate_all_real(pos_panel(spark, sf)))


@query("shelf_units_corr")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(audit.shelf_units_corr(_sales(spark, sf)))


@query("blank_counts")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """At barcode grain, whose short histories leave blanks."""
    barcodes = pos_panel(spark, sf).withColumn(S.KEY, F.concat_ws("|", S.KEY, "product_id"))
    return audit.blank_counts(features.features_from_raw(barcodes, FLOOR))


@query("feature_correlations")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(audit.feature_correlations(_features(spark, sf)))


@query("promo_drift")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(reports.promo_drift(_staged_sales(spark, sf)))


@query("growth_flip")
def _(spark: SparkSession, sf: str) -> DataFrame:
    sales = _staged_sales(spark, sf)
    return tidy(reports.growth_flip(sales, features.movement(sales)))


# --- preparation, grouping, validation ---------------------------------------------------------


@query("clip_fill")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(prepare.clip_fill(_staged_features(spark, sf)))


@query("robust_scale")
def _(spark: SparkSession, sf: str) -> DataFrame:
    table = _staged_features(spark, sf)
    return tidy(prepare.robust_scale(table, prepare.fit_ranges(table)))


@query("pca_reduce")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _points(spark, sf)


@query("pca_2d")
def _(spark: SparkSession, sf: str) -> DataFrame:
    table = _staged_features(spark, sf)
    flat = prepare.fit_preparation(table).transform(table, 2)
    return flat.select(S.KEY, F.col("x")[0].alias("pc1"), F.col("x")[1].alias("pc2"))


@query("kmeans_fit")
def _(spark: SparkSession, sf: str) -> DataFrame:
    points = _points(spark, sf)
    return cluster.fit_groups(points, K).transform(points)


def _first_products(points: DataFrame, k: int) -> tuple[str, ...]:
    return tuple(r[S.KEY] for r in points.select(S.KEY).orderBy(S.KEY).limit(k).collect())


@query("kmeans_from_starts")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of the scaled features, from the first three products as starting centres."""
    points = _scaled_banded(spark, sf)
    (fit,) = cluster.fit_runs(points, [cluster.Run(K, 1, starts=_first_products(points, K))])
    ordered = cluster.canonical_order(points, fit.centres)
    return cluster.Grouping(ordered, fit.inertia).transform(points)


@query("scan_from_starts")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The scan of the scaled features, every k from its first products as starting centres."""
    points = _scaled_banded(spark, sf)
    ks = range(2, 11)
    fits = cluster.fit_runs(points, [cluster.Run(k, 1, starts=_first_products(points, k)) for k in ks])
    labelled = cluster.with_labels(points, [f.centres for f in fits])
    shares = (
        labelled.select(F.posexplode("labels").alias("at", "label"))
        .groupBy("at", "label")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("at")
        .agg((F.max("n") / F.sum("n")).alias("biggest_group"))
    )
    known = spark.createDataFrame(
        [(i, k, f.inertia) for i, (k, f) in enumerate(zip(ks, fits))], "at int, groups int, inertia double"
    )
    return tidy(known.join(shares, "at").drop("at"), 5)


@query("scan_k")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.scan_k(_points(spark, sf))


@query("silhouette_samples")
def _(spark: SparkSession, sf: str) -> DataFrame:
    samples = scores.silhouette_samples(_scaled_banded(spark, sf))
    return tidy(samples.drop("labeling"))


@query("silhouette")
def _(spark: SparkSession, sf: str) -> DataFrame:
    samples = scores.silhouette_samples(_scaled_banded(spark, sf))
    return tidy(scores.silhouette(samples).drop("labeling"))


@query("silhouette_sq")
def _(spark: SparkSession, sf: str) -> DataFrame:
    value = scores.silhouette_sq(_scaled_banded(spark, sf))
    return spark.range(1).select(F.round(F.lit(value), 6).alias("silhouette_sq"))


@query("calinski_harabasz")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(scores.calinski_harabasz(_scaled_banded(spark, sf)).drop("labeling"))


@query("choose_k")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Chooses among groupings of the products into n equal price-tier slices."""
    banded = _banded(spark, sf)
    scaled = prepare.robust_scale(banded, prepare.fit_ranges(banded))
    slices = [
        F.least(F.lit(k - 1), F.floor(F.col("tier") * k)).cast("int") for k in range(2, 11)
    ]
    points = scaled.join(
        banded.select(S.KEY, F.round("price_tier", 6).alias("tier")), S.KEY
    ).select(S.KEY, F.array(*S.FEATURES).alias("x"), F.array(*slices).alias("labels"))
    points = stage(points, "sliced")
    sharp = scores.silhouette(scores.silhouette_samples(points))
    table = sharp.join(scores.calinski_harabasz(points), "labeling").select(
        (F.col("labeling") + 2).cast("int").alias("groups"), "silhouette", "calinski_harabasz"
    )
    return tidy(scores.choose_k(stage(table, "slice-scores")))


@query("adjusted_rand")
def _(spark: SparkSession, sf: str) -> DataFrame:
    both = rules.runs_compare(_banded(spark, sf), _banded(spark, sf, HARSH_FLOOR))
    return tidy(scores.adjusted_rand(stage(both, "both"), "group_before", "group_after"))


@query("adjusted_mutual_info")
def _(spark: SparkSession, sf: str) -> DataFrame:
    table = _banded(spark, sf).join(
        reports.product_format(pos_panel(spark, sf)), S.KEY, "left"
    )
    columns = ["subcategory_nm", "brand_nm", "uom", "format", "pack_size"]
    return tidy(scores.adjusted_mutual_info(stage(table, "attributes"), "group", columns))


@query("cluster_balance")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(scores.cluster_balance(_banded(spark, sf)))


@query("stability")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.stability(_points(spark, sf), K)


@query("method_compare")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return methods.method_compare(_points(spark, sf), K)


@query("setting_sweep")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.setting_sweep(_points(spark, sf), K)


@query("split_biggest")
def _(spark: SparkSession, sf: str) -> DataFrame:
    points = _points(spark, sf)
    groups = _banded(spark, sf).select(S.KEY, "group")
    return cluster.split_biggest(points, groups)


@query("cleaning_sensitivity")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline.cleaning_sensitivity(pos_panel(spark, sf), K, FLOOR, HARSH_FLOOR)


# --- rules, gate, monitoring -------------------------------------------------------------------


@query("name_groups")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rules.name_groups(reports.group_profile(_banded(spark, sf)))


@query("suggest_actions")
def _(spark: SparkSession, sf: str) -> DataFrame:
    banded = _banded(spark, sf)
    return rules.suggest_actions(banded, rules.name_groups(reports.group_profile(banded)))


@query("products_moved")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(rules.products_moved(_banded(spark, sf), _banded(spark, sf, HARSH_FLOOR)))


@query("publish_gate")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The gate on the agreement of the price bands under two price floors."""
    banded = _banded(spark, sf)
    both = stage(rules.runs_compare(banded, _banded(spark, sf, HARSH_FLOOR)), "both")
    agreement = scores.adjusted_rand(both, "group_before", "group_after").select(
        F.round("ari", 6).alias("agreement")
    )
    names = rules.name_groups(reports.group_profile(banded))
    return rules.publish_gate(agreement, rules.suggest_actions(banded, names))


@query("run_parity")
def _(spark: SparkSession, sf: str) -> DataFrame:
    banded = _banded(spark, sf)
    names = rules.name_groups(reports.group_profile(banded))
    expected = {
        "products": 150,
        "groups": 3,
        "group_sizes": [48, 48, 54],
        "group_names": [S.PROMO, S.SHRINKING, S.STEADY],
    }
    return rules.run_parity(banded, names, expected)


@query("assign_to_existing_groups")
def _(spark: SparkSession, sf: str) -> DataFrame:
    table = _staged_features(spark, sf)
    preparation = prepare.fit_preparation(table)
    points = stage(preparation.transform(table), "points")
    path = stage_path(spark, "model")
    prepare.save_preparation(preparation, spark, path)
    pipeline.save_grouping(cluster.fit_groups(points, K), spark, path)
    return pipeline.assign_to_existing_groups(
        _staged_features(spark, sf, HARSH_FLOOR),
        prepare.load_preparation(spark, path),
        pipeline.load_grouping(spark, path),
    )


# --- cross-price links -------------------------------------------------------------------------


def _fits(spark: SparkSession, sf: str) -> DataFrame:
    return links.pair_regression(links.weekly_prices(_sales(spark, sf)))


@query("pair_regression")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(_fits(spark, sf))


@query("pair_skip_rules")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs fitted of pairs formed, among barcodes whose short histories make some unfit.

    Every barcode is a product here, so nearly every raw row is a product week of its own. Totals
    and demand are sums over the rows as they are; only the rows of the top N are merged.
    """
    subcategory = F.element_at(F.split(S.KEY, r"\|"), 2).alias("subcategory_nm")
    sums, shares = ["total_units", "total_sales"], ["any_promo_acv_pct", "acv_pct"]
    rows = stage(
        _kept(spark, sf)
        .withColumn(S.KEY, F.concat_ws("|", S.KEY, "product_id"))
        .select(*S.GRAIN, *sums, *shares),
        "barcode-rows",
    )
    units = rows.select(subcategory, S.KEY, "period_id", F.col("total_units").alias("units"))
    places = stage(links.top_n_sellers(units), "top-sellers")
    merged = clean.merge_barcodes(rows.join(places, S.KEY, "left_semi"), sums, shares)
    weekly = links.weekly_prices(merged.withColumn("subcategory_nm", subcategory))
    ranked = stage(links.ranked_weeks(weekly, places), "ranked-weeks")
    formed = links.pairs_of_weeks(ranked).groupBy(*links.PAIR).agg(F.count(F.lit(1)).alias("weeks"))
    fitted = links.fits_of_weeks(ranked, links.category_demand(units), min_weeks=7).select(
        *links.PAIR, "shared_weeks"
    )
    both = formed.join(fitted, links.PAIR, "left")
    return both.groupBy("subcategory_nm").agg(
        F.count(F.lit(1)).alias("formed"),
        F.count("shared_weeks").alias("fitted"),
    )


@query("effect_pvalue")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(links.effect_pvalue(_fits(spark, sf)).select(*links.PAIR, "effect", "p"))


@query("cross_price_links")
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = links.cross_price_links(_staged_sales(spark, sf), **LOOSE)
    return tidy(found)


@query("strict_links")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """At the published bars: 0.05 over all pairs of the subcategory, effects of 0.30."""
    return tidy(links.strict_links(links.effect_pvalue(_fits(spark, sf))))


@query("all_subcategory_links")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(_loose_links(spark, sf))


# --- the whole run -----------------------------------------------------------------------------


@query("pipeline_run")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Raw panel to published suggestions with the default search, restarts and resamples."""
    result = pipeline.run(
        spark,
        pos_panel(spark, sf),
        stage_path(spark, "published"),
        price_floor=FLOOR,
    )
    gate = result.gate.select("agreement", "bar", "publish").first()
    return result.suggestions.select(
        "*", *[F.lit(gate[c]).alias(c) for c in ("agreement", "bar", "publish")]
    )
