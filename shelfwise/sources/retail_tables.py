"""The raw sales panel as a view over order-line, part, supplier and nation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_schemas: dict[str, T.StructType] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; its schema is inferred once per process, not once per query."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def pos_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line: barcode x retailer x week, with the panel's column names.

    Join sides are left to the planner: they are broadcast when their size allows and shuffled
    otherwise. Product attributes come from the part table, so no window runs over order lines.
    """
    lines = _table(spark, sf_dir, "lineitem")
    part = _table(spark, sf_dir, "part")
    supplier = _table(spark, sf_dir, "supplier")
    nation = _table(spark, sf_dir, "nation")

    sizes = part.groupBy("p_brand", "p_type").agg(F.min("p_size").alias("unit_size"))
    format_code = (F.substring("p_brand", 7, 10).cast("int") % 4).cast("string")
    catalogue = part.join(sizes, ["p_brand", "p_type"]).select(
        F.col("p_partkey"),
        F.col("p_size"),
        F.concat_ws("|", "p_brand", "p_type").alias("rgm_ppg"),
        F.col("p_partkey").cast("string").alias("product_id"),
        F.col("p_type").alias("subcategory_nm"),
        F.col("p_brand").alias("brand_nm"),
        F.col("unit_size").cast("double").alias("product_unit_size"),
        F.concat(F.lit("F"), format_code).alias("attribute_1"),
    )
    places = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey"),
        F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("retailer_nm"),
    )

    money = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    promoted = F.col("l_discount") >= 0.05
    return (
        lines.join(catalogue, F.col("l_partkey") == F.col("p_partkey"))
        .join(places, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            "rgm_ppg",
            "product_id",
            "retailer_nm",
            F.trunc(F.col("l_shipdate").cast("date"), "week").alias("period_id"),
            "subcategory_nm",
            "brand_nm",
            F.lit("CT").alias("uom"),
            "product_unit_size",
            F.lit(1.0).alias("product_pack_count"),
            F.col("l_quantity").alias("total_units"),
            (F.col("l_quantity") * F.col("p_size")).alias("total_volume"),
            money.alias("total_sales"),
            F.when(promoted, F.col("l_quantity")).otherwise(0.0).alias("any_promo_units"),
            F.when(promoted, money).otherwise(0.0).alias("any_promo_amt"),
            (100 * (1 - 10 * F.col("l_tax"))).alias("acv_pct"),
            (1000 * F.col("l_discount")).alias("any_promo_acv_pct"),
            (500 * F.col("l_discount")).alias("acv_tpr_only"),
            (250 * F.col("l_discount")).alias("feature_and_display_acv_pct"),
            (200 * F.col("l_discount")).alias("feature_without_display_acv_pct"),
            (50 * F.col("l_discount")).alias("display_without_feature_acv_pct"),
            F.lit("GOODS").alias("category"),
            F.lit("ALL").alias("cmu"),
            F.lit("Stores").alias("channel_nm"),
            "attribute_1",
            F.col("subcategory_nm").alias("attribute_2"),
            F.lit("STANDARD").alias("attribute_3"),
        )
    )
