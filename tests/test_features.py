import numpy as np
import pandas as pd
import pytest
from panels import movement_by_numpy, shaped
from pyspark.sql import functions as F

from shelfwise import settings as S
from shelfwise.operators import audit, clean, features, reports


@pytest.fixture(scope="module")
def panel():
    """Products of every length at which a rule changes, planted trends, no promotion at all."""
    lengths = [7, 8, 25, 26, 51, 52, 103, 104]
    parts = [shaped(f"LEN{n:03d}", weeks=n, seed=n, deals=0.4) for n in lengths]
    parts += [
        shaped("GROW", drift=0.005, seed=1),
        shaped("SHRINK", drift=-0.005, seed=2),
        shaped("SEASONAL", wave=0.7, seed=3),
        shaped("FLAT", wave=0.01, seed=4),
        shaped("NOPROMO", deals=0.0, seed=5),
        shaped("CHEAP", price=2.5, seed=6, weeks=60),
    ]
    table = pd.concat(parts, ignore_index=True)
    gaps = (table.rgm_ppg == "GROW") & table.period_id.isin(table.period_id.unique()[10:14])
    table = table[~gaps].copy()
    blanks = table.index[(table.rgm_ppg == "FLAT")][::7]
    table.loc[blanks, "acv_pct"] = np.nan
    return table


@pytest.fixture(scope="module")
def sales(spark, panel):
    raw = spark.createDataFrame(panel)
    raw = raw.withColumn("acv_pct", F.when(~F.isnan("acv_pct"), F.col("acv_pct")))
    return clean.clean_panel(raw, min_weeks=1).cache()


def test_movement_equals_numpy_at_every_length(sales, panel):
    got = features.movement(sales).toPandas().set_index("rgm_ppg")
    assert set(got.index) == set(panel.rgm_ppg)
    for name, rows in panel.groupby("rgm_ppg"):
        want = movement_by_numpy(rows)
        for metric, value in want.items():
            np.testing.assert_allclose(
                np.nan if got.loc[name, metric] is None else got.loc[name, metric],
                value,
                atol=1e-8,
                err_msg=f"{name} {metric}",
            )


def test_planted_patterns_are_found(sales):
    got = features.movement(sales).toPandas().set_index("rgm_ppg")
    assert got.loc["GROW", "growth"] > 0 > got.loc["SHRINK", "growth"]
    assert got.loc["SEASONAL", "seasonality"] > got.loc["FLAT", "seasonality"]
    assert np.isnan(got.loc["NOPROMO", "promo_lift"])


def test_one_pass_table_equals_the_joined_halves(sales):
    one = features.product_features(sales, clean.product_meta(sales), min_weeks=1).toPandas()
    halves = features.features_join_dynamics(
        features.product_aggregates(sales), features.movement(sales)
    ).toPandas()
    one, halves = (t.set_index("rgm_ppg").sort_index() for t in (one, halves))
    for column in halves.columns.drop(["subcategory_nm", "brand_nm", "uom"]):
        np.testing.assert_allclose(
            one[column].astype(float), halves[column].astype(float), rtol=1e-9, atol=1e-9
        )


def test_price_tier_shares_ties_and_keeps_blanks(spark):
    rows = [("a", 1.0, 1.0), ("b", 2.0, 1.0), ("c", 2.0, 1.0), ("d", 4.0, 1.0), ("e", 4.0, 0.0)]
    table = spark.createDataFrame(rows, "rgm_ppg string, avg_price double, pack_size double")
    table = table.select(
        "*",
        F.lit(1.0).alias("pack_count"),
        F.lit(None).cast("string").alias("subcategory_nm"),
        F.lit("CT").alias("uom"),
    )
    got = {r.rgm_ppg: r.price_tier for r in features.price_tier(table).collect()}
    assert got == {"a": 0.25, "b": 0.625, "c": 0.625, "d": 1.0, "e": None}


def test_smoothing_with_an_even_width_looks_further_back(spark):
    rows = [("p", i, float(i)) for i in range(8)]
    weekly = spark.createDataFrame(rows, "rgm_ppg string, period_id int, shelf double")
    got = [r.steady for r in features.smoothed_shelf(weekly, 4).orderBy("period_id").collect()]
    want = pd.Series(range(8), dtype=float).rolling(4, center=True, min_periods=4).median()
    assert got == [w if not np.isnan(w) else float(i) for i, w in enumerate(want)]


def test_cleaning_rules(spark):
    base = shaped("P", weeks=14, stores=1, deals=0)
    twin = base.assign(product_id="P-2", acv_pct=95.0)
    cheap = base.head(3).assign(total_sales=base.total_units.head(3) * 0.02)
    none = base.head(2).assign(total_units=0.0)
    short = shaped("NEW", weeks=12, stores=1)
    raw = spark.createDataFrame(pd.concat([base, twin, cheap, none, short]))
    sales = clean.clean_panel(raw)
    rows = sales.orderBy("period_id").toPandas()
    assert list(rows.rgm_ppg.unique()) == ["P"] and len(rows) == 14
    np.testing.assert_allclose(rows.total_units, 2 * base.total_units.to_numpy())
    assert (rows.acv_pct == 95.0).all()
    assert [tuple(r) for r in clean.set_aside(raw).collect()] == [("NEW", 12)]


def test_duplicates_and_constancy(spark):
    base = shaped("P", weeks=5, stores=1)
    twin = base.assign(product_id="P-2")
    raw = spark.createDataFrame(pd.concat([base, twin, shaped("Q", weeks=5, stores=1)]))
    found = audit.duplicate_audit(raw).first()
    assert (found.duplicate_rows, found.duplicate_keys) == (10, 5)
    differs = {r.column: r.share for r in audit.duplicate_differs(raw, ["product_id", "uom"]).collect()}
    assert differs == {"product_id": 1.0, "uom": 0.0}


def test_correlation_without_spread_is_blank(spark):
    row = {c: float(i) for i, c in enumerate(S.FEATURES)}
    table = spark.createDataFrame([row, row])
    got = audit.feature_correlations(table).collect()
    assert len(got) == 45 and all(r["corr"] is None for r in got)


def test_band_edges(spark):
    tiers = [0.0, 1 / 3, 0.34, 2 / 3, 0.67, 1.0]
    table = spark.createDataFrame([(t,) for t in [*tiers, None]], "price_tier double")
    bands = [r.band for r in reports.price_band(table).collect()]
    assert bands == ["value", "value", "mid", "mid", "premium", "premium", None]
