"""Column groups, default thresholds and rule texts.

Every threshold here is only the default of a keyword argument somewhere else.
"""

# Column names of the sales panel.
KEY = "rgm_ppg"
GRAIN = ["rgm_ppg", "retailer_nm", "period_id"]
SALES_COLS = ["total_units", "total_volume", "total_sales", "any_promo_units", "any_promo_amt"]
ACV_COLS = [
    "acv_pct",
    "any_promo_acv_pct",
    "acv_tpr_only",
    "feature_and_display_acv_pct",
    "feature_without_display_acv_pct",
    "display_without_feature_acv_pct",
]
PROMO_MECHANICS = ACV_COLS[2:]
META_COLS = ["subcategory_nm", "brand_nm", "uom", "product_unit_size", "product_pack_count"]
SIZE_COLS = ["product_unit_size", "product_pack_count"]

# The ten features the grouping sees.
FEATURES = [
    "price_tier",
    "shelf_presence",
    "bumpiness",
    "price_moves",
    "growth",
    "seasonality",
    "shelf_trend",
    "promo_activity",
    "promo_share",
    "promo_lift",
]

# Default thresholds.
PRICE_FLOOR = 0.10
MIN_WEEKS = 13
SMOOTHING_WEEKS = 9
SMOOTHING_MIN_WEEKS = 4
MIN_WEEKS_TREND = 8
MIN_WEEKS_PROMO_LIFT = 26
LONG_CYCLE = 52
SHORT_CYCLE = 13
MIN_CONTRAST_WEEKS = 4
K_SEARCH = (3, 10)
KEEP_VARIANCE = 0.90
RESTARTS = 20
SEED = 42
RESAMPLES = 25
RESAMPLE_FRACTION = 0.80
PUBLISH_BAR = 0.60
MOVED_ALARM = 0.20
TOP_N = 40
MIN_SHARED_WEEKS = 20
ALPHA = 0.05
MIN_EFFECT = 0.30
SHELF_FLOOR = 0.5
NAME_CUT = 0.8
SPLIT_SEARCH = (2, 5)

# Group names, suggested actions and reasons.
SHRINKING = "Shrinking shelf"
PROMO = "Promo leaders"
STEADY = "Steady core"
ACTIONS = [
    (PROMO, "Optimise the promo calendar", "Promo weeks clearly outsell quiet weeks"),
    (STEADY, "No single action", "Too big and too mixed for one lever"),
    (SHRINKING, "Review product", "Investigate shelf loss"),
]
NO_RULE = ("Review by hand", "No rule matched this group")
UNDRILLED_ACTION = "No single action"
COMPETE = "compete"
SELL_TOGETHER = "sell together"
