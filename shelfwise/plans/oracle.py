"""DuckDB SQL that states each registered query independently, over the same tables.

Statements share named steps (common table expressions) for the panel, the clean panel, the
features and the groups; each query adds its own last part.
"""

from __future__ import annotations

from shelfwise import settings as S
from shelfwise.plans.queries import (
    ASIDE_WEEKS,
    DIFFER_COLUMNS,
    FLOOR,
    HARSH_FLOOR,
    LOOSE,
    MONEY,
)

PANEL = """
panel AS (
  SELECT p_brand || '|' || p_type AS rgm_ppg,
         cast(l_partkey AS varchar) AS product_id,
         'R' || n_regionkey AS retailer_nm,
         cast(date_trunc('week', l_shipdate) AS date) AS period_id,
         p_type AS subcategory_nm, p_brand AS brand_nm, 'CT' AS uom,
         cast(unit_size AS double) AS product_unit_size,
         cast(1 AS double) AS product_pack_count,
         l_quantity AS total_units, l_quantity * p_size AS total_volume,
         l_extendedprice * (1 - l_discount) AS total_sales,
         CASE WHEN l_discount >= 0.05 THEN l_quantity ELSE 0.0 END AS any_promo_units,
         CASE WHEN l_discount >= 0.05 THEN l_extendedprice * (1 - l_discount) ELSE 0.0 END
           AS any_promo_amt,
         100 * (1 - 10 * l_tax) AS acv_pct,
         1000 * l_discount AS any_promo_acv_pct,
         500 * l_discount AS acv_tpr_only,
         250 * l_discount AS feature_and_display_acv_pct,
         200 * l_discount AS feature_without_display_acv_pct,
         50 * l_discount AS display_without_feature_acv_pct,
         'GOODS' AS category, 'ALL' AS cmu, 'Stores' AS channel_nm,
         'F' || (cast(substr(p_brand, 7, 10) AS int) % 4) AS attribute_1
  FROM lineitem
  JOIN (SELECT *, min(p_size) OVER (PARTITION BY p_brand, p_type) AS unit_size FROM part)
    ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey)"""

_SUMS = ", ".join(f"sum({c}) AS {c}" for c in S.SALES_COLS)
_MAXES = ", ".join(f"max({c}) AS {c}" for c in S.ACV_COLS)
_METAS = ", ".join(f"min({c}) AS {c}" for c in S.META_COLS)


def _clean(floor: float = FLOOR, min_weeks: int = S.MIN_WEEKS, tag: str = "", key: str = "") -> str:
    """Kept rows, merged rows, catalogue and clean panel; ``tag`` keeps two variants apart."""
    source = "panel" if not key else f"(SELECT * REPLACE ({key} AS rgm_ppg) FROM panel)"
    return f"""
kept{tag} AS (
  SELECT * FROM {source} WHERE total_units > 0 AND total_sales / total_units >= {floor}),
merged{tag} AS (
  SELECT *, total_sales / total_units AS price_per_pack
  FROM (SELECT rgm_ppg, retailer_nm, period_id, {_SUMS}, {_MAXES}
        FROM kept{tag} GROUP BY rgm_ppg, retailer_nm, period_id)),
meta{tag} AS (
  SELECT rgm_ppg, {_METAS}, count(DISTINCT period_id) AS n_weeks FROM kept{tag} GROUP BY rgm_ppg),
sales{tag} AS (
  SELECT m.*, {", ".join(f"c.{c}" for c in S.META_COLS)}
  FROM merged{tag} m JOIN meta{tag} c ON m.rgm_ppg = c.rgm_ppg AND c.n_weeks >= {min_weeks})"""


def _moves(tag: str = "") -> str:
    """Weekly view to movement metrics."""
    frame = (
        "OVER (PARTITION BY rgm_ppg ORDER BY period_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)"
    )
    return f"""
weekly{tag} AS (
  SELECT rgm_ppg, period_id, sum(total_units) AS units, round(avg(acv_pct), 9) AS shelf,
         round(avg(any_promo_acv_pct), 9) AS promo
  FROM sales{tag} GROUP BY rgm_ppg, period_id),
steadied{tag} AS (
  SELECT *, coalesce(CASE WHEN count(shelf) {frame} >= {S.SMOOTHING_MIN_WEEKS}
                          THEN quantile_cont(shelf, 0.5) {frame} END, shelf) AS steady
  FROM weekly{tag}),
rated{tag} AS (
  SELECT *, ln(1 + units / greatest(steady, 1)) AS log_rate,
         row_number() OVER (PARTITION BY rgm_ppg ORDER BY period_id) - 1 AS x,
         count(*) OVER (PARTITION BY rgm_ppg) AS n
  FROM steadied{tag}),
lines{tag} AS (
  SELECT rgm_ppg, regr_slope(log_rate, x) AS slope, regr_intercept(log_rate, x) AS intercept,
         regr_slope(shelf, x) AS shelf_slope, stddev_samp(promo) AS promo_sd,
         quantile_cont(promo, 0.25) AS q25, quantile_cont(promo, 0.75) AS q75
  FROM rated{tag} GROUP BY rgm_ppg),
wobbled{tag} AS (
  SELECT r.*, l.* EXCLUDE (rgm_ppg), log_rate - (slope * x + intercept) AS wobble,
         CASE WHEN n >= {2 * S.LONG_CYCLE} THEN {S.LONG_CYCLE} ELSE {S.SHORT_CYCLE} END AS cycle
  FROM rated{tag} r JOIN lines{tag} l ON r.rgm_ppg = l.rgm_ppg),
phased{tag} AS (
  SELECT *, avg(wobble) OVER (PARTITION BY rgm_ppg, x % cycle) AS season FROM wobbled{tag}),
moves{tag} AS (
  SELECT rgm_ppg,
    CASE WHEN max(n) >= {S.MIN_WEEKS_TREND} THEN max(slope) END AS growth,
    CASE WHEN max(n) >= {S.MIN_WEEKS_TREND} THEN max(shelf_slope) END AS shelf_trend,
    CASE WHEN max(n) >= {S.MIN_WEEKS_TREND} AND max(n) >= 2 * max(cycle) AND var_pop(wobble) > 0
         THEN greatest(0.0, 1 - var_pop(wobble - season) / var_pop(wobble)) ELSE 0.0 END
      AS seasonality,
    CASE WHEN max(n) >= {S.MIN_WEEKS_PROMO_LIFT} AND max(promo_sd) > 0
          AND count(*) FILTER (promo >= q75) >= {S.MIN_CONTRAST_WEEKS}
          AND count(*) FILTER (promo <= q25) >= {S.MIN_CONTRAST_WEEKS}
         THEN exp(quantile_cont(wobble, 0.5) FILTER (promo >= q75)
                  - quantile_cont(wobble, 0.5) FILTER (promo <= q25)) - 1 END AS promo_lift
  FROM phased{tag} GROUP BY rgm_ppg)"""


def _products(tag: str = "") -> str:
    return f"""
products{tag} AS (
  SELECT *, unit_swing / nullif(avg_units, 0) AS bumpiness,
         price_swing / nullif(avg_price, 0) AS price_moves,
         promo_revenue / nullif(total_revenue, 0) AS promo_share
  FROM (SELECT rgm_ppg, subcategory_nm, brand_nm, uom, avg(total_units) AS avg_units,
               stddev_samp(total_units) AS unit_swing, avg(price_per_pack) AS avg_price,
               stddev_samp(price_per_pack) AS price_swing, sum(total_sales) AS total_revenue,
               avg(acv_pct) AS shelf_presence, sum(any_promo_amt) AS promo_revenue,
               avg(any_promo_acv_pct) AS promo_activity, min(product_unit_size) AS pack_size,
               min(product_pack_count) AS pack_count, count(DISTINCT period_id) AS n_weeks
        FROM sales{tag} GROUP BY rgm_ppg, subcategory_nm, brand_nm, uom)),
tiered{tag} AS (
  SELECT * EXCLUDE (ppc),
         CASE WHEN ppc IS NOT NULL THEN
           (rank() OVER (PARTITION BY subcategory_nm, uom ORDER BY ppc NULLS LAST)
            + (count(*) OVER (PARTITION BY subcategory_nm, uom, ppc) - 1) / 2.0)
           / count(ppc) OVER (PARTITION BY subcategory_nm, uom) END AS price_tier
  FROM (SELECT *, avg_price / nullif(pack_size * pack_count, 0) AS ppc FROM products{tag}))"""


def _features(floor: float = FLOOR, tag: str = "", key: str = "") -> str:
    """Everything up to the feature table and its price bands."""
    return f"""{_clean(floor, tag=tag, key=key)},{_moves(tag)},{_products(tag)},
features{tag} AS (
  SELECT t.*, m.* EXCLUDE (rgm_ppg) FROM tiered{tag} t LEFT JOIN moves{tag} m
    ON t.rgm_ppg = m.rgm_ppg),
banded{tag} AS (
  SELECT *, CASE band WHEN 'value' THEN 0 WHEN 'mid' THEN 1 ELSE 2 END AS "group"
  FROM (SELECT *, CASE WHEN price_tier <= 1.0/3 THEN 'value' WHEN price_tier <= 2.0/3 THEN 'mid'
                       WHEN price_tier <= 1 THEN 'premium' END AS band FROM features{tag}))"""


PAIRED = """
weekly_prices AS (
  SELECT *, revenue / units AS price
  FROM (SELECT subcategory_nm, rgm_ppg, period_id, sum(total_units) AS units,
               sum(total_sales) AS revenue, avg(any_promo_acv_pct) AS promo, avg(acv_pct) AS shelf
        FROM sales GROUP BY subcategory_nm, rgm_ppg, period_id))"""


def _pairs(top_n: int = S.TOP_N) -> str:
    return f"""{PAIRED},
tops AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY subcategory_nm ORDER BY total_units DESC, rgm_ppg)
              AS place
    FROM (SELECT subcategory_nm, rgm_ppg, sum(units) AS total_units
          FROM weekly_prices GROUP BY subcategory_nm, rgm_ppg))
  WHERE place <= {top_n}),
demand AS (
  SELECT subcategory_nm, period_id, sum(units) AS category_units
  FROM weekly_prices GROUP BY subcategory_nm, period_id),
ranked AS (SELECT w.*, place FROM weekly_prices w JOIN tops t USING (subcategory_nm, rgm_ppg)),
pair_weeks AS (
  SELECT a.subcategory_nm, a.rgm_ppg AS product_a, b.rgm_ppg AS product_b, a.period_id,
         a.units AS units_a, b.units AS units_b, a.price AS price_a, b.price AS price_b,
         a.promo AS promo_a, a.shelf AS shelf_a, category_units
  FROM ranked a JOIN ranked b ON a.subcategory_nm = b.subcategory_nm
   AND a.period_id = b.period_id AND a.place < b.place
  JOIN demand d ON d.subcategory_nm = a.subcategory_nm AND d.period_id = a.period_id)"""


def _regression(min_weeks: int = S.MIN_SHARED_WEEKS, top_n: int = S.TOP_N) -> str:
    """Ordinary least squares by successive orthogonalisation, one step per control."""
    pair = "subcategory_nm, product_a, product_b"
    over = f"OVER (PARTITION BY {pair})"
    controls = ["own_price", "own_promo", "own_shelf", "week", "demand"]
    columns = ["y", "z", *controls]
    steps = f"""{_pairs(top_n)},
design AS (
  SELECT {pair}, count(*) {over} AS n, ln(units_a) AS y, ln(price_b) AS z, ln(price_a) AS own_price,
         promo_a / 100 AS own_promo, ln(greatest(shelf_a, {S.SHELF_FLOOR})) AS own_shelf,
         (period_id - min(period_id) {over}) / 7.0 AS week, ln(category_units) AS demand
  FROM pair_weeks),
step0 AS (
  SELECT {pair}, n, true AS full_rank,
         {", ".join(f"{c} - avg({c}) {over} AS {c}" for c in columns)},
         {", ".join(f"sum({c} * {c}) {over} AS len_{c}" for c in [*controls, "z"])}
  FROM design WHERE n >= {min_weeks})"""
    left = list(columns)
    for at, control in enumerate(controls, start=1):
        left.remove(control)
        norm = f"sum({control} * {control}) {over}"
        rest = ", ".join(
            f"{c} - coalesce(sum({c} * {control}) {over} / nullif({norm}, 0), 0) * {control} AS {c}"
            for c in left
        )
        lengths = ", ".join(f"len_{c}" for c in left if c != "y")
        steps += f""",
step{at} AS (
  SELECT {pair}, n, {rest}, {lengths},
         full_rank AND {norm} > 1e-20 * len_{control} AS full_rank
  FROM step{at - 1})"""
    return (
        steps
        + f""",
fits AS (
  SELECT {pair}, n AS shared_weeks, n - 7 AS dof, zy / zz AS effect,
         sqrt(greatest(0.0, yy - zy * zy / zz) / (n - 7) / zz) AS std_error
  FROM (SELECT {pair}, max(n) AS n, sum(z * z) AS zz, sum(z * y) AS zy, sum(y * y) AS yy,
               bool_and(full_rank) AS full_rank, max(len_z) AS len_z
        FROM step{len(controls)} GROUP BY {pair})
  WHERE full_rank AND zz > 1e-20 * len_z AND n > 7),
tested AS (
  SELECT *, 1 - CASE
      WHEN dof = 1 THEN 2 / pi() * theta
      WHEN dof % 2 = 1 THEN 2 / pi() * (theta + sin(theta) * list_sum(list_transform(
        range(1, (dof + 1) // 2), lambda k: pow(cos(theta), 2 * k - 1)
          * exp(2 * (k - 1) * ln(2.0) + 2 * lgamma(cast(k AS double)) - lgamma(2.0 * k)))))
      ELSE sin(theta) * list_sum(list_transform(
        range(0, dof // 2), lambda k: pow(cos(theta), 2 * k)
          * exp(lgamma(2.0 * k + 1) - 2 * k * ln(2.0) - 2 * lgamma(k + 1.0))))
      END AS p
  FROM (SELECT *, atan(abs(effect / std_error) / sqrt(dof)) AS theta
        FROM fits WHERE std_error > 0)),
related AS (
  SELECT *, CASE WHEN effect > 0 THEN '{S.COMPETE}' ELSE '{S.SELL_TOGETHER}' END AS relationship,
         count(*) OVER (PARTITION BY subcategory_nm) AS tests FROM tested),
strict AS (SELECT * FROM related WHERE p < {LOOSE["alpha"]} AND abs(effect) >= {LOOSE["min_effect"]})"""
    )


SCALED = """
long_raw AS (
  UNPIVOT (SELECT rgm_ppg, {features} FROM banded) ON {features} INTO NAME feature VALUE v),
limits AS (
  SELECT feature, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi
  FROM long_raw GROUP BY feature),
clipped AS (
  SELECT rgm_ppg, feature, least(greatest(v, lo), hi) AS v FROM long_raw JOIN limits USING (feature)),
fills AS (SELECT feature, quantile_cont(v, 0.5) AS fill FROM clipped GROUP BY feature),
filled AS (
  SELECT b.rgm_ppg, b."group", f.feature, coalesce(c.v, f.fill) AS v
  FROM banded b CROSS JOIN fills f
  LEFT JOIN clipped c ON c.rgm_ppg = b.rgm_ppg AND c.feature = f.feature),
spreads AS (
  SELECT feature, quantile_cont(v, 0.5) AS centre,
         quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr
  FROM filled GROUP BY feature),
scaled AS (
  SELECT rgm_ppg, "group", feature, (v - centre) / CASE WHEN iqr = 0 THEN 1 ELSE iqr END AS v
  FROM filled JOIN spreads USING (feature))""".format(features=", ".join(S.FEATURES))

DISTANCES = """
distances AS (
  SELECT a.rgm_ppg AS p, b.rgm_ppg AS q, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS d
  FROM scaled a JOIN scaled b ON a.feature = b.feature GROUP BY a.rgm_ppg, b.rgm_ppg)"""


def _silhouettes(labels: str) -> str:
    """Per-point silhouettes for a table ``labels`` of (labeling, rgm_ppg, label)."""
    return f"""{DISTANCES},
near AS (
  SELECT o.labeling, d.p, o.label AS own, t.label AS other, sum(d) AS total, count(*) AS n
  FROM distances d JOIN {labels} o ON o.rgm_ppg = d.p
  JOIN {labels} t ON t.rgm_ppg = d.q AND t.labeling = o.labeling
  GROUP BY o.labeling, d.p, o.label, t.label),
sides AS (
  SELECT labeling, p, own, max(CASE WHEN own = other AND n > 1 THEN total / (n - 1) END) AS a,
         min(CASE WHEN own <> other THEN total / n END) AS b
  FROM near GROUP BY labeling, p, own),
samples AS (
  SELECT labeling, p AS rgm_ppg, own AS label,
         CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END AS silhouette
  FROM sides)"""


def _calinski(labels: str) -> str:
    return f"""
cells AS (
  SELECT l.labeling, l.label, feature, count(*) AS n, avg(v) AS mean, var_pop(v) * count(*) AS within
  FROM scaled s JOIN {labels} l USING (rgm_ppg) GROUP BY l.labeling, l.label, feature),
centres AS (SELECT feature, avg(v) AS centre FROM scaled GROUP BY feature),
spread AS (
  SELECT labeling, sum(within) AS w, sum(n * (mean - centre) * (mean - centre)) AS b,
         count(DISTINCT label) AS k
  FROM cells JOIN centres USING (feature) GROUP BY labeling),
calinski AS (
  SELECT labeling, (b / (k - 1)) / (w / ((SELECT count(*) FROM banded) - k)) AS calinski_harabasz
  FROM spread)"""


def _ari(both: str, a: str, b: str) -> str:
    return f"""
cross_counts AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {both} GROUP BY ALL),
ari AS (
  SELECT (i - r * c / t) / ((r + c) / 2 - r * c / t) AS ari FROM (
    SELECT (SELECT sum(n * (n - 1) / 2) FROM cross_counts) AS i,
           (SELECT sum(s * (s - 1) / 2) FROM (SELECT sum(n) AS s FROM cross_counts GROUP BY a)) AS r,
           (SELECT sum(s * (s - 1) / 2) FROM (SELECT sum(n) AS s FROM cross_counts GROUP BY b)) AS c,
           (SELECT sum(n) * (sum(n) - 1) / 2 FROM cross_counts) AS t))"""


PROFILE = """
profile AS (SELECT "group", {means} FROM banded GROUP BY "group"),
zscores AS (SELECT "group", {scores} FROM profile),
bases AS (
  SELECT "group", CASE WHEN shelf_trend <= -{cut} THEN '{shrinking}'
                       WHEN promo_activity >= {cut} THEN '{promo}' ELSE '{steady}' END AS base
  FROM zscores),
names AS (
  SELECT "group", CASE WHEN place = 1 THEN base ELSE base || ' ' || place END AS group_name
  FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY "group") AS place FROM bases)),
shares AS (
  SELECT "group", count(*) AS products,
         100 * sum(total_revenue) / (SELECT sum(total_revenue) FROM banded) AS revenue_pct
  FROM banded GROUP BY "group"),
suggested AS (
  SELECT group_name, products, round(revenue_pct, 1) AS revenue_pct,
         coalesce(action, '{no_action}') AS action, coalesce(why, '{no_why}') AS why
  FROM shares JOIN names USING ("group")
  LEFT JOIN (VALUES {rules}) AS r(group_name, action, why) USING (group_name))""".format(
    means=", ".join(f"avg({c}) AS {c}" for c in S.FEATURES),
    scores=", ".join(
        f"({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0) AS {c}" for c in S.FEATURES
    ),
    cut=S.NAME_CUT,
    shrinking=S.SHRINKING,
    promo=S.PROMO,
    steady=S.STEADY,
    no_action=S.NO_RULE[0],
    no_why=S.NO_RULE[1],
    rules=", ".join(f"('{n}', '{a}', '{w}')" for n, a, w in S.ACTIONS),
)

BOTH = f"""{_features()},{_features(HARSH_FLOOR, "_b")},
both_runs AS (
  SELECT a.rgm_ppg, a."group" AS group_before, b."group" AS group_after
  FROM banded a JOIN banded_b b ON a.rgm_ppg = b.rgm_ppg)"""

BARCODE = "rgm_ppg || '|' || product_id"


def _rounded(columns: list[str], digits: int = 6) -> str:
    """Money in single precision, the rest rounded (adding zero turns -0.0 into 0.0)."""
    return ", ".join(
        f"cast(cast({c} AS float) AS double) AS {c}"
        if c in MONEY
        else f"round({c}, {digits}) + 0.0 AS {c}"
        for c in columns
    )


def _sql(last: str, *steps: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join([PANEL, *steps]) + "\n" + last.strip()


_CLEAN = _clean()
_FEATURES = _features()
_MEASURES = [*S.SALES_COLS, *S.ACV_COLS]
_MOVES = ["growth", "shelf_trend", "seasonality", "promo_lift"]
_PRICE = "total_sales / nullif(total_units, 0)"



def _lloyd(ks: str) -> str:
    """Lloyd's iteration over ``scaled`` for every k of ``ks`` from the first k products.

    The state of one k is one row: all centres in one list, until no coordinate moves.
    """
    return f"""
points AS MATERIALIZED (
  SELECT rgm_ppg, list(v ORDER BY feature) AS x, row_number() OVER (ORDER BY rgm_ppg) AS n FROM scaled GROUP BY rgm_ppg),
size AS MATERIALIZED (SELECT max(len(x)) AS f FROM points),
wanted AS (SELECT unnest({ks}) AS k),
steps(k, step, flat, moved) AS (
  SELECT k, 0, flatten(list(x ORDER BY n)), true FROM wanted JOIN points ON n <= k GROUP BY k
  UNION ALL
  SELECT k, step + 1, made, list_distance(made, flat) > 1e-9 FROM (
    SELECT k, step, any_value(flat) AS flat, list(coalesce(mean, old) ORDER BY i) AS made FROM (
      SELECT o.k, o.step, o.flat, o.i, o.old, m.mean FROM (
        SELECT k, step, flat, unnest(flat) AS old, unnest(range(len(flat))) AS i FROM steps WHERE moved AND step < 300) o
      LEFT JOIN (
        SELECT k, c * f + j AS i, avg(v) AS mean FROM (
          SELECT k, c, f, unnest(x) AS v, unnest(range(f)) AS j FROM (
            SELECT k, any_value(x) AS x, any_value(f) AS f, arg_min(c, list_distance(x, flat[c * f + 1 : (c + 1) * f])) AS c
            FROM (SELECT k, flat, unnest(range(k)) AS c FROM steps WHERE moved AND step < 300), points, size
            GROUP BY k, rgm_ppg)) GROUP BY k, c * f + j) m
      ON o.k = m.k AND o.i = m.i) GROUP BY k, step)),
fitted AS MATERIALIZED (
  SELECT k, rgm_ppg, arg_min(c, d) AS c, min(d) AS d FROM (
    SELECT k, rgm_ppg, c, list_distance(x, flat[c * f + 1 : (c + 1) * f]) ** 2 AS d
    FROM (SELECT k, flat, unnest(range(k)) AS c FROM (SELECT k, arg_max(flat, step) AS flat FROM steps GROUP BY k)), points, size)
  GROUP BY k, rgm_ppg),
sizes AS (
  SELECT k, c, count(*) AS n, sum(d) AS cost,
         row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, min(rgm_ppg)) - 1 AS number FROM fitted GROUP BY k, c)"""


ORACLE: dict[str, str] = {
    "load_pos": _sql(f"""
SELECT rgm_ppg, product_id, retailer_nm, period_id,
       {_rounded(["total_units", "total_sales", "acv_pct"])} FROM panel"""),
    "parse_period": _sql("SELECT period_id, count(*) AS rows FROM panel GROUP BY period_id"),
    "cast_measures": _sql(f"""
SELECT product_id, retailer_nm, period_id, {_rounded([*_MEASURES, *S.SIZE_COLS])} FROM panel"""),
    "panel_shape": _sql("""
SELECT count(*) AS rows, count(DISTINCT rgm_ppg) AS products,
       count(DISTINCT retailer_nm) AS retailers, count(DISTINCT period_id) AS weeks,
       min(period_id) AS first_week, max(period_id) AS last_week FROM panel"""),
    "publish_tables": _sql(
        'SELECT rgm_ppg, "group", band AS group_name FROM banded', _FEATURES
    ),
    "stage_checkpoint": _sql(
        """
SELECT rgm_ppg, retailer_nm, period_id, round(total_units, 6) AS total_units,
       cast(cast(total_sales AS float) AS double) AS total_sales, round(acv_pct, 6) AS acv_pct,
       cast(cast(price_per_pack AS float) AS double) AS price_per_pack FROM sales""",
        _CLEAN,
    ),
    "load_previous_groups": _sql(
        'SELECT rgm_ppg, "group", band AS group_name FROM banded', _features(HARSH_FLOOR)
    ),
    "price_per_pack": _sql(f"""
SELECT rgm_ppg, product_id, retailer_nm, period_id, cast(cast({_PRICE} AS float) AS double) AS price_per_pack
FROM panel"""),
    "drop_placeholders": _sql(
        """
SELECT rgm_ppg, product_id, retailer_nm, period_id, round(total_units, 6) AS total_units,
       cast(cast(total_sales AS float) AS double) AS total_sales FROM kept""",
        _CLEAN,
    ),
    "subcategory_slice": _sql(
        """
SELECT subcategory_nm, rgm_ppg, retailer_nm, period_id, round(total_units, 6) AS total_units,
       cast(cast(total_sales AS float) AS double) AS total_sales FROM sales
WHERE subcategory_nm = (SELECT subcategory_nm FROM sales GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
""",
        _CLEAN,
    ),
    "top_subcategory": _sql(
        """
SELECT subcategory_nm, count(*) AS rows FROM sales GROUP BY 1
ORDER BY rows DESC, subcategory_nm LIMIT 1""",
        _CLEAN,
    ),
    "derived_ratios": _sql(
        f"SELECT rgm_ppg, {_rounded(['bumpiness', 'price_moves', 'promo_share'])} FROM products",
        _CLEAN,
        _products(),
    ),
    "price_band": _sql(
        "SELECT rgm_ppg, round(price_tier, 6) + 0.0 AS price_tier, band FROM banded", _FEATURES
    ),
    "attach_product_meta": _sql(
        f"""
SELECT m.rgm_ppg, m.retailer_nm, m.period_id, {", ".join(S.META_COLS)}
FROM merged m LEFT JOIN meta c ON m.rgm_ppg = c.rgm_ppg""",
        _CLEAN,
    ),
    "qualifying_products": _sql(
        f"""
SELECT rgm_ppg, count(*) AS rows FROM merged
WHERE rgm_ppg IN (SELECT rgm_ppg FROM meta WHERE n_weeks >= {ASIDE_WEEKS}) GROUP BY rgm_ppg""",
        _CLEAN,
    ),
    "features_join_dynamics": _sql(
        f"SELECT rgm_ppg, {_rounded(['avg_units', 'avg_price', *_MOVES])} FROM features", _FEATURES
    ),
    "pair_weeks_selfjoin": _sql(
        f"""
SELECT subcategory_nm, product_a, product_b, period_id,
       {_rounded(["units_a", "units_b", "price_a", "price_b"])} FROM pair_weeks""",
        _CLEAN,
        _pairs(),
    ),
    "category_demand_join": _sql(
        """
SELECT subcategory_nm, rgm_ppg, period_id, units,
       sum(units) OVER (PARTITION BY subcategory_nm, period_id) AS category_units
FROM weekly_prices""",
        _CLEAN,
        PAIRED,
    ),
    "runs_compare_join": _sql("SELECT * FROM both_runs", BOTH),
    "period_halves_join": _sql(
        """
, mid AS (SELECT quantile_cont(period_id - DATE '1970-01-01', 0.5) AS day FROM sales),
halves AS (
  SELECT rgm_ppg,
         avg(any_promo_acv_pct) FILTER (period_id - DATE '1970-01-01' <= day) AS half1,
         avg(any_promo_acv_pct) FILTER (period_id - DATE '1970-01-01' > day) AS half2
  FROM sales, mid GROUP BY rgm_ppg)
SELECT rgm_ppg, round(half1, 6) + 0.0 AS half1, round(half2, 6) + 0.0 AS half2 FROM halves
WHERE half1 IS NOT NULL AND half2 IS NOT NULL""",
        _CLEAN,
    ),
    "link_group_lookup": _sql(
        """
SELECT subcategory_nm, product_a, product_b, relationship, a.band AS group_a, b.band AS group_b
FROM strict s LEFT JOIN (SELECT rgm_ppg, band FROM banded) a ON a.rgm_ppg = s.product_a
LEFT JOIN (SELECT rgm_ppg, band FROM banded) b ON b.rgm_ppg = s.product_b""",
        _FEATURES,
        _regression(),
    ),
    "merge_barcodes": _sql(
        f"""
SELECT rgm_ppg, retailer_nm, period_id,
       {_rounded(["total_units", "total_volume", "any_promo_units", *S.ACV_COLS, "price_per_pack"])},
       {_rounded(["total_sales", "any_promo_amt"])} FROM merged""",
        _CLEAN,
    ),
    "product_meta": _sql(f"SELECT rgm_ppg, {', '.join(S.META_COLS)} FROM meta", _CLEAN),
    "history_weeks": _sql("SELECT rgm_ppg, n_weeks FROM meta", _CLEAN),
    "set_aside": _sql(
        f"SELECT rgm_ppg, n_weeks FROM meta WHERE n_weeks < {ASIDE_WEEKS} ORDER BY rgm_ppg", _CLEAN
    ),
    "product_aggregates": _sql(
        f"""
SELECT rgm_ppg, subcategory_nm, brand_nm, uom, n_weeks,
       {_rounded(["avg_units", "unit_swing", "avg_price", "price_swing", "shelf_presence",
                  "promo_activity", "pack_size", "pack_count"])},
       {_rounded(["total_revenue", "promo_revenue"])} FROM products""",
        _CLEAN,
        _products(),
    ),
    "weekly_view": _sql(
        f"SELECT rgm_ppg, period_id, {_rounded(['units', 'shelf', 'promo'])} FROM weekly",
        _CLEAN,
        _moves(),
    ),
    "weekly_prices": _sql(
        f"""
SELECT subcategory_nm, rgm_ppg, period_id, {_rounded(["units", "promo", "shelf", "price"])},
       cast(cast(revenue AS float) AS double) AS revenue FROM weekly_prices""",
        _CLEAN,
        PAIRED,
    ),
    "subcategory_profile": _sql("""
SELECT subcategory_nm, count(*) AS rows, count(DISTINCT rgm_ppg) AS products,
       cast(cast(sum(total_sales) / 1e6 AS float) AS double) AS revenue_m FROM panel GROUP BY subcategory_nm"""),
    "group_profile": _sql(
        f'SELECT "group", {_rounded(S.FEATURES)} FROM profile', _FEATURES, PROFILE
    ),
    "group_revenue_share": _sql(
        'SELECT "group", products, round(revenue_pct, 6) AS revenue_pct FROM shares',
        _FEATURES,
        PROFILE,
    ),
    "group_mix": _sql(
        """
SELECT "group", subcategory_nm,
       round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY "group"), 6) AS pct
FROM banded GROUP BY "group", subcategory_nm""",
        _FEATURES,
    ),
    "coverage_grid": _sql(
        "SELECT format, "
        + ", ".join(
            f"count(*) FILTER (band = '{b}') AS {b}_products, "
            f"cast(cast(coalesce(sum(total_revenue) FILTER (band = '{b}'), 0) / 1e6 AS float) AS double)"
            f" AS {b}_revenue_m"
            for b in ["value", "mid", "premium"]
        )
        + " FROM banded JOIN (SELECT rgm_ppg, min(attribute_1) AS format FROM panel GROUP BY 1)"
        " USING (rgm_ppg) GROUP BY format",
        _FEATURES,
    ),
    "thin_cells": _sql(
        """
, formats AS (SELECT rgm_ppg, min(attribute_1) AS format FROM panel GROUP BY rgm_ppg)
SELECT f.format, d.band, count(b.rgm_ppg) AS products
FROM (SELECT DISTINCT format FROM formats) f
CROSS JOIN (VALUES ('value'), ('mid'), ('premium')) AS d(band)
LEFT JOIN (SELECT rgm_ppg, band, format FROM banded JOIN formats USING (rgm_ppg)) b
  ON b.format = f.format AND b.band = d.band
GROUP BY f.format, d.band HAVING count(b.rgm_ppg) <= 2""",
        _FEATURES,
    ),
    "mechanic_mix": _sql(
        f"""
, per_product AS (
  SELECT rgm_ppg, {", ".join(f"avg({c}) AS {c}" for c in S.PROMO_MECHANICS)}
  FROM sales GROUP BY rgm_ppg),
means AS (
  SELECT "group", {", ".join(f"round(avg(p.{c}), 2) AS {c}" for c in S.PROMO_MECHANICS)}
  FROM per_product p JOIN (SELECT rgm_ppg, "group" FROM banded) USING (rgm_ppg) GROUP BY "group")
SELECT *, round({" + ".join(S.PROMO_MECHANICS)}, 1) AS total_promo_acv FROM means""",
        _FEATURES,
    ),
    "retailer_profile": _sql(
        """
SELECT 'R' || row_number() OVER (ORDER BY sum(total_sales) DESC, retailer_nm) AS code, retailer_nm,
       cast(cast(sum(total_sales) / 1e6 AS float) AS double) AS revenue_m, count(DISTINCT rgm_ppg) AS products,
       round(quantile_cont(acv_pct, 0.5), 6) AS median_shelf,
       round(avg(any_promo_acv_pct), 6) AS avg_promo_acv,
       round(sum(any_promo_amt) / sum(total_sales), 6) AS promo_rev_share
FROM sales GROUP BY retailer_nm""",
        _CLEAN,
    ),
    "layer_profile": _sql(
        """
SELECT "group", count(*) AS products, round(avg(shelf_presence), 6) AS shelf,
       round(avg(promo_activity), 6) AS promo, round(avg(bumpiness), 6) AS bumpiness,
       cast(cast(sum(total_revenue) / 1e6 AS float) AS double) AS revenue_m FROM banded GROUP BY "group" """,
        _FEATURES,
    ),
    "link_group_matrix": _sql(
        """
SELECT least(a.band, b.band) || ' <-> ' || greatest(a.band, b.band) AS group_pair,
       count(*) FILTER (effect > 0) AS compete, count(*) FILTER (effect <= 0) AS sell_together
FROM strict s JOIN (SELECT rgm_ppg, band FROM banded) a ON a.rgm_ppg = s.product_a
JOIN (SELECT rgm_ppg, band FROM banded) b ON b.rgm_ppg = s.product_b GROUP BY group_pair""",
        _FEATURES,
        _regression(),
    ),
    "node_degree": _sql(
        """
SELECT rgm_ppg, count(*) AS links
FROM (SELECT product_a AS rgm_ppg FROM strict UNION ALL SELECT product_b FROM strict)
GROUP BY rgm_ppg""",
        _CLEAN,
        _regression(),
    ),
    "node_table": _sql(
        """
, ids AS (
  SELECT rgm_ppg, printf('D%02d', row_number() OVER (ORDER BY sum(total_units) DESC, rgm_ppg)) AS id
  FROM sales GROUP BY rgm_ppg),
degree AS (
  SELECT rgm_ppg, count(*) AS links
  FROM (SELECT product_a AS rgm_ppg FROM strict UNION ALL SELECT product_b FROM strict)
  GROUP BY rgm_ppg)
SELECT id, min(format) AS format, min(product_unit_size) AS pack, min(uom) AS uom,
       min(product_pack_count) AS count, cast(cast(sum(total_sales) / 1e6 AS float) AS double) AS revenue_m,
       max(links) AS links
FROM degree JOIN sales USING (rgm_ppg) JOIN ids USING (rgm_ppg)
JOIN (SELECT rgm_ppg, min(attribute_1) AS format FROM panel GROUP BY rgm_ppg) USING (rgm_ppg)
GROUP BY id""",
        _CLEAN,
        _regression(),
    ),
    "link_summary": _sql(
        """
SELECT count(*) AS links, count(*) FILTER (effect > 0) AS compete,
       count(*) FILTER (effect < 0) AS sell_together FROM strict""",
        _CLEAN,
        _regression(),
    ),
    "price_tier": _sql(
        "SELECT rgm_ppg, subcategory_nm, round(price_tier, 6) + 0.0 AS price_tier FROM tiered",
        _CLEAN,
        _products(),
    ),
    "smoothed_shelf": _sql(
        "SELECT rgm_ppg, period_id, round(steady, 6) + 0.0 AS steady FROM steadied", _CLEAN, _moves()
    ),
    "sales_rate": _sql(
        "SELECT rgm_ppg, period_id, round(log_rate, 6) + 0.0 AS log_rate FROM rated", _CLEAN, _moves()
    ),
    "growth": _sql("SELECT rgm_ppg, round(growth, 9) + 0.0 AS growth FROM moves", _CLEAN, _moves()),
    "shelf_trend": _sql(
        "SELECT rgm_ppg, round(shelf_trend, 8) + 0.0 AS shelf_trend FROM moves", _CLEAN, _moves()
    ),
    "detrended_wobble": _sql(
        "SELECT rgm_ppg, period_id, round(wobble, 6) + 0.0 AS wobble FROM wobbled", _CLEAN, _moves()
    ),
    "seasonality": _sql(
        "SELECT rgm_ppg, round(seasonality, 6) AS seasonality FROM moves", _CLEAN, _moves()
    ),
    "promo_lift": _sql(
        "SELECT rgm_ppg, round(promo_lift, 6) AS promo_lift FROM moves", _CLEAN, _moves()
    ),
    "movement": _sql(f"SELECT rgm_ppg, {_rounded(_MOVES)} FROM moves", _CLEAN, _moves()),
    "features": _sql(
        f"""
SELECT rgm_ppg, subcategory_nm, brand_nm, uom, n_weeks,
       {_rounded(["avg_units", "unit_swing", "avg_price", "price_swing", "shelf_presence",
                  "promo_activity", "pack_size", "pack_count", "bumpiness", "price_moves",
                  "promo_share", "price_tier", *_MOVES])},
       {_rounded(["total_revenue", "promo_revenue"])} FROM features""",
        _FEATURES,
    ),
    "pareto": _sql(
        """
SELECT rgm_ppg, row_number() OVER (ORDER BY revenue DESC, rgm_ppg) AS place,
       cast(cast(revenue AS float) AS double) AS revenue,
       round(sum(revenue) OVER (ORDER BY revenue DESC, rgm_ppg ROWS UNBOUNDED PRECEDING)
             / sum(revenue) OVER (), 6) AS cum_share
FROM (SELECT rgm_ppg, sum(total_sales) AS revenue FROM sales GROUP BY rgm_ppg)""",
        _CLEAN,
    ),
    "pareto_summary": _sql(
        """
, curve AS (
  SELECT row_number() OVER (ORDER BY revenue DESC, rgm_ppg) AS place, count(*) OVER () AS n,
         sum(revenue) OVER (ORDER BY revenue DESC, rgm_ppg ROWS UNBOUNDED PRECEDING)
           / sum(revenue) OVER () AS share
  FROM (SELECT rgm_ppg, sum(total_sales) AS revenue FROM sales GROUP BY rgm_ppg))
SELECT max(n) AS products,
       round(max(share) FILTER (place = greatest(1, round_even(0.03 * n, 0))), 6) AS top_share,
       min(place) FILTER (share >= 0.80) AS products_for_most,
       round(1 - max(share) FILTER (place = n - n // 2), 6) AS bottom_half_share FROM curve""",
        _CLEAN,
    ),
}

_DECOMPOSED = """
weeks AS (
  SELECT period_id, sum(total_sales) / 1e6 AS revenue_m FROM sales GROUP BY period_id),
trended AS (
  SELECT *, CASE WHEN count(*) OVER near >= 26 THEN avg(revenue_m) OVER near END AS trend
  FROM weeks WINDOW near AS (ORDER BY period_id ROWS BETWEEN 26 PRECEDING AND 25 FOLLOWING)),
detrended AS (
  SELECT *, revenue_m - trend AS detrended, cast(weekofyear(period_id) AS int) AS week_of_year
  FROM trended),
seasonal AS (
  SELECT *, avg(detrended) OVER (PARTITION BY week_of_year) AS season FROM detrended),
decomposed AS (SELECT *, detrended - season AS leftover FROM seasonal)"""

ORACLE |= {
    "category_decomposition": _sql(
        f"""
SELECT period_id, week_of_year,
       {_rounded(["revenue_m", "trend", "detrended", "season", "leftover"])} FROM decomposed""",
        _CLEAN,
        _DECOMPOSED,
    ),
    "decomposition_summary": _sql(
        """
, months AS (
  SELECT month(period_id) AS m, avg(season) AS mean FROM decomposed
  WHERE season IS NOT NULL GROUP BY m)
SELECT round(var_samp(trend) / var_samp(revenue_m), 6) AS trend_share,
       round(var_samp(season) / var_samp(revenue_m), 6) AS season_share,
       round(var_samp(leftover) / var_samp(revenue_m), 6) AS leftover_share,
       (SELECT monthname(make_date(2000, m, 1)) FROM months ORDER BY mean DESC, m LIMIT 1)
         AS peak_month,
       (SELECT round(max(mean), 6) FROM months) AS peak_m,
       (SELECT monthname(make_date(2000, m, 1)) FROM months ORDER BY mean, m LIMIT 1)
         AS trough_month,
       (SELECT round(min(mean), 6) FROM months) AS trough_m,
       round(avg(revenue_m), 6) AS avg_week_m FROM decomposed""",
        _CLEAN,
        _DECOMPOSED,
    ),
    "size_rank_ids": _sql(
        """
SELECT printf('D%02d', place) AS id, rgm_ppg FROM tops
WHERE subcategory_nm = (SELECT subcategory_nm FROM sales GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
""",
        _CLEAN,
        _pairs(),
    ),
    "retailer_codes": _sql(
        """
SELECT 'R' || row_number() OVER (ORDER BY sum(total_sales) DESC, retailer_nm) AS code, retailer_nm
FROM sales GROUP BY retailer_nm""",
        _CLEAN,
    ),
    "feature_zscores": _sql(
        f'SELECT "group", {_rounded(S.FEATURES)} FROM zscores', _FEATURES, PROFILE
    ),
    "top_n_sellers": _sql(
        "SELECT subcategory_nm, rgm_ppg, total_units, cast(place AS int) AS place FROM tops",
        _CLEAN,
        _pairs(),
    ),
    "strongest_links": _sql(
        """
SELECT subcategory_nm, product_a, product_b, round(effect, 6) + 0.0 AS effect, round(p, 6) + 0.0 AS p
FROM strict ORDER BY abs(effect) DESC, product_a, product_b LIMIT 8""",
        _CLEAN,
        _regression(),
    ),
    "suggestions_order": _sql(
        "SELECT group_name, revenue_pct FROM suggested ORDER BY revenue_pct DESC, group_name",
        _FEATURES,
        PROFILE,
    ),
    "common_products": _sql(
        f"""
SELECT rgm_ppg FROM sales WHERE rgm_ppg IN (SELECT rgm_ppg FROM meta WHERE n_weeks >= {ASIDE_WEEKS})
INTERSECT SELECT rgm_ppg FROM sales_b""",
        _CLEAN,
        _clean(HARSH_FLOOR, tag="_b"),
    ),
    "exclusive_retailer_share": _sql(
        """
, odd AS (
  SELECT retailer_nm FROM merged GROUP BY retailer_nm
  ORDER BY quantile_cont(acv_pct, 0.5), retailer_nm LIMIT 1),
sold AS (
  SELECT rgm_ppg, list_sort(list(DISTINCT retailer_nm)) AS stores FROM merged GROUP BY rgm_ppg)
SELECT max(retailer_nm) AS odd_retailer, count(*) AS products,
       round(avg(CASE WHEN stores = [retailer_nm] THEN 1.0 ELSE 0.0 END), 6) AS share_exclusive
FROM sold, odd""",
        _clean(key=BARCODE),
    ),
    "constant_columns": _sql("""
SELECT DISTINCT "column", value
FROM (UNPIVOT (SELECT category, cmu, channel_nm FROM panel) ON category, cmu, channel_nm
      INTO NAME "column" VALUE value)"""),
    "attribute_constancy": _sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS attribute, count(*) FILTER (n = 1) AS constant_products "
            f"FROM (SELECT count(DISTINCT {c}) AS n FROM panel GROUP BY rgm_ppg)"
            for c in [*S.META_COLS, "attribute_1"]
        )
    ),
    "promo_parts_check": _sql(f"""
, parts AS (SELECT *, {" + ".join(S.PROMO_MECHANICS)} AS total FROM panel)
SELECT round(avg(CASE WHEN abs(total - any_promo_acv_pct) <= 1.0 + 1e-5 * abs(any_promo_acv_pct)
                      THEN 1.0 ELSE 0.0 END), 6) AS share_close,
       round(corr(total, any_promo_acv_pct), 6) + 0.0 AS corr,
       count(*) FILTER (total > 100) AS rows_over_100 FROM parts"""),
    "promo_bounds_check": _sql("""
SELECT round(avg(CASE WHEN any_promo_units <= total_units THEN 1.0 ELSE 0.0 END), 6) AS units_within,
       round(avg(CASE WHEN any_promo_amt <= total_sales + 1e-6 THEN 1.0 ELSE 0.0 END), 6)
         AS money_within FROM panel"""),
    "volume_consistency": _sql(
        """
SELECT round(quantile_cont(cv, 0.5), 6) AS median_cv
FROM (SELECT CASE WHEN avg(v) > 0 THEN stddev_samp(v) / avg(v) END AS cv
      FROM (SELECT rgm_ppg, total_volume / total_units AS v FROM kept) GROUP BY rgm_ppg)""",
        _CLEAN,
    ),
    "volume_by_retailer": _sql(
        """
, economy AS (SELECT * FROM kept WHERE subcategory_nm = (
  SELECT subcategory_nm FROM kept GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))
SELECT rgm_ppg, retailer_nm, round(quantile_cont(total_volume / total_units, 0.5), 6) AS median_vpu
FROM economy
WHERE rgm_ppg = (SELECT rgm_ppg FROM economy GROUP BY rgm_ppg ORDER BY count(*) DESC, 1 LIMIT 1)
GROUP BY rgm_ppg, retailer_nm""",
        _CLEAN,
    ),
    "id_fanout": _sql("""
, fanout AS (SELECT product_id, count(DISTINCT rgm_ppg) AS n FROM panel GROUP BY product_id)
SELECT count(*) AS distinct_ids,
       (SELECT product_id FROM fanout ORDER BY n DESC, product_id DESC LIMIT 1) AS worst_id,
       max(n) AS worst_products FROM fanout"""),
    "placeholder_signature": _sql(f"""
SELECT coalesce({_PRICE} < {FLOOR}, false) AS below_floor, count(*) AS rows,
       cast(cast(quantile_cont({_PRICE}, 0.5) AS float) AS double) AS median_price,
       round(quantile_cont(acv_pct, 0.5), 6) AS median_shelf,
       round(sum(total_sales) / (SELECT sum(total_sales) FROM panel), 6) AS revenue_share
FROM panel GROUP BY below_floor"""),
    "price_histogram": _sql(f"""
, logs AS (SELECT log10({_PRICE}) AS lp FROM panel WHERE {_PRICE} > 0),
ends AS (SELECT min(lp) AS lo, max(lp) AS hi FROM logs)
, filled AS (
  SELECT cast(least(79, floor((lp - lo) * 80 / (hi - lo))) AS int) AS bin, count(*) AS n
  FROM logs, ends GROUP BY 1)
SELECT cast(b.bin AS int) AS bin, round(lo + b.bin * (hi - lo) / 80, 6) AS left_edge,
       coalesce(n, 0) AS rows
FROM ends, range(80) AS b(bin) LEFT JOIN filled ON filled.bin = b.bin"""),
    "duplicate_audit": _sql("""
, dup AS (SELECT count(*) AS n FROM panel GROUP BY rgm_ppg, retailer_nm, period_id)
SELECT cast(sum(n) FILTER (n > 1) AS bigint) AS duplicate_rows,
       round(sum(n) FILTER (n > 1) / sum(n), 6) AS duplicate_share,
       count(*) FILTER (n > 1) AS duplicate_keys FROM dup"""),
    "duplicate_differs": _sql(
        ", dup AS (SELECT "
        + ", ".join(f"count(DISTINCT {c}) AS {c}" for c in DIFFER_COLUMNS)
        + " FROM panel GROUP BY rgm_ppg, retailer_nm, period_id HAVING count(*) > 1)"
        + " UNION ALL ".join(
            f"""
SELECT '{c}' AS "column", round(avg(CASE WHEN {c} > 1 THEN 1.0 ELSE 0.0 END), 6) AS share,
       avg(CASE WHEN {c} > 1 THEN 1.0 ELSE 0.0 END) = 0 AS never FROM dup"""
            for c in DIFFER_COLUMNS
        )
    ),
    "duplicate_all_real": _sql("""
SELECT round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS share_all_sold
FROM (SELECT bool_and(total_units > 0) AS ok FROM panel
      GROUP BY rgm_ppg, retailer_nm, period_id HAVING count(*) > 1)"""),
    "shelf_units_corr": _sql(
        """
SELECT round(corr(ln(greatest(shelf, 0.1)), ln(greatest(units, 1))), 6) AS corr
FROM (SELECT avg(acv_pct) AS shelf, avg(total_units) AS units FROM sales GROUP BY rgm_ppg)""",
        _CLEAN,
    ),
    "blank_counts": _sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, count(*) FILTER ({c} IS NULL) AS blanks FROM features"
            for c in S.FEATURES
        ),
        _features(key=BARCODE),
    ),
    "feature_correlations": _sql(
        " UNION ALL ".join(
            f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) + 0.0 AS corr, "
            f"abs(corr({a}, {b})) > 0.5 AS strong FROM features"
            for i, a in enumerate(S.FEATURES)
            for b in S.FEATURES[i + 1 :]
        ),
        _FEATURES.replace("features AS (", "features AS MATERIALIZED ("),
    ),
    "promo_drift": _sql(
        """
, mid AS (SELECT quantile_cont(period_id - DATE '1970-01-01', 0.5) AS day FROM sales),
halves AS (
  SELECT rgm_ppg,
         avg(any_promo_acv_pct) FILTER (period_id - DATE '1970-01-01' <= day) AS half1,
         avg(any_promo_acv_pct) FILTER (period_id - DATE '1970-01-01' > day) AS half2
  FROM sales, mid GROUP BY rgm_ppg)
SELECT round(avg(abs(half2 - half1)), 6) AS mean_abs_change, count(*) AS products FROM halves
WHERE half1 IS NOT NULL AND half2 IS NOT NULL""",
        _CLEAN,
    ),
    "growth_flip": _sql(
        """
, slopes AS (
  SELECT rgm_ppg, regr_slope(ln(1 + units), x) AS raw_growth FROM rated GROUP BY rgm_ppg)
SELECT count(*) AS products, count(*) FILTER (sign(raw_growth) <> sign(growth)) AS flipped,
       round(avg(CASE WHEN sign(raw_growth) = sign(shelf_trend) THEN 1.0 ELSE 0.0 END)
             FILTER (sign(raw_growth) <> sign(growth)), 6) AS agree_share
FROM slopes JOIN moves USING (rgm_ppg) WHERE growth IS NOT NULL AND raw_growth IS NOT NULL""",
        _CLEAN,
        _moves(),
    ),
    "clip_fill": _sql(
        "SELECT rgm_ppg, "
        + ", ".join(f"round(max(v) FILTER (feature = '{c}'), 6) + 0.0 AS {c}" for c in S.FEATURES)
        + " FROM filled GROUP BY rgm_ppg",
        _FEATURES,
        SCALED,
    ),
    "robust_scale": _sql(
        "SELECT rgm_ppg, "
        + ", ".join(f"round(max(v) FILTER (feature = '{c}'), 6) + 0.0 AS {c}" for c in S.FEATURES)
        + " FROM scaled GROUP BY rgm_ppg",
        _FEATURES,
        SCALED,
    ),
}

_BAND_LABELS = """
labels AS (SELECT 0 AS labeling, rgm_ppg, "group" AS label FROM banded)"""
_SLICES = """
labels AS (
  SELECT k - 2 AS labeling, rgm_ppg,
         cast(least(k - 1, floor(round(price_tier, 6) * k)) AS int) AS label
  FROM banded CROSS JOIN (SELECT cast(range AS int) AS k FROM range(2, 11)))"""
_SCALED = SCALED.replace("scaled AS (", "scaled AS MATERIALIZED (")

ORACLE |= {
    "silhouette_samples": _sql(
        "SELECT rgm_ppg, label, round(silhouette, 6) + 0.0 AS silhouette FROM samples",
        _FEATURES,
        _SCALED,
        _BAND_LABELS,
        _silhouettes("labels"),
    ),
    "kmeans_from_starts": _sql(
        'SELECT rgm_ppg, cast(number AS int) AS "group" FROM fitted JOIN sizes USING (k, c)',
        _FEATURES,
        _SCALED,
        _lloyd("[3]"),
        recursive=True,
    ),
    "scan_from_starts": _sql(
        """
SELECT k AS groups, round(sum(cost), 5) AS inertia, round(max(n) / sum(n), 5) AS biggest_group FROM sizes GROUP BY k""",
        _FEATURES,
        _SCALED,
        _lloyd("range(2, 11)"),
        recursive=True,
    ),
    "silhouette": _sql(
        """
SELECT round(avg(silhouette), 6) AS silhouette,
       round(avg(CASE WHEN silhouette < 0 THEN 1.0 ELSE 0.0 END), 6) AS negative_share
FROM samples""",
        _FEATURES,
        _SCALED,
        _BAND_LABELS,
        _silhouettes("labels"),
    ),
    "silhouette_sq": _sql(
        "SELECT round(avg(silhouette), 6) AS silhouette_sq FROM samples",
        _FEATURES,
        _SCALED,
        _BAND_LABELS,
        _silhouettes("labels").replace("sqrt(sum((a.v - b.v) * (a.v - b.v)))",
                                       "sum((a.v - b.v) * (a.v - b.v))"),
    ),
    "calinski_harabasz": _sql(
        "SELECT round(calinski_harabasz, 6) AS calinski_harabasz FROM calinski",
        _FEATURES,
        _SCALED,
        _BAND_LABELS,
        _calinski("labels"),
    ),
    "choose_k": _sql(
        """
, scored AS (
  SELECT labeling + 2 AS groups, avg(silhouette) AS silhouette, max(calinski_harabasz) AS ch
  FROM samples JOIN calinski USING (labeling) GROUP BY labeling),
placed AS (
  SELECT groups, silhouette,
         (rank() OVER (ORDER BY silhouette) + (count(*) OVER (PARTITION BY silhouette) - 1) / 2.0
          + rank() OVER (ORDER BY ch) + (count(*) OVER (PARTITION BY ch) - 1) / 2.0) / 2 AS mean_rank
  FROM scored WHERE groups BETWEEN 3 AND 10)
SELECT cast(groups AS int) AS groups, round(silhouette, 6) + 0.0 AS silhouette,
       round(mean_rank, 6) AS mean_rank
FROM placed ORDER BY mean_rank DESC, placed.silhouette DESC, groups LIMIT 1""",
        _FEATURES,
        _SCALED,
        _SLICES,
        _silhouettes("labels"),
        _calinski("labels"),
    ),
    "adjusted_rand": _sql(
        "SELECT round(ari, 6) + 0.0 AS ari FROM ari",
        BOTH,
        _ari("both_runs", "group_before", "group_after"),
    ),
    "adjusted_mutual_info": _sql(
        """
, attributes AS (
  SELECT b."group" AS g, subcategory_nm, brand_nm, uom, f.format, cast(pack_size AS varchar) AS pack_size
  FROM banded b LEFT JOIN (SELECT rgm_ppg, min(attribute_1) AS format FROM panel GROUP BY 1) f
    ON f.rgm_ppg = b.rgm_ppg),
long AS (
  FROM attributes UNPIVOT INCLUDE NULLS (
    value FOR attribute IN (subcategory_nm, brand_nm, uom, format, pack_size))),
cells AS (SELECT attribute, g, value, count(*) AS n FROM long GROUP BY ALL),
rows AS (SELECT attribute, g, sum(n) AS a FROM cells GROUP BY ALL),
cols AS (SELECT attribute, value, sum(n) AS b FROM cells GROUP BY ALL),
size AS (SELECT cast(count(*) AS double) AS t FROM banded),
mi AS (
  SELECT attribute, sum(n / t * ln(n * t / (a * b))) AS mi
  FROM cells JOIN rows USING (attribute, g) JOIN cols USING (attribute, value), size
  GROUP BY attribute),
emi AS (
  SELECT attribute, sum(m / t * ln(t * m / (a * b)) * exp(
           lgamma(a + 1) + lgamma(b + 1) + lgamma(t - a + 1) + lgamma(t - b + 1) - lgamma(t + 1)
           - lgamma(m + 1) - lgamma(a - m + 1) - lgamma(b - m + 1) - lgamma(t - a - b + m + 1)))
         AS emi
  FROM (SELECT attribute, cast(a AS double) AS a, cast(b AS double) AS b, t,
               cast(unnest(range(cast(greatest(1, a + b - t) AS bigint),
                                 cast(least(a, b) AS bigint) + 1)) AS double) AS m
        FROM rows JOIN cols USING (attribute), size)
  GROUP BY attribute),
hg AS (SELECT attribute, -sum(a / t * ln(a / t)) AS h FROM rows, size GROUP BY attribute),
hv AS (
  SELECT attribute, -sum(b / t * ln(b / t)) AS h, count(value) AS v FROM cols, size
  GROUP BY attribute)
SELECT attribute, round((mi - emi) / ((hg.h + hv.h) / 2 - emi), 6) + 0.0 AS ami
FROM mi JOIN emi USING (attribute) JOIN hg USING (attribute) JOIN hv USING (attribute)
WHERE v > 1""",
        _FEATURES.replace("banded AS (", "banded AS MATERIALIZED ("),
    ),
    "cluster_balance": _sql(
        """
SELECT round(-sum(s * ln(s)) / ln(count(*)), 6) AS balance
FROM (SELECT count(*) / sum(count(*)) OVER () AS s FROM banded GROUP BY "group")""",
        _FEATURES,
    ),
    "name_groups": _sql('SELECT "group", group_name FROM names', _FEATURES, PROFILE),
    "suggest_actions": _sql("SELECT * FROM suggested", _FEATURES, PROFILE),
    "products_moved": _sql(
        """
SELECT round(coalesce(avg(CASE WHEN group_before <> group_after THEN 1.0 ELSE 0.0 END), 0), 6)
         AS moved,
       coalesce(avg(CASE WHEN group_before <> group_after THEN 1.0 ELSE 0.0 END), 0) > 0.20 AS redraw
FROM both_runs""",
        BOTH,
    ),
    "publish_gate": _sql(
        """
, gate AS (
  SELECT (SELECT round(ari, 6) FROM ari) AS agreement, count(*) AS groups,
         count(*) FILTER (action = 'No single action') AS drilled FROM suggested)
SELECT agreement, agreement >= 0.60 AS publish,
       CASE WHEN agreement >= 0.60
            THEN printf('agreement %.2f reaches the bar', agreement)
            ELSE printf('agreement %.2f is below the bar: nothing is published', agreement)
       END AS reason, cast(0.60 AS double) AS bar, groups, groups - drilled AS actioned, drilled AS undrilled
FROM gate""",
        BOTH,
        PROFILE,
        _ari("both_runs", "group_before", "group_after"),
    ),
    "run_parity": _sql(
        f"""
, got AS (
  SELECT cast(sum(products) AS varchar) AS products, cast(count(*) AS varchar) AS groups,
         string_agg(cast(products AS varchar), ', ' ORDER BY products) AS group_sizes,
         string_agg(group_name, ', ' ORDER BY group_name) AS group_names
  FROM shares JOIN names USING ("group"))
SELECT what, got, expected, CASE WHEN got = expected THEN 'OK' ELSE 'DIFFERENT' END AS verdict
FROM (UNPIVOT got ON products, groups, group_sizes, group_names INTO NAME what VALUE got)
JOIN (VALUES ('products', '150'), ('groups', '3'), ('group_sizes', '48, 48, 54'),
             ('group_names', '{S.PROMO}, {S.SHRINKING}, {S.STEADY}')) AS e(what, expected)
  USING (what)""",
        _FEATURES,
        PROFILE,
    ),
    "pair_regression": _sql(
        f"""
SELECT subcategory_nm, product_a, product_b, shared_weeks, dof,
       {_rounded(["effect", "std_error"])} FROM fits WHERE std_error > 0""",
        _CLEAN,
        _regression(),
    ),
    "pair_skip_rules": _sql(
        """
, formed AS (SELECT DISTINCT subcategory_nm, product_a, product_b FROM pair_weeks)
SELECT subcategory_nm, count(*) AS formed, count(shared_weeks) AS fitted
FROM formed LEFT JOIN (SELECT * FROM fits WHERE std_error > 0)
  USING (subcategory_nm, product_a, product_b) GROUP BY subcategory_nm""",
        _clean(min_weeks=0, key=BARCODE),
        _regression(7),
    ),
    "effect_pvalue": _sql(
        """
SELECT subcategory_nm, product_a, product_b, round(effect, 6) + 0.0 AS effect, round(p, 6) + 0.0 AS p
FROM tested""",
        _CLEAN,
        _regression(),
    ),
    "cross_price_links": _sql(
        """
SELECT product_a, product_b, round(effect, 6) + 0.0 AS effect, round(p, 6) + 0.0 AS p, relationship
FROM strict
WHERE subcategory_nm = (SELECT subcategory_nm FROM sales GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
""",
        _CLEAN,
        _regression(),
    ),
    "strict_links": _sql(
        f"""
SELECT subcategory_nm, product_a, product_b, round(effect, 6) + 0.0 AS effect, round(p, 6) + 0.0 AS p,
       relationship FROM related WHERE p < {S.ALPHA} / tests AND abs(effect) >= {S.MIN_EFFECT}""",
        _CLEAN,
        _regression(),
    ),
    "all_subcategory_links": _sql(
        """
SELECT subcategory_nm, product_a, product_b, round(effect, 6) + 0.0 AS effect, round(p, 6) + 0.0 AS p,
       relationship FROM strict""",
        _CLEAN,
        _regression(),
    ),
}
