"""Naming rules, suggested actions, the publish gate and run-to-run monitoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwise import settings as S
from shelfwise.operators.reports import group_revenue_share


def feature_zscores(profile: DataFrame, group: str = "group") -> DataFrame:
    """Profile columns as z-scores across groups (population spread; none, no score)."""
    ends = profile.agg(
        F.struct(
            *[F.avg(c).alias(f"{c}_mean") for c in S.FEATURES],
            *[F.stddev_pop(c).alias(f"{c}_sd") for c in S.FEATURES],
        ).alias("e")
    ).scalar()

    def z(c: str) -> Column:
        gap = F.col(c) - ends.getField(f"{c}_mean")
        return F.try_divide(gap, ends.getField(f"{c}_sd")).alias(c)

    return profile.select(group, *[z(c) for c in S.FEATURES])


def name_groups(profile: DataFrame, cut: float = S.NAME_CUT, group: str = "group") -> DataFrame:
    """A name per group by ordered rules on the z-scores; repeats are numbered in group order."""
    base = (
        F.when(F.col("shelf_trend") <= -cut, S.SHRINKING)
        .when(F.col("promo_activity") >= cut, S.PROMO)
        .otherwise(S.STEADY)
    )
    place = F.row_number().over(Window.partitionBy("base").orderBy(group))
    named = feature_zscores(profile, group).select(group, base.alias("base"))
    numbered = named.withColumn("place", place)
    name = F.when(F.col("place") == 1, F.col("base")).otherwise(
        F.concat_ws(" ", "base", F.col("place").cast("string"))
    )
    return numbered.select(group, name.alias("group_name"))


def suggest_actions(grouped: DataFrame, names: DataFrame, group: str = "group") -> DataFrame:
    """One action per named group with its size and revenue share, biggest share first."""
    spark = grouped.sparkSession
    rules = spark.createDataFrame(S.ACTIONS, "group_name string, action string, why string")
    action, why = S.NO_RULE
    return (
        group_revenue_share(grouped, group)
        .join(names, group)
        .join(F.broadcast(rules), "group_name", "left")  # three fixed rows
        .select(
            "group_name",
            "products",
            F.round("revenue_pct", 1).alias("revenue_pct"),
            F.coalesce("action", F.lit(action)).alias("action"),
            F.coalesce("why", F.lit(why)).alias("why"),
        )
        .orderBy(F.desc("revenue_pct"), "group_name")
    )


def runs_compare(before: DataFrame, after: DataFrame, group: str = "group") -> DataFrame:
    """Products present in both runs with their group before and after."""
    return before.select(S.KEY, F.col(group).alias("group_before")).join(
        after.select(S.KEY, F.col(group).alias("group_after")), S.KEY
    )


def products_moved(
    before: DataFrame, after: DataFrame, group: str = "group", alarm: float = S.MOVED_ALARM
) -> DataFrame:
    """Share of common products whose group changed, and whether that is a lot.

    Group numbers are arbitrary between runs; compare ``group_name`` to be independent of them.
    """
    moved = F.when(F.col("group_before") != F.col("group_after"), 1.0).otherwise(0.0)
    return (
        runs_compare(before, after, group)
        .agg(F.coalesce(F.avg(moved), F.lit(0.0)).alias("moved"))
        .withColumn("redraw", F.col("moved") > alarm)
    )


def publish_gate(
    agreement: DataFrame, suggestions: DataFrame, bar: float = S.PUBLISH_BAR
) -> DataFrame:
    """One row: the bar, groups with and without an action, publish or not, and why.

    ``agreement`` is a one-row table with the column ``agreement``.
    """
    counts = suggestions.agg(
        F.struct(
            F.count(F.lit(1)).alias("groups"),
            F.count_if(F.col("action") == S.UNDRILLED_ACTION).alias("undrilled"),
        ).alias("c")
    ).scalar()
    groups, undrilled = counts.getField("groups"), counts.getField("undrilled")
    reached = F.coalesce(F.col("agreement") >= bar, F.lit(False))
    return agreement.select(
        "agreement",
        F.lit(float(bar)).alias("bar"),
        groups.alias("groups"),
        (groups - undrilled).alias("actioned"),
        undrilled.alias("undrilled"),
        reached.alias("publish"),
        F.when(reached, F.format_string("agreement %.2f reaches the bar", "agreement"))
        .otherwise(F.format_string("agreement %.2f is below the bar: nothing is published", "agreement"))
        .alias("reason"),
    )


def run_parity(groups: DataFrame, names: DataFrame, expected: dict) -> DataFrame:
    """Compare products, number of groups, sorted sizes and sorted names with expected values.

    ``expected`` may hold ``products``, ``groups``, ``group_sizes`` and ``group_names``.
    """
    sizes = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    got = sizes.join(names, "group", "left").agg(
        F.sum("n").cast("string").alias("products"),
        F.count(F.lit(1)).cast("string").alias("groups"),
        F.concat_ws(
            ", ", F.transform(F.sort_array(F.collect_list("n")), lambda x: x.cast("string"))
        ).alias("group_sizes"),
        F.concat_ws(", ", F.sort_array(F.collect_list("group_name"))).alias("group_names"),
    )

    def text(value) -> str:
        return ", ".join(map(str, sorted(value))) if isinstance(value, list) else str(value)

    items = [k for k in ["products", "groups", "group_sizes", "group_names"] if k in expected]
    wanted = F.create_map(*[F.lit(v) for k in items for v in (k, text(expected[k]))])
    return (
        got.unpivot([], items, "what", "got")
        .withColumn("expected", wanted[F.col("what")])
        .withColumn(
            "verdict", F.when(F.col("got") == F.col("expected"), "OK").otherwise("DIFFERENT")
        )
    )
