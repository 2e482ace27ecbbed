"""The scheduled run: raw panel to published groups, suggestions and links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise import settings as S
from shelfwise.operators import clean, cluster, features, links, prepare, reports, rules, scores
from shelfwise.sources.publish import latest_run, load_previous_groups, publish_tables, run_name
from shelfwise.sources.staging import stage


@dataclass(frozen=True)
class RunResult:
    """What a run produced; ``published`` is the run name, or None when the gate held it back."""

    groups: DataFrame
    profile: DataFrame
    suggestions: DataFrame
    set_aside: DataFrame
    split: DataFrame
    links: DataFrame
    scan: DataFrame
    gate: DataFrame
    moved: DataFrame | None
    preparation: prepare.Preparation
    grouping: cluster.Grouping
    published: str | None


def run(
    spark: SparkSession,
    raw: DataFrame,
    root: str,
    price_floor: float = S.PRICE_FLOOR,
    min_weeks: int = S.MIN_WEEKS,
    search: tuple[int, int] = S.K_SEARCH,
    restarts: int = S.RESTARTS,
    resamples: int = S.RESAMPLES,
    publish_bar: float = S.PUBLISH_BAR,
    top_n: int = S.TOP_N,
    score: str = "exact",
) -> RunResult:
    """Clean, describe, group, check, link, and publish if the groups hold up.

    The clean panel, the features and the prepared points are staged: each feeds several branches.
    ``score`` is the silhouette that k and the split are chosen by: ``exact``, or ``squared``, which is linear.
    """
    panel, aside = clean.clean_and_set_aside(raw, price_floor, min_weeks)
    sales = stage(panel, "clean-panel")
    table = stage(
        features.product_features(sales, clean.product_meta(sales), min_weeks), "features"
    )
    preparation = prepare.fit_preparation(table)
    points = stage(preparation.transform(table), "points")

    fitted = cluster.fit_scan(points, search[1], restarts)
    scan = stage(cluster.scan_k(points, fitted=fitted, score=score), "scan")
    k = scores.choose_k(scan, *search).first()["groups"]
    grouping = cluster.Grouping(cluster.canonical_order(points, fitted[k].centres), fitted[k].inertia)
    labelled = stage(table.join(grouping.transform(points), S.KEY), "labelled")
    profile = reports.group_profile(labelled)
    names = stage(rules.name_groups(profile), "names")
    groups = labelled.join(names, "group")
    suggestions = stage(rules.suggest_actions(labelled, names), "suggestions")
    split = cluster.split_biggest(points, labelled.select(S.KEY, "group"), restarts=restarts, score=score)

    agreement = cluster.stability(points, k, resamples, restarts=restarts, base=grouping.centres)
    gate = stage(rules.publish_gate(agreement, suggestions, publish_bar), "gate")
    before = load_previous_groups(spark, root)
    moved = None if before is None else rules.products_moved(before, groups, "group_name")
    tables = {
        "groups": groups,
        "group_profiles": profile.join(names, "group").select("group_name", *S.FEATURES),
        "suggestions": suggestions,
        "products_set_aside": aside.select(S.KEY),
        "biggest_group_split": split,
        "cross_price_links": links.cross_price_links(sales, top_n=top_n),
    }
    if moved is not None:
        moved = stage(moved, "moved")
    name = run_name()
    if gate.first()["publish"]:  # the model is there before the run can be seen
        prepare.save_preparation(preparation, spark, f"{root}/{name}/model")
        save_grouping(grouping, spark, f"{root}/{name}/model")
    published = publish_tables(tables, gate, root, name)
    return RunResult(
        groups=groups,
        profile=tables["group_profiles"],
        suggestions=suggestions,
        set_aside=tables["products_set_aside"],
        split=split,
        links=tables["cross_price_links"],
        scan=scan,
        gate=gate,
        moved=moved,
        preparation=preparation,
        grouping=grouping,
        published=published,
    )


def cleaning_sensitivity(
    raw: DataFrame,
    k: int,
    floor: float = S.PRICE_FLOOR,
    other_floor: float = 5 * S.PRICE_FLOOR,
    restarts: int = S.RESTARTS,
) -> DataFrame:
    """Agreement of the groups found under two price floors, on the products both keep."""

    def groups(at: float) -> DataFrame:
        table = stage(features.features_from_raw(raw, at), "features")
        points = stage(prepare.fit_preparation(table).transform(table), "points")
        return cluster.fit_groups(points, k, restarts).transform(points)

    return cluster.grouping_agreement(groups(floor), groups(other_floor))


def common_products(one: DataFrame, other: DataFrame) -> DataFrame:
    """Products in both tables."""
    return one.select(S.KEY).intersect(other.select(S.KEY))


def assign_to_existing_groups(
    features_table: DataFrame, preparation: prepare.Preparation, grouping: cluster.Grouping
) -> DataFrame:
    """Groups for (new) products from fitted parameters, without refitting anything."""
    points = preparation.transform(features_table)
    return grouping.transform(points)


def load_model(
    spark: SparkSession, root: str
) -> tuple[prepare.Preparation, cluster.Grouping] | None:
    """The fitted parameters of the latest published run, for scoring new products; None before the first."""
    run = latest_run(spark, root)
    if run is None:
        return None
    path = f"{root}/{run}/model"
    return prepare.load_preparation(spark, path), load_grouping(spark, path)


def save_grouping(grouping: cluster.Grouping, spark: SparkSession, path: str) -> None:
    rows = [(i, [float(v) for v in c]) for i, c in enumerate(grouping.centres)]
    spark.createDataFrame(rows, "group int, centre array<double>").withColumn(
        "inertia", F.lit(grouping.inertia)
    ).write.mode("overwrite").parquet(f"{path}/centres")


def load_grouping(spark: SparkSession, path: str) -> cluster.Grouping:
    import numpy as np

    rows = spark.read.parquet(f"{path}/centres").orderBy("group").collect()
    return cluster.Grouping(np.array([r["centre"] for r in rows]), rows[0]["inertia"])
