"""Putting the ten features on a comparable footing: clip, fill, scale, principal components."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise import settings as S
from shelfwise.functions.ordered import order_statistics, quantile_positions

PARAMETER_SCHEMA = (
    "feature string, low double, high double, fill double, centre double, spread double"
)


@dataclass(frozen=True)
class FeatureRange:
    """Fitted numbers of one feature."""

    low: float
    high: float
    fill: float
    centre: float
    spread: float


Ranges = dict[str, FeatureRange]


def _filled_positions(probs: dict[str, float]) -> dict:
    """Where the quantiles of a column lie among its own values once its blanks hold its median.

    The filled values stand behind the lower of the two middle values, so positions up to there stay, positions beyond
    them move by the number of blanks, and those in between (NULL) are the median.
    """

    def moved(p: float, end):
        def at(n, blanks):
            place, middle = end(F.lit(p) * (n + blanks - 1)), F.floor((n - 1) / 2)
            return F.when(place <= middle, place).when(place > middle + blanks, place - blanks)

        return at

    return {f"{name}_{side}": moved(p, end) for name, p in probs.items() for side, end in (("lo", F.floor), ("hi", F.ceil))}


_QUARTILES = {"q1": 0.25, "q2": 0.5, "q3": 0.75}


def _order(table: DataFrame, low: float, high: float) -> dict[str, dict]:
    """The order statistics of every feature; ten rows come back."""
    long = table.select(*S.FEATURES).unpivot([], S.FEATURES, "feature", "value")
    outer = quantile_positions({"low": low, "mid": 0.5, "high": high})
    rows = order_statistics(long, "value", outer | _filled_positions(_QUARTILES), ["feature"]).collect()
    return {r["feature"]: r.asDict() for r in rows}


def _between(row: dict, name: str, p: float, n: int) -> float:
    position = p * (n - 1)
    return row[f"{name}_lo"] + (row[f"{name}_hi"] - row[f"{name}_lo"]) * (position - math.floor(position))


def _clip_fill(features: DataFrame, ranges: dict[str, tuple[float, float, float]]) -> DataFrame:
    def column(c: str):
        low, high, fill = ranges[c]
        # least and greatest skip NULL, so a blank must not reach them.
        clipped = F.when(
            F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(low)), F.lit(high))
        )
        return F.coalesce(clipped, F.lit(fill)).alias(c)

    return features.select(S.KEY, *[column(c) for c in S.FEATURES])


def fit_ranges(features: DataFrame, low: float = 0.01, high: float = 0.99) -> Ranges:
    """Everything clip, fill and scale need, from one selection over all features.

    The median lies between the clip limits, so clipping does not move it, and the quartiles of the clipped and filled
    column are clipped order statistics of the raw one. A feature nobody has becomes zero.
    """
    found = _order(features, low, high)
    out = {}
    for c in S.FEATURES:
        if c not in found:
            out[c] = FeatureRange(0.0, 0.0, 0.0, 0.0, 1.0)
            continue
        row, n = found[c], found[c]["_total"]
        bottom, fill, top = (_between(row, k, p, n) for k, p in (("low", low), ("mid", 0.5), ("high", high)))
        for name in _QUARTILES:
            for side in ("lo", "hi"):
                v = row[f"{name}_{side}"]
                row[f"{name}_{side}"] = min(max(fill if v is None else v, bottom), top)
        q = {name: _between(row, name, p, n + row["_blanks"]) for name, p in _QUARTILES.items()}
        out[c] = FeatureRange(bottom, top, fill, centre=q["q2"], spread=(q["q3"] - q["q1"]) or 1.0)
    return out


def clip_fill_ranges(
    features: DataFrame, low: float = 0.01, high: float = 0.99
) -> dict[str, tuple[float, float, float]]:
    """Clip limits and fill value per feature."""
    return {c: (r.low, r.high, r.fill) for c, r in fit_ranges(features, low, high).items()}


def clip_fill(features: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Features clipped to their outer quantiles, blanks filled with the median."""
    return _clip_fill(features, clip_fill_ranges(features, low, high))


def robust_scale(features: DataFrame, ranges: Ranges) -> DataFrame:
    """Clipped and filled features, centred on the median and divided by the quartile range."""
    limits = {c: (r.low, r.high, r.fill) for c, r in ranges.items()}
    filled = _clip_fill(features, limits)
    return filled.select(
        S.KEY,
        *[((F.col(c) - ranges[c].centre) / ranges[c].spread).alias(c) for c in S.FEATURES],
    )


def _with_vector(scaled: DataFrame) -> DataFrame:
    return scaled.select(S.KEY, array_to_vector(F.array(*S.FEATURES)).alias("features"))


@dataclass(frozen=True)
class Preparation:
    """Fitted ranges and components; applies to new products without refitting."""

    ranges: Ranges
    pca: PCAModel
    components: int

    def transform(self, features: DataFrame, components: int | None = None) -> DataFrame:
        """Product and its leading components as an array column ``x``."""
        keep = self.components if components is None else components
        vectors = self.pca.transform(_with_vector(robust_scale(features, self.ranges)))
        return vectors.select(S.KEY, F.slice(vector_to_array("components"), 1, keep).alias("x"))


def components_kept(explained: list[float], keep_variance: float) -> int:
    """The fewest leading components whose explained shares add up to more than the target."""
    total = 0.0
    for count, share in enumerate(explained, start=1):
        total += share
        if total > keep_variance:
            return count
    return len(explained)


def fit_preparation(
    features: DataFrame, keep_variance: float = S.KEEP_VARIANCE
) -> Preparation:
    """Fit ranges and components on a (staged) feature table."""
    ranges = fit_ranges(features)
    scaled = _with_vector(robust_scale(features, ranges))
    pca = PCA(k=len(S.FEATURES), inputCol="features", outputCol="components").fit(scaled)
    explained = [float(v) for v in pca.explainedVariance.toArray()]
    return Preparation(ranges, pca, components_kept(explained, keep_variance))


def save_preparation(preparation: Preparation, spark, path: str) -> None:
    """Ten parameter rows as Parquet and the component model next to them."""
    rows = [
        (c, r.low, r.high, r.fill, r.centre, r.spread) for c, r in preparation.ranges.items()
    ]
    spark.createDataFrame(rows, PARAMETER_SCHEMA).write.mode("overwrite").parquet(f"{path}/ranges")
    spark.createDataFrame([(preparation.components,)], "components int").write.mode(
        "overwrite"
    ).parquet(f"{path}/kept")
    preparation.pca.write().overwrite().save(f"{path}/pca")


def load_preparation(spark, path: str) -> Preparation:
    rows = spark.read.parquet(f"{path}/ranges").collect()
    ranges = {
        r["feature"]: FeatureRange(r["low"], r["high"], r["fill"], r["centre"], r["spread"])
        for r in rows
    }
    kept = spark.read.parquet(f"{path}/kept").first()["components"]
    return Preparation(ranges, PCAModel.load(f"{path}/pca"), kept)
