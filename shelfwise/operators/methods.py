"""K-Means, Gaussian mixture and bisecting K-Means side by side, each fitted to all resamples at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise import settings as S
from shelfwise.operators import scores
from shelfwise.operators.cluster import Run, fit_runs, mean_agreement, with_resamples
from shelfwise.operators.mixtures import fit_mixtures
from shelfwise.sources.staging import stage

#: a leaf that was split, its two centres, and the number of the leaf that the second centre's points make
Split = tuple[int, np.ndarray, int]
Labeller = Callable[[np.ndarray], np.ndarray]


def _nearest(centres: np.ndarray) -> Labeller:
    return lambda x: ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)


def _leaf(splits: Sequence[Split]) -> Labeller:
    def label(x: np.ndarray) -> np.ndarray:
        leaf = np.zeros(len(x), dtype=int)
        for parent, centres, child in splits:
            leaf[(leaf == parent) & (_nearest(centres)(x) == 1)] = child
        return leaf

    return label


def _labelled(points: DataFrame, labellers: Sequence[Labeller]) -> DataFrame:
    """Key, x, members and one label per labeller, in one vectorised pass."""
    table = points.select(S.KEY, "x", "members")

    def assign(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.vstack(batch["x"].to_numpy())
                batch["labels"] = list(np.stack([f(x) for f in labellers], axis=1).astype(np.int32))
                yield batch

    schema = T.StructType([*table.schema.fields, T.StructField("labels", T.ArrayType(T.IntegerType()))])
    return table.mapInPandas(assign, schema)


def fit_bisecting(
    points: DataFrame, k: int, slots: int, restarts: int = S.RESTARTS, seed: int = S.SEED
) -> list[list[Split]]:
    """Bisecting K-Means of every member slot: k - 1 times the biggest leaf of each is cut in two, all in the same jobs.

    Of leaves of one size the one with the smallest number is cut. A leaf of equal points cannot be cut and stays.
    """
    trees: list[list[Split]] = [[] for _ in range(slots)]
    for step in range(1, k):
        state = stage(_labelled(points, [_leaf(t) for t in trees]), "leaves")
        sizes = (
            state.select(F.posexplode(F.arrays_zip("members", "labels")).alias("slot", "at"))
            .where("at.members")
            .groupBy("slot", F.col("at.labels").alias("leaf"))
            .agg(F.count(F.lit(1)).alias("n"))
            .groupBy("slot")
            .agg(F.max_by("leaf", F.struct("n", -F.col("leaf"))).alias("leaf"))
        )
        biggest = {r["slot"]: r["leaf"] for r in sizes.collect()}
        inside = [
            F.element_at("members", i + 1) & (F.element_at("labels", i + 1) == biggest.get(i, 0)) for i in range(slots)
        ]
        part = state.select(S.KEY, "x", F.array(*inside).alias("members"))
        fits = fit_runs(part, [Run(2, restarts, seed, member=i) for i in range(slots)])
        for i, fit in enumerate(fits):
            trees[i].append((biggest.get(i, 0), fit.centres, step))
    return trees


def method_compare(
    points: DataFrame,
    k: int,
    times: int = S.RESAMPLES,
    fraction: float = S.RESAMPLE_FRACTION,
    restarts: int = S.RESTARTS,
    mixture_restarts: int = 5,
    seed: int = S.SEED,
    score: str = "exact",
) -> DataFrame:
    """K-Means, Gaussian mixture and bisecting K-Means by silhouette, stability and balance.

    The last member slot holds all products; a method's fit to it is the one that the resamples' fits are held against.
    Mixtures start from the first ``mixture_restarts`` restarts of the K-Means fits of their resample, and the likeliest
    counts. Bisecting K-Means stands for hierarchical clustering, whose merges need all pairs in one place.
    """
    every = F.concat("members", F.array(F.lit(True)))
    sampled = stage(with_resamples(points, times, fraction, seed).withColumn("members", every), "method-points")
    slots = times + 1
    runs = [Run(k, max(restarts, mixture_restarts), seed, member=i) for i in range(slots)]
    fits = fit_runs(sampled, runs)
    starts = [(centres, i) for i, fit in enumerate(fits) for _, centres in fit.restarts[:mixture_restarts]]
    tried = fit_mixtures(sampled, starts)
    mixtures = [
        max(tried[i * mixture_restarts : (i + 1) * mixture_restarts], key=lambda m: m.likelihood) for i in range(slots)
    ]
    labellers: dict[str, list[Labeller]] = {
        "kmeans": [_nearest(fit.best_of(restarts)[1]) for fit in fits],
        "gaussian_mixture": [m.label for m in mixtures],
        "hierarchical": [_leaf(t) for t in fit_bisecting(sampled, k, slots, restarts, seed)],
    }
    names = list(labellers)
    labelled = stage(_labelled(sampled, [f for n in names for f in labellers[n]]), "method-labels")
    full = F.array(*[F.element_at("labels", (at + 1) * slots) for at in range(len(names))])
    sharp = scores.silhouette(scores.silhouettes(labelled.select(S.KEY, "x", full.alias("labels")), score))
    rows = None
    for at, name in enumerate(names):
        again = F.array(
            *[
                F.struct(
                    F.lit(i).alias("sample"),
                    F.element_at("members", i + 1).alias("inside"),
                    F.element_at("labels", at * slots + i + 1).alias("again"),
                )
                for i in range(times)
            ]
        )
        whole = F.element_at("labels", (at + 1) * slots)
        pairs = labelled.select(whole.alias("full"), F.inline(again)).where("inside")
        balance = scores.cluster_balance(labelled.select(S.KEY, whole.alias("label")), "label")
        row = sharp.where(F.col("labeling") == at).select(
            F.lit(name).alias("method"),
            "silhouette",
            mean_agreement(pairs).scalar().alias("stability"),
            balance.scalar().alias("balance"),
        )
        rows = row if rows is None else rows.unionByName(row)
    return stage(rows, "methods")
