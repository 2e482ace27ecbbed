"""Gaussian mixtures by expectation-maximisation, many fits at a time.

Every start of every resample advances in the same job: a task works out the responsibilities of its own points and
returns, per fit and component, their sum, their first and second moments about the present mean, and the
log-likelihood. Spark adds these; only parameters (their number is set by the arguments, not by the data) pass through
the driver.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CHUNK = 1024
MAX_STEPS = 100
TOLERANCE = 1e-3
RIDGE = 1e-6


@dataclass(frozen=True)
class Mixture:
    """Weights (k), means (k x d) and covariances (k x d x d) with their mean log-likelihood a point."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    likelihood: float
    converged: bool

    def label(self, x: np.ndarray) -> np.ndarray:
        """The likeliest component of every row of ``x``."""
        return _log_joint(x, self.weights, self.means, _whitening(self.covariances)).argmax(axis=1)


def _whitening(covariances: np.ndarray) -> np.ndarray:
    """Per covariance the matrix W with W W' = its inverse."""
    return np.linalg.inv(np.linalg.cholesky(covariances)).swapaxes(-1, -2)


def _log_joint(x: np.ndarray, weights: np.ndarray, means: np.ndarray, white: np.ndarray) -> np.ndarray:
    """Log of weight times density, a row for each point and a column for each component."""
    apart = ((x[None] - means[:, None]) @ white) ** 2
    heights = np.log(np.diagonal(white, axis1=1, axis2=2)).sum(axis=1) - 0.5 * x.shape[1] * np.log(2 * np.pi)
    return np.log(weights) + heights - 0.5 * apart.sum(axis=2).T


def _schema(d: int) -> T.StructType:
    names = ["n", "likelihood", *[f"s{i}" for i in range(d)], *[f"m{i}_{j}" for i in range(d) for j in range(i + 1)]]
    doubles = [T.StructField(c, T.DoubleType()) for c in names]
    return T.StructType([T.StructField("slot", T.LongType()), *doubles])


def _moments(
    weights: np.ndarray, means: np.ndarray, covariances: np.ndarray | None, member: np.ndarray
) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A task's sums for every fit. Without covariances, points belong wholly to the nearest mean."""
    fits, k, d = means.shape
    white = None if covariances is None else _whitening(covariances)
    low = np.tril_indices(d)

    def shares(x: np.ndarray, f: int) -> tuple[np.ndarray, float]:
        if white is None:
            near = ((x[:, None] - means[f][None]) ** 2).sum(axis=2).argmin(axis=1)
            return (near[:, None] == np.arange(k)).astype(float), 0.0
        joint = _log_joint(x, weights[f], means[f], white[f])
        top = joint.max(axis=1, keepdims=True)
        total = top + np.log(np.exp(joint - top).sum(axis=1, keepdims=True))
        return np.exp(joint - total), float(total.sum())

    def add_up(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes, likelihood = np.zeros((fits, k)), np.zeros((fits, k))
        first, second = np.zeros((fits, k, d)), np.zeros((fits, k, d, d))
        for batch in batches:
            points = np.vstack(batch["x"].to_numpy()) if len(batch) else np.zeros((0, d))
            flags = np.vstack(batch["members"].to_numpy()) if len(batch) else None
            for at in range(0, len(points), _CHUNK):
                part = points[at : at + _CHUNK]
                for f in range(fits):
                    x = part if member[f] < 0 else part[flags[at : at + _CHUNK, member[f]]]
                    if not len(x):
                        continue
                    share, total = shares(x, f)
                    gap = x[None] - means[f][:, None]
                    weighted = gap * share.T[:, :, None]
                    sizes[f] += share.sum(axis=0)
                    likelihood[f, 0] += total
                    first[f] += weighted.sum(axis=1)
                    second[f] += weighted.swapaxes(1, 2) @ gap
        second = second.reshape(fits * k, d, d)[:, low[0], low[1]]
        sums = np.column_stack([sizes.ravel(), likelihood.ravel(), first.reshape(fits * k, d), second])
        table = pd.DataFrame(sums, columns=_schema(d).names[1:])
        table.insert(0, "slot", np.arange(fits * k))
        yield table

    return add_up


def fit_mixtures(
    points: DataFrame,
    starts: Sequence[tuple[np.ndarray, int | None]],
    max_steps: int = MAX_STEPS,
    tolerance: float = TOLERANCE,
    ridge: float = RIDGE,
) -> list[Mixture]:
    """One mixture with full covariances for each start, all advanced together, one Spark job a step.

    A start is k centres (the same k for all) and the slot of the member flag of its resample, or None for all points;
    the first responsibilities are those of the nearest centre. A fit drops out once its mean log-likelihood a point
    changes by less than ``tolerance``. ``ridge`` is added to every variance, so a component of one point, of equal
    points or of none keeps a density. A fit that still moves after ``max_steps`` is reported and warned about.
    """
    if len({len(c) for c, _ in starts}) != 1:
        raise ValueError("all starts of one call need the same number of components")
    if "members" not in points.columns:
        points = points.withColumn("members", F.array(F.lit(True)))
    table = points.select("x", "members")
    means = np.array([c for c, _ in starts], dtype=float)
    member = np.array([-1 if m is None else m for _, m in starts])
    fits, k, d = means.shape
    weights, covariances = np.full((fits, k), 1 / k), np.tile(np.eye(d), (fits, k, 1, 1))
    schema = _schema(d)
    low = np.tril_indices(d)

    def sums(which: np.ndarray, hard: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        step = _moments(weights[which], means[which], None if hard else covariances[which], member[which])
        added = table.mapInPandas(step, schema).groupBy("slot").agg(*[F.sum(c).alias(c) for c in schema.names[1:]])
        rows = added.toPandas().set_index("slot").reindex(range(len(which) * k), fill_value=0.0).to_numpy()
        sizes = rows[:, 0].reshape(len(which), k)
        likelihood = rows[:, 1].reshape(len(which), k).sum(axis=1) / np.maximum(sizes.sum(axis=1), 1e-300)
        second = np.zeros((len(which) * k, d, d))
        second[:, low[0], low[1]] = second[:, low[1], low[0]] = rows[:, 2 + d :]
        return sizes, likelihood, rows[:, 2 : 2 + d].reshape(len(which), k, d), second.reshape(len(which), k, d, d)

    def advance(which: np.ndarray, hard: bool = False) -> np.ndarray:
        """New parameters of the fits; the mean log-likelihood of those before."""
        sizes, likelihood, first, second = sums(which, hard)
        held = sizes + 10 * np.finfo(float).eps
        shift = first / held[:, :, None]
        weights[which] = held / held.sum(axis=1, keepdims=True)
        means[which] += shift
        spread = second / held[:, :, None, None] - shift[..., :, None] * shift[..., None, :]
        covariances[which] = spread + ridge * np.eye(d)
        return likelihood

    table.persist()
    try:
        moving = np.arange(fits)
        advance(moving, hard=True)
        before = np.full(fits, -np.inf)
        for _ in range(max_steps):
            likelihood = advance(moving)
            done = np.abs(likelihood - before[moving]) < tolerance
            before[moving] = likelihood
            moving = moving[~done]
            if not len(moving):
                break
        _, final, _, _ = sums(np.arange(fits), hard=False)
    finally:
        table.unpersist()
    if len(moving):
        warnings.warn(f"{len(moving)} of {fits} mixtures still move after {max_steps} steps", stacklevel=2)
    still = set(moving.tolist())
    return [Mixture(weights[f], means[f], covariances[f], float(final[f]), f not in still) for f in range(fits)]
