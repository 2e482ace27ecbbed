"""K-Means with restarts, many fits at a time, and what is built on it.

Spark's own estimator fits one model per call, a job per iteration, and has no restarts. Choosing
k, restarting, and refitting resamples need hundreds of fits of the same points, so here one job
per iteration advances every fit together: each task adds up, for its own points, the sums that
every fit needs, Spark adds the partial sums, and only the centres (their number is set by the
parameters, not by the data) pass through the driver.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise import settings as S
from shelfwise.functions.ordered import exact_quantiles
from shelfwise.operators import scores
from shelfwise.sources.staging import stage

MAX_ITERATIONS = 300
_CHUNK = 1024


@dataclass(frozen=True)
class Run:
    """One K-Means problem: k, restarts, seed, and the slot of its member flag, if resampled.

    ``starts`` names the products to start from; nothing is drawn then and restarts are all alike.
    """

    k: int
    restarts: int = S.RESTARTS
    seed: int = S.SEED
    init: str = "k-means++"
    member: int | None = None
    starts: tuple[str, ...] = ()


@dataclass(frozen=True)
class Fit:
    """Best restart of a run: centres (k x d), their inertia, and every restart's inertia and centres.

    ``converged`` says whether every restart's centres stood still before the iterations ran out.
    """

    centres: np.ndarray
    inertia: float
    restarts: list[tuple[float, np.ndarray]]
    converged: bool = True

    def best_of(self, count: int) -> tuple[float, np.ndarray]:
        return min(self.restarts[:count], key=lambda r: r[0])


def _mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number scrambled, so that neighbouring inputs give unrelated outputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _proposals(
    centres: np.ndarray, chosen: int, spread: np.ndarray, salt: np.ndarray, member: np.ndarray
) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A task's next starting centre for every fit: the point with the least -ln(u) / weight.

    u is drawn from a hash of the product and the fit, so the least over all tasks is a draw with
    probability in proportion to the weight, however the points are partitioned. The weight is the
    squared distance to the centres chosen so far, or one for a plain random start; chosen points
    weigh nothing and are taken again only when there is no other.
    """

    def propose(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = np.full(len(centres), np.inf)
        point: list = [None] * len(centres)
        for batch in batches:
            x = np.vstack(batch["x"].to_numpy()) if len(batch) else np.zeros((0, 1))
            for at in range(0, len(x), _CHUNK):
                part = x[at : at + _CHUNK]
                seeds = batch["h"].to_numpy()[at : at + _CHUNK].astype(np.int64).view(np.uint64)
                u = _mixed(_mixed(seeds)[:, None] ^ salt[None, :]).astype(float) + 0.5
                score = -np.log(u / 2.0**64)
                gap = np.full((len(part), len(centres)), np.inf)
                for c in range(chosen):
                    gap = np.minimum(gap, ((part[:, None, :] - centres[None, :, c]) ** 2).sum(axis=2))
                weight = np.where(spread[None, :] & (chosen > 0), gap, (gap > 0).astype(float))
                score = np.where(weight > 0, score / np.maximum(weight, 1e-300), 1e200 + score)
                if (member >= 0).any():
                    flags = np.vstack(batch["members"].to_numpy()[at : at + _CHUNK])
                    inside = np.where(member >= 0, flags[:, member], True)
                    score = np.where(inside, score, np.inf)
                least = score.argmin(axis=0)
                for fit in np.flatnonzero(score.min(axis=0) < best):
                    best[fit], point[fit] = score[least[fit], fit], part[least[fit]]
        rows = [(i, b, p.tolist()) for i, (b, p) in enumerate(zip(best, point)) if p is not None]
        yield pd.DataFrame(rows, columns=["slot", "score", "x"])

    return propose


def _start_centres(
    table: DataFrame, runs: Sequence[Run], owner: list[tuple[int, int]], d: int
) -> np.ndarray:
    """Starting centres of every fit, drawn among all points: one pass a centre serves all fits."""
    centres = np.zeros((len(owner), max(r.k for r in runs), d))
    spread = np.array([runs[i].init != "random" for i, _ in owner])
    member = np.array([-1 if runs[i].member is None else runs[i].member for i, _ in owner])
    names = [(runs[i].seed, restart, runs[i].k, member[f], int(spread[f])) for f, (i, restart) in enumerate(owner)]
    for step in range(centres.shape[1]):
        open_ = np.array([f for f, (i, _) in enumerate(owner) if runs[i].k > step and not runs[i].starts])
        if not len(open_):
            continue
        salt = np.array([zlib.crc32(repr((*map(int, names[f]), step)).encode()) for f in open_], dtype=np.uint64)
        propose = _proposals(centres[open_], step, spread[open_], _mixed(salt + np.uint64(1)), member[open_])
        rows = (
            table.select("h", "x", "members")
            .mapInPandas(propose, "slot long, score double, x array<double>")
            .groupBy("slot")
            .agg(F.min_by("x", F.struct("score", "x")).alias("x"))
            .collect()
        )
        for r in rows:
            centres[open_[r["slot"]], step] = r["x"]
    return centres


def _sum_schema(d: int) -> T.StructType:
    names = ["slot", "n", "cost", *[f"s{i}" for i in range(d)]]
    return T.StructType(
        [T.StructField(c, T.LongType() if c == "slot" else T.DoubleType()) for c in names]
    )


def _partial_sums(
    centres: np.ndarray, valid: np.ndarray, member: np.ndarray
) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A task's contribution to every fit: per centre, point count, coordinate sums and cost."""
    fits, k, d = centres.shape
    flat = centres.reshape(fits * k, d)
    lengths = np.where(valid.ravel(), (flat**2).sum(axis=1), np.inf)

    def add_up(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, sizes, cost = np.zeros((fits * k, d)), np.zeros(fits * k), np.zeros(fits * k)
        for batch in batches:
            points = np.vstack(batch["x"].to_numpy()) if len(batch) else np.zeros((0, d))
            flags = np.vstack(batch["members"].to_numpy()) if len(batch) else None
            for at in range(0, len(points), _CHUNK):
                x = points[at : at + _CHUNK]
                gap = (lengths - 2 * x @ flat.T).reshape(len(x), fits, k)
                best = gap.argmin(axis=2)
                weight = np.where(member >= 0, flags[at : at + _CHUNK][:, member], True)
                hit = (np.arange(k) == best[:, :, None]) & weight[:, :, None]
                hit = hit.reshape(len(x), fits * k).astype(float)
                sums += hit.T @ x
                sizes += hit.sum(axis=0)
                near = gap.min(axis=2) + (x**2).sum(axis=1)[:, None]
                cost += (hit.reshape(len(x), fits, k) * near[:, :, None]).sum(axis=0).ravel()
        table = pd.DataFrame(sums, columns=[f"s{i}" for i in range(d)])
        table.insert(0, "slot", np.arange(fits * k))
        table.insert(1, "n", sizes)
        table.insert(2, "cost", cost)
        yield table[table["n"] > 0]

    return add_up


def fit_runs(
    points: DataFrame, runs: Sequence[Run], max_iter: int = MAX_ITERATIONS
) -> list[Fit]:
    """Fit every run with all its restarts by Lloyd's iterations, one Spark job per iteration.

    ``points`` holds ``x`` and, for resampled runs, ``members`` (array of booleans). Starting
    centres are drawn among all points and every iteration uses all points. Fits drop out once
    their centres stand still; the inertia is that of the centres returned. A fit that still moves
    after ``max_iter`` iterations is reported by ``converged`` and a warning.
    """
    if "members" not in points.columns:
        points = points.withColumn("members", F.array(F.lit(True)))
    table = points.select("x", "members", F.xxhash64(S.KEY).alias("h"))
    table.persist()
    try:
        size = table.agg(
            F.max(F.size("x")).alias("d"), F.max(F.array_max(F.transform("x", F.abs))).alias("far")
        ).first()
        d, scale = size["d"], max(1.0, size["far"])
        owner = [(i, r) for i, run in enumerate(runs) for r in range(run.restarts)]
        centres = _start_centres(table, runs, owner, d)
        named = sorted({key for run in runs for key in run.starts})
        if named:
            rows = points.where(F.col(S.KEY).isin(named)).select(S.KEY, "x").collect()
            at = {r[S.KEY]: r["x"] for r in rows}
            for fit, (i, _) in enumerate(owner):
                if runs[i].starts:
                    centres[fit, : runs[i].k] = [at[key] for key in runs[i].starts]
        widest = centres.shape[1]
        valid = np.array([np.arange(widest) < runs[i].k for i, _ in owner])
        member = np.array([-1 if runs[i].member is None else runs[i].member for i, _ in owner])
        names = ["n", "cost", *[f"s{i}" for i in range(d)]]

        def added_up(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """New centres of the fits and the cost of the present ones."""
            step = _partial_sums(centres[which], valid[which], member[which])
            partial = table.select("x", "members").mapInPandas(step, _sum_schema(d))
            rows = partial.groupBy("slot").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
            new, cost = centres[which].reshape(-1, d).copy(), np.zeros(len(which) * widest)
            slots = rows["slot"].to_numpy()
            new[slots] = rows[[f"s{i}" for i in range(d)]].to_numpy() / rows[["n"]].to_numpy()
            cost[slots] = rows["cost"].to_numpy()
            return new.reshape(len(which), widest, d), cost.reshape(len(which), widest).sum(axis=1)

        moving = np.arange(len(owner))
        for _ in range(max_iter):
            new, _ = added_up(moving)
            shift = np.abs(new - centres[moving]).max(axis=(1, 2))
            centres[moving] = new
            moving = moving[shift > 1e-10 * scale]
            if len(moving) == 0:
                break
        _, inertia = added_up(np.arange(len(owner)))
    finally:
        table.unpersist()
    still = {owner[at][0] for at in moving}
    if still:
        warnings.warn(f"{len(moving)} of {len(owner)} fits still move after {max_iter} iterations", stacklevel=2)
    found: list[list[tuple[float, np.ndarray]]] = [[] for _ in runs]
    for at, (i, _) in enumerate(owner):
        found[i].append((float(inertia[at]), centres[at, : runs[i].k]))
    best = [min(options, key=lambda r: r[0]) for options in found]
    return [Fit(c, cost, options, i not in still) for i, ((cost, c), options) in enumerate(zip(best, found))]


def nearest(centres: np.ndarray) -> Column:
    """Index of the centre closest to ``x``, as a JVM expression."""
    distances = [
        F.aggregate(
            F.zip_with("x", F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)),
            F.lit(0.0),
            lambda acc, v: acc + v,
        )
        for c in centres
    ]
    together = F.array(*distances)
    return (F.array_position(together, F.array_min(together)) - 1).cast("int")


def canonical_order(points: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Centres reordered by group size descending, then by the group's first product name.

    Group numbers then mean the same in every run that finds the same groups.
    """
    sizes = (
        points.select(S.KEY, nearest(centres).alias("label"))
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"), F.min(S.KEY).alias("first"))
        .collect()
    )
    found = [r["label"] for r in sorted(sizes, key=lambda r: (-r["n"], r["first"]))]
    empty = [i for i in range(len(centres)) if i not in found]
    return centres[found + empty]


@dataclass(frozen=True)
class Grouping:
    """Fitted centres in canonical order; scores new points without refitting."""

    centres: np.ndarray
    inertia: float

    def transform(self, points: DataFrame, name: str = "group") -> DataFrame:
        return points.select(S.KEY, nearest(self.centres).alias(name))


def fit_groups(
    points: DataFrame, k: int, restarts: int = S.RESTARTS, seed: int = S.SEED
) -> Grouping:
    """The best of ``restarts`` K-Means fits with k groups."""
    (fit,) = fit_runs(points, [Run(k, restarts, seed)])
    return Grouping(canonical_order(points, fit.centres), fit.inertia)


def with_labels(points: DataFrame, labelings: Sequence[np.ndarray]) -> DataFrame:
    """Key, x and one label per labeling, in one vectorised pass over the points."""

    def assign(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.vstack(batch["x"].to_numpy())
            each = [((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1) for c in labelings]
            batch["labels"] = list(np.stack(each, axis=1).astype(np.int32))
            yield batch

    table = points.select(S.KEY, "x")
    schema = T.StructType([*table.schema.fields, T.StructField("labels", T.ArrayType(T.IntegerType()))])
    return table.mapInPandas(assign, schema)


def fit_scan(
    points: DataFrame,
    high: int = S.K_SEARCH[1],
    restarts: int = S.RESTARTS,
    seed: int = S.SEED,
) -> dict[int, Fit]:
    """The fits of k = 2 .. ``high``, advanced together."""
    ks = list(range(2, high + 1))
    return dict(zip(ks, fit_runs(points, [Run(k, restarts, seed) for k in ks])))


def scan_k(
    points: DataFrame,
    high: int = S.K_SEARCH[1],
    restarts: int = S.RESTARTS,
    seed: int = S.SEED,
    fitted: dict[int, Fit] | None = None,
    score: str = "exact",
) -> DataFrame:
    """Inertia, silhouette, Calinski-Harabasz and biggest share for k = 2 .. ``high``.

    ``points`` should be staged; all k are scored together, and fitted unless the fits are given.
    ``score`` is the silhouette's, ``exact`` or ``squared``.
    """
    fitted = fitted or fit_scan(points, high, restarts, seed)
    ks, fits = list(fitted), list(fitted.values())
    labelled = stage(with_labels(points, [f.centres for f in fits]), "scan-labels")
    sizes = (
        labelled.select(F.posexplode("labels").alias("labeling", "label"))
        .groupBy("labeling", "label")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("labeling")
        .agg((F.max("n") / F.sum("n")).alias("biggest_group"))
    )
    known = points.sparkSession.createDataFrame(
        [(i, k, f.inertia) for i, (k, f) in enumerate(zip(ks, fits))],
        "labeling int, groups int, inertia double",
    )
    sharp = scores.silhouette(scores.silhouettes(labelled, score))
    return (
        known.join(sharp, "labeling")
        .join(scores.calinski_harabasz(labelled), "labeling")
        .join(sizes, "labeling")
        .select("groups", "inertia", "silhouette", "calinski_harabasz", "biggest_group")
        .orderBy("groups")
    )


def _chance(slot: int, seed: int) -> Column:
    """A uniform number in [0, 1) that depends on the product, the slot and the seed alone."""
    bits = F.xxhash64(F.col(S.KEY), F.lit(slot), F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1))
    return bits / F.lit(float(1 << 52))


def with_resamples(
    points: DataFrame,
    times: int = S.RESAMPLES,
    fraction: float = S.RESAMPLE_FRACTION,
    seed: int = S.SEED,
) -> DataFrame:
    """``points`` with ``members``: ``times`` samples without replacement, each of the exact size.

    Sample i holds the products with the smallest i-th hash; the cut is an exact quantile per
    sample, so no sample is ever ordered in one place. The cut lies halfway between two hashes.
    """
    n = points.count()
    size = int(fraction * n)
    if n < 2 or size >= n:
        return points.withColumn("members", F.array(*[F.lit(True)] * times))
    draws = points.select(
        F.posexplode(F.array(*[_chance(i, seed) for i in range(times)])).alias("sample", "draw")
    )
    at = max(0.0, size - 0.5) / (n - 1)
    cuts = {
        r["sample"]: r["cut"] for r in exact_quantiles(draws, "draw", {"cut": at}, ["sample"], cheap=True).collect()
    }
    flags = [_chance(i, seed) <= F.lit(cuts[i]) for i in range(times)]
    return points.withColumn("members", F.array(*flags))


def mean_agreement(pairs: DataFrame) -> DataFrame:
    """Mean adjusted Rand index over samples of (sample, full, again) label rows."""
    agreement = scores.adjusted_rand(pairs, "full", "again", ["sample"])
    return agreement.agg(F.avg("ari").alias("agreement"))


def stability(
    points: DataFrame,
    k: int,
    times: int = S.RESAMPLES,
    fraction: float = S.RESAMPLE_FRACTION,
    restarts: int = S.RESTARTS,
    seed: int = S.SEED,
    base: np.ndarray | None = None,
) -> DataFrame:
    """Mean agreement between the grouping of all products and groupings of resamples.

    ``base`` holds the centres of the grouping of all; without it that is fitted in the same jobs.
    """
    sampled = stage(with_resamples(points, times, fraction, seed), "resamples")
    again = [Run(k, restarts, seed, member=i) for i in range(times)]
    fits = fit_runs(sampled, again if base is not None else [*again, Run(k, restarts, seed)])
    base = fits.pop().centres if base is None else base
    again = F.array(
        *[
            F.struct(
                F.lit(i).alias("sample"),
                F.element_at("members", i + 1).alias("inside"),
                nearest(f.centres).alias("again"),
            )
            for i, f in enumerate(fits)
        ]
    )
    pairs = sampled.select(nearest(base).alias("full"), F.inline(again)).where("inside")
    return mean_agreement(pairs)


def split_biggest(
    points: DataFrame,
    groups: DataFrame,
    search: tuple[int, int] = S.SPLIT_SEARCH,
    restarts: int = S.RESTARTS,
    seed: int = S.SEED,
    score: str = "exact",
) -> DataFrame:
    """The largest group split again, by the number of parts with the best silhouette.

    A group with no more products than ``search`` asks parts for cannot be searched and is an error.
    """
    biggest = (
        groups.groupBy("group")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "group")
        .limit(1)
        .select("group")
        .scalar()
    )
    members = groups.where(F.col("group") == biggest).select(S.KEY)
    part = stage(points.join(members, S.KEY, "left_semi"), "biggest")
    size = part.count()
    if size <= search[1]:
        raise ValueError(f"a group of {size} products cannot be split into up to {search[1]} parts")
    ks = list(range(search[0], search[1] + 1))
    fits = fit_runs(part, [Run(k, restarts, seed) for k in ks])
    labelled = stage(with_labels(part, [f.centres for f in fits]), "biggest-labels")
    ranked = (
        scores.silhouette(scores.silhouettes(labelled, score))
        .orderBy(F.desc("silhouette"), "labeling")
        .limit(1)
        .collect()
    )
    best = fits[ranked[0]["labeling"]]
    return Grouping(canonical_order(part, best.centres), best.inertia).transform(part, "sub")


def setting_sweep(
    points: DataFrame,
    k: int,
    inits: Sequence[str] = ("k-means++", "random"),
    restarts: Sequence[int] = (1, 5, 20, 50),
    seeds: Sequence[int] = (0, 42, 123),
    base: np.ndarray | None = None,
    score: str = "exact",
) -> DataFrame:
    """Does anything but k matter? Inertia, silhouette and agreement with the base grouping.

    Every (init, seed) is fitted once with the most restarts; fewer restarts are a prefix of them.
    """
    most = max(restarts)
    runs = [Run(k, most, seed, init) for init in inits for seed in seeds]
    if base is None:
        runs.append(Run(k))
    fits = fit_runs(points, runs)
    if base is None:
        base = fits[-1].centres
    settings = []
    for run, fit in zip(runs, fits[: len(inits) * len(seeds)]):
        settings += [(run.init, n, run.seed, *fit.best_of(n)) for n in restarts]
    labelled = stage(with_labels(points, [base, *[s[4] for s in settings]]), "sweep-labels")
    sharp = scores.silhouette(scores.silhouettes(labelled, score))
    long = labelled.select(
        F.element_at("labels", 1).alias("base"),
        F.posexplode("labels").alias("labeling", "label"),
    ).where(F.col("labeling") > 0)
    same = scores.adjusted_rand(long, "base", "label", ["labeling"])
    known = points.sparkSession.createDataFrame(
        [(i, s[0], s[1], s[2], float(s[3])) for i, s in enumerate(settings, start=1)],
        "labeling int, init string, restarts int, seed int, inertia double",
    )
    return (
        known.join(sharp, "labeling")
        .join(same, "labeling")
        .select("init", "restarts", "seed", "inertia", "silhouette", F.col("ari").alias("agreement"))
        .orderBy("init", "restarts", "seed")
    )


def grouping_agreement(one: DataFrame, other: DataFrame) -> DataFrame:
    """Products in both groupings and their adjusted Rand index."""
    both = one.select(S.KEY, F.col("group").alias("a")).join(
        other.select(S.KEY, F.col("group").alias("b")), S.KEY
    )
    ari = scores.adjusted_rand(both, "a", "b").scalar()
    return both.agg(F.count(F.lit(1)).alias("products")).withColumn("ari", ari)
