"""Scores of a grouping: silhouette, Calinski-Harabasz, agreement between labelings, balance.

Functions that score several labelings at once take a long table (product, labeling, label), so
that one pass serves a whole scan.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwise import settings as S
from shelfwise.functions.ordered import join_null_safe, position_by
from shelfwise.functions.stats import ln_gamma
from shelfwise.sources.staging import stage

BLOCK = 2048


def _group_sums(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Distance sums between two blocks, for the points of either and the groups of the other that they need."""
    alone = key[0] == key[1]
    right = left if alone else right
    out = [pd.DataFrame({"point": [], "code": [], "total": [], "n": []})]
    if left.empty or right.empty:
        return out[0]

    def wants(points: pd.DataFrame, others: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The others' groups, who is in them, and which of them each point needs."""
        codes = np.vstack(others["codes"].to_numpy())
        groups, place = np.unique(codes, return_inverse=True)
        inside = np.zeros((len(others), len(groups)))
        inside[np.repeat(np.arange(len(others)), codes.shape[1]), place.ravel()] = 1.0
        row = np.repeat(np.arange(len(points)), points["need"].map(len))
        need = np.concatenate([np.asarray(n, dtype=np.int64) for n in points["need"]])
        at = np.minimum(np.searchsorted(groups, need), len(groups) - 1)
        held = groups[at] == need
        wanted = np.zeros((len(points), len(groups)), dtype=bool)
        wanted[row[held], at[held]] = True
        return groups, inside, wanted

    def add(points: pd.DataFrame, distance: np.ndarray, groups: np.ndarray, inside: np.ndarray, wanted: np.ndarray):
        sums, sizes = distance @ inside, inside.sum(axis=0)
        row, at = np.nonzero(wanted)
        names = points["point"].to_numpy()[row]
        out.append(pd.DataFrame({"point": names, "code": groups[at], "total": sums[row, at], "n": sizes[at]}))

    ours = wants(left, right)
    theirs = None if alone else wants(right, left)
    back = theirs is not None and theirs[2].any()
    # rows are left out only where the other side does not need them either
    rows = np.ones(len(left), dtype=bool) if back else ours[2].any(axis=1)
    columns = np.ones(len(right), dtype=bool) if ours[2].any() else (theirs[2].any(axis=1) if back else rows)
    if not rows.any() or not columns.any():
        return out[0]
    a, b = np.vstack(left["x"].to_numpy())[rows], np.vstack(right["x"].to_numpy())[columns]
    distance = np.zeros((len(a), len(b)))
    for axis in range(a.shape[1]):
        distance += (a[:, axis, None] - b[None, :, axis]) ** 2
    np.sqrt(distance, out=distance)
    if ours[2].any():
        add(left[rows], distance, ours[0], ours[1][columns], ours[2][rows])
    if back:
        add(right[columns], distance.T, theirs[0], theirs[1][rows], theirs[2][columns])
    return pd.concat(out[1:])


class _Groups:
    """Size, centre and mean squared distance to the centre of every group of every labeling, by their codes."""

    def __init__(self, points: DataFrame) -> None:
        d, wide = points.select(F.size("x").alias("d"), F.size("labels").alias("l")).agg(F.max("d"), F.max("l")).first() or (0, 0)
        self.d, self.labelings = d or 0, wide or 0
        middle = points.agg(*[F.avg(F.col("x")[i]) for i in range(self.d)]).first() if self.d else ()
        self.middle = np.array([v or 0.0 for v in middle])
        names = ["n", "q", *[f"s{i}" for i in range(self.d)]]
        schema = ", ".join(["labeling int", "label int", *[f"{n} double" for n in names]])
        table = points.select("x", "labels").mapInPandas(self._partial(names), schema)
        rows = table.groupBy("labeling", "label").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
        rows = rows.sort_values(["labeling", "label"], ignore_index=True)
        self.names = rows[["labeling", "label"]].to_numpy()
        self.sizes = rows["n"].to_numpy(dtype=float)
        shift = rows[names[2:]].to_numpy(dtype=float) / np.maximum(self.sizes, 1.0)[:, None]
        self.centres = shift + self.middle
        self.spread = np.maximum(rows["q"].to_numpy(dtype=float) / np.maximum(self.sizes, 1.0) - (shift**2).sum(axis=1), 0.0)
        whole = self.names[:, 0] == 0
        self.scale = float(np.sqrt(rows["q"].to_numpy(dtype=float)[whole].sum() / max(self.sizes[whole].sum(), 1.0)))

    def _partial(self, names: list[str]) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
        middle, labelings = self.middle, self.labelings

        def add_up(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                x = np.vstack(batch["x"].to_numpy()) - middle
                labels = np.vstack(batch["labels"].to_numpy())
                each = pd.DataFrame(np.column_stack([np.ones(len(x)), (x**2).sum(axis=1), x]), columns=names)
                for at in range(labelings):
                    sums = each.groupby(labels[:, at]).sum().rename_axis("label").reset_index()
                    sums.insert(0, "labeling", at)
                    yield sums

        return add_up

    def codes(self, labels: np.ndarray) -> np.ndarray:
        """The code of every label: its place among (labeling, label) in order."""
        out = np.empty(labels.shape, dtype=np.int64)
        for at in range(labels.shape[1]):
            first = int((self.names[:, 0] < at).sum())
            known = self.names[self.names[:, 0] == at, 1]
            out[:, at] = first + np.searchsorted(known, labels[:, at])
        return out

    def of(self, labeling: int) -> np.ndarray:
        return np.flatnonzero(self.names[:, 0] == labeling)


def _needs(points: DataFrame, groups: _Groups) -> DataFrame:
    """Points with their groups' codes, the codes whose distance sums can matter, and a number that orders by groups.

    The mean distance to a group lies between the distance to its centre and the root of the mean squared distance to
    its members. A group whose lower bound is above the least upper bound of all other groups cannot be the nearest one.
    """
    slack = 1e-7 * groups.scale  # more than what rounding does to the bounds

    def bound(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.vstack(batch["x"].to_numpy())
            codes = groups.codes(np.vstack(batch["labels"].to_numpy()))
            need = np.zeros((len(x), len(groups.sizes)), dtype=bool)
            place = np.zeros(len(x))
            for at in range(groups.labelings):
                these = groups.of(at)
                square = ((x[:, None] - groups.centres[these][None]) ** 2).sum(axis=2)
                own = codes[:, at, None] == these[None]
                most = np.where(own, np.inf, np.sqrt(square + groups.spread[these]))
                close = own | (np.sqrt(square) <= most.min(axis=1, keepdims=True) * (1 + 1e-9) + slack)
                # one alone in its group scores zero whatever the others are
                need[:, these] = close & (groups.sizes[codes[:, at]] > 1)[:, None]
                place = place + codes[:, at] / float(len(groups.sizes) + 1) ** at
            yield pd.DataFrame(
                {
                    "point": batch["point"],
                    "x": batch["x"],
                    "codes": list(codes),
                    "need": [np.flatnonzero(n) for n in need],
                    "place": place,
                }
            )

    schema = "point string, x array<double>, codes array<long>, need array<long>, place double"
    return points.select(F.col(S.KEY).alias("point"), "x", "labels").mapInPandas(bound, schema)


def needed_sums(points: DataFrame, groups: _Groups, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Points in blocks, and the distance sums (point, code, total, n) that their silhouettes need.

    Blocks hold neighbours in the order of their groups, so most blocks hold few groups. Two blocks meet once, in one
    grouped task, if a point of either needs a group of the other, and the task returns sums for both.
    """
    dealt = position_by(_needs(points, groups), "place", "point", "at")
    number = F.floor((F.col("at") - 1) / block).cast("int").alias("block")
    blocks = stage(dealt.select("point", "x", "codes", "need", number), "silhouette-blocks")
    need = blocks.select("block", F.explode("need").alias("code")).distinct()
    have = blocks.select(F.col("block").alias("other"), F.explode("codes").alias("code")).distinct()
    meet = need.join(have, "code").select(
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    )
    meet = stage(meet.distinct(), "silhouette-pairs")
    low = blocks.withColumnRenamed("block", "low").join(meet, "low")
    high = blocks.withColumnRenamed("block", "high").join(meet.where("low < high"), "high")
    high = high.select(*[F.col(c).alias(c) for c in low.columns])  # columns of its own
    sums = (
        low.groupBy("low", "high")
        .cogroup(high.groupBy("low", "high"))
        .applyInPandas(_group_sums, "point string, code long, total double, n double")
        .groupBy("point", "code")
        .agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    )
    return blocks, sums


def silhouette_samples(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """Euclidean silhouette of every product under every labeling.

    ``points`` holds the product, ``x`` (array of doubles) and ``labels`` (array of ints, one per labeling). Own groups
    are summed exactly, other groups only where bounds leave them a chance of being nearest; what remains is quadratic
    in the size of a group and its rivals. Groups, a few per labeling, pass through the driver with their sums. A
    product alone in its group scores zero, and so does one without any other group.
    """
    groups = _Groups(points)
    blocks, sums = needed_sums(points, groups, block)
    names = [(i, int(a), int(b)) for i, (a, b) in enumerate(groups.names)]
    known = points.sparkSession.createDataFrame(names, "code long, labeling int, label int")
    own = blocks.select("point", F.explode("codes").alias("code")).join(known, "code")
    other = known.select(F.col("code").alias("to_code"), "labeling")
    near = sums.withColumnRenamed("code", "to_code").join(other, "to_code")
    same = F.col("to_code") == F.col("code")
    mean_other = F.when(~same, F.col("total") / F.col("n"))
    mean_own = F.when(same & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))
    found = (
        own.join(near, ["point", "labeling"], "left")
        .groupBy("point", "labeling", "label")
        .agg(F.max(mean_own).alias("a"), F.min(mean_other).alias("b"))
    )
    score = F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))
    return found.select(
        F.col("point").alias(S.KEY),
        "labeling",
        "label",
        F.when(F.col("a").isNull(), 0.0).otherwise(F.coalesce(score, F.lit(0.0))).alias("silhouette"),
    )


def silhouette_sq_samples(points: DataFrame) -> DataFrame:
    """Silhouettes on squared distances, every labeling in one pass over the points, linear in their number.

    The mean squared distance to a group follows from its centre and spread. Same columns as `silhouette_samples`.
    """
    groups = _Groups(points)

    def work_out(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.vstack(batch["x"].to_numpy())
            labels = np.vstack(batch["labels"].to_numpy())
            codes = groups.codes(labels)
            for at in range(groups.labelings):
                these, size = groups.of(at), groups.sizes[codes[:, at]]
                mean = ((x[:, None] - groups.centres[these][None]) ** 2).sum(axis=2) + groups.spread[these]
                own = codes[:, at, None] == these[None]
                a = np.where(own, mean, 0.0).sum(axis=1) * size / np.maximum(size - 1, 1.0)
                b = np.where(own, np.inf, mean).min(axis=1)
                most = np.maximum(a, b)
                good = (size > 1) & np.isfinite(b) & (most > 0)
                value = np.where(good, np.where(good, b - a, 0.0) / np.where(good, most, 1.0), 0.0)
                yield pd.DataFrame({S.KEY: batch[S.KEY], "labeling": at, "label": labels[:, at], "silhouette": value})

    schema = f"{S.KEY} string, labeling int, label int, silhouette double"
    return points.select(S.KEY, "x", "labels").mapInPandas(work_out, schema)


def silhouettes(points: DataFrame, score: str = "exact") -> DataFrame:
    """`silhouette_samples` for the score ``exact``, `silhouette_sq_samples` for ``squared``."""
    if score not in ("exact", "squared"):
        raise ValueError(f"score is exact or squared, not {score}")
    return silhouette_samples(points) if score == "exact" else silhouette_sq_samples(points)


def silhouette(samples: DataFrame) -> DataFrame:
    """Mean silhouette and share of negative ones per labeling."""
    return samples.groupBy("labeling").agg(
        F.avg("silhouette").alias("silhouette"),
        F.avg(F.when(F.col("silhouette") < 0, 1.0).otherwise(0.0)).alias("negative_share"),
    )


def silhouette_sq(points: DataFrame) -> float:
    """Silhouette on squared distances, linear in the number of products; another number than
    ``silhouette``, for product ranges where the quadratic one is too dear. First labeling only."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    ready = points.select(
        array_to_vector("x").alias("features"),
        F.element_at("labels", 1).cast("double").alias("prediction"),
    )
    return ClusteringEvaluator().evaluate(ready)


def calinski_harabasz(points: DataFrame) -> DataFrame:
    """Between over within spread per labeling, from sums per group and dimension."""
    cells = (
        points.select("x", F.posexplode("labels").alias("labeling", "label"))
        .select("labeling", "label", F.posexplode("x").alias("axis", "v"))
        .groupBy("labeling", "label", "axis")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("v").alias("mean"),
            (F.var_pop("v") * F.count(F.lit(1))).alias("inside"),
        )
    )
    everyone = Window.partitionBy("labeling", "axis")
    centre = F.sum(F.col("mean") * F.col("n")).over(everyone) / F.sum("n").over(everyone)
    spread = cells.withColumn("gap", F.col("mean") - centre)
    totals = spread.groupBy("labeling").agg(
        F.sum("inside").alias("within"),
        F.sum(F.col("n") * F.col("gap") * F.col("gap")).alias("between"),
        F.count_if(F.col("axis") == 0).alias("k"),
        F.sum(F.when(F.col("axis") == 0, F.col("n"))).alias("n"),
    )
    return totals.select(
        "labeling",
        F.try_divide(
            F.col("between") * (F.col("n") - F.col("k")), F.col("within") * (F.col("k") - 1)
        ).alias("calinski_harabasz"),
    )


def _contingency(df: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by, a, b).agg(F.count(F.lit(1)).cast("double").alias("nij"))


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def adjusted_rand(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Adjusted Rand index of two label columns, per ``by`` if given."""
    by = list(by)
    cells = stage(_contingency(df, a, b, by), "contingency")  # label counts, read three times

    def margin(column: str, name: str) -> DataFrame:
        sums = cells.groupBy(*by, column).agg(F.sum("nij").alias("s"))
        return sums.groupBy(*by).agg(
            F.sum(_pairs(F.col("s"))).alias(name), F.sum("s").alias(f"{name}_n")
        )

    inside = cells.groupBy(*by).agg(F.sum(_pairs(F.col("nij"))).alias("index"))
    key = by or ["_one"]
    one = [] if by else [F.lit(1).alias("_one")]
    parts = [t.select("*", *one) for t in (inside, margin(a, "rows"), margin(b, "cols"))]
    joined = parts[0].join(parts[1], key).join(parts[2], key)
    expected = F.try_divide(F.col("rows") * F.col("cols"), _pairs(F.col("rows_n")))
    ceiling = (F.col("rows") + F.col("cols")) / 2
    score = F.coalesce(
        F.try_divide(F.col("index") - expected, ceiling - expected), F.lit(1.0)
    )
    return joined.select(*by, score.alias("ari"))


def adjusted_mutual_info(df: DataFrame, group: str, attributes: Sequence[str]) -> DataFrame:
    """Adjusted mutual information of the groups with each attribute of more than one value.

    A missing attribute is a category of its own. The expected information sums over possible
    cell counts; each (group, value) pair unfolds at most as many as its smaller margin, so the
    work is linear in the number of products, and groups of pairs are spread by the explode.
    """
    long = df.select(
        F.col(group).alias("g"), *[F.col(a).cast("string").alias(a) for a in attributes]
    ).unpivot(["g"], list(attributes), "attribute", "value")
    counts = long.groupBy("attribute", "g", "value").agg(
        F.count(F.lit(1)).cast("double").alias("nij")
    )
    cells = stage(counts, "contingency")
    rows = cells.groupBy("attribute", "g").agg(F.sum("nij").alias("a"))
    cols = cells.groupBy("attribute", "value").agg(F.sum("nij").alias("b"))
    total = df.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()

    def entropy(table: DataFrame, column: str, name: str) -> DataFrame:
        p = F.col(column) / F.col("n")
        return (
            table.withColumn("n", total)
            .groupBy("attribute")
            .agg((-F.sum(p * F.log(p))).alias(name), F.count(column).alias(f"{name}_k"))
        )

    joint = join_null_safe(cells.join(rows, ["attribute", "g"]), cols, ["attribute", "value"])
    information = (
        joint.withColumn("n", total)
        .groupBy("attribute")
        .agg(
            F.sum(
                F.col("nij") / F.col("n")
                * F.log(F.col("nij") * F.col("n") / (F.col("a") * F.col("b")))
            ).alias("mi")
        )
    )
    a, b, n, m = F.col("a"), F.col("b"), F.col("n"), F.col("m")

    def ln_fact(x: Column) -> Column:
        return ln_gamma(x + 1)

    weight = F.exp(
        ln_fact(a) + ln_fact(b) + ln_fact(n - a) + ln_fact(n - b)
        - ln_fact(n) - ln_fact(m) - ln_fact(a - m) - ln_fact(b - m) - ln_fact(n - a - b + m)
    )
    # Margins of one attribute meet on the attribute: groups x values rows, both label counts.
    chance = (
        rows.join(cols, "attribute")
        .withColumn("n", total)
        .withColumn(
            "count",
            F.explode(
                F.sequence(
                    F.greatest(F.lit(1.0), a + b - n).cast("int"), F.least("a", "b").cast("int")
                )
            ),
        )
        .withColumn("m", F.col("count").cast("double"))
        .groupBy("attribute")
        .agg(F.sum(m / n * F.log(n * m / (a * b)) * weight).alias("emi"))
    )
    scored = (
        information.join(chance, "attribute")
        .join(entropy(rows, "a", "h_group"), "attribute")
        .join(entropy(cols, "b", "h_value"), "attribute")
        .join(
            cols.groupBy("attribute").agg(F.count("value").alias("values")), "attribute"
        )
        .where(F.col("values") > 1)
    )
    ceiling = (F.col("h_group") + F.col("h_value")) / 2
    score = F.coalesce(
        F.try_divide(F.col("mi") - F.col("emi"), ceiling - F.col("emi")), F.lit(1.0)
    )
    return scored.select("attribute", score.alias("ami")).orderBy(F.desc("ami"), "attribute")


def cluster_balance(groups: DataFrame, group: str = "group") -> DataFrame:
    """Entropy of the group shares over its maximum; one group has no balance to speak of."""
    sizes = groups.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    total = groups.agg(F.count(F.lit(1)).alias("n")).scalar()
    share = F.col("n") / F.col("total")
    return sizes.withColumn("total", total).agg(
        F.try_divide(-F.sum(share * F.log(share)), F.log(F.count(F.lit(1)))).alias("balance")
    )


def choose_k(scores: DataFrame, low: int = S.K_SEARCH[0], high: int = S.K_SEARCH[1]) -> DataFrame:
    """The k in range with the best mean rank of both scores, ties to the better silhouette.

    ``scores`` has one row per k tried.
    """
    tried = scores.where(F.col("groups").between(low, high))

    def average_rank(column: str) -> Column:
        peers = F.count(F.lit(1)).over(Window.partitionBy(column))
        return F.rank().over(Window.orderBy(column)) + (peers - 1) / 2

    ranked = tried.select(
        "groups",
        "silhouette",
        ((average_rank("silhouette") + average_rank("calinski_harabasz")) / 2).alias("mean_rank"),
    )
    return ranked.orderBy(F.desc("mean_rank"), F.desc("silhouette"), "groups").limit(1)
