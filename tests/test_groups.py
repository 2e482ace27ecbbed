import numpy as np
import pandas as pd
import pytest
from panels import shaped
from pyspark.sql import functions as F

from shelfwise import settings as S
from shelfwise.operators import cluster, features, methods, mixtures, prepare, rules, scores
from shelfwise.plans import pipeline
from shelfwise.sources.publish import load_previous_groups, load_published
from shelfwise.sources.staging import stage


@pytest.fixture(scope="module")
def raw(spark):
    """Three kinds of product, eight of each."""
    kinds = {
        "DEAR": dict(base=250, price=11.0, deals=0.04, lift=0.2, drift=0.001),
        "DEAL": dict(base=2600, price=2.2, deals=0.5, lift=1.4, drift=-0.003),
        "YEARLY": dict(base=900, price=5.0, deals=0.15, drift=0.006, wave=0.7),
    }
    parts = [
        shaped(f"{kind}{i}", seed=40 * at + i, **how)
        for at, (kind, how) in enumerate(kinds.items())
        for i in range(8)
    ]
    return stage(spark.createDataFrame(pd.concat(parts)), "planted")


@pytest.fixture(scope="module")
def table(raw):
    return stage(features.features_from_raw(raw), "features")


@pytest.fixture(scope="module")
def prepared(table):
    preparation = prepare.fit_preparation(table)
    return preparation, stage(preparation.transform(table), "points")


def _ari(found, column="group"):
    kind = F.regexp_extract(S.KEY, "^[A-Z]+", 0)
    return scores.adjusted_rand(found.withColumn("kind", kind), "kind", column).first().ari


def test_planted_kinds_are_recovered_and_assignable(spark, table, prepared, tmp_path):
    preparation, points = prepared
    grouping = cluster.fit_groups(points, 3)
    groups = grouping.transform(points)
    assert _ari(groups) > 0.7
    prepare.save_preparation(preparation, spark, str(tmp_path))
    pipeline.save_grouping(grouping, spark, str(tmp_path))
    again = pipeline.assign_to_existing_groups(
        table,
        prepare.load_preparation(spark, str(tmp_path)),
        pipeline.load_grouping(spark, str(tmp_path)),
    )
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in groups.collect()}


def test_stability_of_planted_groups_and_exact_sample_sizes(prepared):
    _, points = prepared
    sampled = cluster.with_resamples(points, 5)
    sizes = sampled.select(F.posexplode("members").alias("i", "inside")).where("inside")
    assert [r["count"] for r in sizes.groupBy("i").count().collect()] == [19] * 5
    assert cluster.stability(points, 3, times=5, restarts=5).first().agreement > 0.6


def test_silhouette_in_blocks_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    label = np.array([0] * 25 + [1] * 34 + [2])
    rows = [(f"p{i}", x[i].tolist(), [int(label[i])]) for i in range(60)]
    points = spark.createDataFrame(rows, "rgm_ppg string, x array<double>, labels array<int>")
    got = scores.silhouette_samples(points, block=16).toPandas().set_index("rgm_ppg").silhouette
    distance = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for i in range(60):
        mine = label == label[i]
        if mine.sum() == 1:
            want = 0.0
        else:
            a = distance[i, mine].sum() / (mine.sum() - 1)
            b = min(distance[i, label == o].mean() for o in set(label) - {label[i]})
            want = (b - a) / max(a, b)
        assert got[f"p{i}"] == pytest.approx(want, abs=1e-12)


def _numpy_silhouette(x, label, square=False):
    distance = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    distance = distance if square else np.sqrt(distance)
    out = []
    for i in range(len(x)):
        mine = label == label[i]
        others = [distance[i, label == o].mean() for o in set(label) - {label[i]}]
        if mine.sum() == 1 or not others:
            out.append(0.0)
            continue
        a, b = distance[i, mine].sum() / (mine.sum() - 1), min(others)
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return np.array(out)


def test_silhouettes_of_several_labelings_leave_out_far_groups(spark):
    rng = np.random.default_rng(8)
    places = rng.normal(size=(6, 2)) * 40
    kind = np.repeat(np.arange(6), 40)
    x = places[kind] + rng.normal(size=(240, 2))
    x[5] = x[6]  # a repeated point
    labelings = [kind, kind // 2, rng.integers(0, 3, 240), np.zeros(240, dtype=int), np.where(np.arange(240) == 7, 9, kind)]
    labels = np.stack(labelings, axis=1)
    rows = [(f"p{i}", x[i].tolist(), labels[i].tolist()) for i in range(240)]
    points = spark.createDataFrame(rows, "rgm_ppg string, x array<double>, labels array<int>").repartition(3)
    for square, samples in ((False, scores.silhouette_samples(points, block=32)), (True, scores.silhouettes(points, "squared"))):
        got = samples.toPandas().set_index(["labeling", "rgm_ppg"]).sort_index()
        for at, label in enumerate(labelings):
            mine = got.loc[at].loc[[f"p{i}" for i in range(240)]]
            assert mine.label.tolist() == label.tolist()
            assert mine.silhouette.to_numpy() == pytest.approx(_numpy_silhouette(x, label, square), abs=1e-9)
    one = points.withColumn("labels", F.slice("labels", 1, 1))
    _, sums = scores.needed_sums(one, scores._Groups(one), block=32)
    assert 240 * 2 <= sums.count() < 240 * 4  # of 240 * 6
    with pytest.raises(ValueError, match="exact or squared"):
        scores.silhouettes(points, "other")
    assert scores.silhouette_samples(points.limit(0)).count() == 0


def _numpy_mixture(x, centres, steps):
    k, d = centres.shape
    near = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    share = (near[:, None] == np.arange(k)).astype(float)
    bound = -np.inf
    for _ in range(steps):
        size = share.sum(axis=0) + 10 * np.finfo(float).eps
        mean = share.T @ x / size[:, None]
        joint = np.empty((len(x), k))
        for c in range(k):
            gap = x - mean[c]
            spread = (share[:, c, None] * gap).T @ gap / size[c] + 1e-6 * np.eye(d)
            _, height = np.linalg.slogdet(2 * np.pi * spread)
            apart = (gap @ np.linalg.inv(spread) * gap).sum(axis=1)
            joint[:, c] = np.log(size[c] / size.sum()) - 0.5 * (height + apart)
        total = np.logaddexp.reduce(joint, axis=1)
        if abs(total.mean() - bound) < 1e-3:
            # the library takes one more step of the parameters before it stops
            steps = 0
        bound, share = total.mean(), np.exp(joint - total[:, None])
        if not steps:
            size = share.sum(axis=0)
            return share.T @ x / size[:, None], size / size.sum()
    raise AssertionError("does not settle")


def test_mixtures_equal_numpy_from_the_same_starts(spark):
    rng = np.random.default_rng(21)
    wide = np.array([[3.0, 1.0], [1.0, 0.5]])
    x = np.concatenate([rng.normal(size=(150, 2)), [6.0, 0.0] + rng.normal(size=(90, 2)) @ wide, [0.0, 9.0] + rng.normal(size=(60, 2))])
    inside = rng.random(300) < 0.8
    rows = [(f"p{i}", v.tolist(), [bool(inside[i]), True]) for i, v in enumerate(x)]
    points = spark.createDataFrame(rows, "rgm_ppg string, x array<double>, members array<boolean>")
    starts = [x[[0, 160, 250]], x[[3, 200, 299]]]
    fits = mixtures.fit_mixtures(points.repartition(4), [(starts[0], None), (starts[1], 1), (starts[0], 0)])
    for fit, data, start in zip(fits, (x, x, x[inside]), (starts[0], starts[1], starts[0])):
        means, weights = _numpy_mixture(data, start, 100)
        assert fit.converged and fit.means == pytest.approx(means, abs=1e-6) and fit.weights == pytest.approx(weights, abs=1e-8)
    assert (fits[0].label(x)[:150] == 0).mean() > 0.95
    twice = np.array([[0.0, 0.0]] * 3 + [[5.0, 5.0]] * 3)  # equal points, and a component without any
    few = spark.createDataFrame([(f"p{i}", v.tolist()) for i, v in enumerate(twice)], "rgm_ppg string, x array<double>")
    (fit,) = mixtures.fit_mixtures(few, [(np.array([[0.0, 0.0], [5.0, 5.0], [90.0, 90.0]]), None)])
    assert np.isfinite(fit.likelihood) and fit.label(twice).tolist() == [0, 0, 0, 1, 1, 1]
    with pytest.warns(UserWarning, match="still move"):
        mixtures.fit_mixtures(points, [(starts[0], None)], max_steps=1)


def test_methods_side_by_side(prepared):
    _, points = prepared
    table = methods.method_compare(points, 3, times=4, restarts=4, mixture_restarts=2).toPandas().set_index("method")
    assert sorted(table.index) == ["gaussian_mixture", "hierarchical", "kmeans"]
    assert table.loc["kmeans", "stability"] > 0.5 and table.loc["hierarchical", "silhouette"] > 0.2
    assert ((table.balance > 0) & (table.balance <= 1 + 1e-12)).all() and (table.stability <= 1 + 1e-12).all()


def test_any_partitioning_fits_alike(prepared):
    _, points = prepared
    (one,) = cluster.fit_runs(points, [cluster.Run(3, 4)])
    (two,) = cluster.fit_runs(points.repartition(5), [cluster.Run(3, 4)])
    assert one.converged and one.inertia == pytest.approx(two.inertia)
    centres = [sorted(map(tuple, f.centres.round(8).tolist())) for f in (one, two)]
    assert centres[0] == centres[1]


def test_seeds_reach_small_far_groups(spark):
    """Three groups of four, far from 1,500 points about the origin; every fit starts among all points."""
    rng = np.random.default_rng(12)
    far = np.array([[90.0, 0.0], [0.0, 90.0], [-90.0, -90.0]])
    x = np.concatenate([rng.normal(size=(1500, 2)), *[f + rng.normal(size=(4, 2)) for f in far]])
    rows = [(f"p{i}", v.tolist()) for i, v in enumerate(x)]
    points = spark.createDataFrame(rows, "rgm_ppg string, x array<double>")
    truth = sum(((g - g.mean(axis=0)) ** 2).sum() for g in np.split(x, [1500, 1504, 1508]))
    for parts in (1, 9):
        (fit,) = cluster.fit_runs(points.repartition(parts), [cluster.Run(4, 5)])
        assert fit.inertia == pytest.approx(truth)


def test_inertia_belongs_to_the_centres_and_a_short_fit_says_so(prepared):
    _, points = prepared
    with pytest.warns(UserWarning, match="still move"):
        (fit,) = cluster.fit_runs(points, [cluster.Run(4, 3)], max_iter=1)
    x = np.array([r["x"] for r in points.collect()])
    cost = ((x[:, None] - fit.centres[None]) ** 2).sum(axis=2).min(axis=1).sum()
    assert not fit.converged and fit.inertia == pytest.approx(cost)


def test_a_group_too_small_to_split_is_an_error(prepared):
    _, points = prepared
    few = points.limit(4)
    with pytest.raises(ValueError, match="cannot be split"):
        cluster.split_biggest(few, few.select(S.KEY, F.lit(0).alias("group")))


def test_agreement_ignores_label_names(spark):
    rows = [(0, 7), (0, 7), (1, 3), (1, 3), (2, 9)]
    table = spark.createDataFrame(rows, "a int, b int")
    assert scores.adjusted_rand(table, "a", "b").first().ari == pytest.approx(1.0)


def test_names_follow_the_rules_and_number_repeats(spark):
    profile = pd.DataFrame(0.0, index=range(5), columns=S.FEATURES)
    profile.loc[0, "shelf_trend"] = -3.0
    profile.loc[1, "promo_activity"] = 30.0
    named = rules.name_groups(spark.createDataFrame(profile.rename_axis("group").reset_index()))
    assert [r.group_name for r in named.orderBy("group").collect()] == [
        S.SHRINKING,
        S.PROMO,
        S.STEADY,
        f"{S.STEADY} 2",
        f"{S.STEADY} 3",
    ]


@pytest.mark.parametrize("agreement, publish", [(0.30, False), (0.96, True)])
def test_gate(spark, agreement, publish):
    score = spark.createDataFrame([(agreement,)], "agreement double")
    suggestions = spark.createDataFrame([(S.UNDRILLED_ACTION,), ("x",)], "action string")
    row = rules.publish_gate(score, suggestions).first()
    assert row.publish is publish
    assert ("reaches" if publish else "nothing is published") in row.reason
    assert (row.bar, row.groups, row.actioned, row.undrilled) == (S.PUBLISH_BAR, 2, 1, 1)


def test_moved_products(spark):
    before = spark.createDataFrame([("a", 0), ("b", 1), ("gone", 1)], "rgm_ppg string, group int")
    after = spark.createDataFrame([("a", 0), ("b", 0), ("new", 1)], "rgm_ppg string, group int")
    assert tuple(rules.products_moved(before, after).first()) == (0.5, True)
    none = after.where(F.col(S.KEY) == "new")
    assert tuple(rules.products_moved(before, none).first()) == (0.0, False)


def test_a_held_back_run_leaves_the_published_one(spark, raw, tmp_path):
    root = str(tmp_path)
    options = dict(search=(3, 3), restarts=3, resamples=2, top_n=4)
    assert load_previous_groups(spark, root) is None
    first = pipeline.run(spark, raw, root, publish_bar=0.0, **options)
    assert first.published and first.moved is None
    held = pipeline.run(spark, raw, root, publish_bar=1.01, **options)
    assert held.published is None and held.moved.first().moved == 0.0
    assert load_previous_groups(spark, root).count() == 24
    assert load_published(spark, root, "suggestions").count() == 3
    preparation, grouping = pipeline.load_model(spark, root)
    assert grouping.centres.tolist() == first.grouping.centres.tolist()
