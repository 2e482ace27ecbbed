"""Hard negatives against all products, and the search within one cover tree."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import negatives

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows: list[tuple], every: int = 100, positives: int = 5, many: int = 10) -> list[tuple]:
    held = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        held[i, label, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)] = None
    out = []
    for i, label, v in held:
        if i % every:
            continue
        scores = [(-sum(a * b for a, b in zip(v, w)), j, l) for j, l, w in held if j != i]
        scores.sort()
        for p, j, _ in [s for s in scores if s[2] == label][:positives]:
            fit = [s for s in scores if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p]
            out += [(i, j, r, n, -p, -s) for r, (s, n, _) in enumerate(fit[:many], 1)]
    return sorted(out)


def _awkward(rng: random.Random) -> list[tuple]:
    """Few small components, so that scores tie; copies, repeated rows and ids, nulls, infinities, unlike lengths."""
    rows = [(i, [rng.randrange(-3, 4) / 4 for _ in range(5)], rng.randrange(3)) for i in range(300)]
    rows += [(1000 + i, rows[100][1], i % 4) for i in range(90)]
    rows += [rows[0], rows[0], rows[100], (200, [0.5] * 5, 1), (None, [0.5] * 5, 1), (401, None, 1), (402, [0.5] * 5, None)]
    rows += [(403, [0.5, None, 1.0], 1), (404, [0.5, float("nan")], 1), (405, [float("inf")] * 5, 1), (500, [2.0, 1.0], 0)]
    return rows + [(406, [1.0, 0.25, 0.5], 2), (600, [], 0), (407, [], 1), (700, [0.0] * 5, 2)]


@pytest.mark.parametrize("block,chunk", [(1 << 14, 4096), (2, 64)])
def test_rows_equal_brute_force(spark, block, chunk):
    rows = _awkward(random.Random(5))
    table = spark.createDataFrame(rows, ROWS).repartition(4)
    found = negatives.hard_negatives(table, F.col("vec_id") % 100 == 0, block=block, chunk=chunk).collect()
    want = brute(rows)
    assert sorted(map(tuple, found)) == want and len(want) > 250


def _clustered(rng: np.random.Generator, n: int, clusters: int, width: int = 24) -> np.ndarray:
    centres = rng.normal(size=(clusters, width))
    made = centres[rng.integers(0, clusters, n)] + 0.05 * rng.normal(size=(n, width))
    return np.floor(256 * made * rng.uniform(0.9, 1, (n, 1))).astype(np.int32)


def test_tree_covers_and_skips():
    rng = np.random.default_rng(1)
    vectors = _clustered(rng, 3000, 60)
    ids, labels = rng.permutation(3000), rng.integers(0, 4, 3000)
    t = negatives.tree(ids, labels, vectors, 11)
    assert len(t.level) > 3 and sorted(t.ids) == sorted(ids)
    by_id = vectors[np.argsort(ids)]
    assert (by_id[t.ids] == t.vectors).all()
    wide = np.sqrt(np.maximum(t.longest - (t.vectors.astype(float) ** 2).sum(axis=1), 0))
    points = np.concatenate([t.vectors, wide[:, None]], axis=1)
    leaves = np.flatnonzero(t.child[:, 0] == t.child[:, 1])
    assert sorted(t.rows[leaves].tolist())[0][0] == 0 and t.rows[leaves][:, 1].max() == 3000
    for node in range(len(t.centre)):
        apart = np.linalg.norm(points[slice(*t.rows[node])] - points[t.centre[node]], axis=1)
        assert (apart <= t.radius[node] * (1 + 1e-6) + 1e-3).all()
    anchors = {"vectors": vectors[:40], "ids": ids[:40], "labels": labels[:40]}
    score = vectors[:40].astype(np.int64) @ vectors.T.astype(np.int64)
    for same, low, top in ((True, -np.inf, np.inf), (False, 2e5, 6e5)):
        asks = {"number": np.arange(40), "who": np.arange(40), "low": np.full(40, low), "top": np.full(40, top)}
        search = negatives.Search(anchors, asks, 5, same)
        search.visit(t)
        want = []
        for a in range(40):
            fit = ((labels == labels[a]) == same) & (ids != ids[a]) & (score[a] >= low) & (score[a] <= top)
            want += [(a, -s, i) for s, i in sorted(zip(-score[a][fit], ids[fit]))[:5]]
        assert list(zip(*(c.tolist() for c in search.found))) == want
        assert search.products < 0.25 * score.size


def test_copies_of_a_vector_are_one_point_and_its_first_ids():
    ids = np.arange(5000)[::-1].copy()
    t = negatives.tree(ids, ids % 3, np.ones((5000, 4), dtype=np.int32), 11)
    assert len(t.centre) == 1 and sorted(t.ids) == list(range(33))


def test_products_beyond_a_double_are_exact():
    v = np.array([[1 << 24, 3], [(1 << 24) - 1, 1]], dtype=np.int32).repeat(64, axis=1)
    anchors = {"vectors": v[:1], "ids": np.array([0]), "labels": np.array([0])}
    search = negatives.Search(anchors, {"number": np.arange(1), "who": np.arange(1), "low": np.array([-np.inf]), "top": np.array([np.inf])}, 1, True)
    search.visit(negatives.tree(np.array([7]), np.array([0]), v[1:], 11))
    assert search.found[1].tolist() == [64 * ((1 << 24) * ((1 << 24) - 1) + 3)]


def test_empty_tables_and_other_columns(spark):
    assert negatives.op12(spark.createDataFrame([], ROWS)).count() == 0
    rows = [(7 * i, [1.0, i / 9], i % 2, "x", i) for i in range(1, 150)]
    named = spark.createDataFrame(rows, ROWS + ", vec string, score int")
    assert negatives.op12(named).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert negatives.op12(named.where("vec_id % 100 <> 0")).count() == 0
    assert negatives.matrix([b"", b"\1\0\0\0"]).tolist() == [[0], [1]]


def test_query_equals_sql(spark):
    from compare import connect, difference

    import __spark_entry__ as contract

    sf = "/root/testdata/sf0.01"
    got = contract.queries()["op12_negatives"](spark, sf).toPandas()
    assert difference(got, connect(sf).execute(contract.oracle_sql()["op12_negatives"]).df()) is None and len(got) > 100
