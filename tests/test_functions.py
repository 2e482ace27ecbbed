import math

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shelfwise.functions.ordered import (
    average_rank,
    exact_quantiles,
    order_statistics,
    ordered_bits,
    position_by,
    value_of_bits,
)
from shelfwise.functions.stats import ln_gamma, student_t_two_sided
from shelfwise.sources import pos_csv


@pytest.fixture(scope="module")
def numbers():
    """A hot group with heavy ties and both signs, a tiny one, a missing key and NaN values."""
    rng = np.random.default_rng(7)
    hot = np.round(rng.lognormal(3, 2, 4000), 2) * rng.choice([-1, 1], 4000)
    hot[:1500] = 0.0
    return pd.DataFrame(
        {
            "g": ["hot"] * 4000 + ["one"] + [None] * 5,
            "id": [f"{i:05d}" for i in range(4006)],
            "v": [*hot, 5.0, 1.0, 2.0, np.nan, 4.0, 8.0],
        }
    )


def test_quantiles_equal_numpy(spark, numbers):
    probs = {"lo": 0.01, "q1": 0.25, "mid": 0.5, "q3": 0.75, "hi": 0.99, "end": 1.0}
    got = exact_quantiles(spark.createDataFrame(numbers), "v", probs, ["g"]).collect()
    assert len(got) == 3
    for row in got:
        values = numbers[numbers.g.isna() if row.g is None else numbers.g == row.g].v.dropna()
        for name, p in probs.items():
            assert row[name] == pytest.approx(np.quantile(values, p), abs=1e-9)


NARROW = {
    "narrow": lambda rng, n: 50 + 0.04 * rng.random(n),
    "tiny": lambda rng, n: 1e-9 * rng.random(n) - 3e-10,
    "one": lambda rng, n: np.full(n, 12.5),
    "wide": lambda rng, n: rng.normal(size=n) * 10.0 ** rng.integers(-300, 300, n),
}


def test_narrow_values_and_ties_are_selected_by_their_bits(spark):
    n, probs = 150_000, {"lo": 0.01, "mid": 0.5, "hi": 0.9}
    made = {name: f(np.random.default_rng(3), n) for name, f in NARROW.items()}
    table = spark.createDataFrame(pd.DataFrame(made).sample(frac=1, random_state=1))
    long = table.unpivot([], list(made), "g", "v")
    got = {r.g: r for r in exact_quantiles(long, "v", probs, ["g"]).collect()}
    for name, values in made.items():
        for slot, p in probs.items():
            assert got[name][slot] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_every_round_of_bits(spark, numbers):
    hot = numbers[numbers.g == "hot"]
    values = np.sort(hot.v)
    at = {f"p{i}": (lambda n, _, i=i: F.lit(i)) for i in (0, 7, 1999, 2600, 3999)}
    for room in (0, 1, 100):  # none, and few, of the buckets are sorted
        got = order_statistics(spark.createDataFrame(hot), "v", at, room=room).collect()
        assert len(got) == 1 and got[0]["_total"] == 4000
        assert [got[0][name] for name in at] == [values[int(name[1:])] for name in at]


def test_bits_order_as_doubles_do(spark):
    values = [-np.inf, -1e300, -1.5, -5e-324, 0.0, 5e-324, 1e-9, 1.5, np.inf]
    table = spark.createDataFrame([(v,) for v in values], "v double")
    rows = table.select("v", ordered_bits(F.col("v")).alias("u")).select("v", "u", value_of_bits(F.col("u")).alias("w")).collect()
    assert [r.w for r in sorted(rows, key=lambda r: r.u)] == values
    blank = spark.createDataFrame([(None,), (float("nan"),), (-0.0,)], "v double").select(ordered_bits(F.col("v")))
    assert sorted(blank.collect(), key=repr) == [(0,), (None,), (None,)]


def test_ties_of_a_hot_value_are_split_over_tasks(spark):
    n = 200_000
    table = spark.range(n).select(F.format_string("%07d", "id").alias("id"), F.lit(7.0).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or so few rows would be put together
    try:
        got = position_by(table, "v", "id", "place", "running")
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got.where("place <> cast(id as long) + 1 or abs(running - 7.0 * place) > 1e-6").count() == 0
    assert max(sizes) < n / 2


def test_average_rank_equals_pandas(spark, numbers):
    table = spark.createDataFrame(numbers).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = average_rank(table, "v", ["g"], "r", "n").toPandas().set_index("id").sort_index()
    want = numbers.set_index("id").groupby("g", dropna=False).v.rank()
    np.testing.assert_allclose(got.r.astype(float), want.sort_index())


def test_positions_and_running_totals(spark, numbers):
    hot = numbers[numbers.g == "hot"]
    got = position_by(spark.createDataFrame(hot), "v", "id", "place", "running").toPandas()
    want = hot.sort_values(["v", "id"], ascending=[False, True])
    got = got.sort_values("place")
    assert list(got.id) == list(want.id) and list(got.place) == list(range(1, 4001))
    np.testing.assert_allclose(got.running, want.v.cumsum(), atol=1e-6)


def test_student_t_textbook_values(spark):
    cases = [(2.0, 10, 0.0733880), (0.5, 1, 0.7048328), (3.182446, 3, 0.05), (2.0, 2, 0.1835034)]
    table = spark.createDataFrame([(t, d) for t, d, _ in cases], "t double, dof int")
    theta = F.atan(F.abs("t") / F.sqrt("dof"))
    got = table.select(student_t_two_sided(theta, F.col("dof")).alias("p")).collect()
    for row, (_, _, p) in zip(got, cases):
        assert row.p == pytest.approx(p, abs=1e-6)


def test_log_gamma(spark):
    xs = [0.5, 1.0, 2.0, 10.0, 1000.5]
    table = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r.g for r in table.select(ln_gamma(F.col("x")).alias("g")).collect()]
    np.testing.assert_allclose(got, [math.lgamma(x) for x in xs], rtol=1e-13, atol=1e-13)


def test_csv_with_marked_header_and_bad_values(spark, tmp_path):
    path = tmp_path / "pos.csv"
    path.write_text("﻿ retailer_nm ,period_id,total_units\ns,9/23/2023,7\ns,1/2/2024,n/a\n")
    got = pos_csv.read_panel(spark, str(path)).orderBy("period_id").collect()
    assert [(r.retailer_nm, str(r.period_id), r.total_units) for r in got] == [
        ("s", "2023-09-23", 7.0),
        ("s", "2024-01-02", None),
    ]


def test_a_bad_date_stops_the_job(spark):
    table = spark.createDataFrame([("1/2/2024",), ("2024-01-02",)], "period_id string")
    with pytest.raises(PySparkException, match="is not a M/d/yyyy date"):
        pos_csv.parse_period(table).collect()


def test_files_are_read_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("retailer_nm,period_id,total_units,total_sales\nA,1/2/2024,2,200\n")
    (tmp_path / "b.csv").write_text("retailer_nm,period_id,total_sales,total_units\nB,1/2/2024,200,2\n")
    for columns in (["retailer_nm"], ["retailer_nm", "total_units"]):
        with pytest.raises(Exception, match="header"):
            pos_csv.read_panel(spark, str(tmp_path)).select(*columns).collect()


def test_a_bad_date_stops_a_job_that_reads_no_date(spark, tmp_path):
    (tmp_path / "a.csv").write_text("retailer_nm,period_id,total_units\nA,1/2/2024,2\nB,bad,1\n")
    with pytest.raises(PySparkException, match="is not a M/d/yyyy date"):
        pos_csv.read_panel(spark, str(tmp_path)).agg({"total_units": "sum"}).collect()
