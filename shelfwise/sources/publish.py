"""Publishing a run's tables behind the gate, and finding the last published run."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_name() -> str:
    """A name for a run of now; later runs have greater names."""
    return datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")


def publish_tables(
    tables: dict[str, DataFrame], gate: DataFrame, root: str, run: str | None = None
) -> str | None:
    """Write every table of a run, then make the run current; nothing changes if the gate says no.

    Tables go to a folder of their own run, computed once as Parquet and copied from there as CSV;
    the one-row entry appended to the list of runs at the end is what makes them visible, so
    readers see the old run or the whole new one.
    """
    if not gate.first()["publish"]:
        return None
    run = run or run_name()
    spark = gate.sparkSession
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{root}/{run}/{name}")
        written = spark.read.schema(table.schema).parquet(f"{root}/{run}/{name}")
        written.write.mode("overwrite").option("header", True).csv(f"{root}/{run}/{name}.csv")
    entry = spark.createDataFrame([(run,)], "run string")
    entry.coalesce(1).write.mode("append").parquet(f"{root}/runs")
    return run


def latest_run(spark: SparkSession, root: str) -> str | None:
    try:
        runs = spark.read.parquet(f"{root}/runs")
    except AnalysisException:
        return None
    return runs.agg(F.max("run").alias("run")).first()["run"]


def load_published(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """A table of the latest published run, or None before the first."""
    run = latest_run(spark, root)
    return None if run is None else spark.read.parquet(f"{root}/{run}/{name}")


def load_previous_groups(spark: SparkSession, root: str) -> DataFrame | None:
    """Product and group of the last published run, if there is one."""
    groups = load_published(spark, root, "groups")
    return None if groups is None else groups.select("rgm_ppg", "group", "group_name")
