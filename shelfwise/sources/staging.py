"""Stage boundaries: a written table that cuts lineage and survives lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_DIR_KEY = "spark.checkpoint.dir"
_TIDY_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage_root(spark: SparkSession) -> str:
    """The shared folder the session names, else one in its warehouse, which is shared as well."""
    root = spark.conf.get(_DIR_KEY, None)
    return root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/stages"


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{stage_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Used where one result feeds several branches, so that the raw scan and the big shuffle run
    once; as the table is on shared storage its size is known to the planner and a lost executor
    costs no recomputation of what came before. Nothing reads the write's shuffle files again, so
    they go with it and do not add up over the stages of a long job.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    before = spark.conf.get(_TIDY_KEY, "false")
    spark.conf.set(_TIDY_KEY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_TIDY_KEY, before)
    return spark.read.schema(df.schema).parquet(path)
