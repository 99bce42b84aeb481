"""Cutting of long lineages."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a reliable checkpoint in the folder of spark.checkpoint.dir.

    Later steps then plan from stored rows, and a lost executor repeats no step before. Only a local master, as in
    tests, may leave the folder unset; on a cluster no machine's own folder would serve the others, so that is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "checkpoints"))
    return df.checkpoint()


def within_tables(spark: SparkSession) -> None:
    """From now on joins on a table and more keys need no exchange of rows that are dealt by the table."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    # a union must not promise its sides' partitioning then: sides whose partitions were merged differently would fail to zip
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def by_table(df: DataFrame) -> DataFrame:
    """``df`` dealt by table_id once and stored, for many steps that work within a table; rows without a table go.

    Joins, groupings and windows whose keys begin with the table then need no further exchange. Joins on more keys than
    the table's alone take that only with ``within_tables``.
    """
    conf = df.sparkSession.conf
    within_tables(df.sparkSession)
    # a stored frame's partitioning outlives its copies in a plan only where the column is never null
    df = df.where("table_id is not null").withColumn("table_id", F.coalesce("table_id", F.lit(0).cast("long")))
    return dealt(df.repartition(int(conf.get("spark.sql.shuffle.partitions")), "table_id"))


def dealt(df: DataFrame) -> DataFrame:
    """``cut`` that keeps the partitioning in mind, which a plan that adapts as it runs does not tell."""
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df)
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)
