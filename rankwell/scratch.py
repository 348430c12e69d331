"""Shared working storage: where intermediate tables are written so that lineage can be cut.

Tables go to the folder the cluster names in ``spark.checkpoint.dir``.  They survive the loss of
executors, unlike cached or locally checkpointed blocks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Only a ``local[...]`` session, where driver and tasks are one process on one machine, may fall
    back to a temporary folder; anything else has to configure the setting.
    """
    root = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="rankwell-")
    spark.conf.set(_SETTING, root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, sort_by: list[str] | None = None) -> DataFrame:
    """Write `df` once and read it back: a short lineage, true sizes for the optimizer, column pruning."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    out = df.sortWithinPartitions(*sort_by) if sort_by else df
    out.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
