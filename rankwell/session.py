"""Session defaults for the operators of this package."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import SparkSession

import rankwell

# Functions that run in tasks travel with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(rankwell)

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A join partition is split once it is twice the median and above 64 MB, so that one hot user
    # or item is shared by several tasks.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # ... even where the split costs another shuffle after the join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2.0",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def build_session(app: str = "rankwell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; `conf` uses `__` for the dots of a setting's name."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {**DEFAULTS, **{name.replace("__", "."): value for name, value in conf.items()}}
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
