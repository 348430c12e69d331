"""Popularity and mean-rating predictors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.functions import scalars as S
from rankwell.operators.core import global_mean_rating, item_mean_rating
from rankwell.operators.joins import lookup_items


def popularity_fit(train: DataFrame) -> DataFrame:
    """Each item's row count over the largest one."""
    counts = train.groupBy("item_id").agg(F.count("*").alias("_n"))
    most = counts.agg(F.max("_n"))
    return counts.select("item_id", (F.col("_n") / most.scalar()).alias("score"))


def popularity_score(pairs: DataFrame, fitted: DataFrame, out: str = "score") -> DataFrame:
    """Add the popularity of the item, 0 for unseen ones."""
    return lookup_items(pairs, fitted.select("item_id", F.col("score").alias(out))).withColumn(out, F.coalesce(out, F.lit(0.0)))


def popularity_rating(pairs: DataFrame, train: DataFrame, out: str = "predicted") -> DataFrame:
    """Add the item's mean rating, or the overall mean, within 1..5."""
    means = item_mean_rating(train).withColumnRenamed("mean_rating", "_mean")
    return lookup_items(pairs, means).withColumn(
        out, S.clip(F.coalesce(F.col("_mean"), global_mean_rating(train).scalar()))).drop("_mean")


def global_mean_predictor(pairs: DataFrame, train: DataFrame, out: str = "predicted") -> DataFrame:
    """Add the overall mean rating."""
    return pairs.withColumn(out, global_mean_rating(train).scalar())
