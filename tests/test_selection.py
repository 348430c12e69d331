"""Medians by selection, whole-vector sums and full lists."""

import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankwell.functions.vectors import weighted_vectors
from rankwell.operators import core, knn, profile, retrieval


@pytest.mark.parametrize("kind", ["distinct", "repeated", "one", "two", "wide", "close", "infinite"])
def test_median_by_sorting(spark, kind):
    rng = np.random.default_rng(6)
    values = {
        "distinct": rng.normal(size=20_001).tolist(), "repeated": [1.0] * 700 + [2.0] * 5 + [9.0] * 600, "one": [4.5], "two": [1.0, 2.0],
        "wide": [-1.7e308, 1.7e308, 1e-300, 3.0, 5.0, 1e200], "close": [1.0, np.nextafter(1.0, 2), np.nextafter(1.0, 0), 1.0 + 1e-15],
        "infinite": [float("inf"), float("-inf"), 1.0, 7.0, float("inf")]}[kind]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(5)
    assert profile.exact_median(df, "v").first()["median"] == statistics.median(values)


def test_median_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert profile.exact_median(df, "v").first()["median"] is None
    assert np.isnan(profile.exact_median(spark.createDataFrame([(float("nan"),)], "v double"), "v").first()["median"])


def test_median_reads_its_input_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.range(3_001).select((F.col("id") % 997).cast("double").alias("v")).mapInArrow(seen, "v double")
    assert profile.exact_median(df, "v").first()["median"] == statistics.median(i % 997 for i in range(3_001))
    assert read.value == 3_001


def test_vector_sums_are_one_aggregate(spark):
    rng = np.random.default_rng(7)
    rows = [(int(k), rng.normal(size=64).tolist(), float(w)) for k, w in zip(rng.integers(0, 9, 500), rng.normal(size=500))]
    df = spark.createDataFrame([*rows, (3, None, 1.0)], "k long, v array<double>, w double")
    sums = {r.k: r.vector for r in weighted_vectors(df, ["k"], "v", 64, F.col("w")).collect()}
    means = {r.k: r.vector for r in weighted_vectors(df, ["k"], "v", 64, mean=True).collect()}
    for k in sums:
        own = [(np.array(v), w) for i, v, w in rows if i == k]
        assert np.allclose(sums[k], sum(v * w for v, w in own)) and np.allclose(means[k], np.mean([v for v, _ in own], axis=0))
    plan = weighted_vectors(df, ["k"], "v", 64, F.col("w"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate_metrics") + plan.count("aggregate") < 8


def test_lists_are_full_and_a_user_without_neighbours_is_no_hit(spark):
    """With places below the free items, every user has that many; the unknown user's truth comes last."""
    data = [(0, i, 1.0) for i in range(7)] + [(1, 0, 2.0), (1, 3, 1.0), (2, 5, 1.0)] + [(3, i, 1.0) for i in range(20, 40)]
    train = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "row_key long, user_id long, item_id long, rating double")
    lists, history = knn.itemknn_fit(train, 5), core.sum_pairs(train)
    asked = spark.createDataFrame([(100, 0, 9), (101, 1, 30), (102, 9, 31)], "row_key long, user_id long, item_id long")
    found = retrieval.retrieve_topn(asked, lists, history, 12)
    assert {r.user_id: r["count"] for r in found.groupBy("user_id").count().collect()} == {0: 12, 1: 12, 9: 12}
    pool = retrieval.inject_truth(asked, found, 12)
    score = retrieval.rerank(pool, lambda df, out: df.withColumn(out, -F.col("position").cast("double")))
    ranks = {r.row_id: r.new_rank for r in score.where("is_truth").collect()}
    assert ranks[102] == 12
    assert retrieval.two_stage_metrics(score.where("row_id = 102"), [10]).first()[0] == 0.0
