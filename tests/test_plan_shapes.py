"""Properties of physical plans that matter at scale."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from checks import derived as D
from rankwell.operators import core, joins, knn, metrics, popular, sequences

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def test_limits_apply_before_the_shuffle(spark):
    seqs = plan(sequences.user_sequences(D.inter(spark, FOLDER), 50))
    assert seqs.index("WindowGroupLimit") and seqs.count("WindowGroupLimit") >= 2
    sims = spark.range(10).select(F.col("id").alias("item_a"), (F.col("id") + 1).alias("item_b"), F.lit(0.5).alias("sim"))
    assert plan(knn.topk_neighbours(sims)).count("WindowGroupLimit") >= 2


def test_scans_read_what_is_needed(spark, tmp_path):
    core.split_to_tables(D.inter(spark, FOLDER).withColumn("split", F.lit("train")), f"{tmp_path}/s")
    text = plan(core.item_mean_rating(spark.read.parquet(f"{tmp_path}/s").where("split = 'train'")))
    assert "ReadSchema: struct<item_id:bigint,rating:double>" in text and "PartitionFilters: [isnotnull(split" in text


def test_split_is_a_projection(spark):
    labelled = core.random_split(D.table(spark, FOLDER, "events"), ["event_id"])
    assert "Exchange" not in plan(labelled)


@pytest.mark.parametrize("make", [
    lambda s: joins.cross_weights(s, [(0.5, 0.5), (1.0, 0.0)], ["rating", "rating"]),
    lambda s: popular.popularity_rating(s.select("user_id", "item_id"), s),
    lambda s: metrics.evaluate_calibrated(s.withColumn("score", F.col("rating")), s.withColumn("score", F.col("rating"))),
    lambda s: core.kcore(s, 20),
])
def test_no_nested_loops(spark, make):
    text = plan(make(D.inter(spark, FOLDER)))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_ranking_shuffles_candidates_once(spark):
    pool = spark.range(100).select(
        F.col("id").cast("string").alias("row_id"), F.lit(0).alias("cand_idx"), F.lit(0.5).alias("score"))
    text = plan(metrics.evaluate_ranking(pool))
    assert text.count("Arguments: hashpartitioning") == 1


def test_splits_are_written_without_sorting(spark, tmp_path, monkeypatch):
    # A sort by split holds a whole file's rows in a task.
    from pyspark.sql.readwriter import DataFrameWriter

    names = ["spark.sql.maxConcurrentOutputFileWriters", "spark.sql.optimizer.plannedWrite.enabled"]
    before, write, seen = [spark.conf.get(n) for n in names], DataFrameWriter.parquet, []
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda *a, **k: seen.append(int(spark.conf.get(names[0]))) or write(*a, **k))
    core.split_to_tables(spark.range(30).withColumn("split", F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") % 3 + 1).cast("int"))),
                         f"{tmp_path}/s")
    assert seen[0] >= 3 and [spark.conf.get(n) for n in names] == before
    assert {r.split: r["count"] for r in spark.read.parquet(f"{tmp_path}/s").groupBy("split").count().collect()} == dict.fromkeys("abc", 10)


def test_recommended_items_meet_the_known_ones_in_one_shuffle(spark):
    history = spark.range(20).selectExpr("id % 4 as user_id", "id as item_id", "1.0D as rating")
    lists = spark.range(20).selectExpr("id as item_id", "(id + 1) % 20 as neighbour", "0.5D as sim", "1L as rank")
    made = knn.itemknn_recommend(history, lists, history, 3, fill_from=0)
    assert "LeftAnti" not in plan(made)
    assert {(r.user_id, r.item_id) for r in made.collect()} <= {(u, i) for u in range(4) for i in range(20) if i % 4 != u}


def test_recommended_items_are_added_up_where_their_user_is_ranked(spark, monkeypatch):
    history = spark.range(60).selectExpr("id % 4 as user_id", "id % 23 as item_id", "id % 5 + 1.0D as rating").distinct()
    lists = spark.range(20).selectExpr("id as item_id", "explode(array((id + 1) % 20, (id + 7) % 25)) as neighbour", "0.5D + id / 64 as sim", "1L as rank")
    made = knn.itemknn_recommend(history, lists, history, 3, fill_from=0)
    # Terms go to their user, and neither to pairs nor on from there.
    dealt = [line for line in plan(made).splitlines() if "Arguments: hashpartitioning(user_id" in line]
    assert dealt and not any("item_id" in line for line in dealt)
    seen = lambda df: sorted((r.user_id, r.item_id, r.score, r.rank) for r in df.collect())
    monkeypatch.setattr(knn, "LIST", 2)  # long histories are dealt by pair
    assert seen(knn.itemknn_recommend(history, lists, history, 3, fill_from=0)) == seen(made)


def test_lists_are_sent_to_evaluated_rows_whole(spark):
    from rankwell.operators import retrieval

    rows = spark.createDataFrame([("a", 1, 5), ("b", 1, 9), ("c", None, 5), ("d", 2, None), ("a", 1, 5)], "row_key string, user_id long, item_id long")
    found = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 7, 1), (None, 5, 1), (3, 3, 1)], "user_id long, item_id long, rank long")
    pool = retrieval.inject_truth(rows, found, 2)
    assert sorted(map(str, (tuple(r) for r in pool.collect()))) == sorted(map(str, [
        *[("a", 1, 5, 1, True, True), ("a", 1, 6, 2, False, True)] * 2, ("b", 1, 5, 1, False, False), ("b", 1, 9, 2, True, False),
        ("c", None, 5, 1, True, False), ("d", 2, 7, 1, None, False), ("d", 2, None, 2, True, False)]))
    assert plan(retrieval.inject_truth(rows, found, 2)).count("Arguments: hashpartitioning") <= 2
