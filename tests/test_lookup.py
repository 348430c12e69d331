"""Lookups of both sides of pairs, and what is scored through them."""

import pytest
from pyspark.sql import functions as F

from rankwell.operators import aspects, factors, fusion, joins, knn, text


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(joins, "LOOKUP_BROADCAST", 0)
    monkeypatch.setattr(joins, "BLOCK_BYTES", 2_000)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_equals_joins(spark, small_blocks, how):
    n = F.col("id")
    pairs = spark.range(600).select(F.when(n % 50 != 0, n % 37).alias("user_id"), (n % 41).alias("item_id"), "id")
    users = spark.range(30).select(n.alias("user_id"), (n * 10).alias("u"))
    users = users.unionByName(users.where("user_id = 3"))
    items = spark.range(40).select(n.alias("item_id"), (n * 100).alias("i"))
    columns = ["id", "user_id", "item_id", "u", "i"]
    seen = lambda df: sorted(map(str, df.select(columns).collect()))
    got = joins.lookup_both(pairs, users, items, (100, 100), how)
    assert seen(got) == seen(pairs.join(users, "user_id", how).join(items, "item_id", how))
    as_int = users.withColumn("user_id", F.col("user_id").cast("int"))
    assert seen(joins.lookup_both(pairs, as_int, items, (100, 100), how)) == seen(got)


def test_vectors_are_not_shuffled_with_pairs(spark, small_blocks):
    vectors = lambda key: spark.range(50).select(F.col("id").alias(f"{key}_id"), F.array(F.col("id") * 1.0, F.lit(1.0)).alias(f"{key}_vector"))
    pairs = spark.range(500).select((F.col("id") % 50).alias("user_id"), (F.col("id") % 49).alias("item_id"), "id")
    scored = factors.Factors(vectors("user"), vectors("item"), 2).score(pairs)
    assert {r.id: r.score for r in scored.collect()} == {i: (i % 50) * (i % 49) + 1.0 for i in range(500)}
    # The pairs and each side, once.
    assert _plan(scored).count("Exchange") == 3 and "SortMergeJoin" not in _plan(scored)


@pytest.mark.parametrize("longest", [2, 4096])
def test_neighbour_scores_are_not_made_of_shuffled_terms(spark, small_blocks, monkeypatch, longest):
    monkeypatch.setattr(knn, "LIST", longest)  # users and items of more entries go the other way
    history = spark.createDataFrame([(1, 1, 2.0), (1, 1, 1.0), (1, 2, None), (2, 3, 4.0), (3, 1, 1.0), (3, 2, 1.0), (3, 3, 1.0), (None, 1, 1.0)],
                                    "user_id long, item_id long, rating double")
    near = spark.createDataFrame([(5, 1, 0.5, 1), (5, 2, 0.25, 2), (6, 3, 1.0, 1), (7, 1, 0.5, 1), (7, 2, 0.5, 2), (7, 3, 0.5, 3)],
                                 "item_id long, neighbour long, sim double, rank long")
    pairs = spark.createDataFrame([(u, i, f"{u}-{i}") for u in (1, 2, 3, 4, None) for i in (5, 6, 7, 8, None)] * 2,
                                  "user_id long, item_id long, row string")
    for weighted in (True, False):
        seen = lambda way: sorted((r.row or "", r.score) for r in knn.itemknn_score(pairs, near, history, weighted, per_row_work=way).collect())
        assert seen("auto") == seen("pairs") == seen("history")
    if longest == 4096:
        assert "SortMergeJoin" not in _plan(knn.itemknn_score(pairs, near, history))


def test_vector_means_hold_one_sum_at_a_time(spark, monkeypatch):
    from rankwell.functions import vectors

    monkeypatch.setattr(vectors, "_SUM_BYTES", 7 * 16)  # seven rows at a time
    n = F.col("id")
    key = F.when(n % 11 != 0, F.when(n % 2 == 0, 0).otherwise(n % 40)).cast("long")
    rows = spark.range(500, numPartitions=3).select(key.alias("k"), F.concat(F.lit("s"), n % 3).alias("t"), F.when(n % 7 != 0, F.array(n * 1.0, -n * 0.5)).alias("v"))
    for kind in ("float", "double"):
        typed = rows.withColumn("v", F.col("v").cast(f"array<{kind}>"))
        made = vectors.mean_vectors(typed, ["k", "t"], "v", 2)
        expected = typed.where("v is not null").groupBy("k", "t").agg(*[F.avg(F.col("v")[i].cast("double")).alias(f"x{i}") for i in (0, 1)])
        assert {(r.k, r.t): pytest.approx([r.x0, r.x1]) for r in expected.collect()} == {(r.k, r.t): r.vector for r in made.collect()}
    assert vectors.mean_vectors(rows.where("false"), ["k"], "v", 2).collect() == []


def test_means_of_profiles_send_no_sums_of_one_row(spark):
    from rankwell.operators import text

    rows = spark.range(300).select((F.col("id") % 100).alias("user_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("v"))
    made = text.average_vectors_by_id(rows, "user_id", "v", 2, 101)
    assert "ObjectHashAggregate" not in _plan(made)
    assert {r.user_id: r.vector for r in made.collect()} == {i: [i + 100.0, 1.0] for i in range(100)} | {100: [0.0, 0.0]}


def _profiles(spark, key, name, n=50):
    return spark.range(n).select(F.col("id").alias(f"{key}_id"), F.array(F.col("id") * 1.0, F.lit(1.0)).alias(name))


def test_features_are_not_shuffled_with_pairs(spark, small_blocks):
    pairs = spark.range(500).select((F.col("id") % 60).alias("user_id"), (F.col("id") % 49).alias("item_id"), "id")
    base = factors.Factors(_profiles(spark, "user", "user_vector"), _profiles(spark, "item", "item_vector"), 2)
    weights = spark.range(40).select(F.col("id").alias("user_id"), F.array(*[F.lit(float(i)) for i in range(6)]).alias("weights"))
    item_aspects = spark.range(50).select(F.col("id").alias("item_id"), *[F.lit(3.0).alias(a) for a in aspects.S.VECTOR_ASPECTS])
    inputs = fusion.Inputs(base, _profiles(spark, "user", "vector"), _profiles(spark, "item", "vector", 30), 2, weights, item_aspects)
    made = inputs.add(pairs)
    assert _plan(made).count("Exchange") == 3 and "SortMergeJoin" not in _plan(made)  # the pairs and each side, once
    assert inputs.add(made) is made
    got = {r.id: r for r in made.collect()}
    for i, r in got.items():
        u, v = i % 60, i % 49
        assert r.factor_product == ([u * v, 1.0] if u < 50 else [0.0, 0.0]) and r.factor_concat == [*([u, 1.0] if u < 50 else [0.0, 0.0]), v, 1.0]
        assert r.text_product == ([u * v, 1.0] if u < 50 and v < 30 else [0.0, 0.0])
        assert r.quality == pytest.approx(45.0 if u < 40 else 3.0)
    assert len(got) == 500


def test_aspects_of_pairs_take_one_lookup(spark, small_blocks):
    pairs = spark.range(300).select((F.col("id") % 53).alias("user_id"), (F.col("id") % 49).alias("item_id"), "id")
    train = spark.range(200).select((F.col("id") % 40).alias("user_id"), (F.col("id") % 45).alias("item_id"),
                                    (F.col("id") % 5 + 1.0).alias("service"), F.lit(None).cast("double").alias("rooms"))
    names = ["service", "rooms"]
    users, items = _profiles(spark, "user", "user_vector"), _profiles(spark, "item", "item_vector")
    apart = aspects.aspect_pair_features(text.text_pair_features(pairs, users, items), train, names)
    of_users, of_items = aspects.aspect_sides(train, names)
    users, items = users.join(of_users, "user_id", "left").localCheckpoint(), items.join(of_items, "item_id", "left").localCheckpoint()
    looked_up = text.text_pair_features(pairs, users, items)
    assert _plan(looked_up).count("Exchange") == 3 and "SortMergeJoin" not in _plan(looked_up)
    together = aspects.aspect_pair_features(looked_up, train, names)
    assert together.columns == apart.columns
    assert sorted(map(str, together.collect())) == sorted(map(str, apart.collect()))
    scored = spark.createDataFrame([(1, 2, 2.0, 4.0, [0.25, 0.75])], "user_id long, item_id long, service_hat double, rooms_hat double, _weights array<double>")
    assert [r.score for r in aspects.decomposed_score(scored, None, names).collect()] == [3.5]


def _candidates(spark, n=40):
    rows = spark.range(n).select(F.concat(F.lit("row number "), "id").alias("row_id"), F.when(F.col("id") % 9 != 0, F.col("id") % 7).alias("user_id"))
    idx = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("cand_idx"))
    return idx.select("row_id", "user_id", (F.xxhash64("row_id", "cand_idx") % 30 + 30).alias("item_id"), "cand_idx",
                      (F.col("cand_idx") == 0).cast("long").alias("label"))


def test_runs_hold_neighbours_together(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 1, 6), (None, 1, 7), (None, 1, None), ("a", None, 9), ("a", 1, 4)],
                                 "k string, u long, x long").coalesce(1)
    assert [tuple(r) for r in joins.in_runs(rows, ["k", "u"]).collect()] == [
        ("a", 1, [5, 6]), (None, 1, [7, None]), ("a", None, [9]), ("a", 1, [4])]
    parted = joins.in_runs(rows.withColumn("even", F.coalesce(F.col("x") % 2, F.lit(0))), ["k", "u"], "even").collect()
    assert [tuple(r) for r in parted] == [("a", 1, 0, [6]), ("a", 1, 1, [5]), (None, 1, 0, [None]), (None, 1, 1, [7]), ("a", None, 1, [9]), ("a", 1, 0, [4])]


@pytest.mark.parametrize("how", ["left", "inner"])
def test_candidates_are_sent_row_by_row(spark, small_blocks, monkeypatch, how):
    pairs, n = _candidates(spark), F.col("id")
    users = spark.range(6).select(n.alias("user_id"), (n * 10).alias("u"))
    items = spark.range(50).select(n.alias("item_id"), (n * 100).alias("i"))
    columns = [*pairs.columns, "u", "i"]
    seen = lambda df, names=columns: sorted(map(str, df.select(names).collect()))
    got = joins.lookup_both(pairs, users, items, (100, 100), how)
    assert seen(got) == seen(pairs.join(users, "user_id", how).join(items, "item_id", how)) and "MapInArrow" in _plan(got)
    names, expected = [*pairs.columns, "i"], pairs.join(items, "item_id", how)
    few = joins.lookup_items(pairs, items, how)
    assert "BroadcastHashJoin" in _plan(few) and seen(few, names) == seen(expected, names)
    monkeypatch.setattr(joins, "ITEM_BROADCAST_ROWS", 0)
    many = joins.lookup_items(pairs, items, how)
    assert "MapInArrow" in _plan(many) and seen(many, names) == seen(expected, names)
    plain = pairs.drop("row_id")
    assert seen(joins.lookup_items(plain, items, how), names[1:]) == seen(expected, names[1:])


def test_scores_of_a_group_are_shuffled_as_lists(spark):
    from rankwell.operators import blending, metrics, stacking

    scored = _candidates(spark).withColumn("score", F.when(F.col("item_id") % 11 != 0, (F.col("item_id") % 5) * 1.0)).repartition(5)
    scored = scored.unionByName(scored.where("row_id = 'row number 3'"))  # a key that comes twice
    truth = {}
    for r in scored.collect():
        if r.cand_idx == 0 and r.score is not None:
            truth[r.row_id] = max(r.score, truth.get(r.row_id, -1.0))
    ranks = dict.fromkeys([f"row number {i}" for i in range(40)], 0.0)
    for r in scored.collect():
        if r.cand_idx and r.score is not None and r.score > truth.get(r.row_id, 99.0):
            ranks[r.row_id] += 1.0
    made = metrics.rank_of_positive(scored)
    assert {r.row_id: r["rank"] for r in made.collect()} == ranks and "Window" not in _plan(made)
    board = blending.component_metrics(scored, ["score"])
    assert "Window" not in _plan(board)
    assert board.first().hr_5 == pytest.approx(sum(r < 5 for r in ranks.values()) / 40) and board.first().n == 40
    assert blending.component_metrics(scored.where("cand_idx = 0"), ["score"]).collect() == []
    for dealt in (stacking.holdout_label_table(scored, ["score"], 20), blending.minmax_by_group(scored, ["score"])):
        assert "MapInArrow" in _plan(dealt) and dealt.count() == 820
    assert {r.row_id for r in stacking.holdout_label_table(scored, ["score"], 20).where("not complete").collect()} == {"row number 3"}
    assert "Exchange hashpartitioning" not in _plan(blending.minmax_by_user(scored.localCheckpoint(), ["score"])).replace("row_id", "")


def test_training_rows_are_written_once(spark, monkeypatch):
    labelled = spark.range(40).select((F.col("id") % 6).alias("user_id"), (F.col("id") % 5).alias("item_id"), (F.col("id") % 2 * 1.0).alias("label"))
    single = lambda key: _profiles(spark, key, f"{key}_vector").withColumn(f"{key}_vector", F.col(f"{key}_vector").cast("array<float>"))
    inputs = fusion.Inputs(factors.Factors(single("user"), single("item"), 2))
    written, made = [], []
    monkeypatch.setattr(fusion, "staged", lambda df, label: written.append(label) or df.localCheckpoint())
    rows = inputs.written(labelled, "rows")
    seen = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert rows.columns == inputs.add(labelled).columns and seen(rows) == seen(inputs.add(labelled))
    written.clear()
    fusion.fusion_ranker(rows, inputs, [2], 1)
    assert written == []


def test_vectors_of_pairs_take_one_lookup(spark, small_blocks):
    pairs = spark.range(300).select((F.col("id") % 53).alias("user_id"), (F.col("id") % 49).alias("item_id"), "id")
    users, items = _profiles(spark, "user", "user_vector"), _profiles(spark, "item", "item_vector")
    made = joins.lookup_vectors(pairs, users.unionByName(users.where("user_id = 3")), items)
    assert "SortMergeJoin" not in _plan(made) and _plan(made).count("Exchange") == 3
    assert sorted(r.id for r in made.collect()) == sorted([i for i in range(300) if i % 53 < 50] + [i for i in range(300) if i % 53 == 3])


def test_rows_dealt_by_user_stay_where_they_are(spark):
    rows = spark.range(300).select(F.when(F.col("id") % 10 != 0, F.col("id") % 7).alias("user_id"), (F.col("id") % 5).alias("item_id"), "id")
    train = rows.where("id % 4 = 0").unionByName(rows.where("id % 4 = 0"))
    conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = joins.rows_in_train_pairs(rows.repartition("user_id"), train)
        assert _plan(made).count("Exchange") <= 3 and "SortMergeJoin" not in _plan(made)
        pairs = {(r.user_id, r.item_id) for r in train.collect()}
        assert {r.id for r in made.collect()} == {r.id for r in rows.collect() if r.user_id is not None and (r.user_id, r.item_id) in pairs}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)
