import math

import pytest
from pyspark.sql import functions as F

from rankwell.operators import blending, metrics, reports, retrieval, stacking


def pool(spark, groups):
    data = [(g, 1, i, i, int(i == 0), float(s)) for g, scores in groups.items() for i, s in enumerate(scores)]
    return spark.createDataFrame(data, "row_id string, user_id long, item_id long, cand_idx long, label long, score double")


GROUPS = {"none": [1.0] + [0.5] * 99, "five": [1.0] + [1.0] * 5 + [2.0] * 3 + [0.0] * 91, "all": [0.0] * 100}


@pytest.mark.parametrize("tie,ranks", [
    ("optimistic", {"none": 0, "five": 3, "all": 0}),
    ("pessimistic", {"none": 0, "five": 8, "all": 99}),
    ("mean", {"none": 0, "five": 5.5, "all": 49.5})])
def test_tie_rules(spark, tie, ranks):
    got = {r.row_id: r["rank"] for r in metrics.rank_of_positive(pool(spark, GROUPS), tie=tie).collect()}
    assert got == ranks


def test_unknown_tie_rule(spark):
    with pytest.raises(ValueError):
        metrics.rank_of_positive(pool(spark, GROUPS), tie="best")


def test_metrics(spark):
    r = metrics.evaluate_ranking(pool(spark, GROUPS)).first()
    assert r.hr_5 == 1.0 and r.n == 3
    assert r.ndcg_5 == pytest.approx((1 + 1 / math.log2(5) + 1) / 3)
    assert r.hr_5 <= r.hr_10 <= r.hr_20 and all(r[f"ndcg_{k}"] <= r[f"hr_{k}"] for k in (5, 10, 20))
    # One positive among better ones: rank 1 of [5, 3, 1, 7, 2] for 3.
    one = pool(spark, {"x": [0.9, 1.0, 0.8, 0.7, 0.6]})
    assert metrics.evaluate_ranking(one, cutoffs=[5]).first().ndcg_5 == pytest.approx(1 / math.log2(3))


def test_ranked_list_is_stable(spark):
    got = {r.cand_idx: r.position for r in metrics.ranked_list(pool(spark, {"x": [1.0, 2.0, 1.0, 2.0]})).collect()}
    assert got == {1: 1, 3: 2, 0: 3, 2: 4}


def rated(spark, data):
    return spark.createDataFrame(data, "score double, rating double")


def test_calibration(spark):
    val = rated(spark, [(float(x), 2.0 + 0.5 * x) for x in range(5)])
    line = metrics.fit_calibration(val).first()
    assert (line.a, line.b) == (pytest.approx(0.5), pytest.approx(2.0))
    test = rated(spark, [(0.0, 2.0), (100.0, 5.0), (float("nan"), 3.0)])
    r = metrics.evaluate_calibrated(val, test).first()
    assert r.rmse == pytest.approx(math.sqrt(1 / 3)) and r.mae == pytest.approx(1 / 3) and r.n == 3


def test_constant_scores_fall_back_to_the_mean(spark):
    val = rated(spark, [(0.3, 1.0), (0.3, 4.0), (0.3, 4.0)])
    line = metrics.fit_calibration(val).first()
    assert (line.a, line.b) == (0.0, 3.0)
    assert metrics.val_score_std(val).first().note is not None
    assert metrics.val_score_std(rated(spark, [(0.0, 1.0), (1.0, 1.0)])).first().note is None


def test_best_epoch(spark):
    log = spark.createDataFrame([("a", e, v) for e, v in enumerate([0.1, 0.3, 0.3, 0.2, 0.9], 1)] +
                                [("b", e, v) for e, v in enumerate([0.1, 0.2, 0.3], 1)], "run string, epoch long, hr double")
    got = {r.run: (r.best_epoch, r.best_value, r.stopped_at) for r in metrics.best_epoch(log, "hr", 2, ["run"]).collect()}
    assert got == {"a": (2, 0.3, 4), "b": (3, 0.3, None)}


def scores(spark):
    data = []
    for g in range(12):
        for i in range(8):
            data.append((f"g{g}", g % 3, i, i, int(i == 0), ((g * 7 + i * 5) % 11) / 3.0, float((g + i * i) % 7), float(i == g % 8)))
    return spark.createDataFrame(
        data, "row_id string, user_id long, item_id long, cand_idx long, label long, a double, b double, c double")


def test_minmax(spark):
    cols = ["a", "b", "c"]
    for scaled in (blending.minmax_by_group(scores(spark), cols), blending.minmax_by_user(scores(spark), cols)):
        low, high = scaled.agg(F.least(*[F.min(c) for c in cols]), F.greatest(*[F.max(c) for c in cols])).first()
        assert (low, high) == (0.0, 1.0) and scaled.count() == 96
    flat = scores(spark).withColumn("a", F.lit(3.0))
    assert blending.minmax_by_group(flat, ["a"]).agg(F.max("a")).first()[0] == 0.0
    assert blending.minmax_by_user(flat, ["a"]).agg(F.max("a")).first()[0] == 0.0


def test_weight_grid():
    grid = blending.weight_grid(0.1)
    assert len(grid) == 66 and grid[0] == (0.0, 0.0, 1.0) and grid[-1] == (1.0, 0.0, 0.0)
    assert all(sum(w) == pytest.approx(1.0) for w in grid)


def test_grid_search_agrees_with_single_blends(spark):
    cols, grid = ["a", "b", "c"], blending.weight_grid(0.25)
    table = {r.combo: r for r in blending.grid_search(scores(spark), cols, grid).collect()}
    assert len(table) == len(grid) == 15
    for i in (0, 3, 7, 14):
        one = metrics.evaluate_ranking(blending.blend(scores(spark), dict(zip(cols, grid[i]))), "blend").first()
        assert table[i].ndcg_10 == pytest.approx(one.ndcg_10) and table[i].hr_5 == pytest.approx(one.hr_5)
    components = {r.model: r for r in blending.component_metrics(scores(spark), cols).collect()}
    assert table[0].ndcg_10 == pytest.approx(components["c"].ndcg_10)
    best = blending.best_weights(blending.grid_search(scores(spark), cols, grid))
    won = blending.evaluate_blend(scores(spark), best, cols).first()
    assert won.ndcg_10 == pytest.approx(max(r.ndcg_10 for r in table.values()))


def test_two_stage(spark):
    rows = spark.createDataFrame([("r1", 1, 11), ("r2", 1, 99), ("r3", 2, 5), ("r4", 3, 7)],
                                 "row_key string, user_id long, item_id long")
    retrieved = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 4, 1)], "user_id long, item_id long, rank long")
    pool = retrieval.inject_truth(rows, retrieved, 3)
    got = {}
    for r in pool.collect():
        got.setdefault(r.row_id, []).append((r.position, r.item_id, r.is_truth))
    assert {k: sorted(v) for k, v in got.items()} == {
        "r1": [(1, 10, False), (2, 11, True), (3, 12, False)],
        "r2": [(1, 10, False), (2, 11, False), (3, 99, True)],
        "r3": [(1, 4, False), (2, 5, True)],
        "r4": [(1, 7, True)]}
    ranked = retrieval.rerank(pool, lambda df, out: df.withColumn(out, F.col("item_id") * 1.0))
    m = retrieval.two_stage_metrics(ranked, [1, 2]).first()
    assert m.recall == 0.25 and m.hr_1 == 0.75 and m.hr_2 == 1.0 and m.n == 4


def test_label_table(spark):
    table = stacking.holdout_label_table(scores(spark).where("not (row_id = 'g1' and cand_idx = 4)"), ["a"], 8)
    assert {r.row_id for r in table.where("not complete").collect()} == {"g1"}


def test_stack(spark):
    model = stacking.stack_fit(scores(spark), ["a", "b"], 2, 2)
    out = stacking.stack_predict(model, scores(spark), ["a", "b"])
    assert out.count() == 96 and out.where("stacked between 0 and 1").count() == 96
    weights = stacking.feature_importance(out, model, ["a", "b"])
    assert weights.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)


def test_reports(spark):
    rows = spark.createDataFrame([("a", "hr", 0.5), ("b", "hr", 0.4), ("c", "hr", 0.6), ("a", "ndcg", 0.3), ("b", "ndcg", 0.35),
                                  ("c", "ndcg", 0.3)], "model string, metric string, value double")
    board = {r.model: (r.hr, r.ndcg) for r in reports.model_leaderboard(rows, ["hr", "ndcg"]).collect()}
    assert board == {"a": (0.5, 0.3), "b": (0.4, 0.35), "c": (0.6, 0.3)}
    delta = {r.metric: r.delta for r in reports.delta_vs_best_baseline(rows, ["a", "b"]).collect()}
    assert delta == {"hr": pytest.approx(0.1), "ndcg": pytest.approx(-0.05)}
    assert {r.metric: r.gain_pct for r in reports.relative_gain(rows, "a", "b").collect()}["hr"] == pytest.approx(25.0)
    long = reports.metric_rows(spark.createDataFrame([(0.1, 0.2)], "hr double, ndcg double"), "m", ["hr", "ndcg"])
    assert long.count() == 2
    mixed = spark.createDataFrame([("a", 1.0, None, 0.5), ("b", None, 2.0, None)],
                                  "model string, rmse double, rmse_calibrated double, a double")
    assert {r.model: (r.rmse, r.a, r.mae) for r in reports.rating_leaderboard(mixed).collect()} == {
        "a": (1.0, 0.5, None), "b": (2.0, None, None)}
