"""Stacked and blended evaluation of several models on shared candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.operators import blending, metrics, stacking
from rankwell.operators.blending import Scorer
from rankwell.scratch import staged


@dataclass(frozen=True)
class EnsembleResult:
    metrics: DataFrame
    weights: DataFrame
    importance: DataFrame
    rating: DataFrame


def evaluate_ensemble(val: DataFrame, test: DataFrame, scorers: dict[str, Scorer], val_rows: DataFrame,
                      test_rows: DataFrame, step: float = 0.1) -> EnsembleResult:
    """Score both candidate tables with all models, then compare them, their best blend and a stack.

    The wide score tables are written once; everything after reads them.
    """
    names = list(scorers)
    val_scores = staged(blending.score_table(val, scorers), "val-scores")
    test_scores = staged(blending.score_table(test, scorers), "test-scores")

    grid = blending.weight_grid(step, len(names))
    results = staged(blending.grid_search(blending.minmax_by_group(val_scores, names), names, grid), "grid")
    best = blending.best_weights(results)
    blended = blending.evaluate_blend(blending.minmax_by_group(test_scores, names), best, names)

    model = stacking.stack_fit(blending.minmax_by_user(val_scores, names), names)
    stacked = lambda s: staged(stacking.stack_predict(model, blending.minmax_by_user(s, names), names), "stacked")
    val_stacked, test_stacked = stacked(val_scores), stacked(test_scores)

    one = lambda df, name: df.select(F.lit(name).alias("model"), *[c for c in df.columns if c != "model"])
    board = blending.component_metrics(test_scores, names).unionByName(one(blended, "blend")).unionByName(
        one(metrics.evaluate_ranking(test_stacked, "stacked"), "stack"))
    rating = metrics.calibrate_positives(val_stacked, val_rows, test_stacked, test_rows, "stacked")
    return EnsembleResult(board, best, stacking.feature_importance(test_scores, model, names), rating)
