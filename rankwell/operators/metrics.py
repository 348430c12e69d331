"""Ranking and rating metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwell.functions import scalars as S
from rankwell.operators.core import review_sample
from rankwell.operators.joins import attach_pair_rating, gathered, in_runs
from rankwell.scratch import staged

# Cut-offs of the ranking metrics.
CUTOFFS = [5, 10, 20]
TIES = ("optimistic", "pessimistic", "mean")


def _places_lost(score: Column, truth: Column, tie: str) -> Column:
    """By how many places one other candidate moves the positive down."""
    if tie not in TIES:
        raise ValueError(f"tie must be one of {TIES}")
    above = F.when(score > truth, 1.0)
    equal = {"optimistic": 0.0, "pessimistic": 1.0, "mean": 0.5}[tie]
    return above.when(score == truth, equal).otherwise(0.0)


def rank_of_positive(scored: DataFrame, score: str = "score", tie: str = "optimistic", group: str = "row_id",
                     by: list[str] = []) -> DataFrame:
    """0-based rank of candidate 0 in each group; `tie` says where equal scores put it.

    A group is one positive and its negatives, so it is small; one shuffle by group, of the lists of scores that
    lie together.
    """
    ranks = places_above(scored, [score], [*by, group], lambda s, t: _places_lost(s, t, tie), 0.0)
    return ranks.select(*by, group, F.col("_r0").alias("rank"))


def places_above(scored: DataFrame, columns: list[str], keys: list[str], lost: Callable[[Column, Column], Column], zero) -> DataFrame:
    """Per group the sum of `lost` of each negative's score and the positive's, from `zero`, for each score column as `_r0`,
    `_r1`, ..., and the number of negatives as `_n`."""
    runs = in_runs(scored.select(*keys, "cand_idx", *[F.col(c).alias(f"_s{i}") for i, c in enumerate(columns)]), keys)
    at = lambda i, test: F.transform(
        F.filter(F.arrays_zip("cand_idx", f"_s{i}"), lambda one: test(one["cand_idx"])), lambda one: one[f"_s{i}"])
    narrow = runs.select(*keys, F.size(F.filter("cand_idx", lambda x: x != 0)).alias("_n"), *[column for i in range(len(columns)) for column in (
        F.array_max(at(i, lambda x: x == 0)).alias(f"_t{i}"), at(i, lambda x: x != 0).alias(f"_s{i}"))])
    # Dealt before they are put together: a map side would only sort them.
    whole = narrow.repartition(*keys).groupBy(*keys).agg(F.sum("_n").alias("_n"), *[column for i in range(len(columns)) for column in (
        F.max(f"_t{i}").alias(f"_t{i}"), F.flatten(F.collect_list(f"_s{i}")).alias(f"_s{i}"))])
    total = lambda i, truth: F.aggregate(f"_s{i}", F.lit(zero), lambda done, s: done + lost(s, truth))
    return whole.select(*keys, "_n", *[total(i, F.col(f"_t{i}")).alias(f"_r{i}") for i in range(len(columns))])


def hit(rank: Column | str, k: int) -> Column:
    r = F.col(rank) if isinstance(rank, str) else rank
    return F.when(r < k, 1.0).otherwise(0.0)


def gain(rank: Column | str, k: int) -> Column:
    r = F.col(rank) if isinstance(rank, str) else rank
    return F.when(r < k, 1.0 / F.log2(r + 2)).otherwise(0.0)


def hit_ratio(ranks: DataFrame, k: int) -> DataFrame:
    return ranks.agg(F.avg(hit("rank", k)).alias(f"hr_{k}"))


def ndcg(ranks: DataFrame, k: int) -> DataFrame:
    return ranks.agg(F.avg(gain("rank", k)).alias(f"ndcg_{k}"))


def metric_columns(rank: Column | str = "rank", cutoffs: list[int] = CUTOFFS) -> list[Column]:
    return [F.avg(hit(rank, k)).alias(f"hr_{k}") for k in cutoffs] + [
        F.avg(gain(rank, k)).alias(f"ndcg_{k}") for k in cutoffs]


def evaluate_ranking(scored: DataFrame, score: str = "score", cutoffs: list[int] = CUTOFFS,
                     tie: str = "optimistic", by: list[str] = []) -> DataFrame:
    """Hit ratio and NDCG at all cut-offs, per value of `by` if given."""
    ranks = rank_of_positive(scored, score, tie, by=by)
    return ranks.groupBy(*by).agg(*metric_columns("rank", cutoffs), F.count("*").alias("n"))


def ranked_list(scored: DataFrame, score: str = "score", group: str = "row_id") -> DataFrame:
    """Candidates of each group in order of their score, earlier candidates first among equals."""
    order = Window.partitionBy(group).orderBy(F.desc(score), "cand_idx")
    return gathered(scored, group, [c for c in ("user_id",) if c in scored.columns]).withColumn("position", F.row_number().over(order).cast("long"))


def mean_pairwise_loss(pairs: DataFrame, positive: str = "pos_score", negative: str = "neg_score") -> DataFrame:
    return pairs.agg(F.avg(S.pairwise_loss(positive, negative)).alias("loss"), F.count("*").alias("n"))


def rating_errors(rows: DataFrame, predicted: str = "predicted", truth: str = "rating") -> DataFrame:
    """Root mean square error, mean absolute error and number of rows."""
    error = F.col(predicted) - F.col(truth)
    return rows.agg(F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"),
                    F.count("*").alias("n"))


def val_score_std(val: DataFrame, score: str = "score") -> DataFrame:
    """Spread of the scores, and a note if it is too small to fit a line."""
    spread = val.agg(F.stddev_pop(S.finite_or_zero(score)).alias("score_std"))
    flat = F.coalesce(F.col("score_std"), F.lit(0.0)) < 1e-10
    return spread.withColumn("note", F.when(flat, F.lit("scores near-constant")))


def fit_calibration(val: DataFrame, score: str = "score", truth: str = "rating") -> DataFrame:
    """Least squares line rating = a * score + b; constant scores give a = 0 and the mean rating."""
    used = val.select(S.finite_or_zero(score).alias("_s"), F.col(truth).alias("_y"))
    fitted = used.agg(
        F.regr_slope("_y", "_s").alias("_slope"), F.regr_intercept("_y", "_s").alias("_intercept"),
        F.stddev_pop("_s").alias("score_std"), F.avg("_y").alias("_mean"), F.count("*").alias("n"))
    flat = F.col("_slope").isNull() | (F.col("score_std") < 1e-10)
    return fitted.select(
        F.when(flat, F.lit(0.0)).otherwise(F.col("_slope")).alias("a"),
        F.when(flat, F.col("_mean")).otherwise(F.col("_intercept")).alias("b"), "score_std", "n")


def apply_calibration(rows: DataFrame, line: DataFrame, score: str = "score", out: str = "predicted") -> DataFrame:
    """Ratings within 1..5 from scores and a fitted line (one row, read as a scalar)."""
    fitted = rows.withColumn("_line", line.select(F.struct("a", "b")).scalar())
    return fitted.withColumn(out, S.clip(F.col("_line.a") * S.finite_or_zero(score) + F.col("_line.b"))).drop("_line")


def evaluate_calibrated(val: DataFrame, test: DataFrame, score: str = "score", truth: str = "rating") -> DataFrame:
    """Errors on `test` of the line fitted on `val`, with the line."""
    line = fit_calibration(val, score, truth)
    errors = rating_errors(apply_calibration(test, line, score), "predicted", truth)
    with_line = errors.withColumn("_line", line.select(F.struct("a", "b")).scalar())
    return with_line.select("rmse", "mae", "n", F.col("_line.a").alias("a"), F.col("_line.b").alias("b"))


def calibrate_positives(val: DataFrame, val_rows: DataFrame, test: DataFrame, test_rows: DataFrame,
                        score: str = "score") -> DataFrame:
    """As `evaluate_calibrated` on the positives of two candidate tables, with mean ratings per pair."""
    rated = lambda cand, rows: attach_pair_rating(
        cand.where(F.col("label") == 1).select("user_id", "item_id", score), rows).where(F.col("rating").isNotNull())
    return evaluate_calibrated(rated(val, val_rows), rated(test, test_rows), score)


def best_epoch(log: DataFrame, metric: str, patience: int, by: list[str] = []) -> DataFrame:
    """Per run: the first epoch with the best value, that value, and the epoch where patience runs out.

    Logs have one row per epoch, so a window per run is small.
    """
    order = Window.partitionBy(*by).orderBy("epoch")
    earlier = F.coalesce(F.max(metric).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    marked = log.withColumn("_gain", F.col(metric) > earlier)
    last_gain = F.max(F.when(F.col("_gain"), F.col("_n"))).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = marked.withColumn("_n", F.row_number().over(order))
    waited = numbered.withColumn("_stop", F.col("_n") - F.coalesce(last_gain, F.lit(0)) >= patience)
    stop = waited.withColumn("_stop_at", F.min(F.when(F.col("_stop"), F.col("epoch"))).over(Window.partitionBy(*by)))
    seen = stop.where(F.col("_stop_at").isNull() | (F.col("epoch") <= F.col("_stop_at")))
    best = F.max(F.struct(F.col(metric).alias("v"), (-F.col("_n")).alias("o"), F.col("epoch").alias("e")))
    return seen.groupBy(*by).agg(best["e"].alias("best_epoch"), best["v"].alias("best_value"),
                                 F.max("_stop_at").alias("stopped_at"))


def sampled_metric_check(scored: DataFrame, rows: DataFrame, n: int, key: str = "row_key", score: str = "score",
                         k: int = 10, seed: int = 42) -> DataFrame:
    """The hit ratio on a sample of `n` evaluated rows beside the one on all of them."""
    ranks = staged(rank_of_positive(scored, score), "ranks")
    picked = review_sample(rows, n, [key], seed).select(F.col(key).alias("row_id"))
    part = ranks.join(picked, "row_id", "left_semi").agg(F.avg(hit("rank", k)))
    full = ranks.agg(F.avg(hit("rank", k)).alias("hr_full"))
    both = full.withColumn("hr_sample", part.scalar())
    return both.withColumn("difference", F.abs(F.col("hr_full") - F.col("hr_sample")))
