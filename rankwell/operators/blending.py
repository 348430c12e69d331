"""Score tables, normalisation, weighted blends and their grid search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwell.operators.joins import BROADCAST_ROWS, gathered, weighted_sum
from rankwell.operators.metrics import CUTOFFS, evaluate_ranking, gain, hit, places_above
from rankwell.scratch import staged

# A scorer adds a score column of the given name to (user_id, item_id) rows.
Scorer = Callable[[DataFrame, str], DataFrame]


def score_pairs(pairs: DataFrame, scorer: Scorer, out: str = "score") -> DataFrame:
    """The contract of every ranker: the rows of `pairs` with one more column."""
    return scorer(pairs, out)


def score_table(candidates: DataFrame, scorers: dict[str, Scorer]) -> DataFrame:
    """The candidates with one score column per model."""
    out = candidates
    for name, scorer in scorers.items():
        out = score_pairs(out, scorer, name)
    return out


def _scaled(c: str, low: Column, high: Column, smallest: float) -> Column:
    span = high - low
    return (F.col(c) - low) / F.when(span <= smallest, F.lit(1.0)).otherwise(span)


def minmax_by_group(scores: DataFrame, columns: list[str], group: str = "row_id") -> DataFrame:
    """Each column on 0..1 within its candidate group; ranges below 1e-8 count as 1."""
    w = Window.partitionBy(group)
    ends = {f"_{e}_{c}": f(c).over(w) for c in columns for e, f in (("lo", F.min), ("hi", F.max))}
    tiny = 1e-8 * (1 - 1e-15)
    return gathered(scores, group, [c for c in ("user_id",) if c in scores.columns]).withColumns(ends).withColumns(
        {c: _scaled(c, F.col(f"_lo_{c}"), F.col(f"_hi_{c}"), tiny) for c in columns}).drop(*ends)


def minmax_by_user(scores: DataFrame, columns: list[str], user: str = "user_id") -> DataFrame:
    """Each column on 0..1 over all groups of a user; an empty range counts as 1.

    The ends are partial aggregates joined back, so a user with very many rows is not sorted in one task.  Those of
    few users are broadcast, and no candidate is shuffled.
    """
    ends = staged(scores.groupBy(user).agg(*[f(c).alias(f"_{e}_{c}") for c in columns
                                             for e, f in (("lo", F.min), ("hi", F.max))]), "user-ends")
    if ends.count() <= BROADCAST_ROWS:
        joined = scores.join(F.broadcast(ends), user)
    else:
        joined = gathered(scores, user, [c for c in ("row_id",) if c in scores.columns]).join(ends, user)
    scaled = {c: _scaled(c, F.col(f"_lo_{c}"), F.col(f"_hi_{c}"), 0.0) for c in columns}
    return joined.withColumns(scaled).select(scores.columns)


def blend(scores: DataFrame, weights: dict[str, float], out: str = "blend") -> DataFrame:
    """Add the weighted sum of score columns."""
    return scores.withColumn(out, weighted_sum(list(weights), [F.lit(float(w)) for w in weights.values()]))


def weight_grid(step: float = 0.1, n: int = 3) -> list[tuple[float, ...]]:
    """All weight combinations that sum to 1, in ascending order; whole steps avoid drift."""
    parts = round(1 / step)

    def rest(left: int, slots: int) -> list[tuple[int, ...]]:
        if slots == 1:
            return [(left,)]
        return [(i, *r) for i in range(left + 1) for r in rest(left - i, slots - 1)]

    return [tuple(round(i / parts, 6) for i in combo) for combo in rest(parts, n)]


def grid_search(scores: DataFrame, columns: list[str], weights: list[tuple[float, ...]],
                cutoffs: list[int] = CUTOFFS) -> DataFrame:
    """Metrics of every weight combination, with the weights and `combo`, its place in the list.

    The positive's scores are put beside its negatives once, and each combination is one conditional
    count per group: the candidate rows are shuffled once, not once per combination.
    """
    w = Window.partitionBy("row_id")
    truths = {f"_t_{c}": F.max(F.when(F.col("cand_idx") == 0, F.col(c))).over(w) for c in columns}
    negatives = scores.select("row_id", "cand_idx", *columns).withColumns(truths).where(F.col("cand_idx") != 0)

    def places_lost(combo: tuple[float, ...]) -> Column:
        lit = [F.lit(float(x)) for x in combo]
        return F.sum(F.when(weighted_sum(columns, lit) > weighted_sum(list(truths), lit), 1).otherwise(0))

    ranks = negatives.groupBy("row_id").agg(*[places_lost(c).alias(f"_r{i}") for i, c in enumerate(weights)])
    per_combo = ranks.select(F.posexplode(F.array(*[F.col(f"_r{i}") for i in range(len(weights))])).alias("combo", "rank"))
    metrics = per_combo.groupBy("combo").agg(
        *[F.avg(hit("rank", k)).alias(f"hr_{k}") for k in cutoffs],
        *[F.avg(gain("rank", k)).alias(f"ndcg_{k}") for k in cutoffs])
    table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in weights])
    named = [F.element_at(F.element_at(table, F.col("combo") + 1), i + 1).alias(f"w_{c}") for i, c in enumerate(columns)]
    return metrics.select(F.col("combo").cast("long").alias("combo"), *named, *metrics.columns[1:])


def best_weights(results: DataFrame, metric: str = "ndcg_10") -> DataFrame:
    """The first combination with the best metric (to nine digits)."""
    return results.orderBy(F.round(metric, 9).desc(), "combo").limit(1)


def evaluate_blend(test: DataFrame, best: DataFrame, columns: list[str], cutoffs: list[int] = CUTOFFS) -> DataFrame:
    """Metrics on `test` of the winning combination (one row, read as a scalar)."""
    won = best.select(F.struct(*[F.col(f"w_{c}") for c in columns])).scalar()
    mixed = test.withColumn("_w", won).withColumn(
        "blend", weighted_sum(columns, [F.col(f"_w.w_{c}") for c in columns]))
    return evaluate_ranking(mixed, "blend", cutoffs)


def component_metrics(scores: DataFrame, columns: list[str], cutoffs: list[int] = CUTOFFS) -> DataFrame:
    """Each score column evaluated on the same candidates: one row per model, one shuffle for all."""
    above = lambda s, t: F.when(s > t, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    ranks = places_above(scores, columns, ["row_id"], above, F.lit(0).cast("long")).where(F.col("_n") > 0).select(
        *[F.col(f"_r{i}").alias(c) for i, c in enumerate(columns)])
    long = ranks.select(F.inline(F.array(*[F.struct(F.lit(c).alias("model"), F.col(c).alias("rank")) for c in columns])))
    return long.groupBy("model").agg(
        *[F.avg(hit("rank", k)).alias(f"hr_{k}") for k in cutoffs],
        *[F.avg(gain("rank", k)).alias(f"ndcg_{k}") for k in cutoffs], F.count("*").alias("n"))
