"""Counts, distributions and other profiles of a review table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwell.functions import scalars as S
from rankwell.scratch import staged


def frequency_counts(df: DataFrame, key: str, out: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(out))


def _with_ids(approximate: bool) -> tuple[Column, Column]:
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return distinct("user_id").alias("n_users"), distinct("item_id").alias("n_items")


def dataset_stats(df: DataFrame, approximate: bool = False, extra: list[Column] = []) -> DataFrame:
    """One row: total and valid reviews, users, items, density, sparsity (%), reviews per user and item.

    `approximate` counts ids with a sketch, which avoids the shuffle of all ids; `extra` adds more
    aggregates to the same pass.
    """
    valid = S.is_valid_review("user_id", "item_id", "rating")
    total = df.withColumns({"_ok": valid, "user_id": F.when(valid, F.col("user_id")),
                            "item_id": F.when(valid, F.col("item_id"))})
    counted = total.agg(F.count("*").alias("n_total"), F.count_if("_ok").alias("n_valid"), *_with_ids(approximate),
                        *extra)
    cells = F.col("n_users").cast("double") * F.col("n_items")
    density = F.when(cells > 0, F.col("n_valid") / cells * 100).otherwise(F.lit(0.0))
    return counted.withColumns({
        "density": density,
        "sparsity": F.lit(100.0) - density,
        "per_user": F.coalesce(F.col("n_valid") / F.nullif(F.col("n_users"), F.lit(0)), F.lit(0.0)),
        "per_item": F.coalesce(F.col("n_valid") / F.nullif(F.col("n_items"), F.lit(0)), F.lit(0.0)),
    })


def stats_columns(value: Column | str, prefix: str = "") -> list[Column]:
    """Count, mean, population variance and deviation, minimum and maximum; zeros when there is no value."""
    v = F.col(value) if isinstance(value, str) else value
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [
        F.count(v).alias(f"{prefix}n"), zero(F.avg(v)).alias(f"{prefix}mean"),
        zero(F.var_pop(v)).alias(f"{prefix}var"), zero(F.stddev_pop(v)).alias(f"{prefix}std"),
        F.min(v).alias(f"{prefix}min"), F.max(v).alias(f"{prefix}max"),
    ]


def running_stats(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(*stats_columns(value))


def exact_median(df: DataFrame, value: str, approximate: bool = False) -> DataFrame:
    """The median, the mean of the two middle values for an even count; null without values.

    The range of the values is narrowed by counts per bucket until the wanted place is a single value, so
    nothing ever holds the distinct values: a step counts at most SPLITS buckets.  Not-a-number counts as
    the largest value.  `approximate` uses a bounded sketch instead.
    """
    if approximate:
        return df.agg(F.percentile_approx(value, 0.5).cast("double").alias("median"))
    # Written once, as every step reads them again.
    values = staged(df.select(F.col(value).cast("double").alias("v")).where("v is not null"), "values")
    n = values.count()
    middle = sorted({(n - 1) // 2, n // 2}) if n else []
    found = [_at_place(values, place) for place in middle]
    median = sum(found) / len(found) if found else None
    return df.sparkSession.range(1).select(F.lit(median).cast("double").alias("median"))


#: Buckets of a step of the selection; the driver gets a row per bucket.
SPLITS = 1_024


def _at_place(values: DataFrame, place: int) -> float:
    """The value at `place`, from 0, in the order of `values` (v)."""
    inf = float("inf")
    ends = values.groupBy(F.when(F.isnan("v"), 3).when(F.col("v") == inf, 2).when(F.col("v") == -inf, 0).otherwise(1).alias("k")).agg(
        F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("k").collect()
    for kind in ends:
        if place < kind["n"]:
            break
        place -= kind["n"]
    low, high = kind["low"], kind["high"]
    while low < high:
        # Halves, so that the width of the widest range does not overflow.
        part = F.floor((F.col("v") / 2 - low / 2) / ((high / 2 - low / 2) or 1.0) * SPLITS)
        buckets = values.where(F.col("v").between(low, high)).groupBy(F.least(part, F.lit(SPLITS - 1)).alias("b")).agg(
            F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("b").collect()
        if len(buckets) == 1 and (buckets[0]["low"], buckets[0]["high"]) == (low, high):
            # Too close for arithmetic: only neighbouring numbers are left, which are few.
            for row in values.where(F.col("v").between(low, high)).groupBy("v").count().orderBy("v").collect():
                if place < row["count"]:
                    return row["v"]
                place -= row["count"]
        for bucket in buckets:
            if place < bucket["n"]:
                break
            place -= bucket["n"]
        low, high = bucket["low"], bucket["high"]
    return low


def _share(n: str = "n", out: str = "pct") -> Column:
    """Percentage of all rows.  Only for tables with few rows, such as histograms."""
    return (F.col(n) * 100.0 / F.sum(n).over(Window.partitionBy())).alias(out)


def rating_histogram(df: DataFrame, rating: str = "rating") -> DataFrame:
    stars = df.where(F.col(rating).isNotNull()).groupBy(S.round_star(rating).alias("star"))
    return stars.agg(F.count("*").alias("n")).select("star", "n", _share())


def user_activity(df: DataFrame, key: str = "user_id") -> DataFrame:
    """Users per activity bucket with their share."""
    per_user = frequency_counts(df, key, "reviews")
    buckets = per_user.groupBy(S.activity_bucket("reviews").alias("bucket")).agg(F.count("*").alias("n"))
    return buckets.select("bucket", "n", _share())


def user_activity_summary(df: DataFrame, key: str = "user_id") -> DataFrame:
    """One row: users with exactly one review, with fewer than five, and the largest count."""
    return frequency_counts(df, key, "reviews").agg(
        F.count_if(F.col("reviews") == 1).alias("exactly_one"),
        F.count_if(F.col("reviews") < 5).alias("below_five"),
        F.max("reviews").alias("most"),
    )


def count_of_counts(df: DataFrame, key: str) -> DataFrame:
    """How many keys have each number of rows (`item_popularity_hist` for items)."""
    return frequency_counts(df, key, "reviews").groupBy("reviews").agg(F.count("*").alias("n"))


def _long(df: DataFrame, names: list[str], measures: list[str], key: str) -> DataFrame:
    """One aggregate row with `name__measure` columns as one row per name."""
    structs = F.array(*[
        F.struct(F.lit(n).alias(key), *[F.col(f"{n}__{m}").alias(m) for m in measures]) for n in names
    ])
    return df.select(F.inline(structs))


def aspect_coverage(df: DataFrame, aspects: list[str] = S.ASPECTS) -> DataFrame:
    """Per aspect: filled values, their share of all rows, and their mean; one pass over the table."""
    wide = []
    for a in aspects:
        wide += [F.count(a).alias(f"{a}__n"), (F.count(a) * 100.0 / F.count("*")).alias(f"{a}__pct"),
                 F.avg(a).alias(f"{a}__mean")]
    return _long(df.agg(*wide), aspects, ["n", "pct", "mean"], "aspect")


def aspect_summary(train: DataFrame, aspects: list[str] = S.VECTOR_ASPECTS) -> DataFrame:
    """Per aspect: mean, sample deviation and missing values."""
    wide = []
    for a in aspects:
        wide += [F.avg(a).alias(f"{a}__mean"), F.stddev_samp(a).alias(f"{a}__std"),
                 F.count_if(F.col(a).isNull()).alias(f"{a}__missing")]
    return _long(train.agg(*wide), aspects, ["mean", "std", "missing"], "aspect")


def _words(df: DataFrame, text: str) -> DataFrame:
    return df.where(F.length(text) > 0).select(S.word_count(text).alias("words"))


def text_length_stats(df: DataFrame, text: str = "text") -> DataFrame:
    return _words(df, text).agg(*stats_columns("words"))


def text_length_buckets(df: DataFrame, text: str = "text") -> DataFrame:
    grouped = _words(df, text).groupBy(S.length_bucket("words").alias("bucket"))
    return grouped.agg(F.count("*").alias("n")).select("bucket", "n", _share())


def reviews_per_year(df: DataFrame, date: str = "date") -> DataFrame:
    years = df.select(S.extract_year(date).alias("year")).where(F.col("year").isNotNull())
    return years.groupBy("year").agg(F.count("*").alias("n")).select("year", "n", _share())


def profile_report(df: DataFrame, words: str | None = None) -> DataFrame:
    """One row with the headline figures: sizes, medians, activity, rating and text length.

    `words` names a column that already has the word counts; otherwise `text` is counted.  Three
    passes: one for the totals and one each for the counts per user and per item, which arrive as
    small histograms.
    """
    filled = F.col(words) if words else F.when(F.length("text") > 0, S.word_count("text"))
    totals = dataset_stats(df, extra=[F.avg("rating").alias("mean_rating"), F.avg(filled).alias("mean_words")])
    median = F.percentile("reviews", F.lit(0.5), F.col("n")).alias("median")
    users = count_of_counts(df, "user_id").agg(F.struct(
        median, F.sum(F.when(F.col("reviews") < 5, F.col("n")).otherwise(0)).alias("below_five"),
        F.max("reviews").alias("most"))).scalar()
    items = count_of_counts(df, "item_id").agg(median).scalar()
    return totals.withColumn("_users", users).select(
        "n_total", "n_users", "n_items", "sparsity", "per_user", "per_item",
        F.col("_users.median").alias("median_per_user"), items.alias("median_per_item"),
        F.col("_users.below_five").alias("users_below_five"), F.col("_users.most").alias("most_per_user"),
        "mean_rating", "mean_words",
    )


def split_summary(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows, share of all rows, users and items of each split."""
    per = df.groupBy(split).agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"),
        F.count_distinct("item_id").alias("n_items"))
    return per.select(split, "n", _share(), "n_users", "n_items")


def per_entity_count_summary(df: DataFrame, key: str) -> DataFrame:
    """Fewest, median, mean and most rows per id of `key`."""
    counts = count_of_counts(df, key)
    return counts.agg(
        F.min("reviews").alias("least"),
        F.percentile("reviews", F.lit(0.5), F.col("n")).alias("median"),
        (F.sum(F.col("reviews") * F.col("n")) / F.sum("n")).alias("mean"),
        F.max("reviews").alias("most"),
    ).select(F.lit(key).alias("entity"), "*")


def tier_stats(meta: DataFrame, tiers: list[str], item: str = "item_id") -> DataFrame:
    """Per tier: distinct values, values with one item, their share, the largest value and its items."""
    values = meta.select(item, F.inline(F.array(*[
        F.struct(F.lit(t).alias("tier"), F.col(t).cast("string").alias("value")) for t in tiers
    ]))).where(F.col("value").isNotNull())
    sizes = values.groupBy("tier", "value").agg(F.count("*").alias("n"))
    top = F.max(F.struct(F.col("n"), F.col("value")))
    return sizes.groupBy("tier").agg(
        F.count("*").alias("n_values"), F.count_if(F.col("n") == 1).alias("n_single"),
        (F.count_if(F.col("n") == 1) * 100.0 / F.count("*")).alias("pct_single"),
        top["n"].alias("most_items"), top["value"].alias("top_value"),
    )


def top_items(df: DataFrame, n: int, key: str = "item_id") -> DataFrame:
    """The `n` most frequent items with their share of all rows; ties by id."""
    total = df.agg(F.count("*").alias("t"))
    counts = frequency_counts(df, key)
    first = counts.orderBy(F.desc("n"), key).limit(n)
    return first.select(key, "n", (F.col("n") * 100.0 / total.scalar()).alias("pct"))


def core_retention(raw: DataFrame, core: DataFrame) -> DataFrame:
    """Users, items and rows before and after, with the kept share in percent."""
    count = lambda d: d.agg(F.count("*").alias("rows"), F.count_distinct("user_id").alias("users"),
                            F.count_distinct("item_id").alias("items"))
    a, b = count(raw), count(core)
    names = ["rows", "users", "items"]
    side = a.select(F.inline(F.array(*[F.struct(F.lit(n).alias("what"), F.col(n).alias("raw")) for n in names])))
    other = b.select(F.inline(F.array(*[F.struct(F.lit(n).alias("what"), F.col(n).alias("kept")) for n in names])))
    return side.join(other, "what").select("what", "raw", "kept", (F.col("kept") * 100.0 / F.col("raw")).alias("pct"))
