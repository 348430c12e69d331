"""Total orders without a single sorting task.

A window without a partition, or over one hot key, sorts everything in one task.  Here rows are first
put in range buckets with literal bounds taken from a uniform sample; windows then run per bucket and
the (few) bucket totals are added up.  The bounds only balance the work: the result is exact whatever
they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SAMPLE_PER_BUCKET = 48


def bucket_count(df: DataFrame, buckets: int | None = None) -> int:
    if buckets:
        return buckets
    return max(2, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 256))


def range_bounds(df: DataFrame, order: list[str], buckets: int) -> list[tuple]:
    """Up to `buckets - 1` bounds that cut the rows of `df` in similar shares.

    The rows with the smallest hash of the order columns are a uniform sample; the driver gets at
    most 48 of them per bucket.
    """
    size = buckets * _SAMPLE_PER_BUCKET
    sample = (
        df.select(*order).orderBy(F.xxhash64(*order)).limit(size).distinct().orderBy(*order).collect()
    )
    step = len(sample) / buckets
    picked = [tuple(sample[int(step * i)]) for i in range(1, buckets)] if sample else []
    return [p for i, p in enumerate(picked) if i == 0 or p != picked[i - 1]]


def range_bucket(df: DataFrame, order: list[str], bounds: list[tuple]) -> Column:
    """The bucket number of a row: a balanced tree of comparisons with the bounds."""
    types = {f.name: f.dataType for f in df.schema.fields}
    key = F.struct(*[F.col(c) for c in order])

    def bound(values: tuple) -> Column:
        return F.struct(*[F.lit(v).cast(types[c]).alias(c) for c, v in zip(order, values)])

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < bound(bounds[middle]), tree(low, middle)).otherwise(tree(middle + 1, high))

    return tree(0, len(bounds))


def global_rank(df: DataFrame, order: list[str], name: str, buckets: int | None = None) -> DataFrame:
    """Add the 0-based position of each row in the order of `order` (unique) as `name`."""
    n = bucket_count(df, buckets)
    marked = df.withColumn("_bucket", range_bucket(df, order, range_bounds(df, order, n)))
    totals = marked.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # At most `n` rows: one per bucket.
    offsets = totals.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_bucket").orderBy(*order)
    return (
        marked.withColumn("_inside", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(name, (F.col("_before") + F.col("_inside") - 1).cast("long"))
        .drop("_bucket", "_inside", "_before")
    )


def previous_value(df: DataFrame, part: list[str], order: list[str], value: str, name: str,
                   buckets: int | None = None) -> DataFrame:
    """Add the `value` of the row before, per `part` in the order of `order` (unique within it).

    Works bucket by bucket; the first row of a bucket takes the last value of the bucket before.  No
    task gets more than about one bucket, even if one key holds most of the rows.
    """
    n = bucket_count(df, buckets)
    marked = df.withColumn("_bucket", range_bucket(df, order, range_bounds(df, order, n)))
    inside = Window.partitionBy(*part, "_bucket").orderBy(*order)
    lagged = marked.withColumn("_prev", F.lag(value).over(inside)).withColumn(
        "_first", F.row_number().over(inside) == 1)
    ends = marked.groupBy(*part, "_bucket").agg(
        F.max(F.struct(*order, F.col(value).alias("_end"))).getField("_end").alias("_end"))
    over_buckets = Window.partitionBy(*part).orderBy("_bucket")
    carried = ends.select(*part, "_bucket", F.lag("_end").over(over_buckets).alias("_carry"))
    return (
        lagged.join(carried, [*part, "_bucket"], "left")
        .withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev")))
        .drop("_bucket", "_prev", "_first", "_carry")
    )


def smallest_keys(df: DataFrame, key: Column, ranks: Callable[[int], list[int]],
                  small: int = 20_000) -> list[str | None]:
    """For each rank n, the n-th smallest value (from 1) of `key`, a column of 32 uniform hex digits.

    `ranks` makes the ranks from the number of rows; one below 1 gives None.  Counts per leading
    digits narrow the range four digits at a time until few rows are left, so the rows are never
    sorted.  The driver sees at most 65,536 counts and `small` keys at a time.
    """
    keyed = df.select(key.alias("_k"))
    known: dict[str, list[tuple[str, int]]] = {}

    def counts(prefix: str) -> list[tuple[str, int]]:
        if prefix not in known:
            rows = (keyed.where(F.col("_k").startswith(prefix)) if prefix else keyed).groupBy(
                F.substring("_k", 1, len(prefix) + 4).alias("p")).count().collect()
            known[prefix] = sorted((r["p"], r["count"]) for r in rows)
        return known[prefix]

    def find(left: int) -> str | None:
        prefix = ""
        while True:
            size = 0
            for p, size in counts(prefix):
                if left <= size:
                    prefix = p
                    break
                left -= size
            if size <= small or len(prefix) >= 32:
                return keyed.where(F.col("_k").startswith(prefix)).orderBy("_k").limit(left).collect()[-1]["_k"]

    total = sum(c for _, c in counts(""))
    return [find(min(r, total)) if r >= 1 and total else None for r in ranks(total)]
