"""Negative sampling, training triples and evaluation candidates.

Negatives are drawn uniformly, with replacement, from the items a user does not have.  Each draw is a
number r below the count of those items and is mapped to the r-th of them, so nothing is rejected and
drawn again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from rankwell.functions import scalars as S
from rankwell.functions.draws import draw_below, free_below
from rankwell.functions.vectors import dot, hadamard
from rankwell.operators.joins import lookup_vectors
from rankwell.scratch import staged

# Users with more items than this are looked up in a table instead of with one array per row.
ARRAY_LIMIT = 256
# Draws held at a time in a task.
_DRAWS = 1_000_000


def draw_unseen(rows: DataFrame, positives: DataFrame, n_items: int, first: int, last: int, seed: int,
                key: list[str], out: str = "neg_item", index: str = "draw",
                array_limit: int = ARRAY_LIMIT) -> DataFrame:
    """Expand each row into draws `first`..`last`, each with one item its user does not have.

    `positives` holds distinct (user_id, item_id) pairs.  Rows of users who have every item vanish.
    """
    sizes = staged(positives.groupBy("user_id").agg(F.count("*").alias("n_pos")), "n-positives")
    most = sizes.agg(F.max("n_pos")).first()[0] or 0
    args = (n_items, first, last, seed, key, out, index)
    if most <= array_limit:
        return _draw_with_array(rows, positives, *args)
    heavy = sizes.where(F.col("n_pos") > array_limit)
    light = _draw_with_array(rows.join(heavy, "user_id", "left_anti"),
                             positives.join(heavy, "user_id", "left_anti"), *args)
    return light.unionByName(_draw_by_blocks(rows.join(heavy, "user_id", "left_semi"),
                                             positives.join(heavy, "user_id", "left_semi"), *args))


def _spread(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows dealt out evenly before each is expanded: small partitions would be merged by their size before that."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, *key)


def _draw_with_array(rows, positives, n_items, first, last, seed, key, out, index) -> DataFrame:
    """One bounded array of taken items per user."""
    taken = positives.groupBy("user_id").agg(F.array_sort(F.collect_set("item_id")).alias("_seen"))
    none = F.array().cast("array<bigint>")
    joined = rows.join(taken.select("user_id", free_below(F.col("_seen")).alias("_free")), "user_id", "left").withColumn(
        "_free", F.coalesce("_free", none)).withColumn("_key", F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit("")))
    drawn = _spread(joined, key).mapInArrow(_drawer(rows.columns, n_items, first, last, seed), StructType(
        [*rows.schema.fields, StructField("_drawn", ArrayType(LongType()))]))
    return drawn.select(*rows.columns, F.posexplode("_drawn").alias("_at", out)).select(
        *rows.columns, (F.col("_at") + first).cast("long").alias(index), out)


def _drawer(columns: list[str], n_items: int, first: int, last: int, seed: int):
    """The items of `draw_below` and `unseen_item` for the draws of each row, as one list; empty if no item is free."""
    tails = [f"{draw}|{seed}".encode() for draw in range(first, last + 1)]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = max(1, _DRAWS // len(tails))
        for batch in (whole.slice(at, share) for whole in batches for at in range(0, whole.num_rows, share)):
            free, offsets = batch.column("_free").flatten().to_numpy(), batch.column("_free").offsets.to_numpy()
            begin, taken = offsets[:-1].astype("int64") - offsets[0], np.diff(offsets).astype("int64")
            some = np.flatnonzero(taken < n_items)
            digests = b"".join([md5(key.encode() + tail).digest()[:8] for key in batch.column("_key").take(pa.array(some)).to_pylist() for tail in tails])
            # The first 15 hex digits, 60 bits.
            number = (np.frombuffer(digests, ">u8") >> np.uint64(4)).astype("int64").reshape(len(some), len(tails))
            number %= (n_items - taken[some])[:, None]
            # Counts of free items are at most n_items, so rows lie one behind the other.
            stride = n_items + 1
            places = np.searchsorted(free + np.repeat(np.arange(len(taken)), taken) * stride, number + some[:, None] * stride, side="right")
            items = number + places - begin[some][:, None]
            ends = np.zeros(len(taken) + 1, "int32")
            ends[some + 1] = len(tails)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(ends), pa.int32()), pa.array(items.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(name) for name in columns], lists], [*columns, "_drawn"])

    return draw


def _draw_by_blocks(rows, positives, n_items, first, last, seed, key, out, index) -> DataFrame:
    """For users with very many items: a lookup table instead of an array per row.

    The table says, for each user and each stretch of about sqrt(n_items) draws, how many taken items
    come before it and which ones fall into it.  A draw finds its line by (user, stretch), so a user
    with very many rows is spread over as many keys, and no row carries an array through a shuffle.
    """
    width = max(1, math.isqrt(n_items))
    earlier = lambda order: Window.partitionBy("user_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    # How many free ids lie below each taken one: its id minus its place among the user's taken ids.
    blocks = positives.groupBy("user_id", F.floor(F.col("item_id") / width).alias("_block")).agg(
        F.array_sort(F.collect_set("item_id")).alias("_taken"))
    placed = staged(blocks.withColumn("_n", F.size("_taken").cast("long")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(earlier("_block")), F.lit(0))), "blocks")
    free = placed.select("user_id", "_before", F.posexplode("_taken").alias("_i", "_item")).select(
        "user_id", (F.col("_item") - F.col("_before") - F.col("_i")).alias("_f"))
    # Neighbouring taken ids have the same count; together they are one entry.
    runs = free.groupBy("user_id", "_f").agg(F.count("*").alias("_n"))
    lists = runs.groupBy("user_id", F.floor(F.col("_f") / width).alias("_stretch")).agg(
        F.array_sort(F.collect_list(F.struct("_f", "_n"))).alias("_runs"), F.sum("_n").alias("_in"))
    sizes = placed.groupBy("user_id").agg((F.lit(n_items) - F.sum("_n")).alias("_free"))
    stretches = sizes.where(F.col("_free") > 0).select("user_id", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("_free") - 1) / width))).alias("_stretch"))
    table = stretches.join(lists, ["user_id", "_stretch"], "left").select(
        "user_id", "_stretch", "_runs", F.coalesce(F.sum("_in").over(earlier("_stretch")), F.lit(0)).alias("_before"))

    draws = F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))
    drawn = _spread(rows.join(sizes, "user_id"), key).select(*rows.columns, "_free", F.explode(draws).alias(index)).withColumn(
        "_r", draw_below(F.col("_free"), *[F.col(k) for k in key], F.col(index), seed)).where(F.col("_r").isNotNull())
    here = F.aggregate(
        F.coalesce("_runs", F.array().cast("array<struct<_f:bigint,_n:bigint>>")), F.lit(0).cast("long"),
        lambda acc, run: acc + F.when(run["_f"] <= F.col("_r"), run["_n"]).otherwise(0))
    return drawn.withColumn("_stretch", F.floor(F.col("_r") / width)).join(table, ["user_id", "_stretch"]).select(
        *rows.columns, index, (F.col("_r") + F.col("_before") + here).cast("long").alias(out))


def bpr_triples(train: DataFrame, n_items: int, m: int = 1, seed: int = 42, key: str = "row_key",
                keep: list[str] = [], positives: DataFrame | None = None, array_limit: int = ARRAY_LIMIT) -> DataFrame:
    """`m` (user, positive, negative) rows per training row.

    Negatives avoid the user's training items, or those in `positives` if it is given.
    """
    taken = positives if positives is not None else train.select("user_id", "item_id").distinct()
    rows = train.select(key, "user_id", F.col("item_id").alias("pos_item"), *keep)
    return draw_unseen(rows, taken, n_items, 0, m - 1, seed, [key], array_limit=array_limit)


def rated_triples(train: DataFrame, n_items: int, m: int = 1, seed: int = 42, key: str = "row_key") -> DataFrame:
    """Triples with the positive's rating on 0..1 (1 star without a rating column)."""
    rated = train if "rating" in train.columns else train.withColumn("rating", F.lit(1.0))
    return bpr_triples(rated, n_items, m, seed, key, ["rating"]).withColumn("target", S.unit_scale("rating"))


def aspect_triples(train: DataFrame, n_items: int, m: int = 1, seed: int = 42, key: str = "row_key") -> DataFrame:
    """Triples with the positive's aspect vector."""
    vectors = train.withColumn("aspects", S.aspect_vector(S.VECTOR_ASPECTS, train.columns))
    return bpr_triples(vectors, n_items, m, seed, key, ["aspects"])


def eval_candidates(split: DataFrame, positives: DataFrame, n_items: int, n_negatives: int = 99, seed: int = 42,
                    key: str = "row_key", array_limit: int = ARRAY_LIMIT) -> DataFrame:
    """Per evaluated row its positive (`cand_idx` 0) and negatives outside all of the user's positives."""
    rows = split.select(F.col(key).alias("row_id"), "user_id", F.col("item_id").alias("_pos"))
    drawn = draw_unseen(rows, positives, n_items, 1, n_negatives, seed, ["row_id"], "item_id", "cand_idx", array_limit)
    truth = rows.select("row_id", "user_id", "_pos", F.lit(0).cast("long").alias("cand_idx"),
                        F.col("_pos").alias("item_id"))
    both = truth.unionByName(drawn)
    return both.select("row_id", "user_id", "item_id", "cand_idx",
                       F.when(F.col("cand_idx") == 0, 1).otherwise(0).cast("long").alias("label"))


def sequence_candidates(split: DataFrame, positives: DataFrame, sequences: DataFrame, n_items: int,
                        max_len: int, n_negatives: int = 99, seed: int = 42, key: str = "row_key") -> DataFrame:
    """Evaluation candidates plus the user's shifted and padded history; users without one are dropped.

    The history stays in a table of its own per user: join on `user_id` where both are needed.
    """
    from rankwell.operators.sequences import padded

    known = split.join(sequences, "user_id", "left_semi")
    pool = eval_candidates(known, positives, n_items, n_negatives, seed, key)
    return pool.join(padded(sequences, max_len), "user_id")


def first_negative_pairs(candidates: DataFrame) -> DataFrame:
    """The positive and the first negative of each group side by side."""
    pick = lambda i: F.max(F.when(F.col("cand_idx") == i, F.col("item_id")))
    pairs = candidates.where(F.col("cand_idx") <= 1).groupBy("row_id", "user_id").agg(
        pick(0).alias("pos_item"), pick(1).alias("neg_item"))
    return pairs.where(F.col("pos_item").isNotNull() & F.col("neg_item").isNotNull())


def pointwise_pairs(triples: DataFrame) -> DataFrame:
    """Triples as labelled rows: the positive with label 1, the negative with label 0."""
    key = [c for c in triples.columns if c not in ("pos_item", "neg_item")]
    return triples.select(*key, F.inline(F.array(
        F.struct(F.col("pos_item").alias("item_id"), F.lit(1.0).alias("label")),
        F.struct(F.col("neg_item").alias("item_id"), F.lit(0.0).alias("label")),
    )))


def pointwise_training_set(triples: DataFrame, user_vectors: DataFrame, item_vectors: DataFrame) -> DataFrame:
    """Labelled rows with the elementwise product and the dot product of the two sides' vectors."""
    joined = lookup_vectors(pointwise_pairs(triples), user_vectors, item_vectors)
    return joined.withColumn("product", hadamard("user_vector", "item_vector")).withColumn(
        "dot", dot("user_vector", "item_vector")).drop("user_vector", "item_vector")
