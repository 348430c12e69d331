"""Joins and set operations on interactions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, AtomicType, StructField, StructType

from rankwell.scratch import staged

PAIR = ["user_id", "item_id"]
# A side is broadcast only below this many rows of a known width (two numbers: about 32 MB).
BROADCAST_ROWS = 1_000_000
# Bytes of one side's rows that `lookup_both` broadcasts at most, and that a cell of its grid gets of each side.
LOOKUP_BROADCAST, BLOCK_BYTES = 16 << 20, 128 << 20
# Rows of a few numbers each that are broadcast to spare many times as many rows a shuffle (about 160 MB in a task's process).
ITEM_BROADCAST_ROWS = 2_000_000


def small_side(df: DataFrame, rows: int | None) -> DataFrame:
    """Mark `df` for broadcast if its row count is known and small; otherwise the optimizer decides."""
    return F.broadcast(df) if rows is not None and rows <= BROADCAST_ROWS else df


def attach_ids(df: DataFrame, id_map: DataFrame, key: str, out: str) -> DataFrame:
    """Replace a string key by its dense id; rows without one are dropped."""
    return df.join(id_map.select(F.col("key").alias(key), F.col("id").alias(out)), key).drop(key)


def restrict_to_core(df: DataFrame, core: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """All rows whose user and item are both in the core."""
    users = core.select(user).distinct()
    items = core.select(item).distinct()
    return df.join(items, item, "left_semi").join(users, user, "left_semi").select(df.columns)


def attach_pair_rating(rows: DataFrame, ratings: DataFrame, out: str = "rating") -> DataFrame:
    """The mean rating of each row's (user, item) pair, null if there is none; keeps the row count."""
    means = ratings.groupBy(*PAIR).agg(F.avg("rating").alias(out))
    return rows.join(means, PAIR, "left")


def rows_in_train_pairs(rows: DataFrame, train: DataFrame) -> DataFrame:
    """Rows whose pair occurs in the training split; rows that are dealt by user stay where they are."""
    rows.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return rows.join(train.select(*PAIR).distinct().hint("shuffle_hash"), PAIR, "left_semi").select(rows.columns)


def exclude_seen(scored: DataFrame, history: DataFrame) -> DataFrame:
    """Drop the items a user already has."""
    return scored.join(history.select(*PAIR), PAIR, "left_anti").select(scored.columns)


def cold_start(test: DataFrame, train: DataFrame, key: str) -> DataFrame:
    """Distinct ids of the test split that the training split lacks."""
    return test.select(key).distinct().join(train.select(key), key, "left_anti")


def split_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Number of distinct pairs that two splits share."""
    return a.select(*PAIR).intersect(b.select(*PAIR)).agg(F.count("*").alias("n_shared"))


def union_splits(*splits: DataFrame) -> DataFrame:
    out = splits[0]
    for s in splits[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def expand_to_all_items(df: DataFrame, n: int, key: str = "item_id") -> DataFrame:
    """One row for each id 0..n-1, with nulls where `df` has none."""
    ids = df.sparkSession.range(n).select(F.col("id").alias(key))
    return ids.join(df, key, "left")


def row_bytes(df: DataFrame) -> int:
    """Bytes of a row of numbers and arrays of numbers, on average; `df` should be written already, as it is read."""
    arrays = [c for c, kind in df.dtypes if kind.startswith("array")]
    lengths = df.agg(F.count("*"), *[F.avg(F.greatest(F.size(c), F.lit(0))) for c in arrays]).first()[1:]
    return int(8 * sum(x or 0 for x in lengths)) + 24 * len(df.columns)


def lookup_both(pairs: DataFrame, users: DataFrame, items: DataFrame, widths: tuple[int, int], how: str = "left") -> DataFrame:
    """Add the columns of `users` (by user_id) and of `items` (by item_id) to each pair.

    `widths` are the bytes of a row of each side, which should be written already, as its rows are counted.
    Pairs are dealt to a grid of user blocks by item blocks and shuffled once.  A cell gets both its blocks
    whole, in memory, so a row of either side is sent once for each block of the other and never once for
    each pair, and nothing wide is shuffled or sorted.  Small sides are broadcast instead.
    """
    sizes = [df.count() * width for df, width in ((users, widths[0]), (items, widths[1]))]
    types = [dict(df.dtypes) for df in (pairs, users, items)]
    alike = types[0]["user_id"] == types[1]["user_id"] and types[0]["item_id"] == types[2]["item_id"]
    if not alike or min(sizes) <= LOOKUP_BROADCAST:  # hashes of different types differ
        ready = [F.broadcast(df) if size <= LOOKUP_BROADCAST else df for df, size in zip((users, items), sizes)]
        if sizes[0] <= sizes[1]:  # the broadcast first: what it adds is narrow, if only one is
            return pairs.join(ready[1], "item_id", how).join(ready[0], "user_id", how)
        return pairs.join(ready[0], "user_id", how).join(ready[1], "item_id", how)
    # Blocks of similar size, and cells for every core.
    tasks = 2 * pairs.sparkSession.sparkContext.defaultParallelism
    block = min(BLOCK_BYTES, math.sqrt(sizes[0] * float(sizes[1]) / tasks))
    return _in_cells(pairs, users, items, *(max(1, math.ceil(size / block)) for size in sizes), how)


def lookup_items(pairs: DataFrame, items: DataFrame, how: str = "left") -> DataFrame:
    """Add the columns of `items`, a few numbers by item_id, to each pair.

    Up to `ITEM_BROADCAST_ROWS` items are broadcast.  Candidates meet more of them in cells as in `lookup_both`.
    """
    items = staged(items, "item-side")
    n = items.count()
    if n <= ITEM_BROADCAST_ROWS:
        return pairs.join(F.broadcast(items), "item_id", how)
    if not _grouped(pairs) or dict(pairs.dtypes)["item_id"] != dict(items.dtypes)["item_id"]:
        return pairs.join(items, "item_id", how)
    n_items = math.ceil(n * row_bytes(items) / BLOCK_BYTES)
    tasks = 2 * pairs.sparkSession.sparkContext.defaultParallelism
    return _in_cells(pairs, None, items, math.ceil(tasks / n_items), n_items, how)


def _in_cells(pairs: DataFrame, users: DataFrame | None, items: DataFrame, n_users: int, n_items: int, how: str) -> DataFrame:
    """The lookup of `lookup_both` in `n_users` times `n_items` cells.  Candidates of a row that go to one cell are one row there."""
    # Both joins follow the deal by cell; otherwise each would deal by its own key again.
    pairs.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    parts = 3 * n_users * n_items  # more parts than cells, so that few parts get several
    of_user = F.pmod(F.xxhash64("user_id"), F.lit(n_users))
    of_item = F.pmod(F.xxhash64("item_id"), F.lit(n_items))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    rest = [c for c in pairs.columns if c not in GROUP]
    grouped = _grouped(pairs)
    if grouped:
        dealt = in_runs(pairs.withColumn("_block", of_item), GROUP, "_block").withColumn("_cell", of_user * n_items + F.col("_block")).drop("_block")
    else:
        dealt = pairs.withColumn("_cell", of_user * n_items + of_item)
    dealt = dealt.repartition(parts, "_cell")
    if users is not None:
        left = users.withColumn("_other", every(n_items)).withColumn("_cell", of_user * n_items + F.col("_other")).drop("_other")
        dealt = dealt.join(left.repartition(parts, "_cell").hint("shuffle_hash"), ["_cell", "user_id"], how)
    if grouped:
        dealt = dealt.select(*[c for c in dealt.columns if c not in rest], F.inline(F.arrays_zip(*rest)))
    right = items.withColumn("_other", every(n_users)).withColumn("_cell", F.col("_other") * n_items + of_item).drop("_other")
    return dealt.join(right.repartition(parts, "_cell").hint("shuffle_hash"), ["_cell", "item_id"], how).drop("_cell")


#: What the candidates of an evaluated row have in common.
GROUP = ["user_id", "row_id"]


def _grouped(pairs: DataFrame) -> bool:
    """Whether these are candidates, which lie row by row."""
    return set(GROUP) < set(pairs.columns) and all(isinstance(f.dataType, AtomicType) for f in pairs.schema.fields)


def in_runs(rows: DataFrame, keys: list[str], within: str | None = None) -> DataFrame:
    """Neighbouring rows of equal `keys` as one row, with the other columns as lists; rows stay in their tasks.

    With `within`, a column of numbers, a run is parted by its values.  Shuffled like this, rows send what they share
    once, however long it is.  A key may have any number of runs, so whoever reads them must add them up.
    """
    others = [f for f in rows.schema.fields if f.name not in keys and f.name != within]
    shared = [*keys, within] if within else keys
    schema = StructType([*[rows.schema[k] for k in shared], *[StructField(f.name, ArrayType(f.dataType)) for f in others]])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            first = np.zeros(batch.num_rows, bool)
            first[0] = True
            for key in keys:
                codes = batch.column(key).dictionary_encode("encode").indices.to_numpy()
                first[1:] |= codes[1:] != codes[:-1]
            if within:
                run, block = np.cumsum(first), batch.column(within).to_numpy()
                order = np.lexsort((block, run))
                run, block = run[order], block[order]
                first[1:] = (run[1:] != run[:-1]) | (block[1:] != block[:-1])
                batch = batch.take(pa.array(order))
            starts = np.flatnonzero(first)
            offsets = pa.array(np.append(starts, batch.num_rows), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k).take(pa.array(starts)) for k in shared],
                 *[pa.ListArray.from_arrays(offsets, batch.column(f.name)) for f in others]], schema.names)

    return rows.select(*shared, *[f.name for f in others]).mapInArrow(pack, schema)


def gathered(rows: DataFrame, key: str, shared: list[str] = []) -> DataFrame:
    """`rows` dealt by `key`, neighbouring ones of equal `key` and `shared` columns as one, so that these are sent once."""
    rest = [c for c in rows.columns if c not in (key, *shared)]
    if not rest or not all(isinstance(f.dataType, AtomicType) for f in rows.schema.fields):
        return rows.repartition(key)
    return in_runs(rows, [key, *shared]).repartition(key).select(key, *shared, F.inline(F.arrays_zip(*rest))).select(rows.columns)


def lookup_vectors(pairs: DataFrame, user_vectors: DataFrame, item_vectors: DataFrame) -> DataFrame:
    """Add the vectors of both sides of each pair (`user_vector`, `item_vector`); they are not shuffled with pairs."""
    users, items = staged(user_vectors, "user-vectors"), staged(item_vectors, "item-vectors")
    return lookup_both(pairs, users, items, (row_bytes(users), row_bytes(items)), "inner")


def cross_weights(scores: DataFrame, weights: list[tuple[float, ...]], columns: list[str]) -> DataFrame:
    """Every weight combination applied to every row, as `combo` and `blend`.

    The combinations are a short literal array that each row expands itself; nothing is shuffled.
    """
    grid = F.array(*[F.struct(*[F.lit(float(w)) for w in combo]) for combo in weights])
    kept = [c for c in scores.columns if c not in columns]
    # Computed per row before expanding, so that only the result is carried on.
    blends = F.transform(grid, lambda w: weighted_sum(columns, [w[f"col{i + 1}"] for i in range(len(columns))]))
    return scores.select(*kept, F.posexplode(blends).alias("combo", "blend"))


def weighted_sum(columns: list[str], weights: list[Column]) -> Column:
    total = weights[0] * F.col(columns[0])
    for c, w in zip(columns[1:], weights[1:]):
        total = total + w * F.col(c)
    return total
