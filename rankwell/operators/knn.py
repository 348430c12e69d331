"""Item-based nearest neighbours with exact cosine similarity.

Dot products of item columns are computed tile by tile.  Items are cut in tiles of bounded size; a
user's items in one tile are one bounded list; a task multiplies the lists of two tiles and sends on
one number per item pair.  A user with d items thus adds at most (number of tiles)^2 rows to the
shuffle instead of d^2, and no group holds all users.  Tile pairs reach a task in order: those with
few products are summed together and sparsely, those with many in a dense block each, so the work
follows the products and not the number of items.

Where most item pairs share no user at all, tiles would hold one or two items of a user each.  Then items are
cut in parts instead, and a user's whole list goes to the parts of its items: a task finds all
that goes with the items of its parts, with nothing left to be added up or ranked after it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankwell.operators.core import dedupe_pairs_mean, sum_pairs
from rankwell.operators.joins import in_runs, lookup_both, small_side
from rankwell.functions import scalars as S
from rankwell.scratch import staged

# Items per tile: a block of 1024 x 1024 sums takes 8 MB in a task.
TILE = 1024
# Users per group: more users make more partial sums of the same item pair.
USERS_PER_GROUP = 100_000
# A user's tiles that meet all its tiles in one task; a user in more tiles is dealt to several.
TILES_TOGETHER = 64
# Products, of both orders, per possible item pair from which on tiles are taken.
DENSE = 4
# Products of the items of a part: a task holds at most so many sums, of one part at a time.
PART_PRODUCTS = 4_000_000
# Users of more items than this are cut in lists of about that length.
LIST = 4096
# Products held at a time while they are summed.
_STEP = 1_000_000
# Item pairs per batch that leaves a task.
_OUT_ROWS = 200_000

_Sums = tuple[np.ndarray, np.ndarray, np.ndarray]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths, places, weights and norms of a column of item lists."""
    offsets, values = column.offsets.to_numpy(), column.flatten()
    fields = [values.field(name).to_numpy(zero_copy_only=False) for name in ("local", "weight", "norm")]
    return offsets[:-1] - offsets[0], np.diff(offsets), *fields


def _added(*parts: _Sums) -> _Sums:
    """Keys in order with their sums; the norms of a key are the same wherever it occurs."""
    keys, sums, norms = (np.concatenate(column) for column in zip(*parts))
    if not len(keys):
        return keys, sums, norms
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(sums[order], first), norms[order][first]


def _cell_sums(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[_Sums]:
    """Sums of the products of two list columns per cell of each tile pair, with the product of both norms.

    Batches are in order of `pair`.  A key is pair * width^2 + cell and is given once.
    """
    size = width * width
    held: _Sums = (np.empty(0, "int64"), np.empty(0), np.empty(0))
    block, at, norm_a, norm_b = None, -1, np.ones(width), np.ones(width)

    def closed() -> _Sums:
        found = np.flatnonzero(block)
        return _added(held, (at * size + found, block[found], norm_a[found // width] * norm_b[found % width]))

    for batch in batches:
        if not batch.num_rows:
            continue
        pair = batch.column("pair").to_numpy()
        start_a, len_a, local_a, weight_a, root_a = _lists(batch.column("a"))
        start_b, len_b, local_b, weight_b, root_b = _lists(batch.column("b"))
        products = len_a.astype("int64") * len_b
        ends = np.cumsum(products)
        # Runs of one tile pair with many products are taken alone, those with few together.
        runs = np.flatnonzero(np.diff(pair, prepend=-1))
        heavy = np.add.reduceat(products, runs) * 8 >= size
        alone = heavy | np.concatenate([[True], heavy[:-1]])
        cuts = np.append(runs[alone], len(pair))
        for row, stop, dense in zip(cuts[:-1], cuts[1:], heavy[alone]):
            if block is not None and not (dense and pair[row] == at):
                held, block = closed(), None
            if dense and block is None:
                block, at = np.zeros(size), int(pair[row])
            while row < stop:
                base = ends[row] - products[row]
                upto = min(stop, max(row + 1, int(np.searchsorted(ends, base + _STEP, side="right"))))
                rows = np.repeat(np.arange(row, upto), products[row:upto])
                within = np.arange(len(rows)) - np.repeat(ends[row:upto] - products[row:upto] - base, products[row:upto])
                left, right = start_a[rows] + within // len_b[rows], start_b[rows] + within % len_b[rows]
                cells = local_a[left] * width + local_b[right]
                weights = weight_a[left] * weight_b[right]
                if dense:
                    norm_a[local_a[left]], norm_b[local_b[right]] = root_a[left], root_b[right]
                    if len(cells) * 8 < size:
                        np.add.at(block, cells, weights)
                    else:
                        block += np.bincount(cells, weights, minlength=size)
                else:
                    held = _added(held, (pair[rows] * size + cells, weights, root_a[left] * root_b[right]))
                    done = np.searchsorted(held[0], pair[upto - 1] * size)
                    yield tuple(column[:done] for column in held)
                    held = tuple(column[done:] for column in held)
                row = upto
    yield closed() if block is not None else held


def _best(owner: np.ndarray, other: np.ndarray, sim: np.ndarray, near: np.ndarray, k: int) -> pa.RecordBatch:
    """The `k` best rows of each owner."""
    order = np.lexsort((other, -near, owner))
    owner = owner[order]
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    rank = np.arange(len(owner)) - np.repeat(starts, np.diff(np.append(starts, len(owner))))
    kept = order[rank < k]
    return pa.RecordBatch.from_arrays(
        [pa.array(column) for column in (owner[rank < k], other[kept], sim[kept], near[kept])],
        ["item_id", "neighbour", "sim", "near"])


def _tile_lists(cells: DataFrame, tiles: int) -> DataFrame:
    """Each user's items of each tile as one list, at most a tile long."""
    return cells.groupBy("user_id", (F.col("item_id") % tiles).cast("long").alias("tile")).agg(
        F.collect_list(F.struct(F.floor(F.col("item_id") / tiles).cast("long").alias("local"), "weight", "norm")).alias("items"))


def _meetings(listed: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Both sides of the join of a user's tiles with each other, on (user_id, salt), and the number of products.

    A user in many tiles gets a salt per `TILES_TOGETHER` of them: its tiles are dealt to the salts on
    the left and repeated for each salt on the right, so one task joins a bounded number of them to all.
    """
    users = listed.groupBy("user_id").agg(F.count("*").alias("_tiles"), F.sum(F.size("items")).cast("double").alias("_items"))
    products, n_wide = users.agg(
        F.sum(F.col("_items") * F.col("_items") / 2), F.count_if(F.col("_tiles") > TILES_TOGETHER)).first()
    salts = F.lit(1)
    if n_wide:
        wide = users.where(F.col("_tiles") > TILES_TOGETHER).select(
            "user_id", F.ceil(F.col("_tiles") / TILES_TOGETHER).cast("int").alias("_salts"))
        listed = listed.join(small_side(wide, n_wide), "user_id", "left")
        salts = F.coalesce("_salts", F.lit(1))
    left = listed.select("user_id", F.pmod(F.xxhash64("tile"), salts).cast("int").alias("salt"),
                         F.col("tile").alias("ta"), F.col("items").alias("a"))
    right = listed.select("user_id", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"),
                          F.col("tile").alias("tb"), F.col("items").alias("b"))
    return left, right, int(products or 0)


def _tiling(cells: DataFrame, tile: int, users_per_group: int) -> tuple[int, int, int]:
    """Number of tiles, items in a tile, and groups of users; no tiles if there is no row."""
    n_items, n_users = cells.agg(F.max("item_id") + 1, F.approx_count_distinct("user_id")).first()
    if not n_items:
        return 0, 0, 0
    # Enough tile pairs for every core, with at least 64 items in a tile.
    cores = cells.sparkSession.sparkContext.defaultParallelism
    tiles = max(-(-n_items // tile), min(math.isqrt(2 * cores) + 1, -(-n_items // 64)))
    return tiles, -(-n_items // tiles), -(-n_users // users_per_group)


def _tile_products(cells: DataFrame, tiles: int, width: int, groups: int, k: int | None) -> DataFrame:
    """(item_a < item_b, dot) per group of users, or with `k` (item_id, neighbour, sim, near) with the best in each task.

    `near` is the similarity to nine digits, by which rows are ordered.
    """
    left, right, products = _meetings(staged(_tile_lists(cells, tiles), "tiles"))
    joined = left.join(right, ["user_id", "salt"]).where("ta <= tb").select(
        (F.col("ta") * tiles + F.col("tb")).alias("pair"),
        F.pmod(F.xxhash64("user_id"), F.lit(groups)).cast("int").alias("part"), "a", "b")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = width * width
        for found in _cell_sums(batches, width):
            for at in range(0, len(found[0]), _OUT_ROWS):
                keys, sums, norms = (column[at:at + _OUT_ROWS] for column in found)
                pair, cell = keys // size, keys % size
                a, b = cell // width * tiles + pair // tiles, cell % width * tiles + pair % tiles
                # Within one tile both orders of a pair were made.
                once = (sums != 0) & ((pair // tiles != pair % tiles) | (a < b))
                a, b, sums, norms = a[once], b[once], sums[once], norms[once]
                if k is None:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(sums)], ["item_a", "item_b", "dot"])
                    continue
                sim = sums / norms
                a, b, sim = a[sim > 0], b[sim > 0], sim[sim > 0]
                near = np.round(sim, 9)
                yield _best(np.concatenate([a, b]), np.concatenate([b, a]), np.tile(sim, 2), np.tile(near, 2), k)

    cores = cells.sparkSession.sparkContext.defaultParallelism
    n_tasks = max(1, min(tiles * (tiles + 1) // 2 * groups, max(2 * cores, min(products // _STEP, 16 * cores))))
    columns = "item_a long, item_b long, dot double" if k is None else "item_id long, neighbour long, sim double, near double"
    return joined.repartition(n_tasks, "pair", "part").sortWithinPartitions("pair").drop("part").mapInArrow(multiply, columns)


def _part_lists(cells: DataFrame, n_items: int, parts: int, n_wide: int, sizes: DataFrame, exact: bool) -> DataFrame:
    """(part, n_own, ids, weights, squares): each user's items once for every part that holds one of them.

    `n_own` is 0 where the list holds the user's items of the part itself.  A user in more than `LIST` items is
    cut in several lists; each part gets all of them, with the `n_own` items of the part in front.
    """
    number = "float" if exact else "double"
    cells = cells.select("user_id", F.struct(
        F.col("item_id").cast("int" if n_items < 1 << 31 else "long").alias("id"),
        F.col("weight").cast(number).alias("weight"), F.col("square").cast(number).alias("square")).alias("one"))
    columns = [F.col(f"all.{field}").alias(name) for field, name in (("id", "ids"), ("weight", "weights"), ("square", "squares"))]
    part = lambda one: (one["id"] % parts).cast("int")
    wide = sizes.where(F.col("_n") > LIST)
    narrow = cells.join(small_side(wide, n_wide), "user_id", "left_anti") if n_wide else cells
    lists = narrow.groupBy("user_id").agg(F.collect_list("one").alias("all")).select(
        F.explode(F.array_distinct(F.transform("all", part))).alias("part"), F.lit(0).alias("n_own"), "all")
    if n_wide:
        lines = cells.join(small_side(wide, n_wide), "user_id")
        owned = lines.groupBy("user_id", part(F.col("one")).alias("part")).agg(F.collect_list("one").alias("own"))
        cut = lines.groupBy("user_id", F.pmod(F.hash("one.id"), F.ceil(F.col("_n") / LIST)).alias("_cut")).agg(
            F.collect_list("one").alias("rest"))
        lists = lists.unionByName(owned.join(cut, "user_id").select("part", F.size("own").alias("n_own"), F.concat("own", "rest").alias("all")))
    return lists.select("part", "n_own", *columns)


def _part_sums(batches: Iterator[pa.RecordBatch], n_items: int, parts: int, once: bool) -> Iterator[_Sums]:
    """Sums of the products of each part's items with all others, with the product of both norms.

    Batches are in order of `part`.  A key is item * n_items + other item and is given once, in order within
    its part; with `once` only pairs whose first item is the smaller one.
    """
    held: _Sums = (np.empty(0, "int64"), np.empty(0), np.empty(0))
    pending: list[_Sums] = []
    waiting, at = 0, -1
    for batch in batches:
        if not batch.num_rows:
            continue
        part, n_own = (batch.column(name).to_numpy() for name in ("part", "n_own"))
        offsets = batch.column("ids").offsets.to_numpy()
        ids, weight, square = (batch.column(name).flatten().to_numpy(zero_copy_only=False) for name in ("ids", "weights", "squares"))
        ids, weight, norm = ids.astype("int64"), weight.astype(float), np.sqrt(square.astype(float))
        begin, size = offsets[:-1].astype("int64") - offsets[0], np.diff(offsets).astype("int64")
        row = np.repeat(np.arange(len(part)), size)
        place = np.arange(len(ids)) - begin[row]
        own = np.flatnonzero(np.where(n_own[row] == 0, ids % parts == part[row], place < n_own[row]))
        row = row[own]
        begin, size = (begin + n_own)[row], (size - n_own)[row]
        ends = np.cumsum(size)
        cuts = np.append(np.flatnonzero(np.diff(part[row], prepend=-1)), len(row))
        for first, stop in zip(cuts[:-1], cuts[1:]):
            if part[row[first]] != at:
                if at >= 0:
                    yield _added(held, *pending)
                held, pending, waiting, at = tuple(column[:0] for column in held), [], 0, part[row[first]]
            while first < stop:
                base = ends[first] - size[first]
                upto = min(stop, max(first + 1, int(np.searchsorted(ends, base + _STEP, side="right"))))
                left = np.repeat(own[first:upto], size[first:upto])
                right = np.arange(len(left)) + np.repeat(begin[first:upto] - (ends[first:upto] - size[first:upto] - base), size[first:upto])
                a, b = ids[left], ids[right]
                wanted = a < b if once else a != b
                left, right = left[wanted], right[wanted]
                pending.append((a[wanted] * n_items + b[wanted], weight[left] * weight[right], norm[left] * norm[right]))
                waiting += len(left)
                if waiting >= max(_STEP, len(held[0])):
                    held, pending, waiting = _added(held, *pending), [], 0
                first = upto
    yield _added(held, *pending)


def _part_products(cells: DataFrame, n_items: int, k: int | None) -> DataFrame | None:
    """(item_a < item_b, dot), or with `k` (item_id, neighbour, sim, rank) of the best; None where tiles do better.

    Every pair is given once, with all users in its sum.
    """
    cores = cells.sparkSession.sparkContext.defaultParallelism
    sizes = staged(cells.groupBy("user_id").agg(F.count("*").alias("_n")), "list-sizes")
    products, n_wide = sizes.agg(F.sum(F.col("_n").cast("double") * F.col("_n")), F.count_if(F.col("_n") > LIST)).first()
    if products >= DENSE * float(n_items) * n_items:
        return None
    inexact = lambda c: F.count_if(F.col(c) != F.col(c).cast("float").cast("double"))
    exact = not any(cells.agg(inexact("weight"), inexact("square")).first())
    parts = max(1, min(n_items, max(2 * cores, math.ceil(products / PART_PRODUCTS))))
    lists = _part_lists(cells, n_items, parts, n_wide, sizes, exact)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sums, norms in _part_sums(batches, n_items, parts, k is None):
            some = np.flatnonzero(sums != 0)
            keys, sums, norms = keys[some], sums[some], norms[some]
            if k is not None:
                sim = sums / norms
                some = np.flatnonzero(sim > 0)
                keys, sums, near = keys[some], sim[some], np.round(sim[some], 9)
                owner = keys // n_items
                # Stable: rows come in order of the neighbour, which decides ties.
                order = np.lexsort((-near, owner))
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                rank = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner)))) + 1
                some = rank <= k
                keys, sums, rank = keys[order[some]], sums[order[some]], rank[some]
            for at in range(0, len(keys), _OUT_ROWS):
                out = [column[at:at + _OUT_ROWS] for column in (keys // n_items, keys % n_items, sums)]
                if k is None:
                    yield pa.RecordBatch.from_arrays([pa.array(column) for column in out], ["item_a", "item_b", "dot"])
                else:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(column) for column in (*out, rank[at:at + _OUT_ROWS])], ["item_id", "neighbour", "sim", "rank"])

    columns = "item_a long, item_b long, dot double" if k is None else "item_id long, neighbour long, sim double, rank long"
    return lists.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(multiply, columns)


def item_cooccurrence(pairs: DataFrame, weight: str | None = None, tile: int = TILE,
                      users_per_group: int = USERS_PER_GROUP) -> DataFrame:
    """Item pairs that share a user: (item_a < item_b, dot), the sum over users of the weights' products.

    `pairs` has distinct (user_id, item_id) and dense item ids.  Without `weight` the sum counts the
    shared users.  All pairs are found, whatever the number of items of a user.
    """
    value = F.col(weight).cast("double") if weight else F.lit(1.0)
    cells = staged(pairs.select("user_id", "item_id", value.alias("weight"), F.lit(1.0).alias("norm"), F.lit(1.0).alias("square")).where(
        F.col("user_id").isNotNull() & F.col("item_id").isNotNull()), "cells")
    tiles, width, groups = _tiling(cells, tile, users_per_group)
    if not tiles:
        return pairs.sparkSession.createDataFrame([], "item_a long, item_b long, dot double")
    found = _part_products(cells, cells.agg(F.max("item_id")).first()[0] + 1, None)
    if found is not None:
        return found
    sums = _tile_products(cells, tiles, width, groups, None)
    if groups == 1:
        return sums
    return sums.groupBy("item_a", "item_b").agg(F.sum("dot").alias("dot"))


def _item_norms(pairs: DataFrame) -> DataFrame:
    squares = F.sum(F.col("rating") * F.col("rating")).cast("double")
    norms = staged(pairs.groupBy("item_id").agg(squares.alias("square")).withColumn("norm", F.sqrt("square")), "norms")
    return small_side(norms, norms.count())


def item_cosine(pairs: DataFrame, tile: int = TILE, users_per_group: int = USERS_PER_GROUP) -> DataFrame:
    """Cosine of each item pair's rating columns: (item_a < item_b, sim).  `pairs` is summed per pair."""
    sized = _item_norms(pairs)
    dots = item_cooccurrence(pairs, "rating", tile, users_per_group)
    a = sized.select(F.col("item_id").alias("item_a"), F.col("norm").alias("_a"))
    b = sized.select(F.col("item_id").alias("item_b"), F.col("norm").alias("_b"))
    return dots.join(a, "item_a").join(b, "item_b").select(
        "item_a", "item_b", (F.col("dot") / (F.col("_a") * F.col("_b"))).alias("sim"))


def topk_neighbours(sims: DataFrame, k: int = 20) -> DataFrame:
    """The `k` most similar items of each item with a positive similarity: (item_id, neighbour, sim, rank).

    Similarities that agree to nine digits are ties, which go to the smaller id.  The limit is applied
    before the shuffle as well as after it.
    """
    mirrored = sims.where(F.col("sim") > 0).select(F.inline(F.array(
        F.struct(F.col("item_a").alias("item_id"), F.col("item_b").alias("neighbour"), "sim"),
        F.struct(F.col("item_b").alias("item_id"), F.col("item_a").alias("neighbour"), "sim"),
    )))
    best = Window.partitionBy("item_id").orderBy(F.round("sim", 9).desc(), "neighbour")
    return mirrored.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)


def nearest_items(pairs: DataFrame, k: int = 20, tile: int = TILE, users_per_group: int = USERS_PER_GROUP) -> DataFrame:
    """`topk_neighbours` of `item_cosine`, without the list of all pairs.

    In parts, a task has all neighbours of its items and ranks them.  In tiles, where one task sums all of an
    item pair, similarities are divided there and an item's best `k` of
    those at hand leave it.  With more groups of users the sums have to be added up first.
    """
    # Every rating finds its item's norm, so norms that are all zero divide nothing: such products are dropped.
    cells = staged(pairs.where(F.col("user_id").isNotNull()).join(_item_norms(pairs), "item_id").select(
        "user_id", "item_id", F.col("rating").cast("double").alias("weight"), "norm", "square"), "cells")
    tiles, width, groups = _tiling(cells, tile, users_per_group)
    if tiles:
        found = _part_products(cells, cells.agg(F.max("item_id")).first()[0] + 1, k)
        if found is not None:
            return found
    if groups != 1:
        return topk_neighbours(item_cosine(pairs, tile, users_per_group), k)
    found = _tile_products(cells, tiles, width, groups, k)
    best = Window.partitionBy("item_id").orderBy(F.desc("near"), "neighbour")
    return found.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k).drop("near")


def itemknn_fit(train: DataFrame, k: int = 20, combine: str = "sum", tile: int = TILE,
                users_per_group: int = USERS_PER_GROUP) -> DataFrame:
    """Neighbour lists, written to the shared folder.

    Repeated ratings of a pair are added up, or averaged with `combine="mean"` (for rating prediction).
    """
    merged = sum_pairs(train) if combine == "sum" else dedupe_pairs_mean(train)
    return staged(nearest_items(staged(merged, "merged"), k, tile, users_per_group), "neighbours")


def _products(pairs: DataFrame, neighbours: DataFrame, history: DataFrame, per_row_work: str) -> DataFrame:
    """(user_id, item_id, sim, rating) for each pair's neighbours in the user's history.

    Two exact ways: from the history through the lists that contain its items, or from the wanted
    pairs through their own lists.  "auto" takes the one with fewer joined rows; an item that is in
    many histories and many lists makes the first one expensive, the second one is bounded by k rows
    per pair.
    """
    if per_row_work == "auto":
        via_history = (
            history.groupBy("item_id").agg(F.count("*").alias("_h"))
            .join(neighbours.groupBy(F.col("neighbour").alias("item_id")).agg(F.count("*").alias("_l")), "item_id")
            .agg(F.sum(F.col("_h").cast("double") * F.col("_l"))).first()[0] or 0.0
        )
        via_pairs = pairs.count() * float(neighbours.agg(F.max("rank")).first()[0] or 0)
        per_row_work = "history" if via_history <= via_pairs else "pairs"
    if per_row_work == "history":
        lists = neighbours.select("item_id", F.col("neighbour").alias("_j"), "sim")
        past = history.select("user_id", F.col("item_id").alias("_j"), "rating")
        return past.join(lists, "_j").select("user_id", "item_id", "sim", "rating")
    wanted = pairs.select("user_id", "item_id").distinct()
    past = history.select("user_id", F.col("item_id").alias("neighbour"), "rating")
    return wanted.join(neighbours.select("item_id", "neighbour", "sim"), "item_id").join(
        past, ["user_id", "neighbour"]).select("user_id", "item_id", "sim", "rating")


def itemknn_score(pairs: DataFrame, neighbours: DataFrame, history: DataFrame, weighted: bool = True,
                  out: str = "score", per_row_work: str = "auto") -> DataFrame:
    """Add the sum over the pair's neighbours in the user's history of similarity times (summed) rating.

    With `weighted` false the similarities alone are added up.  0 where there is no such neighbour.
    Scores are rounded to nine digits: the order of summation must not decide between equal ones.
    """
    # Lists are sent once per block of users: for few pairs that is more than their terms.
    if per_row_work == "auto" and pairs.count() > neighbours.count():
        return _score_by_lists(pairs, neighbours, history, weighted, out)
    return _score_by_terms(pairs, neighbours, history, weighted, out, per_row_work)


def _score_by_terms(pairs, neighbours, history, weighted, out, per_row_work) -> DataFrame:
    found = _products(pairs, neighbours, history, per_row_work)
    term = F.col("sim") * F.col("rating") if weighted else F.col("sim")
    scores = found.groupBy("user_id", "item_id").agg(F.round(F.sum(term), 9).alias(out))
    return pairs.join(scores, ["user_id", "item_id"], "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def _score_by_lists(pairs, neighbours, history, weighted, out) -> DataFrame:
    """Each pair with its user's history and its item's list beside it; no term is shuffled.

    Pairs of users or items with more than `LIST` entries go by terms.
    """
    value = (F.sum("rating") if weighted else F.count("*")).cast("double")
    merged = staged(history.where(F.col("user_id").isNotNull() & F.col("item_id").isNotNull()).groupBy("user_id", "item_id").agg(
        value.alias("weight")), "weights")
    lists = staged(neighbours.select("item_id", "neighbour", F.col("sim").cast("double").alias("sim")), "lists")
    long = lambda rows, key: staged(rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > LIST).select(key), "long-lists")
    long_users, long_items = long(merged, "user_id"), long(lists, "item_id")
    rest = None
    for rows, key in ((long_users, "user_id"), (long_items, "item_id")):
        if n := rows.count():
            few = small_side(rows, n)
            wide = pairs.join(few, key, "left_semi").select(pairs.columns)
            rest = wide if rest is None else rest.unionByName(wide)
            pairs = pairs.join(few, key, "left_anti").select(pairs.columns)
            if key == "user_id":
                merged = merged.join(few, key, "left_anti")
            else:
                lists = lists.join(few, key, "left_anti")
    # Histories in order of the item, so that equal ones are packed alike.
    users = staged(merged.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("item_id", "weight"))).alias("_past")).select(
        "user_id", F.col("_past.item_id").alias("_items"), F.col("_past.weight").alias("_weights")), "histories")
    items = staged(lists.groupBy("item_id").agg(F.collect_list(F.struct("neighbour", "sim")).alias("_list")).select(
        "item_id", F.col("_list.neighbour").alias("_near"), F.col("_list.sim").alias("_sims")), "item-lists")
    width = lambda rows, c: int(rows.agg(F.avg(F.size(c))).first()[0] or 0) * 16 + 60
    joined = lookup_both(pairs, users, items, (width(users, "_items"), width(items, "_near")))
    # The places of the list's items in the history, 0 where they are not in it.
    terms = F.zip_with(F.transform("_near", lambda j: F.array_position("_items", j)), F.col("_sims"), lambda at, sim: F.when(
        at > 0, sim * F.get(F.col("_weights"), (at - 1).cast("int"))))
    total = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    score = F.when(F.arrays_overlap("_near", "_items"), F.round(total, 9)).otherwise(0.0)
    scored = joined.select(*pairs.columns, score.alias(out))
    if rest is None:
        return scored
    return scored.unionByName(_score_by_terms(rest, neighbours, history, weighted, out, "auto").select(scored.columns))


def itemknn_rating(pairs: DataFrame, neighbours: DataFrame, train: DataFrame, out: str = "predicted",
                   per_row_work: str = "auto") -> DataFrame:
    """Add the similarity-weighted mean of the user's (mean) ratings of the neighbours, within 1..5.

    The mean rating of all training rows where there is no neighbour.
    """
    history = dedupe_pairs_mean(train)
    found = _products(pairs, neighbours, history, per_row_work)
    means = found.groupBy("user_id", "item_id").agg(
        (F.sum(F.col("sim") * F.col("rating")) / F.sum("sim")).alias("_mean"))
    overall = train.agg(F.avg("rating"))
    return pairs.join(means, ["user_id", "item_id"], "left").withColumn(
        out, S.clip(F.coalesce(F.col("_mean"), overall.scalar()))).drop("_mean")


def itemknn_recommend(users: DataFrame, neighbours: DataFrame, history: DataFrame, k: int = 10,
                      without_seen: bool = True, fill_from: int | None = None) -> DataFrame:
    """The `k` best items of each user: (user_id, item_id, score, rank), ties by id.

    Scores add up over the *history's* neighbour lists, so the work is k rows per interaction.  Items
    that score nothing fill lists that are too short, smallest ids first: those below `fill_from`, the
    number of items, which is taken from the neighbours and the history if it is not given; with 0 lists
    stay short.
    """
    if fill_from is None:
        ids = neighbours.select(F.greatest("item_id", "neighbour").alias("item_id")).unionByName(history.select("item_id"))
        fill_from = (ids.agg(F.max("item_id")).first()[0] or -1) + 1
    past = staged(history.join(users.select("user_id").distinct(), "user_id", "left_semi").select("user_id", "item_id", "rating"), "past")
    lists = neighbours.select("item_id", "neighbour", "sim")
    long = staged(past.groupBy("user_id").agg(F.count("*").alias("_n")).where(F.col("_n") > LIST).select("user_id"), "long-histories")
    n_long = long.count()
    scored = _sums_by_user(past.join(small_side(long, n_long), "user_id", "left_anti") if n_long else past, lists, without_seen)
    if n_long:
        scored = scored.unionByName(_sums_by_pair(past.join(small_side(long, n_long), "user_id", "left_semi"), lists, without_seen))
    best = Window.partitionBy("user_id").orderBy(F.desc("score"), "item_id")
    ranked = scored.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)
    return ranked if fill_from <= 0 else _filled(users, staged(ranked, "ranked"), past, lists, k, without_seen, fill_from)


def _sums_by_pair(past, lists, without_seen) -> DataFrame:
    """(user_id, item_id, score) with terms dealt by pair, so that a long history is added up in many tasks."""
    terms = past.join(lists, "item_id").select("user_id", F.col("neighbour").alias("item_id"), (F.col("sim") * F.col("rating")).alias("_term"),
                                               F.lit(False).alias("_seen"))
    if without_seen:  # known items meet the terms in the one shuffle that adds them up
        terms = terms.unionByName(past.select("user_id", "item_id", F.lit(None).cast("double").alias("_term"), F.lit(True).alias("_seen")))
    return _unseen_sums(terms)


def _unseen_sums(terms) -> DataFrame:
    return terms.groupBy("user_id", "item_id").agg(F.round(F.sum("_term"), 9).alias("score"), F.max("_seen").alias("_seen")).where(
        "not _seen").drop("_seen")


def _sums_by_user(past, lists, without_seen) -> DataFrame:
    """(user_id, item_id, score), dealt by user: an item's whole list is sent to each user that has it, and ranked where it is added up."""
    whole = in_runs(lists, ["item_id"]).repartition("item_id").groupBy("item_id").agg(
        F.flatten(F.collect_list(F.arrays_zip("neighbour", "sim"))).alias("_list"))
    sent = past.join(whole, "item_id").select(
        "user_id", F.col("_list.neighbour").alias("item_id"), F.transform("_list.sim", lambda sim: sim * F.col("rating")).alias("_term"),
        F.lit(False).alias("_seen"))
    if without_seen:
        kinds = dict(sent.dtypes)
        sent = sent.unionByName(past.select("user_id", F.array("item_id").cast(kinds["item_id"]).alias("item_id"),
                                            F.array(F.lit(None)).cast(kinds["_term"]).alias("_term"), F.lit(True).alias("_seen")))
    return _unseen_sums(sent.repartition("user_id").select("user_id", "_seen", F.inline(F.arrays_zip("item_id", "_term"))))


def _filled(users, ranked, past, lists, k, without_seen, n_items) -> DataFrame:
    """Short lists continued with unlisted items.

    Of the first (taken + k) ids at least k are free, so no more than those are looked at per user.
    """
    sizes = ranked.groupBy("user_id").agg(F.count("*").alias("_listed"))
    short = users.select("user_id").distinct().join(sizes, "user_id", "left").select(
        "user_id", F.coalesce("_listed", F.lit(0)).alias("_listed")).where(F.col("_listed") < k)
    short = staged(short, "short-lists")
    past = past.join(short.select("user_id"), "user_id", "left_semi")
    taken = past.join(lists, "item_id").select("user_id", F.col("neighbour").alias("item_id"))
    if without_seen:
        taken = taken.unionByName(past.select("user_id", "item_id"))
    taken = staged(taken.distinct(), "taken")
    counts = taken.groupBy("user_id").agg(F.count("*").alias("_taken"))
    upto = F.least(F.coalesce("_taken", F.lit(0)) + k, F.lit(n_items).cast("long")) - 1
    free = short.join(counts, "user_id", "left").select(
        "user_id", "_listed", F.explode(F.sequence(F.lit(0).cast("long"), upto)).alias("item_id")).join(
        taken, ["user_id", "item_id"], "left_anti")
    order = Window.partitionBy("user_id").orderBy("item_id")
    more = free.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).where(
        F.col("_listed") + F.col("_n") <= k)
    return ranked.unionByName(more.select(
        "user_id", "item_id", F.lit(0.0).alias("score"), (F.col("_listed") + F.col("_n")).cast("long").alias("rank")))
