"""Raw reviews to a k-core with dense ids and splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.functions import scalars as S
from rankwell.operators import cleaning, core, joins
from rankwell.scratch import staged
from rankwell.sources import tables


@dataclass(frozen=True)
class Prepared:
    """Paths of the written tables."""

    interactions: str
    user_ids: str
    item_ids: str
    stats: str


def prepare(raw: DataFrame, out: str, k: int = 20, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1),
            seed: int = 42, if_present: str = "error") -> Prepared:
    """Clean, reduce to the k-core, number users and items, split, and write everything below `out`.

    The core is found on the two id columns alone; the wide rows are read once more for the survivors.
    """
    rows = cleaning.interactions(raw)
    narrow = rows.select(F.col("user_key").alias("user_id"), F.col("item_key").alias("item_id"))
    edges = core.kcore(narrow, k)
    user_ids = staged(core.build_id_map(edges, "user_id"), "user-ids")
    item_ids = staged(core.build_id_map(edges, "item_id"), "item-ids")
    # Inner joins with the id maps keep the rows of surviving users and items.
    kept = joins.attach_ids(joins.attach_ids(rows, item_ids, "item_key", "item_id"), user_ids, "user_key", "user_id")
    kept = cleaning.keep_existing(kept, ["user_id", "item_id", "rating", "text", "date", "title", *S.ASPECTS])
    keyed = staged(with_row_key(kept), "core-rows")
    labelled = core.random_split(keyed, ["row_key"], ratios, seed)
    paths = Prepared(f"{out}/interactions", f"{out}/user_ids", f"{out}/item_ids", f"{out}/stats")
    tables.write_table(labelled, paths.interactions, ["split"], if_present)
    tables.write_id_map(user_ids, paths.user_ids, if_present=if_present)
    tables.write_id_map(item_ids, paths.item_ids, if_present=if_present)
    tables.write_metrics(core.kcore_stats(edges), paths.stats, if_present=if_present)
    return paths


def with_row_key(rows: DataFrame, copies_per_task: int = 100_000) -> DataFrame:
    """Add `row_key`: a hash of all columns and, for rows that are equal in all of them, a counter.

    Equal rows are counted (before the shuffle as well) and written out again from their count, the
    large counts in pieces by many tasks, so a row with very many copies is never one task's work.
    """
    columns = rows.columns
    counted = rows.groupBy(*columns).agg(F.count("*").alias("_n")).withColumn(
        "_digest", F.md5(F.to_json(F.struct(*columns))))
    single = counted.where(F.col("_n") == 1).select(*columns, F.concat_ws("-", "_digest", F.lit("1")).alias("row_key"))
    pieces = counted.where(F.col("_n") > 1).withColumn(
        "_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / copies_per_task))))
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    start = F.col("_piece") * copies_per_task + 1
    numbers = F.sequence(start, F.least(F.col("_n"), start + copies_per_task - 1))
    copies = pieces.repartition(tasks, "_digest", "_piece").select(
        *columns, "_digest", F.explode(numbers).alias("_copy")).select(
        *columns, F.concat_ws("-", "_digest", F.col("_copy").cast("string")).alias("row_key"))
    return single.unionByName(copies)
