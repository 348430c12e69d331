"""The k-core, dense ids and splits."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.functions.draws import hex_key
from rankwell.functions.ordering import global_rank, smallest_keys
from rankwell.operators.joins import BROADCAST_ROWS
from rankwell.scratch import staged


# Keys are broadcast up to this size; they may be names or addresses of any length.
BROADCAST_BYTES = 64 << 20


@dataclass
class _Keys:
    """Keys to drop, with the number of partners (`_n`) each had left."""

    frame: DataFrame
    key: str
    n: int
    edges: int
    octets: int


@dataclass
class _Side:
    """One side of the edges: partners per key when the edges were written, and what happened since."""

    key: str
    degrees: DataFrame
    live: int
    judged: bool = False
    lost: list[DataFrame] = field(default_factory=list)
    dropped: list[_Keys] = field(default_factory=list)


def _side(edges: DataFrame, key: str) -> _Side:
    degrees = staged(edges.groupBy(key).agg(F.count("*").alias("_n")), "degrees")
    return _Side(key, degrees, degrees.count())


def _small(df: DataFrame, rows: int, octets: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS and octets <= BROADCAST_BYTES else df


def _rare(side: _Side, k: int) -> _Keys:
    """The keys that fell below `k` partners and have some left.

    At first all keys are looked at, then those that the last drop of partners touched.  Keys without any
    partner left are gone with the partners' edges.
    """
    lost = None
    for part in side.lost:
        lost = part if lost is None else lost.unionByName(part)
    before, now = F.col("_n"), F.col("_n")
    counted = side.degrees
    if lost is not None:
        sums = lost.groupBy(side.key).agg(F.sum("_lost").alias("_lost"))
        if side.judged:
            last = side.lost[-1].withColumnRenamed("_lost", "_last")
            counted = counted.join(last, side.key).join(sums, side.key)
            before = F.col("_n") - F.col("_lost") + F.col("_last")
        else:
            counted = counted.join(sums, side.key, "left")
        now = F.col("_n") - F.coalesce("_lost", F.lit(0))
    elif side.judged:
        counted = counted.where("false")
    fallen = staged(counted.where((now < k) & (F.lit(not side.judged) | (before >= k))).select(side.key, now.alias("_n")), "rare")
    gone, n, edges, octets = fallen.agg(
        F.count_if(F.col("_n") == 0), F.count_if(F.col("_n") > 0), F.sum("_n"),
        F.sum(F.octet_length(F.col(side.key).cast("string")))).first()
    side.judged = True
    side.live -= gone
    return _Keys(fallen.where(F.col("_n") > 0), side.key, n, edges or 0, octets or 0)


def _without(edges: DataFrame, side: _Side, k: int) -> DataFrame:
    """Edges of the keys not dropped, by the keys to keep where those are fewer."""
    if not side.dropped:
        return edges
    n = sum(d.n for d in side.dropped)
    if not side.lost and len(side.dropped) == 1 and side.live < n:
        kept = side.degrees.where(F.col("_n") >= k).select(side.key)
        octets = kept.agg(F.sum(F.octet_length(F.col(side.key).cast("string")))).first()[0]
        return edges.join(_small(kept, side.live, octets or 0), side.key, "left_semi").select(edges.columns)
    keys = side.dropped[0].frame.select(side.key)
    for d in side.dropped[1:]:
        keys = keys.unionByName(d.frame.select(side.key))
    return edges.join(_small(keys, n, sum(d.octets for d in side.dropped)), side.key, "left_anti").select(edges.columns)


def kcore(df: DataFrame, k: int, user: str = "user_id", item: str = "item_id",
          trace: list[dict] | None = None) -> DataFrame:
    """The distinct (user, item) edges left when rare users, then rare items, are dropped until all are frequent.

    "Rare" means fewer than `k` distinct partners; rows without a user or item are left out.  Each drop
    subtracts from the counts of the dropped keys' partners only, and what a drop changes is written to the
    shared folder, so a lost executor costs one step.  The edges are written again when half of them are
    gone, and at the end: less than twice in all, besides the first time.  `trace` receives the sizes after
    each round.
    """
    edges = staged(df.select(user, item).where(F.col(user).isNotNull() & F.col(item).isNotNull()).distinct(), "edges")
    written = alive = edges.count()
    sides = {user: _side(edges, user), item: _side(edges, item)}
    rare = _rare(sides[user], k)
    round_no = 0
    while True:
        round_no += 1
        dropped = 0
        for key, partner in ((user, item), (item, user)):
            side, other = sides[key], sides[partner]
            if rare.n:
                dropped += rare.n
                alive -= rare.edges
                side.live -= rare.n
                side.dropped.append(rare)
                if alive * 2 <= written:
                    edges = staged(_without(_without(edges, side, k), other, k), "edges")
                    written = alive
                    sides = {user: _side(edges, user), item: _side(edges, item)}
                    sides[key].judged = True  # its rare keys have just been dropped
                else:
                    keys = _small(rare.frame.select(key), rare.n, rare.octets)
                    other.lost.append(staged(edges.join(keys, key, "left_semi").groupBy(partner).agg(
                        F.count("*").alias("_lost")), "lost"))
                rare = _rare(sides[partner], k)
            elif not other.judged:
                rare = _rare(other, k)
            else:
                rare = _Keys(rare.frame, partner, 0, 0, 0)
        if trace is not None:
            trace.append({"round": round_no, "users": sides[user].live, "items": sides[item].live, "edges": alive})
        if not dropped:
            break
    if not any(side.dropped for side in sides.values()):
        return edges
    return staged(_without(_without(edges, sides[user], k), sides[item], k), "edges")


def kcore_trace(df: DataFrame, k: int, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """Users, items and edges after each round, the last one unchanged."""
    rounds: list[dict] = []
    kcore(df, k, user, item, rounds)
    rows = [(r["round"], r["users"], r["items"], r["edges"]) for r in rounds]
    return df.sparkSession.createDataFrame(rows, "round long, users long, items long, edges long")


def kcore_stats(core: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """Users, items, distinct edges and sparsity (%) of a core."""
    sized = core.agg(F.count_distinct(user).alias("n_users"), F.count_distinct(item).alias("n_items"),
                     F.count_distinct(user, item).alias("n_edges"))
    cells = F.col("n_users").cast("double") * F.col("n_items")
    return sized.withColumn("sparsity", F.lit(100.0) * (F.lit(1.0) - F.col("n_edges") / F.nullif(cells, F.lit(0.0))))


def build_id_map(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """Distinct keys numbered from 0 in their (code point) order, as `key` and `id`."""
    keys = df.select(F.col(key).alias("key")).where(F.col("key").isNotNull()).distinct()
    return global_rank(staged(keys, "keys"), ["key"], "id", buckets).select("key", "id")


def check_contiguous_ids(df: DataFrame, key: str) -> DataFrame:
    """One row: smallest and largest id, distinct ids, and whether they are exactly 0..n-1."""
    seen = df.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count_distinct(key).alias("n_ids"))
    return seen.withColumn("contiguous", (F.col("low") == 0) & (F.col("high") + 1 == F.col("n_ids")))


def missing_ids(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ids of 0..n-1 that `df` lacks."""
    return df.sparkSession.range(n).select(F.col("id").alias(key)).join(df, key, "left_anti")


def split_sizes(n: int, train: float, val: float, test: float) -> tuple[int, int, int]:
    """Rows per split: the holdout is rounded up first, then its test part."""
    if abs(train + val + test - 1.0) >= 1e-6:
        raise ValueError(f"split ratios must sum to 1, got {train + val + test}")
    up = lambda x: math.ceil(round(x, 6))
    holdout = up(n * (val + test))
    n_test = up(holdout * (1 - val / (val + test)))
    return n - holdout, holdout - n_test, n_test


def random_split(df: DataFrame, key: list[str], ratios: tuple[float, float, float] = (0.8, 0.1, 0.1),
                 seed: int = 42, out: str = "split") -> DataFrame:
    """Add a train/val/test label with exact sizes.

    Rows are ordered by a hash of their unique `key`; only the two hash values at the cut points are
    looked up, after which the label is a comparison per row and the table itself is not shuffled.
    """
    h = hex_key(*[F.col(c) for c in key], seed)

    def cuts(n: int) -> list[int]:
        n_train, n_val, _ = split_sizes(n, *ratios)
        return [n_train, n_train + n_val]

    first, second = smallest_keys(df, h, cuts)
    label = F.when(h <= (first or ""), "train").when(h <= (second or ""), "val").otherwise("test")
    return df.withColumn(out, label)


def approximate_split(df: DataFrame, key: list[str], seed: int = 42, out: str = "split") -> DataFrame:
    """As `random_split` with sizes right on average only, without looking at the data first."""
    part = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(10))
    return df.withColumn(out, F.when(part < 8, "train").when(part == 8, "val").otherwise("test"))


def split_to_tables(labelled: DataFrame, path: str, split: str = "split") -> str:
    """Write the splits as partitions of one table.

    A task keeps one file open per split; sorting its rows by split first would hold all of them.
    """
    conf = labelled.sparkSession.conf
    settings = {"spark.sql.maxConcurrentOutputFileWriters": "16", "spark.sql.optimizer.plannedWrite.enabled": "false"}
    before = {name: conf.get(name) for name in settings}
    for name, value in settings.items():
        conf.set(name, value)
    try:
        labelled.write.partitionBy(split).parquet(path)
    finally:
        for name, value in before.items():
            conf.set(name, value)
    return path


def review_sample(df: DataFrame, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """`n` rows picked by the hash of their key: the same rows on every run, without a sort."""
    h = hex_key(*[F.col(c) for c in key], seed)
    cut = smallest_keys(df, h, lambda total: [n])[0]
    return df.where(h <= (cut or ""))


def user_positives(*splits: DataFrame) -> DataFrame:
    """Distinct (user, item) pairs over all given splits."""
    out = splits[0].select("user_id", "item_id")
    for s in splits[1:]:
        out = out.unionByName(s.select("user_id", "item_id"))
    return out.distinct()


def n_users_items(df: DataFrame) -> tuple[int, int]:
    """Sizes of the dense id spaces: largest id plus one."""
    users, items = n_users_items_frame(df).first()
    return users or 0, items or 0


def n_users_items_frame(df: DataFrame) -> DataFrame:
    return df.agg((F.max("user_id") + 1).alias("n_users"), (F.max("item_id") + 1).alias("n_items"))


def dedupe_pairs_mean(df: DataFrame) -> DataFrame:
    return df.groupBy("user_id", "item_id").agg(F.avg("rating").alias("rating"))


def sum_pairs(df: DataFrame) -> DataFrame:
    return df.groupBy("user_id", "item_id").agg(F.sum("rating").alias("rating"))


def item_mean_rating(df: DataFrame) -> DataFrame:
    return df.groupBy("item_id").agg(F.avg("rating").alias("mean_rating"))


def global_mean_rating(df: DataFrame) -> DataFrame:
    return df.agg(F.avg("rating").alias("mean_rating"))
