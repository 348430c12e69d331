import random

import pytest
from pyspark.sql import functions as F

from rankwell.operators import core, joins


def brute_core(edges, k):
    edges = set(edges)
    while True:
        size = len(edges)
        for side in (0, 1):
            degree = {}
            for e in edges:
                degree[e[side]] = degree.get(e[side], 0) + 1
            edges = {e for e in edges if degree[e[side]] >= k}
        if len(edges) == size:
            return edges


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "user_id long, item_id long")


def test_core_cascades(spark, rows):
    # Dropping user 9 makes item 3 rare, which makes user 2 rare, and so on.
    pairs = [(u, i) for u in (0, 1) for i in (0, 1)] + [(2, 0), (2, 3), (3, 3), (3, 4), (9, 4)]
    trace = []
    got = rows(core.kcore(frame(spark, pairs), 2, trace=trace))
    assert got == sorted(brute_core(pairs, 2))
    assert len(trace) >= 3 and trace[-1]["edges"] == trace[-2]["edges"]


def test_core_counts_distinct_partners(spark, rows):
    pairs = [(5, 5)] * 20 + [(u, i) for u in range(3) for i in range(3)]
    assert rows(core.kcore(frame(spark, pairs), 3)) == [(u, i) for u in range(3) for i in range(3)]


@pytest.mark.parametrize("k", [1, 2, 4, 50])
def test_core_matches_brute_force(spark, rows, k):
    rng = random.Random(k)
    # User 0 has every item.
    pairs = [(0, i) for i in range(60)] + [(int(rng.paretovariate(0.8)) % 80, rng.randrange(60)) for _ in range(900)]
    got = rows(core.kcore(frame(spark, pairs), k))
    assert got == sorted(brute_core(pairs, k))
    if got:
        again = core.kcore(frame(spark, got), k)
        assert rows(again) == got


def brute_trace(edges, k):
    edges, out = set(edges), []
    while True:
        size = len(edges)
        for side in (0, 1):
            degree = {}
            for e in edges:
                degree[e[side]] = degree.get(e[side], 0) + 1
            edges = {e for e in edges if degree[e[side]] >= k}
        out.append((len({u for u, _ in edges}), len({i for _, i in edges}), len(edges)))
        if len(edges) == size:
            return out


@pytest.mark.parametrize("limit", ["BROADCAST_ROWS", "BROADCAST_BYTES"])
def test_core_without_broadcast(spark, rows, monkeypatch, limit):
    monkeypatch.setattr(core, limit, 0)
    rng = random.Random(3)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(500)]
    assert rows(core.kcore(frame(spark, pairs), 10)) == sorted(brute_core(pairs, 10))


@pytest.mark.parametrize("seed,k,users,items,n", [(1, 2, 30, 30, 50), (2, 3, 40, 25, 120), (3, 5, 60, 30, 330), (4, 4, 200, 12, 500), (5, 2, 9, 9, 9)])
def test_core_rounds_match_brute_force(spark, rows, seed, k, users, items, n):
    rng = random.Random(seed)
    pairs = [(int(rng.paretovariate(0.7)) % users, rng.randrange(items)) for _ in range(n)]
    trace = []
    assert rows(core.kcore(frame(spark, pairs), k, trace=trace)) == sorted(brute_core(pairs, k))
    assert [(t["users"], t["items"], t["edges"]) for t in trace] == brute_trace(pairs, k)


def test_long_chain_writes_the_edges_twice_at_most(spark, rows, monkeypatch):
    # A block that stays, and a chain that loses one user and one item a round.
    pairs = [(u, i) for u in range(8) for i in range(8)]
    for n in range(12):
        pairs += [(100 + n, 100 + n), (100 + n, 101 + n)]
    written = []
    stage = core.staged
    monkeypatch.setattr(core, "staged", lambda df, label, *a: written.append((label, (out := stage(df, label, *a)).count())) or out)
    trace = []
    assert rows(core.kcore(frame(spark, pairs), 2, trace=trace)) == [(u, i) for u in range(8) for i in range(8)]
    assert len(trace) >= 6
    assert sum(n for label, n in written if label == "edges") < 2 * len(pairs)
    assert sum(n for label, n in written if label in ("lost", "rare")) <= 6 * len(pairs) // 4


def test_core_leaves_out_rows_without_key_and_empty_tables(spark, rows):
    pairs = [(u, i) for u in (0, 1) for i in (0, 1)] + [(None, 0), (0, None), (None, None)]
    assert rows(core.kcore(frame(spark, pairs), 2)) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    trace = []
    assert rows(core.kcore(frame(spark, []), 2, trace=trace)) == []
    assert trace == [{"round": 1, "users": 0, "items": 0, "edges": 0}]
    assert rows(core.kcore(frame(spark, [(0, 0), (1, 1)]), 2)) == []


def test_restrict_keeps_repeated_rows(spark):
    pairs = [(u, i) for u in range(3) for i in range(3)] + [(0, 0)] * 4 + [(7, 0)]
    df = frame(spark, pairs)
    assert joins.restrict_to_core(df, core.kcore(df, 3)).count() == 13


def test_id_map(spark):
    keys = ["b", "a", "B", "é", "a", None]
    got = core.build_id_map(spark.createDataFrame([(k,) for k in keys], "name string"), "name", 3).collect()
    assert {r["key"]: r["id"] for r in got} == {k: i for i, k in enumerate(sorted({"b", "a", "B", "é"}))}


def test_contiguous_ids(spark, rows):
    df = spark.createDataFrame([(0,), (1,), (3,)], "item_id long")
    assert core.check_contiguous_ids(df, "item_id").first()["contiguous"] is False
    assert rows(core.missing_ids(df, "item_id", 5)) == [(2,), (4,)]


@pytest.mark.parametrize("n", [0, 1, 9, 10, 101, 1000])
def test_split_is_exact_disjoint_and_stable(spark, n):
    df = spark.range(n).select(F.col("id").cast("string").alias("row_key"))
    labelled = core.random_split(df, ["row_key"])
    sizes = {r["split"]: r["count"] for r in labelled.groupBy("split").count().collect()}
    expected = dict(zip(("train", "val", "test"), core.split_sizes(n, 0.8, 0.1, 0.1)))
    assert sizes == {s: c for s, c in expected.items() if c}
    again = core.random_split(df.repartition(7), ["row_key"])
    assert labelled.exceptAll(again).count() == 0 and labelled.select("row_key").distinct().count() == n


def test_split_ratios_must_sum_to_one():
    with pytest.raises(ValueError):
        core.split_sizes(10, 0.8, 0.1, 0.2)
    assert core.split_sizes(60000, 0.8, 0.1, 0.1) == (48000, 6000, 6000)
    assert core.split_sizes(11, 0.8, 0.1, 0.1) == (8, 1, 2)


def test_review_sample(spark):
    df = spark.range(500)
    assert core.review_sample(df, 37, ["id"]).count() == 37
    assert core.review_sample(df, 0, ["id"]).count() == 0
    assert core.review_sample(df, 900, ["id"]).count() == 500


def test_sums_and_means_of_repeated_pairs(spark, rows):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 1, 4.0), (1, 2, 5.0)], "user_id long, item_id long, rating double")
    assert rows(core.sum_pairs(df)) == [(1, 1, 6.0), (1, 2, 5.0)]
    assert rows(core.dedupe_pairs_mean(df)) == [(1, 1, 3.0), (1, 2, 5.0)]
    test = spark.createDataFrame([(1, 1), (1, 1), (2, 2)], "user_id long, item_id long")
    got = joins.attach_pair_rating(test, df)
    assert got.count() == 3 and got.where("rating is null").count() == 1
