import hashlib

import pytest
from pyspark.sql import functions as F

from rankwell.operators import sampling, sequences


def draw(n_items, taken, *parts):
    free = [i for i in range(n_items) if i not in taken]
    if not free:
        return None
    return free[int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:15], 16) % len(free)]


N = 90
PAIRS = [(0, i) for i in range(N)] + [(1, i) for i in range(N) if i % 4 != 3] + [(2, 5), (2, 6)] + [(3, i) for i in range(40, 80)]


def inputs(spark):
    positives = spark.createDataFrame(PAIRS, "user_id long, item_id long")
    split = spark.createDataFrame(
        [(f"r{u}-{i}", u, i) for u, i in PAIRS[::3] + [(4, 7)]], "row_key string, user_id long, item_id long")
    return split, positives


@pytest.mark.parametrize("limit", [0, 30, 1000])
def test_candidates_match_brute_force(spark, limit):
    # With a limit of 0 every user goes through the blocks, with 1000 none.
    split, positives = inputs(spark)
    got = sampling.eval_candidates(split, positives, N, 12, seed=5, array_limit=limit).collect()
    taken = {}
    for u, i in PAIRS:
        taken.setdefault(u, set()).add(i)
    expected = set()
    for r in split.collect():
        expected.add((r.row_key, r.user_id, r.item_id, 0, 1))
        for idx in range(1, 13):
            item = draw(N, taken.get(r.user_id, set()), r.row_key, idx, 5)
            if item is not None:
                expected.add((r.row_key, r.user_id, item, idx, 0))
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_full_user_gets_no_negative(spark):
    split, positives = inputs(spark)
    pool = sampling.eval_candidates(split, positives, N, 5)
    assert pool.where("user_id = 0 and label = 0").count() == 0
    assert pool.where("user_id = 0 and label = 1").count() > 0


def test_triples(spark):
    train = spark.createDataFrame([("a", 1, 0, 5.0), ("b", 1, 2, 3.0), ("c", 2, 1, 1.0)],
                                  "row_key string, user_id long, item_id long, rating double")
    made = sampling.rated_triples(train, 4, 6).collect()
    assert len(made) == 18
    assert all((r.user_id, r.neg_item) not in {(1, 0), (1, 2), (2, 1)} and 0 <= r.neg_item < 4 for r in made)
    assert {r.target for r in made} == {1.0, 0.5, 0.0}
    assert {len(r.aspects) for r in sampling.aspect_triples(train, 4).collect()} == {6}
    labelled = sampling.pointwise_pairs(sampling.bpr_triples(train, 4, 2))
    assert labelled.count() == 12 and labelled.where("label = 1").count() == 6


def test_first_negative_pairs(spark):
    split, positives = inputs(spark)
    pool = sampling.eval_candidates(split, positives, N, 3)
    pairs = sampling.first_negative_pairs(pool)
    assert pairs.count() == split.where("user_id <> 0").count()


def history(spark):
    data = [(1, f"2020-01-{d:02d}", f"k{d}", d) for d in range(1, 9)] + [(1, "2020-01-08", "k0", 99), (2, "2020-01-01", "z", 4)]
    return spark.createDataFrame(data, "user_id long, date string, row_key string, item_id long")


def test_sequences_keep_the_latest_in_order(spark):
    got = {r.user_id: r["items"] for r in sequences.user_sequences(history(spark), 4).collect()}
    assert got == {1: [6, 7, 99, 8], 2: [4]}
    assert {r.user_id: r.history for r in sequences.padded(sequences.user_sequences(history(spark), 4), 5).collect()} == {
        1: [0, 7, 8, 100, 9], 2: [0, 0, 0, 0, 5]}


def test_next_item_samples(spark):
    seqs = sequences.user_sequences(history(spark), 3)
    positives = history(spark).select("user_id", "item_id").distinct()
    made = sequences.next_item_samples(seqs, positives, 120, 3, 2).collect()
    assert sorted((r.position, r.history, r.target, r.draw) for r in made) == [
        (1, [0, 0, 8], 99, 0), (1, [0, 0, 8], 99, 1), (2, [0, 8, 100], 8, 0), (2, [0, 8, 100], 8, 1)]
    assert all(r.neg_item not in {1, 2, 3, 4, 5, 6, 7, 8, 99} for r in made)


def test_last_item(spark, rows):
    assert rows(sequences.last_item(history(spark), ["date", "row_key"])) == [(1, 8), (2, 4)]


def test_draws_of_light_users_are_made_in_steps_of_rows(spark, monkeypatch):
    # Lists are searched for many draws at once; rows without a key or a user, and users with every item, as before.
    monkeypatch.setattr(sampling, "_DRAWS", 7)
    taken = {0: set(range(9)), 1: {0, 1, 8}, 2: {4}}
    positives = spark.createDataFrame([(u, i) for u, all_ in taken.items() for i in all_], "user_id long, item_id long")
    rows = spark.createDataFrame([(f"k{n}" if n % 5 else None, n % 4 if n % 7 else None, [n]) for n in range(40)],
                                 "row_key string, user_id long, kept array<long>")
    drawn = sampling.draw_unseen(rows, positives, 9, 2, 4, 42, ["row_key"])
    assert "MapInArrow" in drawn._jdf.queryExecution().toString()
    expected = sorted(
        (str(r.row_key), str(r.user_id), r.kept, d, draw(9, taken.get(r.user_id, ()), *([r.row_key] if r.row_key else []), d, 42))
        for r in rows.collect() if r.user_id != 0 for d in (2, 3, 4))
    assert sorted((str(r.row_key), str(r.user_id), r.kept, r.draw, r.neg_item) for r in drawn.collect()) == expected
