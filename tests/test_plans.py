import json
import random

import pytest
from pyspark.sql import functions as F

from rankwell.operators import core, knn, popular, sampling
from rankwell.plans import baselines, ensemble, preprocess
from rankwell.sources import reviews, tables
from rankwell.streaming.ingest import ingest_new_files


def records(n=900, seed=1):
    rng = random.Random(seed)
    return [{
        "author": f"user {int(rng.paretovariate(1.0)) % 30}", "hotel_url": f"hotel {rng.randrange(25)}",
        "rating": rng.randint(0, 5), "text": "fine", "date": f"201{rng.randrange(10)}-01-01",
        "property_dict": {"rooms": rng.randint(1, 5)},
    } for _ in range(n)]


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_from_raw_files_to_reports(spark, tmp_path):
    data = records()
    write(tmp_path / "raw", "r.jsonl", data)
    paths = preprocess.prepare(reviews.read_reviews_jsonl(spark, str(tmp_path / "raw")), str(tmp_path / "out"), 5)
    rows = spark.read.parquet(paths.interactions)

    good = [r for r in data if r["rating"] > 0]
    pairs = {(r["author"], r["hotel_url"]) for r in good}
    while True:
        before = len(pairs)
        for side in (0, 1):
            n = {}
            for p in pairs:
                n[p[side]] = n.get(p[side], 0) + 1
            pairs = {p for p in pairs if n[p[side]] >= 5}
        if len(pairs) == before:
            break
    users, items = sorted({u for u, _ in pairs}), sorted({i for _, i in pairs})
    expected = sorted((users.index(r["author"]), items.index(r["hotel_url"]), float(r["rating"]))
                      for r in good if r["author"] in users and r["hotel_url"] in items)
    assert sorted(tuple(r) for r in rows.select("user_id", "item_id", "rating").collect()) == expected
    assert {r["key"]: r["id"] for r in tables.read_id_map(spark, paths.user_ids).collect()} == {u: i for i, u in enumerate(users)}
    sizes = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
    assert tuple(sizes[s] for s in ("train", "val", "test")) == core.split_sizes(len(expected), 0.8, 0.1, 0.1)
    assert rows.select("row_key").distinct().count() == len(expected)

    part = {s: rows.where(F.col("split") == s) for s in sizes}
    n_items = core.n_users_items(rows)[1]
    positives = core.user_positives(rows)
    pool = {s: sampling.eval_candidates(part[s], positives, n_items, 9) for s in ("val", "test")}
    report = baselines.ranking_report(part["train"], pool["test"], 5)
    assert {r.model for r in report.collect()} == {"popularity", "itemknn"}
    assert {r.model for r in baselines.rating_report(part["train"], part["test"], 5).collect()} == {
        "global_mean", "item_mean", "itemknn"}

    fitted, lists, history = popular.popularity_fit(part["train"]), knn.itemknn_fit(part["train"], 5), core.sum_pairs(part["train"])
    result = ensemble.evaluate_ensemble(pool["val"], pool["test"], {
        "pop": lambda df, out: popular.popularity_score(df, fitted, out),
        "knn": lambda df, out: knn.itemknn_score(df, lists, history, out=out),
    }, part["val"], part["test"], 0.25)
    assert {r.model for r in result.metrics.collect()} == {"pop", "knn", "blend", "stack"}
    assert result.importance.count() == 2 and result.rating.first().n > 0
    won = result.weights.first()
    assert won.w_pop + won.w_knn == pytest.approx(1.0)


def test_stream_takes_each_file_once(spark, tmp_path):
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    total = 0
    for name in ("a.jsonl", "b.jsonl"):
        new = records(50, seed=len(name) + ord(name[0]))
        write(tmp_path / "in", name, new)
        ingest_new_files(*args).awaitTermination()
        total += sum(r["rating"] > 0 for r in new)
        assert spark.read.parquet(args[2]).count() == total


def test_row_keys_of_copies(spark):
    df = spark.createDataFrame([(1, "a")] * 25 + [(2, "b"), (3, None)], "user_id long, text string")
    keyed = preprocess.with_row_key(df, copies_per_task=4)
    assert keyed.count() == 27 and keyed.select("row_key").distinct().count() == 27
    assert keyed.drop("row_key").exceptAll(df).count() == 0
    assert keyed.exceptAll(preprocess.with_row_key(df.repartition(3))).count() == 0
