import math

import pytest
from pyspark.sql import functions as F

from rankwell.functions import scalars as S
from rankwell.functions import vectors as V
from rankwell.functions.ordering import global_rank, previous_value, smallest_keys
from rankwell.functions.draws import hex_key


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("date,year", [
    ("2015-07-01", 2015), ("July 2015", 2015), ("", None), ("1889-05-05", None), ("20", None), (None, None),
    ("1889 to 2012", 2012), ("in summer", None), ("99 1", None), (" 2001-01-01 ", 2001)])
def test_year(spark, date, year):
    assert one(spark, S.extract_year(F.lit(date).cast("string"))) == year


@pytest.mark.parametrize("rating,star", [(0.5, 0), (1.5, 2), (2.5, 2), (3.5, 4), (4.49, 4)])
def test_star_rounds_half_to_even(spark, rating, star):
    assert one(spark, S.round_star(F.lit(rating))) == star


@pytest.mark.parametrize("text", ["", "  ", "one", " two  words\n", "a b　c\td", "x" * 50, None, "a\x0bb \x85 c", " "])
def test_word_count_is_whitespace_split(spark, text):
    assert one(spark, S.word_count(F.lit(text).cast("string"))) == len((text or "").split())


@pytest.mark.parametrize("n,label", [(0, "0"), (1, "1-10"), (10, "1-10"), (11, "11-50"), (500, "201-500"), (501, "501+")])
def test_length_bucket(spark, n, label):
    assert one(spark, S.length_bucket(F.lit(n))) == label


@pytest.mark.parametrize("n,label", [(1, "1-1"), (4, "2-4"), (5, "5-9"), (99, "50-99"), (100, "100+")])
def test_activity_bucket(spark, n, label):
    assert one(spark, S.activity_bucket(F.lit(n))) == label


def test_item_url(spark):
    url = "Hotel_Review-g194775-d1121769-Reviews-Hotel_Baltic-Giulianova_Province_of_Teramo_Abruzzo.html"
    p = one(spark, S.parse_item_url(F.lit(url)))
    assert (p.g_id, p.d_id, p.hotel_name) == (194775, 1121769, "Hotel_Baltic")
    assert one(spark, S.region_slug(F.lit(p.location_slug))) == "Teramo_Abruzzo"
    assert one(spark, S.country_slug(F.lit(p.location_slug))) == "Abruzzo"
    assert one(spark, S.region_slug(F.lit("Monaco"))) == one(spark, S.country_slug(F.lit("Monaco"))) == "Monaco"
    assert one(spark, S.parse_item_url(F.lit("Attraction-1.html"))) is None


def test_text(spark):
    assert one(spark, S.clean_text(F.lit(None).cast("string"))) == "no review"
    assert one(spark, S.clean_text(F.lit(" \n\t"))) == "no review"
    assert one(spark, S.clean_text(F.lit(" kept "))) == " kept "
    assert one(spark, S.apply_text_policy(F.lit("One TWO  three"), True, 2)) == "one two"
    assert one(spark, S.apply_text_policy(F.lit("One TWO  three"), False)) == "One TWO  three"


def test_numbers(spark):
    assert one(spark, S.tolerant_double(F.lit("4.5"))) == 4.5
    assert one(spark, S.tolerant_double(F.lit("good"))) is None
    assert one(spark, S.clip(F.lit(7.0))) == 5.0 and one(spark, S.clip(F.lit(0.0))) == 1.0
    for x in (float("nan"), float("inf"), float("-inf")):
        assert one(spark, S.finite_or_zero(F.lit(x))) == 0.0
    assert one(spark, S.pairwise_loss(F.lit(2.0), F.lit(1.0))) == pytest.approx(-math.log(1 / (1 + math.exp(-1)) + 1e-8))


@pytest.mark.parametrize("items,length,expected", [
    ([1, 2, 3], 5, [0, 0, 1, 2, 3]), ([1, 2, 3], 2, [2, 3]), ([], 2, [0, 0]), ([1, 2], 2, [1, 2])])
def test_left_pad(spark, items, length, expected):
    array = F.lit(items) if items else F.array().cast("array<bigint>")
    assert one(spark, V.left_pad(array.cast("array<bigint>"), length)) == expected


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, V.dot(a, b)) == 11.0
    assert one(spark, V.hadamard(a, b)) == [3.0, 8.0]
    assert one(spark, V.softmax(a)) == pytest.approx([1 / (1 + math.e), math.e / (1 + math.e)])
    assert sum(one(spark, V.softmax(F.array(F.lit(1000.0), F.lit(0.0))))) == pytest.approx(1.0)


def test_weighted_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 2.0), (1, [3.0, 4.0], 1.0), (2, [5.0, 6.0], 0.5)],
                               "k long, v array<double>, w double")
    sums = {r.k: r.vector for r in V.weighted_vectors(df, ["k"], "v", 2, F.col("w")).collect()}
    assert sums == {1: [5.0, 8.0], 2: [2.5, 3.0]}


@pytest.mark.parametrize("buckets", [2, 7, 40])
def test_global_rank_matches_sorted(spark, buckets):
    keys = [f"k{(i * 7919) % 1000:04d}{'é' if i % 3 else 'z'}" for i in range(1000)] + ["", "Z", "ÿ", "\U0001f600"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {r["key"]: r["id"] for r in global_rank(df, ["key"], "id", buckets).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_previous_value_with_one_hot_key(spark):
    # One user holds most rows, with equal times; nulls must be carried over bucket ends as well.
    events = [(0 if i % 10 else i, (i * 37) % 50, i, None if i % 11 == 0 else i) for i in range(600)]
    df = spark.createDataFrame(events, "u long, t long, id long, item long")
    got = {r["id"]: r["prev"] for r in previous_value(df, ["u"], ["t", "id"], "item", "prev", buckets=9).collect()}
    expected, last = {}, {}
    for u, t, i, item in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        expected[i] = last.get(u)
        last[u] = item
    assert got == expected


def test_smallest_keys_narrows_down(spark):
    df = spark.range(3000).withColumn("k", hex_key(F.col("id"), 1))
    ordered = sorted(r["k"] for r in df.collect())
    found = smallest_keys(df, F.col("k"), lambda n: [1, 1500, n, 0, n + 5], small=1)
    assert found == [ordered[0], ordered[1499], ordered[-1], None, ordered[-1]]
