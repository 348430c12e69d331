"""Joins, set operations, profiles, cores, ids and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import derived as D
from checks.columns import ACTIVITY_CASE, LENGTH_CASE, WORDS
from checks.registry import query
from rankwell.functions import scalars as S
from rankwell.operators import aspects, core, geo, joins, knn, profile, reports

PAIR = ["user_id", "item_id"]


# --- joins ------------------------------------------------------------------------------------------

@query("c1_attach_ids", """select row_key, dense_rank() over (order by hotel_url) - 1 as item_id,
       dense_rank() over (order by author) - 1 as user_id from raw_reviews""")
def with_ids(spark, folder):
    raw = D.raw_reviews(spark, folder).select(F.col("user_id").alias("row_key"), "author", "hotel_url")
    users, items = core.build_id_map(raw, "author"), core.build_id_map(raw, "hotel_url")
    return joins.attach_ids(joins.attach_ids(raw, users, "author", "user_id"), items, "hotel_url", "item_id")


# Each round drops users, then items; the rounds beyond the fixpoint change nothing.
def core_ctes(k: int, rounds: int) -> dict[str, str]:
    out = {"e0": "select distinct user_id, item_id from inter"}
    for r in range(1, rounds + 1):
        out[f"u{r}"] = f"""select * from e{r - 1} where user_id in
            (select user_id from e{r - 1} group by user_id having count(*) >= {k})"""
        out[f"e{r}"] = f"""select * from u{r} where item_id in
            (select item_id from u{r} group by item_id having count(*) >= {k})"""
    return out


K, ROUNDS = 20, 6
CORE = core_ctes(K, ROUNDS)


def kcore(spark, folder):
    return core.kcore(D.inter(spark, folder), K)


@query("c2_restrict_to_core", f"""select row_key, user_id, item_id from inter where user_id in (select user_id from e{ROUNDS})
       and item_id in (select item_id from e{ROUNDS})""", **CORE)
def restricted(spark, folder):
    rows = D.inter(spark, folder).select("row_key", *PAIR)
    return joins.restrict_to_core(rows, kcore(spark, folder))


@query("c3_attach_pair_rating", """select t.row_key, t.user_id, t.item_id, round(p.rating, 6) as rating
       from test t left join (select user_id, item_id, avg(rating) as rating from train group by all) p
       using (user_id, item_id)""")
def pair_rating(spark, folder):
    return joins.attach_pair_rating(D.split(spark, folder, "test").select("row_key", *PAIR), D.split(spark, folder, "train"))


@query("c4_rows_in_train_pairs", """select row_key, user_id, item_id from inter
       where (user_id, item_id) in (select user_id, item_id from train)""")
def in_train(spark, folder):
    return joins.rows_in_train_pairs(D.inter(spark, folder).select("row_key", *PAIR), D.split(spark, folder, "train"))


@query("c5_exclude_seen", """select row_id, user_id, item_id, cand_idx from cands_test
       where (user_id, item_id) not in (select user_id, item_id from train)""")
def unseen(spark, folder):
    pool = D.candidates(spark, folder).select("row_id", *PAIR, "cand_idx")
    return joins.exclude_seen(pool, D.split(spark, folder, "train"))


@query("c6_cold_start", """select 'user' as kind, user_id as id from (select user_id from inter except select user_id from event_inter)
       union all select 'item', item_id from (select item_id from inter except select item_id from event_inter)""")
def cold(spark, folder):
    rows, known = D.inter(spark, folder), D.event_inter(spark, folder)
    return joins.cold_start(rows, known, "user_id").select(F.lit("user").alias("kind"), F.col("user_id").alias("id")).unionByName(
        joins.cold_start(rows, known, "item_id").select(F.lit("item").alias("kind"), F.col("item_id").alias("id")))


_SHARED = "select count(*) as n_shared from (select user_id, item_id from {} intersect select user_id, item_id from {})"


@query("c7_split_overlap", "select 'train_val' as pair, * from ({}) union all select 'train_test', * from ({}) union all "
       "select 'val_test', * from ({})".format(_SHARED.format("train", "val"), _SHARED.format("train", "test"),
                                               _SHARED.format("val", "test")))
def overlap(spark, folder):
    part = {s: D.split(spark, folder, s) for s in ("train", "val", "test")}
    rows = [joins.split_overlap(part[a], part[b]).select(F.lit(f"{a}_{b}").alias("pair"), "n_shared")
            for a, b in (("train", "val"), ("train", "test"), ("val", "test"))]
    return joins.union_splits(*rows)


@query("c8_union_splits", "select row_key, user_id, item_id, rating from inter")
def unioned(spark, folder):
    part = [D.split(spark, folder, s).select("row_key", *PAIR, "rating") for s in ("train", "val", "test")]
    return joins.union_splits(*part)


@query("c9_expand_to_all_items", """select i as item_id, coalesce(n, -1) as n from range((select n from n_items)) as r(i)
       left join (select item_id, count(*) as n from event_inter group by item_id) on item_id = i""")
def expanded(spark, folder):
    counts = profile.frequency_counts(D.event_inter(spark, folder), "item_id")
    wide = joins.expand_to_all_items(counts, D.n_items(spark, folder))
    return wide.select("item_id", F.coalesce("n", F.lit(-1)).alias("n"))


@query("c10_lookup_vectors", """select t.row_key, round(list_sum(list_transform(u.embedding::double[], lambda x, k: x * k)), 6) as u_every,
         round(list_sum(list_transform(i.embedding::double[], lambda x, k: x * k)), 6) as i_every
       from test t join embeddings u on u.vec_id = t.user_id % (select count(*) from embeddings)
       join embeddings i on i.vec_id = t.item_id % (select count(*) from embeddings)""")
def vectors(spark, folder):
    e = D.table(spark, folder, "embeddings")
    n = e.agg(F.count("*")).scalar()
    test = D.split(spark, folder, "test").select("row_key", (F.col("user_id") % n).alias("user_id"), (F.col("item_id") % n).alias("item_id"))
    found = joins.lookup_vectors(test, e.select(F.col("vec_id").alias("user_id"), F.col("embedding").alias("user_vector")),
                                 e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("item_vector")))
    return found.select("row_key", D.every_coordinate(F.col("user_vector")).alias("u_every"),
                        D.every_coordinate(F.col("item_vector")).alias("i_every"))


WEIGHTS = [(0.0, 1.0), (0.3, 0.7), (1.0, 0.0)]


@query("c11_cross_weights", """select row_key, combo, round(a * rating + b * item_mean, 6) as blend
       from (select t.row_key, t.rating, avg(rating) over (partition by item_id) as item_mean from test t),
            (values (0, 0.0, 1.0), (1, 0.3, 0.7), (2, 1.0, 0.0)) as w(combo, a, b)""")
def weighted(spark, folder):
    test = D.split(spark, folder, "test").select("row_key", "item_id", "rating")
    means = test.groupBy("item_id").agg(F.avg("rating").alias("item_mean"))
    return joins.cross_weights(test.join(means, "item_id").drop("item_id"), WEIGHTS, ["rating", "item_mean"])


@query("c12_item_cooccurrence", """select a.item_id as item_a, b.item_id as item_b, count(*)::double as dot
       from s a join s b on a.user_id = b.user_id and a.item_id < b.item_id group by all""",
       s="select distinct user_id, item_id from inter")
def cooccurrence(spark, folder):
    return knn.item_cooccurrence(core.user_positives(D.inter(spark, folder)))


# --- profiles ---------------------------------------------------------------------------------------

@query("d1_frequency_counts", """select 'user' as kind, user_id as id, count(*) as n from inter group by user_id
       union all select 'item', item_id, count(*) from inter group by item_id""")
def frequencies(spark, folder):
    rows = D.inter(spark, folder)
    one = lambda key, kind: profile.frequency_counts(rows, key).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "n")
    return one("user_id", "user").unionByName(one("item_id", "item"))


_STATS = """select n_total, n_valid, n_users, n_items, round(n_valid * 100.0 / (n_users::double * n_items), 6) as density,
    round(100 - n_valid * 100.0 / (n_users::double * n_items), 6) as sparsity,
    round(n_valid::double / n_users, 6) as per_user, round(n_valid::double / n_items, 6) as per_item
  from (select count(*) as n_total, count(*) filter (where ok) as n_valid,
        count(distinct case when ok then author end) as n_users, count(distinct case when ok then hotel_url end) as n_items
        from (select *, coalesce(try_cast(rating as double), 0) > 0 and author <> '' as ok from raw_reviews))"""


@query("d2_dataset_stats", _STATS)
def stats(spark, folder):
    raw = D.raw_reviews(spark, folder).select(
        F.col("author").alias("user_id"), F.col("hotel_url").alias("item_id"), S.tolerant_double("rating").alias("rating"))
    return profile.dataset_stats(raw)


@query("d3_running_stats", """select item_id, count(service) as n, round(coalesce(avg(service), 0), 6) as mean,
       round(coalesce(var_pop(service), 0), 6) as var, round(coalesce(stddev_pop(service), 0), 6) as std,
       min(service) as min, max(service) as max from inter group by item_id""")
def running(spark, folder):
    return profile.running_stats(D.inter(spark, folder), "service", ["item_id"])


@query("d4_exact_median", """select 'user' as kind, quantile_cont(n, 0.5) as median from (select count(*) as n from inter group by user_id)
       union all select 'item', quantile_cont(n, 0.5) from (select count(*) as n from inter group by item_id)""")
def medians(spark, folder):
    rows = D.inter(spark, folder)
    one = lambda key, kind: profile.exact_median(profile.frequency_counts(rows, key), "n").select(F.lit(kind).alias("kind"), "median")
    return one("user_id", "user").unionByName(one("item_id", "item"))


@query("d5_rating_histogram", """select star, n, round(n * 100.0 / sum(n) over (), 6) as pct
       from (select cast(round_even(rating, 0) as bigint) as star, count(*) as n from inter group by all)""")
def histogram(spark, folder):
    return profile.rating_histogram(D.inter(spark, folder))


@query("d6_user_activity", f"""select bucket, n, round(n * 100.0 / sum(n) over (), 6) as pct, exactly_one, below_five, most
       from (select {ACTIVITY_CASE.format('c')} as bucket, count(*) as n from counts group by all),
            (select count(*) filter (where c = 1) as exactly_one, count(*) filter (where c < 5) as below_five,
                    max(c) as most from counts)""",
       counts="select user_id, count(*) as c from inter group by user_id")
def activity(spark, folder):
    rows = D.inter(spark, folder)
    top = profile.user_activity_summary(rows).select(F.struct("exactly_one", "below_five", "most")).scalar()
    return profile.user_activity(rows).select(
        "bucket", "n", "pct", top["exactly_one"].alias("exactly_one"), top["below_five"].alias("below_five"),
        top["most"].alias("most"))


@query("d7_item_popularity_hist", """select reviews, count(*) as n from (select count(*) as reviews from inter group by item_id)
       group by reviews""")
def popularity_hist(spark, folder):
    return profile.count_of_counts(D.inter(spark, folder), "item_id")


@query("d8_aspect_coverage", " union all ".join(
    f"select '{a}' as aspect, count({a}) as n, round(count({a}) * 100.0 / count(*), 6) as pct, round(avg({a}), 6) as mean from inter"
    for a in S.ASPECTS))
def coverage(spark, folder):
    return profile.aspect_coverage(D.inter(spark, folder))


@query("d9_aspect_summary", " union all ".join(
    f"select '{a}' as aspect, round(avg({a}), 6) as mean, round(stddev_samp({a}), 6) as std, count(*) - count({a}) as missing from train"
    for a in S.VECTOR_ASPECTS))
def aspect_summary(spark, folder):
    return profile.aspect_summary(D.split(spark, folder, "train"))


@query("d10_text_length_profile", f"""select bucket, count(*) as n, round(count(*) * 100.0 / max(n_all), 6) as pct,
       max(n_all) as with_text, round(max(mean), 6) as mean, round(max(std), 6) as std, max(low) as min, max(high) as max
       from (select {LENGTH_CASE.format('w')} as bucket, count(*) over () as n_all, avg(w) over () as mean,
                    stddev_pop(w) over () as std, min(w) over () as low, max(w) over () as high from lengths)
       group by bucket""", lengths=f"select {WORDS} as w from documents where length(text) > 0")
def text_lengths(spark, folder):
    docs = D.table(spark, folder, "documents").select("text")
    s = profile.text_length_stats(docs).select(F.struct("n", "mean", "std", "min", "max")).scalar()
    return profile.text_length_buckets(docs).select(
        "bucket", "n", "pct", s["n"].alias("with_text"), *[s[c].alias(c) for c in ("mean", "std", "min", "max")])


@query("d11_reviews_per_year", """select year, n, round(n * 100.0 / sum(n) over (), 6) as pct
       from (select cast(substr(date, 1, 4) as bigint) as year, count(*) as n from inter group by all)""")
def per_year(spark, folder):
    return profile.reviews_per_year(D.inter(spark, folder))


@query("d12_profile_report", f"""select count(*) as n_total, count(distinct user_id) as n_users, count(distinct item_id) as n_items,
       round(100 - count(*) * 100.0 / (count(distinct user_id)::double * count(distinct item_id)), 6) as sparsity,
       round(count(*)::double / count(distinct user_id), 6) as per_user,
       round(count(*)::double / count(distinct item_id), 6) as per_item,
       (select quantile_cont(n, 0.5) from (select count(*) as n from inter group by user_id)) as median_per_user,
       (select quantile_cont(n, 0.5) from (select count(*) as n from inter group by item_id)) as median_per_item,
       (select count(*) filter (where n < 5) from (select count(*) as n from inter group by user_id)) as users_below_five,
       (select max(n) from (select count(*) as n from inter group by user_id)) as most_per_user,
       round(avg(rating), 6) as mean_rating,
       (select round(avg(words), 6) from inter join (select doc_id, length(text) as l, {WORDS} as words from documents) using (doc_id)
        where l > 0) as mean_words
       from inter""")
def report(spark, folder):
    docs = D.table(spark, folder, "documents").where(F.length("text") > 0)
    lengths = docs.select("doc_id", S.word_count("text").alias("words"))
    rows = D.inter(spark, folder).join(lengths, "doc_id", "left")
    return profile.profile_report(rows.select(*PAIR, "rating", "words"), "words")


@query("d13_user_positives", "select distinct user_id, item_id from inter")
def positives(spark, folder):
    return core.user_positives(*[D.split(spark, folder, s) for s in ("train", "val", "test")])


@query("d14_n_users_items", "select max(user_id) + 1 as n_users, max(item_id) + 1 as n_items from inter")
def id_spaces(spark, folder):
    return core.n_users_items_frame(D.inter(spark, folder))


@query("d15_dedupe_pairs_mean", "select user_id, item_id, round(avg(rating), 6) as rating from inter group by all")
def deduped(spark, folder):
    return core.dedupe_pairs_mean(D.inter(spark, folder))


@query("d16_sum_pairs", "select user_id, item_id, sum(rating) as rating from inter group by all")
def summed(spark, folder):
    return core.sum_pairs(D.inter(spark, folder))


@query("d17_mean_ratings", """select item_id, round(avg(rating), 6) as mean_rating, (select round(avg(rating), 6) from train) as overall
       from train group by item_id""")
def means(spark, folder):
    train = D.split(spark, folder, "train")
    return core.item_mean_rating(train).withColumn("overall", core.global_mean_rating(train).scalar())


@query("d19_item_aspect_means", "select i as item_id, " + ", ".join(
    f"round(coalesce({a}, (select avg({a}) from means), 3), 6) as {a}" for a in S.VECTOR_ASPECTS) +
    " from range((select n from n_items)) as r(i) left join means on item_id = i",
    means="select item_id, " + ", ".join(f"avg({a}) as {a}" for a in S.VECTOR_ASPECTS) + " from train group by item_id")
def item_aspects(spark, folder):
    return aspects.item_aspect_means(D.split(spark, folder, "train"), D.n_items(spark, folder))


@query("d20_split_summary", """select split, count(*) as n, round(count(*) * 100.0 / (select count(*) from inter), 6) as pct,
       count(distinct user_id) as n_users, count(distinct item_id) as n_items from labelled group by split""")
def split_summary(spark, folder):
    return profile.split_summary(D.splits(spark, folder))


@query("d21_per_entity_count_summary", " union all ".join(
    f"""select '{k}' as entity, min(n) as least, quantile_cont(n, 0.5) as median, round(avg(n), 6) as mean, max(n) as most
        from (select count(*) as n from train group by {k})""" for k in PAIR))
def entity_counts(spark, folder):
    train = D.split(spark, folder, "train")
    return joins.union_splits(*[profile.per_entity_count_summary(train, k) for k in PAIR])


TIERS = ["g_id", "region_slug", "country_slug"]


@query("d22_tier_stats", " union all ".join(
    f"""select '{t}' as tier, count(*) as n_values, count(*) filter (where n = 1) as n_single,
        round(count(*) filter (where n = 1) * 100.0 / count(*), 6) as pct_single, max(n) as most_items,
        (max((n, value))).value as top_value
        from (select cast({t} as varchar) as value, count(*) as n from meta group by all)""".replace(
        "max((n, value))", "max({'n': n, 'value': value})") for t in TIERS))
def tiers(spark, folder):
    return profile.tier_stats(geo.item_meta(D.item_urls(spark, folder)), TIERS)


@query("d23_top_items", """select item_id, n, round(n * 100.0 / (select count(*) from train), 6) as pct
       from (select item_id, count(*) as n from train group by item_id) order by n desc, item_id limit 25""")
def top(spark, folder):
    return profile.top_items(D.split(spark, folder, "train"), 25)


@query("d24_core_retention", f"""select 'rows' as what, a.r as raw, b.r as kept, round(b.r * 100.0 / a.r, 6) as pct from a, b
       union all select 'users', a.u, b.u, round(b.u * 100.0 / a.u, 6) from a, b
       union all select 'items', a.i, b.i, round(b.i * 100.0 / a.i, 6) from a, b""",
       a="select count(*) as r, count(distinct user_id) as u, count(distinct item_id) as i from inter",
       b=f"""select count(*) as r, count(distinct user_id) as u, count(distinct item_id) as i from inter
       where user_id in (select user_id from e{ROUNDS}) and item_id in (select item_id from e{ROUNDS})""", **CORE)
def retention(spark, folder):
    rows = D.inter(spark, folder).select(*PAIR)
    return profile.core_retention(rows, joins.restrict_to_core(rows, kcore(spark, folder)))


# --- core, ids, splits ------------------------------------------------------------------------------

@query("e1_kcore", f"select user_id, item_id from e{ROUNDS}", **CORE)
def kcore_edges(spark, folder):
    return kcore(spark, folder)


@query("e2_kcore_trace", "select * from (" + " union all ".join(
    f"select {r} as round, count(distinct user_id) as users, count(distinct item_id) as items, count(*) as edges from e{r}"
    for r in range(1, ROUNDS + 1)) + ") t where round = 1 or edges <> (select count(*) from e1) and round <= "
    "(select min(r) from same) or round <= (select min(r) from same)",
    same=" union all ".join(f"select {r} as r where (select count(*) from e{r}) = (select count(*) from e{r - 1})"
                            for r in range(1, ROUNDS + 1)), **CORE)
def trace(spark, folder):
    return core.kcore_trace(D.inter(spark, folder), K)


@query("e3_kcore_stats", f"""select n_users, n_items, n_edges, round(100.0 * (1 - n_edges / (n_users::double * n_items)), 6) as sparsity
       from (select count(distinct user_id) as n_users, count(distinct item_id) as n_items, count(*) as n_edges from e{ROUNDS})""", **CORE)
def core_stats(spark, folder):
    return core.kcore_stats(kcore(spark, folder))


@query("e4_build_id_map", "select item_url as key, row_number() over (order by item_url) - 1 as id from (select distinct item_url from item_urls)")
def id_map(spark, folder):
    return core.build_id_map(D.item_urls(spark, folder), "item_url", buckets=16)


@query("e5_check_contiguous_ids", """select min(item_id) as low, max(item_id) as high, count(distinct item_id) as n_ids,
       min(item_id) = 0 and max(item_id) + 1 = count(distinct item_id) as contiguous from inter""")
def contiguous(spark, folder):
    return core.check_contiguous_ids(D.inter(spark, folder), "item_id")


@query("e6_random_split", "select row_key, split from labelled")
def labelled(spark, folder):
    return core.random_split(D.inter(spark, folder), ["row_key"]).select("row_key", "split")


@query("e7_split_to_tables", "select split, row_key, user_id, item_id, rating, date from labelled")
def split_tables(spark, folder):
    from rankwell.scratch import scratch_path

    rows = core.random_split(D.inter(spark, folder).select("row_key", *PAIR, "rating", "date"), ["row_key"])
    return spark.read.parquet(core.split_to_tables(rows, scratch_path(spark, "split-tables"))).select(
        "split", "row_key", *PAIR, "rating", "date")


@query("e8_review_sample", f"select row_key, user_id, item_id from inter order by md5(concat_ws('|', row_key, {D.SEED})) limit 2000")
def sampled(spark, folder):
    return core.review_sample(D.inter(spark, folder).select("row_key", *PAIR), 2000, ["row_key"])


@query("n6_split_quality_report", """
       select 'shared_pairs_train_val' as "check", n_shared::double as value from ({}) union all
       select 'shared_pairs_train_test', n_shared from ({}) union all select 'shared_pairs_val_test', n_shared from ({})
       union all select 'cold_user_id', count(*) from (select user_id from test except select user_id from train)
       union all select 'cold_item_id', count(*) from (select item_id from test except select item_id from train)
       """.format(_SHARED.format("train", "val"), _SHARED.format("train", "test"), _SHARED.format("val", "test"))
       + "".join(f"""union all select '{k}_least', min(n) from (select count(*) as n from train group by {k})
          union all select '{k}_median', quantile_cont(n, 0.5) from (select count(*) as n from train group by {k})
          union all select '{k}_mean', round(avg(n), 6) from (select count(*) as n from train group by {k})
          union all select '{k}_most', max(n) from (select count(*) as n from train group by {k}) """ for k in PAIR)
       + "".join(f"""union all select 'rows_{s}', count(*) from {s} union all select 'users_{s}', count(distinct user_id) from {s}
          union all select 'items_{s}', count(distinct item_id) from {s} """ for s in ("train", "val", "test")))
def split_quality(spark, folder):
    return reports.split_quality_report(*[D.split(spark, folder, s) for s in ("train", "val", "test")])
