"""Projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import derived as D
from checks.registry import query
from rankwell.functions import scalars as S
from rankwell.functions import vectors as V
from rankwell.operators import cleaning, geo, sequences

_WORDS = r"len(regexp_extract_all({}, '[^\x09-\x0d\x1c-\x20\x{{85}}\p{{Z}}]+'))"
WORDS = _WORDS.format("text")
_RATED = "try_cast(rating as double)"


@query("b1_valid_reviews", f"""select row_key as user_id, author, hotel_url, {_RATED} as rating from raw_reviews
       where coalesce({_RATED}, 0) > 0 and author <> '' and hotel_url <> ''""")
def valid(spark, folder):
    raw = D.raw_reviews(spark, folder).withColumn("rating", S.tolerant_double("rating"))
    return cleaning.valid_reviews(raw, "author", "hotel_url").select("user_id", "author", "hotel_url", "rating")


@query("b2_resolve_synonyms", """select coalesce(nullif(author, ''), row_key) as user_key, hotel_url as item_key, title
       from raw_reviews""")
def synonyms(spark, folder):
    named = cleaning.resolve_synonyms(D.raw_reviews(spark, folder), {
        "user_key": ["author", "user_url", "user_id"], "item_key": ["hotel_url", "item_id"]})
    return named.select("user_key", "item_key", "title")


_OTHER_ASPECTS = [a for a in cleaning.ASPECT_KEYS if a not in ("service", "check_in")]


@query("b3_flatten_aspects", "select row_key as user_id, service, check_in, "
       + ", ".join(f"cast(null as double) as {a}" for a in _OTHER_ASPECTS) + " from raw_reviews")
def flat(spark, folder):
    return cleaning.flatten_aspects(D.raw_reviews(spark, folder)).select("user_id", *cleaning.ASPECT_KEYS)


@query("b4_keep_existing", "select user_id, item_id, rating, date from inter")
def kept(spark, folder):
    return cleaning.keep_existing(D.inter(spark, folder), ["user_id", "item_id", "rating", "text", "date", "title"])


@query("b5_tolerant_cast", f"""select row_key as user_id, {_RATED} as rating,
       try_cast(replace(title, 'line ', '') as double) as line, try_cast(hotel_url as double) as none from raw_reviews""")
def numbers(spark, folder):
    return D.raw_reviews(spark, folder).select(
        "user_id", S.tolerant_double("rating").alias("rating"),
        S.tolerant_double(F.replace("title", F.lit("line "), F.lit(""))).alias("line"),
        S.tolerant_double("hotel_url").alias("none"))


@query("b6_word_count", f"select doc_id, {WORDS} as words from documents")
def words(spark, folder):
    return D.table(spark, folder, "documents").select("doc_id", S.word_count("text").alias("words"))


LENGTH_CASE = """case when {0} between 1 and 10 then '1-10' when {0} between 11 and 50 then '11-50'
    when {0} between 51 and 100 then '51-100' when {0} between 101 and 200 then '101-200'
    when {0} between 201 and 500 then '201-500' when {0} >= 501 then '501+' else '0' end"""
ACTIVITY_CASE = """case when {0} = 1 then '1-1' when {0} between 2 and 4 then '2-4' when {0} between 5 and 9 then '5-9'
    when {0} between 10 and 19 then '10-19' when {0} between 20 and 49 then '20-49'
    when {0} between 50 and 99 then '50-99' when {0} >= 100 then '100+' else '0' end"""


@query("b7_length_bucket", f"select doc_id, {LENGTH_CASE.format(WORDS)} as bucket from documents")
def length_buckets(spark, folder):
    return D.table(spark, folder, "documents").select("doc_id", S.length_bucket(S.word_count("text")).alias("bucket"))


@query("b8_activity_bucket", f"""select user_id, {ACTIVITY_CASE.format('n')} as bucket
       from (select user_id, count(*) as n from events group by user_id)""")
def activity_buckets(spark, folder):
    counts = D.table(spark, folder, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return counts.select("user_id", S.activity_bucket("n").alias("bucket"))


_ODD_DATE = """case when item_id % 5 = 0 then concat('July ', substr(date, 1, 4)) when item_id % 5 = 1 then ''
    when item_id % 5 = 2 then concat('1889-', date) when item_id % 5 = 3 then 'in summer' else date end"""


@query("b9_extract_year", f"""select row_key, odd, coalesce(
         case when try_cast(left(odd, 4) as int) between 1990 and 2030 then try_cast(left(odd, 4) as bigint) end,
         case when try_cast(right(odd, 4) as int) between 1990 and 2030 then try_cast(right(odd, 4) as bigint) end, -1) as year
       from (select row_key, {_ODD_DATE} as odd from inter)""")
def years(spark, folder):
    odd = D.inter(spark, folder).selectExpr("row_key", f"{_ODD_DATE} as odd")
    return odd.select("row_key", "odd", F.coalesce(S.extract_year("odd"), F.lit(-1)).alias("year"))


@query("b10_round_star", """select row_key, cast(round_even(item_id % 11 / 2.0, 0) as bigint) as star from inter""")
def stars(spark, folder):
    return D.inter(spark, folder).select("row_key", S.round_star(F.col("item_id") % 11 / 2.0).alias("star"))


_BLANKED = "case when doc_id % 7 = 0 then null when doc_id % 7 = 1 then '  ' else text end"


@query("b11_clean_text", f"""select doc_id, case when regexp_matches(coalesce(t, ''), '[^\\x09-\\x0d\\x1c-\\x20\\x{{85}}\\p{{Z}}]')
       then t else 'no review' end as text from (select doc_id, {_BLANKED} as t from documents)""")
def cleaned(spark, folder):
    docs = D.table(spark, folder, "documents").selectExpr("doc_id", f"{_BLANKED} as text")
    return docs.select("doc_id", S.clean_text("text").alias("text"))


@query("b12_text_policy", f"select doc_id, md5(lower(text)) as digest from documents where {WORDS} >= 20")
def policy(spark, folder):
    docs = cleaning.text_policy(D.table(spark, folder, "documents"), min_length=20)
    return docs.select("doc_id", F.md5("text").alias("digest"))


@query("b13_fill_missing_aspect_columns", """select row_key, service, rating as cleanliness, rating as location,
       rating as value, rating as rooms, rating as sleep_quality from inter""")
def filled(spark, folder):
    narrow = D.inter(spark, folder).select("row_key", "rating", "service")
    return cleaning.fill_missing_aspect_columns(narrow).drop("rating")


_UNIT = ", ".join(f"(coalesce({a}, 3) - 1) / 4" for a in S.VECTOR_ASPECTS)


@query("b14_normalise_aspects", f"""select row_key, i - 1 as pos, round(v[i], 6) as x
       from (select row_key, [{_UNIT}] as v from inter), range(1, 7) as r(i)""")
def aspect_vectors(spark, folder):
    vectors = cleaning.normalise_aspects(D.inter(spark, folder))
    return vectors.select("row_key", F.posexplode("aspects").alias("pos", "x"))


@query("b15_normalise_rating", "select row_key, (rating - 1) / 4 as target from inter")
def unit_ratings(spark, folder):
    return D.inter(spark, folder).select("row_key", S.unit_scale("rating").alias("target"))


@query("b16_parse_item_url", r"""select item_id, regexp_matches(item_url, p) as parsed,
       case when regexp_matches(item_url, p) then cast(regexp_extract(item_url, p, 1) as bigint) else -1 end as g_id,
       case when regexp_matches(item_url, p) then cast(regexp_extract(item_url, p, 2) as bigint) else -1 end as d_id,
       case when regexp_matches(item_url, p) then regexp_extract(item_url, p, 3) end as hotel_name,
       case when regexp_matches(item_url, p) then regexp_extract(item_url, p, 4) end as location_slug
       from (select *, '^Hotel_Review-g(\d+)-d(\d+)-Reviews-(.+?)-(.+?)\.html$' as p from item_urls)""")
def parsed_urls(spark, folder):
    parsed = D.item_urls(spark, folder).withColumn("p", S.parse_item_url("item_url"))
    return parsed.select("item_id", F.col("p").isNotNull().alias("parsed"), F.coalesce("p.g_id", F.lit(-1)).alias("g_id"),
                         F.coalesce("p.d_id", F.lit(-1)).alias("d_id"), "p.hotel_name", "p.location_slug")


@query("b17_region_country", "select item_id, region_slug, country_slug from meta")
def regions(spark, folder):
    return geo.item_meta(D.item_urls(spark, folder)).select("item_id", "region_slug", "country_slug")


@query("b18_clip", "select row_key, greatest(least(rating * 1.5 - 1, 5), 1) as x from inter")
def clipped(spark, folder):
    return D.inter(spark, folder).select("row_key", S.clip(F.col("rating") * 1.5 - 1).alias("x"))


_STRANGE = """case when item_id % 4 = 0 then cast('NaN' as double) when item_id % 4 = 1 then cast('Infinity' as double)
    when item_id % 4 = 2 then cast('-Infinity' as double) else rating end"""


@query("b19_nan_to_num", f"""select row_key, case when isnan(x) or isinf(x) then 0.0 else x end as x
       from (select row_key, {_STRANGE} as x from inter)""")
def finite(spark, folder):
    strange = D.inter(spark, folder).selectExpr("row_key", f"{_STRANGE} as x")
    return strange.select("row_key", S.finite_or_zero("x").alias("x"))


SEQUENCES = """select user_id, list(item_id order by date, row_key) as items
    from (select *, row_number() over (partition by user_id order by date desc, row_key desc) as rn from train)
    where rn <= {0} group by user_id"""


@query("b20_shift_ids", "select user_id, list_transform(items, lambda x: x + 1)::varchar as ids from s",
       s=SEQUENCES.format(50))
def shifted(spark, folder):
    seqs = sequences.user_sequences(D.split(spark, folder, "train"), 50)
    return seqs.select("user_id", list_text(V.shift_ids("items")).alias("ids"))


def list_text(array) -> F.Column:
    """An id array as text, written as the other engine writes lists."""
    return F.concat(F.lit("["), F.array_join(F.transform(array, lambda x: x.cast("string")), ", "), F.lit("]"))


PADDED = "(list_resize([]::bigint[], greatest({1} - len({0}), 0), 0::bigint) || list_slice({0}, greatest(len({0}) - {1}, 0) + 1, len({0})))"


@query("b21_left_pad", f"select user_id, {PADDED.format('items', 30)}::varchar as ids from s", s=SEQUENCES.format(50))
def left_padded(spark, folder):
    seqs = sequences.user_sequences(D.split(spark, folder, "train"), 50)
    return seqs.select("user_id", list_text(V.left_pad("items", 30)).alias("ids"))


@query("b22_default_rating", "select event_id, user_id, item_id, 1.0::double as rating from event_inter")
def implicit(spark, folder):
    events = D.event_inter(spark, folder).select("event_id", "user_id", "item_id")
    return cleaning.default_rating(events)


@query("b23_softmax", """select vec_id, i - 1 as pos, round(exp(e[i] - top) / total, 6) as x
       from (select *, list_sum(list_transform(e, lambda x: exp(x - top))) as total from
             (select vec_id, embedding::double[] as e, list_max(embedding::double[]) as top from embeddings)),
            range(1, 65) as r(i)""")
def soft(spark, folder):
    v = D.table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return v.select("vec_id", F.posexplode(V.softmax("e")).alias("pos", "x"))


@query("b24_hadamard_dot", """select a.vec_id, round(list_dot_product(a.e, b.e), 6) as dot,
       round(list_sum(list_transform(list_zip(a.e, b.e), lambda p, i: p[1] * p[2] * i)), 6) as every
       from v a join v b on b.vec_id = a.vec_id + 1""", v="select vec_id, embedding::double[] as e from embeddings")
def products(spark, folder):
    v = D.table(spark, folder, "embeddings").select("vec_id", "embedding")
    both = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    return both.select("vec_id", V.dot("embedding", "other").alias("dot"),
                       D.every_coordinate(V.hadamard("embedding", "other")).alias("every"))


@query("b25_sigmoid_bpr_loss", """select row_key, round(1 / (1 + exp(-(rating - 3))), 6) as sigmoid,
       round(-ln(1 / (1 + exp(-(rating - item_id % 5))) + 1e-8), 6) as loss from inter""")
def losses(spark, folder):
    return D.inter(spark, folder).select(
        "row_key", S.sigmoid(F.col("rating") - 3).alias("sigmoid"),
        S.pairwise_loss("rating", (F.col("item_id") % 5).cast("double")).alias("loss"))
