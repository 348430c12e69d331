"""Review-like views derived from the test tables, for Spark and as SQL common table expressions."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.operators import core, knn, popular, sampling
from rankwell.scratch import scratch_path, staged

SEED = 42
NEIGHBOURS = 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# One expression per derived column; the same text runs in both engines.
_ASPECT_SQL = {
    "service": "case when (l_partkey+l_linenumber)%10<8 then cast(1+(l_suppkey+l_linenumber)%5 as double) end",
    "cleanliness": "case when (l_partkey+l_linenumber)%10<6 then cast(1+(l_suppkey+2*l_linenumber)%5 as double) end",
    "location": "case when (l_orderkey+l_linenumber)%10<6 then cast(1+(l_partkey+l_linenumber)%5 as double) end",
    "value": "case when (l_suppkey+l_linenumber)%10<6 then cast(1+(l_partkey+l_suppkey)%5 as double) end",
    "rooms": "case when (l_orderkey+l_partkey)%10<6 then cast(1+(l_orderkey+l_suppkey)%5 as double) end",
    "sleep_quality": "case when (l_orderkey+l_suppkey)%20<11 then cast(1+l_orderkey%5 as double) end",
    "check_in": "cast(null as double)",
    "business_service": "cast(null as double)",
}
_ROW_KEY = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as bigint))"
_INTER_SQL = {
    "row_key": _ROW_KEY,
    "user_id": "o_custkey",
    "item_id": "l_partkey",
    "rating": "cast(ceil(l_quantity/10) as double)",
    "date": "substr(cast(o_orderdate as {text}),1,10)",
    **_ASPECT_SQL,
}


def inter(spark: SparkSession, folder: str) -> DataFrame:
    """Interactions: order lines as reviews of parts by customers."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, folder, "lineitem")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    cols = [f"{sql.format(text='string')} as {name}" for name, sql in _INTER_SQL.items()]
    n_docs = table(spark, folder, "documents").agg(F.count("*")).scalar()
    n_vecs = table(spark, folder, "embeddings").agg(F.count("*")).scalar()
    return joined.select(
        *[F.expr(c) for c in cols],
        ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % n_docs).alias("doc_id"),
        ((F.col("l_orderkey") + F.col("l_linenumber")) % n_vecs).alias("vec_id"),
    )


def item_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses to parse; one in fifty has another form."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    places = F.broadcast(nation.join(region, nation["n_regionkey"] == region["r_regionkey"]))  # 25 rows
    part = table(spark, folder, "part")
    return part.join(places, F.col("n_nationkey") == F.col("p_partkey") % 25).select(
        F.col("p_partkey").alias("item_id"), F.expr(_URL_SQL).alias("item_url"))


_URL_SQL = """case when p_partkey%50=49 then concat('Attraction-',p_partkey,'.html')
    else concat('Hotel_Review-g', case when p_partkey%97=0 then 10000+p_partkey else 100+n_nationkey end,
                '-d',p_partkey,'-Reviews-',replace(p_name,' ','_'),
                '-City',p_partkey%7,'_',n_name,'_',replace(r_name,' ','_'),'.html') end"""


def event_inter(spark: SparkSession, folder: str) -> DataFrame:
    """A second log, with times."""
    return table(spark, folder, "events").select(
        "event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("item_id"), "ts", "value")


# Raw reviews with the faults real files have: missing and zero ratings, words as ratings, empty
# authors, two spellings of one aspect.
_RAW_SQL = {
    "row_key": _ROW_KEY,
    "author": "case when (l_orderkey+l_partkey)%53=0 then '' else concat('user ', o_custkey) end",
    "hotel_url": "concat('hotel-', l_partkey)",
    "rating": "case when (l_orderkey+l_suppkey)%41=0 then null when (l_orderkey+l_suppkey)%41=1 then '0'"
              " when (l_orderkey+l_suppkey)%41=2 then 'good'"
              " else cast(cast(ceil(l_quantity/10) as bigint) as {text}) end",
    "text": "concat('review of order ', l_orderkey)",
    "title": "concat('line ', l_linenumber)",
    "date": "substr(cast(o_orderdate as {text}),1,10)",
    "service": _ASPECT_SQL["service"],
    "check_in": "case when (l_partkey+l_orderkey)%3<2 then cast(1+l_orderkey%5 as double) end",
    "odd": "l_linenumber%2",
}


def raw_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Raw reviews with a property map, ready to be written as JSON."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, folder, "lineitem")
    cols = [f"{sql.format(text='string')} as {name}" for name, sql in _RAW_SQL.items()]
    flat = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).selectExpr(*cols)
    spelling = F.when(F.col("odd") == 1, "check-in").otherwise("check in")
    pairs = F.array(
        F.struct(F.lit("service").alias("k"), F.col("service").alias("v")),
        F.struct(spelling.alias("k"), F.col("check_in").alias("v")))
    filled = F.filter(pairs, lambda p: p["v"].isNotNull())
    return flat.select(F.col("row_key").alias("user_id"), "author", "hotel_url", "rating", "text", "title", "date",
                       F.map_from_entries(filled).alias("property_dict"))


# Expensive inputs that many queries share are made once per session and folder.
@cache
def _splits(app: str, spark: SparkSession, folder: str) -> DataFrame:
    labelled = core.random_split(inter(spark, folder), ["row_key"], seed=SEED)
    return spark.read.parquet(core.split_to_tables(labelled, scratch_path(spark, "splits")))


@cache
def _neighbours(app: str, spark: SparkSession, folder: str, combine: str) -> DataFrame:
    return knn.itemknn_fit(split(spark, folder, "train"), NEIGHBOURS, combine)


@cache
def _candidates(app: str, spark: SparkSession, folder: str, part: str) -> DataFrame:
    everything = splits(spark, folder)
    pool = sampling.eval_candidates(split(spark, folder, part), core.user_positives(everything), n_items(spark, folder),
                                    seed=SEED)
    return staged(pool, f"candidates-{part}")


@cache
def _scores(app: str, spark: SparkSession, folder: str, part: str) -> DataFrame:
    from rankwell.operators import blending

    return staged(blending.score_table(candidates(spark, folder, part), scorers(spark, folder)), f"scores-{part}")


@cache
def _n_items(app: str, spark: SparkSession, folder: str) -> int:
    return core.n_users_items(splits(spark, folder))[1]


def _app(spark: SparkSession) -> str:
    return spark.sparkContext.applicationId


def forget() -> None:
    """Make the shared inputs anew, as a timed run must."""
    for made in (_splits, _neighbours, _candidates, _scores, _n_items):
        made.cache_clear()


def splits(spark: SparkSession, folder: str) -> DataFrame:
    return _splits(_app(spark), spark, folder)


def split(spark: SparkSession, folder: str, part: str) -> DataFrame:
    return splits(spark, folder).where(F.col("split") == part).drop("split")


def neighbours(spark: SparkSession, folder: str, combine: str = "sum") -> DataFrame:
    return _neighbours(_app(spark), spark, folder, combine)


def candidates(spark: SparkSession, folder: str, part: str = "test") -> DataFrame:
    return _candidates(_app(spark), spark, folder, part)


def n_items(spark: SparkSession, folder: str) -> int:
    return _n_items(_app(spark), spark, folder)


MODELS = ["pop", "knn", "mean"]


def scorers(spark: SparkSession, folder: str) -> dict:
    """Three exact models: popularity, neighbours, and the item's mean rating."""
    train = split(spark, folder, "train")
    fitted = popular.popularity_fit(train)
    history = core.sum_pairs(train)
    lists = neighbours(spark, folder)
    return {
        "pop": lambda pairs, out: popular.popularity_score(pairs, fitted, out),
        "knn": lambda pairs, out: knn.itemknn_score(pairs, lists, history, out=out),
        "mean": lambda pairs, out: popular.popularity_rating(pairs, train, out),
    }


def scores(spark: SparkSession, folder: str, part: str = "test") -> DataFrame:
    """The candidates with one score column per model of `MODELS`."""
    return _scores(_app(spark), spark, folder, part)


def vectors_of(rows: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Rows with the vector of their review."""
    return rows.join(table(spark, folder, "embeddings").select("vec_id", "embedding"), "vec_id")


def vectors_by(key: str, rows: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """`vectors_of` rows in order of `key`: they are dealt before they have vectors, whose sums are made of neighbours."""
    return vectors_of(rows.repartition(key).sortWithinPartitions(key), spark, folder)


DIM = 64


def every_coordinate(vector: Column) -> Column:
    """One number in which every coordinate counts with its place, from 1."""
    return F.aggregate(F.transform(vector, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda total, x: total + x)



# ---------------------------------------------------------------------------------------------------
# The same in SQL.  `with_ctes` puts the expressions a statement needs in front of it.

_HEX = "cast('0x' || substr(md5(concat_ws('|', {parts})),1,15) as bigint)"


def draw_sql(bound: str, *parts: str) -> str:
    return f"({_HEX.format(parts=', '.join(parts))} % nullif({bound}, 0))"


def unseen_sql(seen: str, r: str) -> str:
    return f"{r} + len(list_filter(list_transform({seen}, lambda p, i: p - (i - 1)), lambda f: f <= {r}))"


def _cands_sql(part: str) -> str:
    return f"""
      select row_key as row_id, user_id, item_id, cast(0 as bigint) as cand_idx, cast(1 as bigint) as label
      from {part}
      union all
      select row_key, user_id, cast({unseen_sql('seen', 'r')} as bigint), idx, cast(0 as bigint)
      from (
        select row_key, user_id, seen, idx,
               {draw_sql('(select n from n_items) - len(seen)', 'row_key', 'idx', str(SEED))} as r
        from {part} join seen_lists using (user_id), range(1, 100) as d(idx)
      ) where r is not null"""


def _scores_sql(part: str) -> str:
    return f"""
      select c.*, coalesce(p.score, 0.0) as pop, coalesce(k.score, 0.0) as knn,
             greatest(least(coalesce(m.mean_rating, (select avg(rating) from train)), 5.0), 1.0) as mean
      from cands_{part} c left join pop_scores p using (item_id) left join knn_scores k using (user_id, item_id)
      left join item_means m using (item_id)"""


def ranks_sql(source: str, score: str, extra: str = "") -> str:
    """Optimistic ranks of the positives of a scored candidate table."""
    return f"""
      select row_id, {extra} count(*) filter (where cand_idx <> 0 and {score} > t) as rank
      from (select *, max(case when cand_idx = 0 then {score} end) over (partition by row_id) as t from {source})
      group by all"""


def metrics_sql(rank: str = "rank", cutoffs: tuple = (5, 10, 20), digits: int = 6) -> str:
    parts = [f"round(avg(case when {rank} < {k} then 1.0 else 0.0 end), {digits}) as hr_{k}" for k in cutoffs]
    parts += [f"round(avg(case when {rank} < {k} then 1.0 / log2({rank} + 2) else 0.0 end), {digits}) as ndcg_{k}"
              for k in cutoffs]
    return ", ".join(parts)


def _inter_cte() -> str:
    cols = ",\n        ".join(f"{sql.format(text='varchar')} as {name}" for name, sql in _INTER_SQL.items())
    return f"""
      select {cols},
        (l_orderkey*7+l_linenumber) % (select count(*) from documents) as doc_id,
        (l_orderkey+l_linenumber) % (select count(*) from embeddings) as vec_id
      from lineitem join orders on l_orderkey=o_orderkey"""


def _raw_cte() -> str:
    cols = ",\n        ".join(f"{sql.format(text='varchar')} as {name}" for name, sql in _RAW_SQL.items())
    return f"select {cols} from lineitem join orders on l_orderkey=o_orderkey"


CTES = {
    "inter": _inter_cte(),
    "raw_reviews": _raw_cte(),
    "item_urls": f"""select p_partkey as item_id, {_URL_SQL} as item_url
      from part join nation on n_nationkey=p_partkey%25 join region on n_regionkey=r_regionkey""",
    "event_inter": """select event_id, user_id, cast(json_extract_string(props,'$.k') as bigint) as item_id, ts, value
      from events""",
    "labelled": f"""
      select * exclude (rn, n, hold), case when rn <= n - hold then 'train'
               when rn <= n - cast(ceil(round(hold * 0.5, 6)) as bigint) then 'val' else 'test' end as split
      from (select *, cast(ceil(round(n * 0.2, 6)) as bigint) as hold
            from (select *, row_number() over (order by md5(concat_ws('|', row_key, {SEED}))) as rn,
                         count(*) over () as n from inter))""",
    "train": "select * exclude split from labelled where split = 'train'",
    "val": "select * exclude split from labelled where split = 'val'",
    "test": "select * exclude split from labelled where split = 'test'",
    "n_items": "select max(item_id) + 1 as n from inter",
    "n_users": "select max(user_id) + 1 as n from inter",
    "seen_lists": "select user_id, list_sort(list(distinct item_id)) as seen from inter group by user_id",
    "train_lists": "select user_id, list_sort(list(distinct item_id)) as seen from train group by user_id",
    "cands_test": _cands_sql("test"),
    "cands_val": _cands_sql("val"),
    "summed": "select user_id, item_id, sum(rating) as rating from train group by all",
    "averaged": "select user_id, item_id, avg(rating) as rating from train group by all",
    "dots": """select a.item_id as item_a, b.item_id as item_b, sum(a.rating * b.rating) as dot
      from summed a join summed b on a.user_id = b.user_id and a.item_id < b.item_id group by all""",
    "norms": "select item_id, sqrt(sum(rating * rating)) as norm from summed group by item_id",
    "sims": """select item_a, item_b, dot / (a.norm * b.norm) as sim
      from dots join norms a on a.item_id = item_a join norms b on b.item_id = item_b""",
    "neighbours": f"""select * from (
        select *, row_number() over (partition by item_id order by round(sim, 9) desc, neighbour) as rank
        from (select item_a as item_id, item_b as neighbour, sim from sims
              union all select item_b, item_a, sim from sims) where sim > 0) where rank <= {NEIGHBOURS}""",
    "mean_dots": """select a.item_id as item_a, b.item_id as item_b, sum(a.rating * b.rating) as dot
      from averaged a join averaged b on a.user_id = b.user_id and a.item_id < b.item_id group by all""",
    "mean_norms": "select item_id, sqrt(sum(rating * rating)) as norm from averaged group by item_id",
    "mean_sims": """select item_a, item_b, dot / (a.norm * b.norm) as sim
      from mean_dots join mean_norms a on a.item_id = item_a join mean_norms b on b.item_id = item_b""",
    "mean_neighbours": f"""select * from (
        select *, row_number() over (partition by item_id order by round(sim, 9) desc, neighbour) as rank
        from (select item_a as item_id, item_b as neighbour, sim from mean_sims
              union all select item_b, item_a, sim from mean_sims) where sim > 0) where rank <= {NEIGHBOURS}""",
    "knn_scores": """select h.user_id, l.item_id, round(sum(l.sim * h.rating), 9) as score
      from summed h join neighbours l on l.neighbour = h.item_id group by all""",
    "pop_scores": """select item_id, cast(n as double) / max(n) over () as score
      from (select item_id, count(*) as n from train group by item_id)""",
    "item_means": "select item_id, avg(rating) as mean_rating from train group by item_id",
    "scores_test": _scores_sql("test"),
    "scores_val": _scores_sql("val"),
    "recommended": """select * from (
        select user_id, item_id, score, row_number() over (partition by user_id order by score desc, item_id) as rank
        from (select h.user_id, l.neighbour as item_id, round(sum(l.sim * h.rating), 9) as score
              from summed h join neighbours l on l.item_id = h.item_id group by all)
        where (user_id, item_id) not in (select user_id, item_id from summed)
      )""",
    # Lists that are too short go on with the items that score nothing, smallest ids first.
    "filled": """select user_id, item_id, score, rank from recommended union all
      select user_id, item_id, 0.0, coalesce(n, 0) + row_number() over (partition by user_id order by item_id) as rank
      from (select u.user_id, i.item_id, l.n from (select distinct user_id from inter) u, range((select n from n_items)) as i(item_id)
            left join (select user_id, count(*) as n from recommended group by user_id) l on l.user_id = u.user_id
            where coalesce(l.n, 0) < 200 and (u.user_id, i.item_id) not in (select user_id, item_id from summed)
              and (u.user_id, i.item_id) not in (select user_id, item_id from recommended))""",
    "meta": r"""
      select item_id, item_url, cast(regexp_extract(item_url, p, 1) as bigint) as g_id,
             regexp_extract(item_url, p, 3) as hotel_name, regexp_extract(item_url, p, 4) as location_slug,
             case when len(string_split(regexp_extract(item_url, p, 4), '_')) >= 2
                  then array_to_string(list_slice(string_split(regexp_extract(item_url, p, 4), '_'), -2, -1), '_')
                  else regexp_extract(item_url, p, 4) end as region_slug,
             list_extract(string_split(regexp_extract(item_url, p, 4), '_'), -1) as country_slug
      from (select *, '^Hotel_Review-g(\d+)-d(\d+)-Reviews-(.+?)-(.+?)\.html$' as p from item_urls)
      where regexp_matches(item_url, '^Hotel_Review-g(\d+)-d(\d+)-Reviews-(.+?)-(.+?)\.html$')""",
}


def with_ctes(statement: str, **more: str) -> str:
    """`statement` preceded by every common table expression it needs, directly or not."""
    known = {**CTES, **more}
    order: list[str] = []

    def visit(sql: str, own: str = "") -> None:
        for name in known:
            if name != own and name not in order and re.search(rf"\b(from|join|,)\s+{name}\b", sql):
                visit(known[name], name)
                if name not in order:
                    order.append(name)

    visit(statement)
    if not order:
        return statement
    return "with " + ",\n".join(f"{n} as materialized ({known[n]})" for n in order) + "\n" + statement
