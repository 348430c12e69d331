"""Sampling, sequences, text profiles, geography and graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import derived as D
from checks.columns import PADDED, SEQUENCES, list_text
from checks.registry import query
from checks.tables import PAIR, TIERS
from rankwell.functions import scalars as S
from rankwell.functions import vectors as V
from rankwell.operators import core, geo, graph, joins, sampling, sequences, text
from rankwell.scratch import staged


def _train(spark, folder):
    return D.split(spark, folder, "train")


def _triples_sql(m: int, lists: str = "train_lists") -> str:
    return f"""select row_key, user_id, item_id as pos_item, idx as draw, rating, aspects,
        {D.unseen_sql('seen', 'r')} as neg_item
      from (select row_key, user_id, item_id, seen, idx, rating, aspects,
              {D.draw_sql('(select n from n_items) - len(seen)', 'row_key', 'idx', str(D.SEED))} as r
            from (select *, [{', '.join(f'(coalesce({a}, 3) - 1) / 4' for a in S.VECTOR_ASPECTS)}] as aspects from train)
            join {lists} using (user_id), range(0, {m}) as d(idx)) where r is not null"""


@query("g1_bpr_triples", "select row_key, user_id, pos_item, draw, neg_item from t", t=_triples_sql(4))
def triples(spark, folder):
    return sampling.bpr_triples(_train(spark, folder), D.n_items(spark, folder), 4)


@query("g2_rated_triples", "select row_key, user_id, pos_item, draw, neg_item, rating, (rating - 1) / 4 as target from t",
       t=_triples_sql(2))
def rated(spark, folder):
    return sampling.rated_triples(_train(spark, folder), D.n_items(spark, folder), 2)


@query("g3_aspect_triples", "select row_key, user_id, pos_item, draw, neg_item, i - 1 as pos, round(aspects[i], 6) as x "
       "from t, range(1, 7) as r(i)", t=_triples_sql(1))
def with_aspects(spark, folder):
    made = sampling.aspect_triples(_train(spark, folder), D.n_items(spark, folder), 1)
    return made.select("row_key", "user_id", "pos_item", "draw", "neg_item", F.posexplode("aspects").alias("pos", "x"))


@query("g4_eval_candidates", "select row_id, user_id, item_id, cand_idx, label from cands_test")
def candidates(spark, folder):
    everything = D.splits(spark, folder)
    return sampling.eval_candidates(D.split(spark, folder, "test"), core.user_positives(everything),
                                    D.n_items(spark, folder), seed=D.SEED)


@query("g5_sequence_candidates", f"""select row_id, user_id, item_id, cand_idx, label, ids as history
       from (select row_key as row_id, user_id, item_id, 0 as cand_idx, 1 as label from test union all
             select row_key, user_id, {D.unseen_sql('seen', 'r')}, idx, 0 from (select row_key, user_id, seen, idx,
               {D.draw_sql('(select n from n_items) - len(seen)', 'row_key', 'idx', '44')} as r
               from test join seen_lists using (user_id), range(1, 100) as d(idx)) where r is not null)
       join (select user_id, {PADDED.format('list_transform(items, lambda x: x + 1)', 100)}::varchar as ids from s) using (user_id)""",
       s=SEQUENCES.format(100))
def sequence_candidates(spark, folder):
    seqs = sequences.user_sequences(_train(spark, folder), 100)
    made = sampling.sequence_candidates(D.split(spark, folder, "test"), core.user_positives(D.splits(spark, folder)), seqs,
                                        D.n_items(spark, folder), 100, 99, D.SEED + 2)
    return made.withColumn("history", list_text(F.col("history")))


@query("g6_first_negative_pairs", """select a.row_id, a.user_id, a.item_id as pos_item, b.item_id as neg_item
       from cands_val a join cands_val b on a.row_id = b.row_id and a.cand_idx = 0 and b.cand_idx = 1""")
def first_pairs(spark, folder):
    return sampling.first_negative_pairs(D.candidates(spark, folder, "val"))


@query("g7_pointwise_training_set", """select p.row_key, p.user_id, p.draw, p.item_id, p.label,
       round(list_dot_product(u.e, i.e), 6) as dot,
       round(list_sum(list_transform(list_zip(u.e, i.e), lambda x, k: x[1] * x[2] * k)), 6) as every
       from (select row_key, user_id, draw, pos_item as item_id, 1.0::double as label from t union all
             select row_key, user_id, draw, neg_item, 0.0::double from t) p
       join v u on u.vec_id = p.user_id % (select count(*) from embeddings)
       join v i on i.vec_id = p.item_id % (select count(*) from embeddings)""",
       t=_triples_sql(1), v="select vec_id, embedding::double[] as e from embeddings")
def pointwise(spark, folder):
    made = sampling.bpr_triples(_train(spark, folder), D.n_items(spark, folder), 1)
    users, items = _id_vectors(spark, folder)
    rows = sampling.pointwise_training_set(made, users, items)
    return rows.select("row_key", "user_id", "draw", "item_id", "label", "dot", D.every_coordinate(F.col("product")).alias("every"))


def _id_vectors(spark, folder):
    """Each user and item id with the vector of the same number, wrapped around."""
    e = D.table(spark, folder, "embeddings").select("vec_id", "embedding")
    n = e.agg(F.count("*")).scalar()
    rows = D.inter(spark, folder)
    side = lambda key, out: rows.select(key).distinct().withColumn("vec_id", F.col(key) % n).join(e, "vec_id").select(
        key, F.col("embedding").alias(out))
    return side("user_id", "user_vector"), side("item_id", "item_vector")


# --- sequences --------------------------------------------------------------------------------------

@query("h1_user_sequences", "select user_id, items::varchar as items from s", s=SEQUENCES.format(50))
def histories(spark, folder):
    return sequences.user_sequences(_train(spark, folder), 50).select("user_id", list_text(F.col("items")).alias("items"))


@query("h2_next_item_samples", f"""select user_id, position, ids as history, items[position + 1] as target, draw,
         {D.unseen_sql('seen', 'r')} as neg_item
       from (select user_id, items, position, draw, seen,
               {PADDED.format('list_transform(list_slice(items, 1, position), lambda x: x + 1)', 100)}::varchar as ids,
               {D.draw_sql('(select n from n_items) - len(seen)', 'user_id', 'position', 'draw', str(D.SEED))} as r
             from s join seen_lists using (user_id), range(1, 100) as p(position), range(0, 2) as d(draw)
             where position < len(items)) where r is not null""", s=SEQUENCES.format(100))
def next_items(spark, folder):
    seqs = sequences.user_sequences(_train(spark, folder), 100)
    samples = sequences.next_item_samples(seqs, core.user_positives(D.splits(spark, folder)), D.n_items(spark, folder), 100, 2)
    return samples.withColumn("history", list_text(F.col("history")))


@query("h3_history_length_stats", """select quantile_cont(n, 0.5) as p50, round(quantile_cont(n, 0.95), 6) as p95, max(n) as longest
       from (select count(*) as n from train group by user_id)""")
def lengths(spark, folder):
    return sequences.history_length_stats(_train(spark, folder))


@query("h4_previous_item", """select event_id, user_id, item_id, coalesce(lag(item_id) over (partition by user_id order by ts, event_id), -1) as prev_item
       from event_inter""")
def previous(spark, folder):
    events = D.event_inter(spark, folder).select("event_id", "user_id", "item_id", "ts")
    made = sequences.last_and_previous_item(events, ["ts", "event_id"], buckets=16)
    return made.select("event_id", "user_id", "item_id", F.coalesce("prev_item", F.lit(-1)).alias("prev_item"))


# --- text -------------------------------------------------------------------------------------------

def _mean_sql(rows: str, key: str, ids: str) -> str:
    return f"""select k as {key}, b.pos, round(coalesce(x, 0), 6) as x, x is not null as has_rows
      from range((select n from {ids})) as a(k), range(0, {D.DIM}) as b(pos)
      left join (select {key}, i - 1 as pos, avg(embedding[i]::double) as x
                 from {rows} join embeddings using (vec_id), range(1, {D.DIM + 1}) as r(i) group by all) m
      on m.{key} = k and m.pos = b.pos"""


def _long(profiles, key):
    return profiles.select(key, "has_rows", F.posexplode("vector").alias("pos", "x"))


@query("d18_average_vectors_by_id", _mean_sql("inter", "item_id", "n_items"))
def averaged(spark, folder):
    rows = D.vectors_of(D.inter(spark, folder), spark, folder)
    return _long(text.average_vectors_by_id(rows, "item_id", "embedding", D.DIM, D.n_items(spark, folder)), "item_id")


@query("i1_encode_reviews")
def encoded(spark, folder):
    docs = D.table(spark, folder, "documents").select("doc_id", "text")
    vectors = text.encode_reviews(docs, text.text_encoder(docs), out="vector")
    return vectors.select("doc_id", F.size("vector").alias("dim"), V.dot("vector", "vector").alias("norm"))


@query("i2_item_text_profile", _mean_sql("labelled", "item_id", "n_items"))
def item_profiles(spark, folder):
    rows = D.vectors_of(D.splits(spark, folder), spark, folder)
    return _long(text.item_text_profile(rows, "embedding", D.DIM, D.n_items(spark, folder)), "item_id")


_IN_TRAIN = "select * from inter where (user_id, item_id) in (select user_id, item_id from train)"


@query("i3_user_text_profile", _mean_sql("used", "user_id", "n_users"), used=_IN_TRAIN)
def user_profiles(spark, folder):
    everything = D.splits(spark, folder)
    n_users, _ = core.n_users_items(everything)
    rows = D.vectors_of(everything, spark, folder)
    return _long(text.user_text_profile(rows, _train(spark, folder), "embedding", D.DIM, n_users), "user_id")


_PROFILE = "select {0}, list(x order by pos) as v from (select {0}, i as pos, avg(embedding[i]::double) as x from {1} " \
           "join embeddings using (vec_id), range(1, 65) as r(i) group by all) group by {0}"


@query("i4_text_pair_features", """select t.row_key, t.user_id, t.item_id,
         round(list_dot_product(u.v, i.v) / (sqrt(list_dot_product(u.v, u.v)) * sqrt(list_dot_product(i.v, i.v))), 6) as text_cosine,
         round(list_sum(list_transform(list_zip(u.v, i.v), lambda x, k: x[1] * x[2] * k)), 6) as every
       from test t join users u using (user_id) join items i using (item_id)""",
       used=_IN_TRAIN, users=_PROFILE.format("user_id", "used"), items=_PROFILE.format("item_id", "inter"))
def pair_features(spark, folder):
    everything = D.splits(spark, folder)
    n_users, n_items = core.n_users_items(everything)
    rows = lambda key: D.vectors_by(key, everything.select(*PAIR, "vec_id"), spark, folder)
    users = text.user_text_profile(rows("user_id"), _train(spark, folder), "embedding", D.DIM, n_users)
    items = text.item_text_profile(rows("item_id"), "embedding", D.DIM, n_items)
    made = text.text_pair_features(
        D.split(spark, folder, "test").select("row_key", *PAIR),
        staged(users.where("has_rows").select("user_id", F.col("vector").alias("user_vector")), "user-profiles"),
        staged(items.where("has_rows").select("item_id", F.col("vector").alias("item_vector")), "item-profiles"))
    return made.select("row_key", *PAIR, "text_cosine", D.every_coordinate(F.col("text_product")).alias("every"))


# --- geography and graph ----------------------------------------------------------------------------

def _meta(spark, folder):
    return geo.item_meta(D.item_urls(spark, folder))


@query("j1_hotel_meta", "select item_id, item_url, g_id, hotel_name, location_slug, region_slug, country_slug from meta")
def meta(spark, folder):
    return _meta(spark, folder)


@query("j2_url_parse_failures", "select item_id, item_url from item_urls where item_id not in (select item_id from meta)")
def failures(spark, folder):
    return geo.url_parse_failures(D.item_urls(spark, folder))


GRAPH = {
    "tier_values": " union all ".join(f"select item_id, '{t}' as tier, cast({t} as varchar) as value from meta" for t in TIERS),
    "tier_ids": """select tier, value, row_number() over (partition by tier order by value) - 1 as local_id
        from (select distinct tier, value from tier_values)""",
    "layout": """select kind, size, coalesce(sum(size) over (order by position rows between unbounded preceding and 1 preceding), 0)::bigint as offset_
        from (select 0 as position, 'user' as kind, (select n from n_users) as size union all
              select 1, 'item', (select n from n_items) union all """ + " union all ".join(
        f"select {i + 2}, '{t}', (select count(*) from tier_ids where tier = '{t}')" for i, t in enumerate(TIERS)) + ")",
    "half_edges": """select user_id as a, item_id + (select n from n_users) as b from inter union all
        select item_id + (select n from n_users), local_id + offset_
        from tier_values join tier_ids using (tier, value) join layout on kind = tier""",
    "edges": "select a as src, b as dst, 1.0::double as w from half_edges union all select b, a, 1.0::double from half_edges",
    "degrees": "select src, sum(w) as degree from edges group by src",
    "adjacency": """select e.src, e.dst, e.w / sqrt(a.degree * b.degree) as w
        from (select src, dst, sum(w) as w from edges group by all) e
        join degrees a on a.src = e.src join degrees b on b.src = e.dst""",
}


def graph_parts(spark, folder, tiers=TIERS):
    """Edges and layout of the graph with the given tiers."""
    rows = D.inter(spark, folder).select(*PAIR)
    n_users, n_items = core.n_users_items(rows)
    if not tiers:
        none = spark.createDataFrame([], "tier string, value string, local_id long")
        return graph.hetero_edges(rows, n_users), graph.node_layout(n_users, n_items, none, [])
    found = staged(_meta(spark, folder), "meta")
    ids = staged(graph.tier_id_map(found, tiers), "tier-ids")
    layout = staged(graph.node_layout(n_users, n_items, ids, tiers), "layout")
    return graph.hetero_edges(rows, n_users, found, ids, layout), layout


@query("j3_tier_id_map", "select tier, value, local_id from tier_ids", **GRAPH)
def tier_ids(spark, folder):
    return graph.tier_id_map(_meta(spark, folder), TIERS)


@query("j4_node_layout", 'select kind, size, offset_ as "offset" from layout', **GRAPH)
def layout(spark, folder):
    return graph_parts(spark, folder)[1]


@query("j5_hetero_edges", "select src, dst, w from edges", **GRAPH)
def edges(spark, folder):
    return graph_parts(spark, folder)[0]


@query("j6_node_degree", "select src, degree from degrees", **GRAPH)
def degrees(spark, folder):
    return graph.node_degree(graph_parts(spark, folder)[0])


@query("j7_normalise_adjacency", "select src, dst, round(w, 6) as w from adjacency", **GRAPH)
def adjacency(spark, folder):
    return graph.normalise_adjacency(graph_parts(spark, folder)[0])


SUBSETS = {"none": [], "g": TIERS[:1], "gr": TIERS[:2], "grc": TIERS}


@query("j8_graph_summary", " union all ".join(
    f"""select '{name}' as tiers, (select n from n_users) as n_users, (select n from n_items) as n_items,
        (select count(*) from tier_ids where tier in ({', '.join(repr(t) for t in tiers + ['-'])})) as n_tier_nodes,
        (select n from n_users) + (select n from n_items) + (select count(*) from tier_ids where tier in ({', '.join(repr(t) for t in tiers + ['-'])})) as n_nodes,
        2 * ((select count(*) from inter) + (select count(*) from tier_values where tier in ({', '.join(repr(t) for t in tiers + ['-'])}))) as n_edges,
        2 * ((select count(*) from (select distinct user_id, item_id from inter)) + (select count(*) from tier_values where tier in ({', '.join(repr(t) for t in tiers + ['-'])}))) as n_distinct"""
    for name, tiers in SUBSETS.items()), **GRAPH)
def summaries(spark, folder):
    made = [graph.graph_summary(*graph_parts(spark, folder, tiers)).select(F.lit(name).alias("tiers"), "*")
            for name, tiers in SUBSETS.items()]
    return joins.union_splits(*made)


_DIM = 64


@query("j9_propagate", f"""select node, pos, round(sum(x) / 3, 6) as x from
       (select node, pos, x from l0 union all select node, pos, x from l1 union all select node, pos, x from l2) group by all""",
       l0=f"""select k as node, i - 1 as pos, embedding[i]::double as x
          from range((select max(src) + 1 from edges)) as a(k) join embeddings on vec_id = k % (select count(*) from embeddings),
          range(1, {_DIM + 1}) as r(i)""",
       l1="select src as node, pos, sum(w * x) as x from adjacency join l0 on l0.node = dst group by all",
       l2="select src as node, pos, sum(w * x) as x from adjacency join l1 on l1.node = dst group by all", **GRAPH)
def propagated(spark, folder):
    found, layout = graph_parts(spark, folder)
    e = D.table(spark, folder, "embeddings")
    n_vecs, n_nodes = e.count(), layout.agg(F.sum("size")).first()[0]
    nodes = spark.range(n_nodes).select(F.col("id").alias("node"), (F.col("id") % n_vecs).alias("vec_id")).join(
        e.select("vec_id", F.slice("embedding", 1, _DIM).alias("vector")), "vec_id")
    norm = staged(graph.normalise_adjacency(found), "adjacency")
    return graph.propagate(nodes, norm, 2, _DIM).select("node", F.posexplode("vector").alias("pos", "x"))


@query("j10_geo_cohort_items", """select item_id, tier, value as tier_value, count(*) over w - 1 as n_peers,
         round((coalesce(sum(v) over w, 0) - coalesce(v, 0)) / nullif(count(v) over w - case when v is null then 0 else 1 end, 0), 6) as peer_mean
       from tier_values left join (select item_id, avg(rating) as v from inter group by item_id) using (item_id)
       window w as (partition by tier, value)""", **GRAPH)
def cohorts(spark, folder):
    ratings = core.item_mean_rating(D.inter(spark, folder)).withColumnRenamed("mean_rating", "value")
    return graph.geo_cohort_items(_meta(spark, folder), TIERS, ratings)
