"""Recommenders, metrics, blending, retrieval, stacking and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks import derived as D
from checks.columns import SEQUENCES
from checks.registry import query
from checks.sources import epochs
from checks.tables import PAIR, TIERS
from rankwell.functions import scalars as S
from rankwell.operators import (
    aspects, blending, core, factors, fusion, geo, joins, knn, metrics, popular, profile, reports, retrieval, sampling,
    sequence_models, sequences, stacking, text,
)
from rankwell.scratch import staged

CUTS = ["hr_5", "hr_10", "hr_20", "ndcg_5", "ndcg_10", "ndcg_20"]


def _train(spark, folder):
    return D.split(spark, folder, "train")


def _pairs(spark, folder, part="test"):
    return D.split(spark, folder, part).select("row_key", *PAIR, "rating")


def evaluated(source: str, score: str, more: str = "") -> str:
    return f"select {more}{D.metrics_sql()}, count(*) as n from ({D.ranks_sql(source, score)})"


# --- exact recommenders -----------------------------------------------------------------------------

@query("flagship_popularity_ranking", evaluated("scores_p", "score"),
       scores_p="select c.*, coalesce(p.score, 0.0) as score from cands_test c left join pop_scores p using (item_id)")
def flagship(spark, folder):
    """Popularity evaluated on the one-positive, 99-negatives pool."""
    return evaluate_popularity(D.inter(spark, folder))


def evaluate_popularity(inter):
    from rankwell.plans import baselines

    return baselines.popularity_ranking(inter)


@query("k1_popularity", """select c.row_id, c.cand_idx, c.item_id, round(coalesce(p.score, 0.0), 6) as score
       from cands_test c left join pop_scores p using (item_id)""")
def popularity(spark, folder):
    scored = popular.popularity_score(D.candidates(spark, folder), popular.popularity_fit(_train(spark, folder)))
    return scored.select("row_id", "cand_idx", "item_id", "score")


@query("k2_popularity_rating", """select t.row_key, t.user_id, t.item_id, t.rating,
       round(greatest(least(coalesce(m.mean_rating, (select avg(rating) from train)), 5), 1), 6) as predicted
       from test t left join item_means m using (item_id)""")
def popularity_rating(spark, folder):
    return popular.popularity_rating(_pairs(spark, folder), _train(spark, folder))


@query("k3_global_mean_rating", """select row_key, user_id, item_id, rating, (select round(avg(rating), 6) from train) as predicted
       from test""")
def mean_rating(spark, folder):
    return popular.global_mean_predictor(_pairs(spark, folder), _train(spark, folder))


@query("k4_item_cosine", "select item_a, item_b, round(sim, 6) as sim from sims")
def cosines(spark, folder):
    return knn.item_cosine(core.sum_pairs(_train(spark, folder)))


@query("k5_topk_neighbours", "select item_id, neighbour, round(sim, 6) as sim, rank from neighbours")
def neighbour_lists(spark, folder):
    return knn.itemknn_fit(_train(spark, folder), D.NEIGHBOURS)


@query("k6_itemknn_score", """select c.row_id, c.cand_idx, c.user_id, c.item_id, round(coalesce(k.score, 0), 6) as score
       from cands_test c left join knn_scores k using (user_id, item_id)""")
def knn_scores(spark, folder):
    scored = knn.itemknn_score(D.candidates(spark, folder), D.neighbours(spark, folder), core.sum_pairs(_train(spark, folder)))
    return scored.select("row_id", "cand_idx", *PAIR, "score")


@query("k7_itemknn_score_unweighted", """select t.row_key, t.user_id, t.item_id, round(coalesce(s.score, 0), 6) as score
       from test t left join (select h.user_id, l.item_id, round(sum(l.sim), 9) as score
         from summed h join neighbours l on l.neighbour = h.item_id group by all) s using (user_id, item_id)""")
def knn_unweighted(spark, folder):
    history = core.sum_pairs(_train(spark, folder))
    pairs = _pairs(spark, folder).select("row_key", *PAIR)
    return knn.itemknn_score(pairs, D.neighbours(spark, folder), history, weighted=False)


@query("k8_itemknn_recommend", "select user_id, item_id, round(score, 6) as score, rank from filled where rank <= 10 and user_id in (select user_id from train)")
def recommended(spark, folder):
    train = _train(spark, folder)
    return knn.itemknn_recommend(train, D.neighbours(spark, folder), core.sum_pairs(train), 10)


@query("k9_itemknn_rating", """select t.row_key, t.user_id, t.item_id, t.rating,
         round(greatest(least(coalesce(s.p, (select avg(rating) from train)), 5), 1), 6) as predicted
       from test t left join (select h.user_id, l.item_id, sum(l.sim * h.rating) / sum(l.sim) as p
         from averaged h join mean_neighbours l on l.neighbour = h.item_id group by all) s using (user_id, item_id)""")
def knn_ratings(spark, folder):
    return knn.itemknn_rating(_pairs(spark, folder), D.neighbours(spark, folder, "mean"), _train(spark, folder))


# --- fitted recommenders (checked by rows) ----------------------------------------------------------

def _factors(spark, folder):
    return factors.latent_factor_ranker(_train(spark, folder))


@query("k10_latent_factor_ranker")
def latent(spark, folder):
    scored = _factors(spark, folder).score(D.candidates(spark, folder))
    return metrics.evaluate_ranking(scored)


# Which items are listed depends on the fit; how many are, none of them known, in falling order, does not.
@query("k10_latent_factor_lists", """select t.user_id, least(200, (select count(distinct item_id) from train) - count(distinct t.item_id)) as n_listed,
         0 as n_known, least(200, (select count(distinct item_id) from train) - count(distinct t.item_id)) as last_rank, 0 as n_rising
       from train t group by t.user_id
       having (select count(distinct item_id) from train) > count(distinct t.item_id)""")
def latent_lists(spark, folder):
    train = _train(spark, folder)
    lists = staged(factors.top_items(_factors(spark, folder), train, train, 200), "factor-lists")
    known = lists.join(train.select(*PAIR), PAIR, "left_semi").groupBy("user_id").agg(F.count("*").alias("n_known"))
    above = F.lag("score").over(Window.partitionBy("user_id").orderBy("rank"))
    sized = lists.select("user_id", "rank", "score", above.alias("above")).groupBy("user_id").agg(
        F.count("*").alias("n_listed"), F.max("rank").alias("last_rank"), F.count_if(F.col("score") > F.col("above")).alias("n_rising"))
    return sized.join(known, "user_id", "left").na.fill(0, ["n_known"])


@query("k11_latent_factor_rating")
def latent_rating(spark, folder):
    model = factors.latent_factor_rating(_train(spark, folder))
    return metrics.rating_errors(factors.predict_rating(model, _pairs(spark, folder)))


@query("k12_graph_factor_ranker")
def graph_factors(spark, folder):
    base, train = _factors(spark, folder), _train(spark, folder)
    meta = geo.item_meta(D.item_urls(spark, folder))
    pool = D.candidates(spark, folder)
    plain = factors.graph_factor_ranker(train, base).score(pool, "plain")
    tiered = factors.graph_factor_ranker(train, base, meta, TIERS).score(plain, "tiered")
    return blending.component_metrics(tiered, ["plain", "tiered"])


def _labelled(spark, folder):
    triples = sampling.bpr_triples(_train(spark, folder), D.n_items(spark, folder), 1)
    return sampling.pointwise_pairs(triples).select(*PAIR, "label")


def _inputs(spark, folder):
    train, everything = _train(spark, folder), D.splits(spark, folder)
    n_users, n_items = core.n_users_items(everything)
    rows = lambda key: D.vectors_by(key, everything.select(*PAIR, "vec_id"), spark, folder)
    return fusion.Inputs(
        factors=_factors(spark, folder),
        user_text=text.user_text_profile(rows("user_id"), train, "embedding", D.DIM, n_users),
        item_text=text.item_text_profile(rows("item_id"), "embedding", D.DIM, n_items),
        text_dim=D.DIM,
        weights=aspects.user_aspect_weights(train),
        item_aspects=aspects.item_aspect_means(train, n_items))


@query("k13_fusion_ranker")
def fused(spark, folder):
    made = _inputs(spark, folder)
    texts = {"user_text": made.user_text, "item_text": made.item_text, "text_dim": D.DIM}
    variants = {
        "all": made,
        "factors_only": fusion.Inputs(factors=made.factors),
        "text_only": fusion.Inputs(**texts),
        "no_attention": fusion.Inputs(factors=made.factors, **texts),
    }
    labelled = made.written(_labelled(spark, folder), "labelled")
    models = {name: fusion.fusion_ranker(labelled, inputs, [16], iterations=5) for name, inputs in variants.items()}
    # Hundreds of numbers for each of a hundred candidates per row: made where they are used, and never written.
    out = made.add(D.candidates(spark, folder))
    for name, model in models.items():
        out = model.score(out, name)
    return blending.component_metrics(out, list(variants))


@query("k14_multitask_ranker")
def multitask(spark, folder):
    inputs = fusion.Inputs(factors=_factors(spark, folder))
    model = fusion.multitask_ranker(_labelled(spark, folder), _train(spark, folder).select(*PAIR, "rating"), inputs,
                                    hidden=[16], iterations=5, trees=3)
    return metrics.evaluate_ranking(model.score(D.candidates(spark, folder)))


def _aspect_inputs(spark, folder):
    """Features of pairs from training rows alone: aspect means of both sides and the product of their texts."""
    n_users, n_items = core.n_users_items(D.splits(spark, folder))
    rows = _train(spark, folder)
    train = staged(D.vectors_of(rows, spark, folder).drop("embedding"), "train-rows")  # those that have a vector, without it
    profile = lambda key, n, name: text.average_vectors_by_id(
        D.vectors_by(key, rows.select(key, "vec_id"), spark, folder), key, "embedding", D.DIM, n).select(key, F.col("vector").alias(name))
    weights = aspects.user_aspect_weights(train)
    # All that is looked up of a side stands in one table, so pairs are shuffled once, without features.
    of_users, of_items = aspects.aspect_sides(train)
    users = staged(profile("user_id", n_users, "user_vector").join(of_users, "user_id", "left").join(
        weights.select("user_id", F.col("weights").alias("_weights")), "user_id", "left"), "user-side")
    items = staged(profile("item_id", n_items, "item_vector").join(of_items, "item_id", "left"), "item-side")

    def ready(pairs, own=False):
        made = aspects.aspect_pair_features(text.text_pair_features(pairs, users, items), train, own=own)
        return made.withColumn("features", F.concat("aspect_means", "text_product"))

    dim = D.DIM + 2 * len(S.VECTOR_ASPECTS)
    model = aspects.aspect_regressors(ready(train.select(*PAIR, *S.VECTOR_ASPECTS), own=True), "features", dim)
    return lambda pairs: aspects.decomposed_score(aspects.predict_aspects(ready(pairs), model, "features"), weights)


@query("k15_aspect_regressors")
def regressors(spark, folder):
    """Aspects of test pairs; neither their ratings nor their texts are read."""
    pairs = D.split(spark, folder, "test").select("row_key", *PAIR)
    scored = _aspect_inputs(spark, folder)(pairs)
    return scored.select("row_key", *PAIR, *[f"{a}_hat" for a in S.VECTOR_ASPECTS], "score")


@query("k15_aspect_ranking")
def aspect_ranking(spark, folder):
    """The same score over the candidates of every test row."""
    return metrics.evaluate_ranking(_aspect_inputs(spark, folder)(D.candidates(spark, folder)))


@query("k15_aspect_lines", " union all ".join(
           f"""select '{a}' as aspect, regr_count({a}, mean_rating) as n, round(regr_slope({a}, mean_rating), 6) as slope,
       round(regr_intercept({a}, mean_rating), 6) as intercept from joined""" for a in S.VECTOR_ASPECTS),
       joined="select t.*, m.mean_rating from train t join item_means m using (item_id)")
def aspect_lines(spark, folder):
    """All lines on one feature, the item's mean rating, without a ridge."""
    train = _train(spark, folder)
    means = train.groupBy("item_id").agg(F.array(F.avg("rating")).alias("features"))
    model = aspects.aspect_regressors(train.join(means, "item_id"), "features", 1, regularisation=0.0)
    lines = [(a, model.counts[a], model.coefficients[a][0], model.intercepts[a]) for a in S.VECTOR_ASPECTS]
    return spark.createDataFrame(lines, "aspect string, n long, slope double, intercept double")


_LOGITS = "select user_id, [" + ", ".join(f"coalesce(covar_samp({a}, rating), 0)" for a in S.VECTOR_ASPECTS) + \
          "] as z from train group by user_id"
_WEIGHTS = """select user_id, i, exp(z[i] - list_max(z)) / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))) as weight
    from logits, range(1, 7) as r(i)"""
ATTENTION = {"logits": _LOGITS, "aspect_weights": _WEIGHTS}


@query("k16_user_aspect_weights", "select user_id, i - 1 as pos, round(weight, 6) as weight from aspect_weights", **ATTENTION)
def weights(spark, folder):
    made = aspects.user_aspect_weights(_train(spark, folder))
    return made.select("user_id", F.posexplode("weights").alias("pos", "weight"))


@query("k17_quality_score", """select t.row_key, t.user_id, t.item_id, t.rating, round(sum(coalesce(w.weight, 1 / 6.0) * a.x), 6) as quality
       from test t, range(1, 7) as r(i) left join aspect_weights w on w.user_id = t.user_id and w.i = r.i
       join filled a on a.item_id = t.item_id and a.i = r.i group by all""",
       means="select item_id, " + ", ".join(f"avg({a}) as {a}" for a in S.VECTOR_ASPECTS) + " from train group by item_id",
       filled="select k as item_id, i, [" + ", ".join(
           f"coalesce({a}, (select avg({a}) from means), 3)" for a in S.VECTOR_ASPECTS) +
       "][i] as x from range((select n from n_items)) as g(k) left join means on item_id = k, range(1, 7) as r(i)", **ATTENTION)
def quality(spark, folder):
    train = _train(spark, folder)
    return aspects.quality_score(_pairs(spark, folder), aspects.user_aspect_weights(train),
                                 aspects.item_aspect_means(train, D.n_items(spark, folder)))


@query("k18_attention_summary", "select ([" + ", ".join(f"'{a}'" for a in S.VECTOR_ASPECTS) +
       "])[i] as aspect, round(avg(weight), 6) as mean, round(stddev_pop(weight), 6) as std from aspect_weights group by all", **ATTENTION)
def attention(spark, folder):
    return aspects.attention_summary(aspects.user_aspect_weights(_train(spark, folder)))


@query("k19_sequence_ranker")
def sequence_model(spark, folder):
    seqs = sequences.user_sequences(_train(spark, folder), 50)
    model = sequence_models.sequence_ranker(seqs)
    return metrics.evaluate_ranking(model.score(D.candidates(spark, folder)))


@query("k19_sequence_cooccurrence", """select prev_item, item_id, count(*) as n, round(sum(1.0::double / d), 6) as weight
       from (select items[p] as prev_item, items[p + d] as item_id, d
             from seqs, range(1, 51) as a(p), range(1, 6) as b(d) where p + d <= len(items))
       where prev_item <> item_id group by all""", seqs=SEQUENCES.format(50))
def sequence_counts(spark, folder):
    return sequence_models.sequence_cooccurrence(sequences.user_sequences(_train(spark, folder), 50))


@query("k19_sequence_users", """select s.user_id, count(distinct i)::bigint as n_known, 32::bigint as dim
       from (select user_id, unnest(items) as i from seqs) s
       where i in (select items[p] from seqs, range(1, 51) as a(p), range(1, 6) as b(d)
                   where p + d <= len(items) and items[p] <> items[p + d]) group by s.user_id""", seqs=SEQUENCES.format(50))
def sequence_users(spark, folder):
    """Users with a vector, its length and the number of items it is made of."""
    seqs = sequences.user_sequences(_train(spark, folder), 50)
    model = sequence_models.sequence_ranker(seqs)
    known = sequence_models.sequence_cooccurrence(seqs).select(F.col("prev_item").alias("item_id")).distinct()
    n = seqs.select("user_id", F.explode("items").alias("item_id")).distinct().join(known, "item_id", "left_semi")
    n = n.groupBy("user_id").agg(F.count("*").alias("n_known"))
    return model.users.join(n, "user_id", "left").select("user_id", "n_known", F.size("user_vector").alias("dim"))


STEPS = {
    "steps": """select * from (select user_id, item_id, lag(item_id) over (partition by user_id order by ts, event_id) as prev_item
        from event_inter) where prev_item is not null""",
    "transitions": """select prev_item, item_id, n, n::double / sum(n) over (partition by prev_item) as p
        from (select prev_item, item_id, count(*) as n from steps group by all)""",
}


@query("k20_transition_ranker", "select prev_item, item_id, n, round(p, 6) as p from transitions", **STEPS)
def transitions(spark, folder):
    return sequence_models.transition_table(D.event_inter(spark, folder), ["ts", "event_id"])


@query("k21_score_pairs", """select e.event_id, e.user_id, e.item_id, round(coalesce(t.p, 0), 6) as step,
         round(coalesce(p.score, 0), 6) as pop
       from event_inter e join (select user_id, arg_max(item_id, {'t': ts, 'e': event_id}) as last_item from event_inter group by user_id) l using (user_id)
       left join transitions t on t.prev_item = l.last_item and t.item_id = e.item_id
       left join pop_scores p on p.item_id = e.item_id""", **STEPS)
def contract(spark, folder):
    events = D.event_inter(spark, folder)
    model = sequence_models.transition_ranker(events, ["ts", "event_id"])
    fitted = popular.popularity_fit(_train(spark, folder))
    out = blending.score_pairs(events.select("event_id", *PAIR), model.score, "step")
    return blending.score_pairs(out, lambda pairs, name: popular.popularity_score(pairs, fitted, name), "pop")


# --- metrics ----------------------------------------------------------------------------------------

def _tied(tie: str) -> str:
    equal = {"optimistic": "0", "pessimistic": "1", "mean": "0.5"}[tie]
    return f"""select '{tie}' as tie, row_id, sum(case when cand_idx = 0 then 0 when knn > t then 1 when knn = t then {equal} else 0 end)::double as rank
      from (select *, max(case when cand_idx = 0 then knn end) over (partition by row_id) as t from scores_test) group by row_id"""


@query("l1_rank_of_positive", " union all ".join(_tied(t) for t in metrics.TIES))
def ranks(spark, folder):
    scored = D.scores(spark, folder)
    made = [metrics.rank_of_positive(scored, "knn", t).select(F.lit(t).alias("tie"), "row_id", "rank") for t in metrics.TIES]
    return joins.union_splits(*made)



@query("l2_hit_ratio", f"""select round(avg(case when rank < 10 then 1.0 else 0.0 end), 6) as hr_10 from ({D.ranks_sql('scores_test', 'knn')})""")
def hits(spark, folder):
    return metrics.hit_ratio(metrics.rank_of_positive(D.scores(spark, folder), "knn"), 10)


@query("l3_ndcg", f"""select round(avg(case when rank < 10 then 1.0 / log2(rank + 2) else 0 end), 6) as ndcg_10 from ({D.ranks_sql('scores_test', 'knn')})""")
def gains(spark, folder):
    return metrics.ndcg(metrics.rank_of_positive(D.scores(spark, folder), "knn"), 10)


@query("l4_evaluate_ranking", evaluated("scores_test", "knn"))
def ranking(spark, folder):
    return metrics.evaluate_ranking(D.scores(spark, folder), "knn")


@query("l5_ranked_list", """select row_id, cand_idx, item_id,
       row_number() over (partition by row_id order by knn desc, cand_idx) as position from scores_test""")
def full_order(spark, folder):
    return metrics.ranked_list(D.scores(spark, folder), "knn").select("row_id", "cand_idx", "item_id", "position")


@query("l6_mean_bpr_loss", """select round(avg(-ln(1 / (1 + exp(-(a.pop - b.pop))) + 1e-8)), 6) as loss, count(*) as n
       from scores_val a join scores_val b on a.row_id = b.row_id and a.cand_idx = 0 and b.cand_idx = 1""")
def pair_loss(spark, folder):
    pairs = sampling.first_negative_pairs(D.candidates(spark, folder, "val"))
    fitted = popular.popularity_fit(_train(spark, folder))
    side = lambda df, key, out: popular.popularity_score(df.withColumnRenamed(key, "item_id"), fitted, out).drop("item_id")
    return metrics.mean_pairwise_loss(side(side(pairs, "pos_item", "pos_score"), "neg_item", "neg_score"))


@query("l7_rating_errors", """select round(sqrt(avg((p - rating) ** 2)), 6) as rmse, round(avg(abs(p - rating)), 6) as mae, count(*) as n
       from (select t.rating, greatest(least(coalesce(m.mean_rating, (select avg(rating) from train)), 5), 1) as p
             from test t left join item_means m using (item_id))""")
def errors(spark, folder):
    return metrics.rating_errors(popularity_rating(spark, folder))


CALIBRATION = {
    part + "_rated": f"""select t.row_key, t.user_id, t.item_id, t.rating, coalesce(k.score, 0) as score
        from {part} t left join knn_scores k using (user_id, item_id)""" for part in ("val", "test")
} | {"line": """select coalesce(regr_slope(rating, score), 0) as a, coalesce(regr_intercept(rating, score), avg(rating)) as b,
        stddev_pop(score) as score_std, count(*) as n from val_rated"""}


def _rated(spark, folder, part):
    history = core.sum_pairs(_train(spark, folder))
    return knn.itemknn_score(_pairs(spark, folder, part), D.neighbours(spark, folder), history)


@query("l8_fit_calibration", "select round(a, 6) as a, round(b, 6) as b, round(score_std, 6) as score_std, n from line", **CALIBRATION)
def line(spark, folder):
    return metrics.fit_calibration(_rated(spark, folder, "val"))


@query("l9_evaluate_calibrated", """select round(sqrt(avg((p - rating) ** 2)), 6) as rmse, round(avg(abs(p - rating)), 6) as mae, count(*) as n,
       round(max(a), 6) as a, round(max(b), 6) as b
       from (select t.rating, l.a, l.b, greatest(least(l.a * t.score + l.b, 5), 1) as p from test_rated t, line l)""", **CALIBRATION)
def calibrated(spark, folder):
    return metrics.evaluate_calibrated(_rated(spark, folder, "val"), _rated(spark, folder, "test"))


@query("l10_val_score_std", """select 'knn' as model, round(stddev_pop(score), 6) as score_std, null::varchar as note from val_rated
       union all select 'constant', 0.0, 'scores near-constant' from (select count(*) from val_rated)""", **CALIBRATION)
def spread(spark, folder):
    val = _rated(spark, folder, "val")
    flat = popular.global_mean_predictor(val.drop("score"), _train(spark, folder), "score")
    return metrics.val_score_std(val).select(F.lit("knn").alias("model"), "*").unionByName(
        metrics.val_score_std(flat).select(F.lit("constant").alias("model"), "*"))


_POSITIVES = {
    f"{part}_pos": f"""select s.knn as score, r.rating from scores_{part} s join
        (select user_id, item_id, avg(rating) as rating from {part} group by all) r using (user_id, item_id) where s.label = 1"""
    for part in ("val", "test")
} | {"line": "select regr_slope(rating, score) as a, regr_intercept(rating, score) as b from val_pos"}


@query("l11_calibrate_positives", """select round(sqrt(avg((p - rating) ** 2)), 6) as rmse, round(avg(abs(p - rating)), 6) as mae, count(*) as n,
       round(max(a), 6) as a, round(max(b), 6) as b
       from (select t.rating, l.a, l.b, greatest(least(l.a * t.score + l.b, 5), 1) as p from test_pos t, line l)""", **_POSITIVES)
def positives_line(spark, folder):
    return metrics.calibrate_positives(
        D.scores(spark, folder, "val"), D.split(spark, folder, "val"),
        D.scores(spark, folder, "test"), D.split(spark, folder, "test"), "knn")


@query("l12_best_epoch", """select item_id, arg_max(epoch, {'v': value, 'o': -k}) as best_epoch, round(max(value), 6) as best_value,
         coalesce(max(stop_at), -1) as stopped_at
       from (select *, min(case when k - last_gain >= 2 then epoch end) over (partition by item_id) as stop_at
             from (select *, coalesce(max(case when gain then k end) over (partition by item_id order by epoch), 0) as last_gain
                   from (select *, row_number() over w as k, value > coalesce(max(value) over
                           (w rows between unbounded preceding and 1 preceding), 0) as gain
                         from log window w as (partition by item_id order by epoch))))
       where stop_at is null or epoch <= stop_at group by item_id""",
       log="select item_id, cast(substr(date, 1, 4) as bigint) as epoch, avg(rating) as value from inter group by all")
def stopping(spark, folder):
    log = D.inter(spark, folder).groupBy("item_id", F.substring("date", 1, 4).cast("long").alias("epoch")).agg(
        F.avg("rating").alias("value"))
    made = metrics.best_epoch(log, "value", 2, ["item_id"])
    return made.withColumn("stopped_at", F.coalesce("stopped_at", F.lit(-1)))


@query("l13_sampled_metric_check", f"""select round(hr_full, 6) as hr_full, round(hr_sample, 6) as hr_sample,
         round(abs(hr_full - hr_sample), 6) as difference
       from (select avg(case when rank < 10 then 1.0 else 0 end) as hr_full,
               avg(case when rank < 10 then 1.0 else 0 end) filter (where row_id in
                 (select row_key from test order by md5(concat_ws('|', row_key, {D.SEED})) limit 1000)) as hr_sample
             from ({D.ranks_sql('scores_test', 'pop')}))""")
def sample_check(spark, folder):
    return metrics.sampled_metric_check(D.scores(spark, folder), D.split(spark, folder, "test"), 1000, score="pop")


# --- blending ---------------------------------------------------------------------------------------

def _scaled_sql(source: str, over: str, smallest: str) -> str:
    cols = ", ".join(
        f"({m} - min({m}) over w) / case when max({m}) over w - min({m}) over w {smallest} then 1.0 "
        f"else max({m}) over w - min({m}) over w end as {m}" for m in D.MODELS)
    return f"select row_id, user_id, item_id, cand_idx, label, {cols} from {source} window w as (partition by {over})"


SCALED = {
    f"scaled_{part}": _scaled_sql(f"scores_{part}", "row_id", "< 1e-8") for part in ("val", "test")
} | {f"by_user_{part}": _scaled_sql(f"scores_{part}", "user_id", "= 0") for part in ("val", "test")}
_ROUNDED = "select row_id, cand_idx, " + ", ".join(f"round({m}, 6) as {m}" for m in D.MODELS) + " from {}"


@query("m1_minmax_by_group", _ROUNDED.format("scaled_test"), **SCALED)
def scaled(spark, folder):
    return blending.minmax_by_group(D.scores(spark, folder), D.MODELS).select("row_id", "cand_idx", *D.MODELS)


@query("m2_minmax_by_user", _ROUNDED.format("by_user_test"), **SCALED)
def scaled_by_user(spark, folder):
    return blending.minmax_by_user(D.scores(spark, folder), D.MODELS).select("row_id", "cand_idx", *D.MODELS)


@query("m3_score_table", "select row_id, cand_idx, user_id, item_id, label, " + ", ".join(
    f"round({m}, 6) as {m}" for m in D.MODELS) + " from scores_test")
def score_table(spark, folder):
    made = blending.score_table(D.candidates(spark, folder), D.scorers(spark, folder))
    return made.select("row_id", "cand_idx", *PAIR, "label", *D.MODELS)


@query("m4_blend", evaluated("mixed", "blend"), mixed="select *, 0.2 * pop + 0.5 * knn + 0.3 * mean as blend from scaled_test", **SCALED)
def blended(spark, folder):
    scaled = blending.minmax_by_group(D.scores(spark, folder), D.MODELS)
    return metrics.evaluate_ranking(blending.blend(scaled, {"pop": 0.2, "knn": 0.5, "mean": 0.3}), "blend")


GRID = blending.weight_grid(0.1)
_GRID_CTES = {
    "grid": "select * from (values " + ", ".join(
        f"({i}, {a}::double, {b}::double, {c}::double)" for i, (a, b, c) in enumerate(GRID)) + ") as g(combo, a, b, c)",
    "truths": "select row_id, pop, knn, mean from scaled_val where cand_idx = 0",
    "grid_ranks": """select combo, s.row_id, count(*) filter (where a * s.pop + b * s.knn + c * s.mean > a * t.pop + b * t.knn + c * t.mean) as rank
        from scaled_val s join truths t using (row_id), grid where cand_idx <> 0 group by all""",
    "grid_metrics": "select combo, " + D.metrics_sql(digits=12) + " from grid_ranks group by combo",
}
_GRID_COLUMNS = ", ".join(f"round({c}, 6) as {c}" for c in CUTS)


def _grid(spark, folder):
    scaled = blending.minmax_by_group(D.scores(spark, folder, "val"), D.MODELS)
    return blending.grid_search(scaled, D.MODELS, GRID)


@query("m5_weight_grid", "select combo, a as w_pop, b as w_knn, c as w_mean, (select count(*) from scores_val) as n_rows from grid", **SCALED, **_GRID_CTES)
def grid(spark, folder):
    one = D.scores(spark, folder, "val").agg(F.count("*").alias("n_rows"))
    combos = F.array(*[F.struct(F.lit(i).cast("long").alias("combo"), *[F.lit(w).alias(f"w_{m}") for m, w in zip(D.MODELS, c)])
                       for i, c in enumerate(GRID)])
    return one.select("n_rows", F.inline(combos))


@query("m6_grid_search", f"select combo, a as w_pop, b as w_knn, c as w_mean, {_GRID_COLUMNS} from grid_metrics join grid using (combo)",
       **SCALED, **_GRID_CTES)
def grid_search(spark, folder):
    return _grid(spark, folder)


@query("m7_evaluate_blend", evaluated("mixed", "blend"), best="select g.* from grid_metrics join grid g using (combo) order by round(ndcg_10, 9) desc, combo limit 1",
       mixed="select s.*, a * pop + b * knn + c * mean as blend from scaled_test s, best", **SCALED, **_GRID_CTES)
def best_blend(spark, folder):
    best = blending.best_weights(_grid(spark, folder))
    scaled = blending.minmax_by_group(D.scores(spark, folder), D.MODELS)
    return blending.evaluate_blend(scaled, best, D.MODELS)


# --- two stages -------------------------------------------------------------------------------------

N = 200
STAGES = {
    "retrieved": f"select user_id, item_id, score, rank from filled where rank <= {N}",
    "asked": """select t.row_key as row_id, t.user_id, t.item_id as truth, r.item_id is not null as was_retrieved,
          coalesce(s.size, 0) as size from test t left join retrieved r on r.user_id = t.user_id and r.item_id = t.item_id
        left join (select user_id, max(rank) as size from retrieved group by user_id) s on s.user_id = t.user_id""",
    "pool": f"""select row_id, a.user_id, item_id, rank as position, item_id = truth as is_truth, was_retrieved
        from asked a join retrieved r on r.user_id = a.user_id where was_retrieved or rank < {N}
        union all select row_id, user_id, truth, least(size + 1, {N}), true, false from asked where not was_retrieved""",
    "reranked": """select p.*, coalesce(s.score, 0) as score,
          row_number() over (partition by row_id order by coalesce(s.score, 0) desc, position) as new_rank
        from pool p left join pop_scores s using (item_id)""",
}


def _retrieved(spark, folder):
    train = _train(spark, folder)
    return retrieval.retrieve_topn(D.split(spark, folder, "test"), D.neighbours(spark, folder), core.sum_pairs(train), N)


def _pool(spark, folder):
    return retrieval.inject_truth(D.split(spark, folder, "test"), staged(_retrieved(spark, folder), "retrieved"), N)


def _reranked(spark, folder):
    return retrieval.rerank(_pool(spark, folder), D.scorers(spark, folder)["pop"])


@query("m8_retrieve_topn", """select user_id, item_id, round(score, 6) as score, rank from retrieved
       where user_id in (select user_id from test)""", **STAGES)
def retrieved(spark, folder):
    return _retrieved(spark, folder)


@query("m9_inject_truth", "select row_id, user_id, item_id, position, is_truth, was_retrieved from pool", **STAGES)
def injected(spark, folder):
    return _pool(spark, folder)


@query("m10_rerank", "select row_id, item_id, position, new_rank, round(score, 6) as score from reranked", **STAGES)
def reranked(spark, folder):
    return _reranked(spark, folder).select("row_id", "item_id", "position", "new_rank", "score")


@query("m11_two_stage_metrics", f"""select {D.metrics_sql('(new_rank - 1)')}, round(avg(was_retrieved::int), 6) as recall, count(*) as n
       from reranked where is_truth""", **STAGES)
def two_stages(spark, folder):
    return retrieval.two_stage_metrics(_reranked(spark, folder))


# --- stacking ---------------------------------------------------------------------------------------

def _stack(spark, folder):
    val = blending.minmax_by_user(D.scores(spark, folder, "val"), D.MODELS)
    return stacking.stack_fit(val, D.MODELS, trees=5, depth=3)


@query("m12_stack")
def stacked(spark, folder):
    test = blending.minmax_by_user(D.scores(spark, folder), D.MODELS)
    return metrics.evaluate_ranking(stacking.stack_predict(_stack(spark, folder), test, D.MODELS), "stacked")


@query("m12_stack_pairs")
def stacked_by_pairs(spark, folder):
    val, test = (blending.minmax_by_user(D.scores(spark, folder, part), D.MODELS) for part in ("val", "test"))
    return metrics.evaluate_ranking(stacking.pair_stack_fit(val, D.MODELS).predict(test), "stacked")


@query("m13_feature_importance")
def importance(spark, folder):
    return stacking.feature_importance(D.scores(spark, folder), _stack(spark, folder), D.MODELS)


_COMPONENTS = " union all ".join(evaluated("scores_test", m, f"'{m}' as model, ") for m in D.MODELS)


@query("m14_component_metrics", _COMPONENTS)
def components(spark, folder):
    return blending.component_metrics(D.scores(spark, folder), D.MODELS)


@query("m15_holdout_label_table", """select row_id, user_id, item_id, cand_idx, label, round(pop, 6) as pop, round(knn, 6) as knn,
         round(mean, 6) as mean, count(*) over w = 100 and sum(label) over w = 1 as complete
       from scores_val window w as (partition by row_id)""")
def label_table(spark, folder):
    return stacking.holdout_label_table(D.scores(spark, folder, "val"), D.MODELS)


# --- reports ----------------------------------------------------------------------------------------

_LONG = {
    "components": _COMPONENTS,
    "long": " union all ".join(f"select model, '{m}' as metric, {m} as value from components" for m in CUTS),
}


def _metric_rows(spark, folder):
    made = blending.component_metrics(D.scores(spark, folder), D.MODELS)
    return made.select(F.inline(F.array(*[
        F.struct("model", F.lit(m).alias("metric"), F.round(m, 6).alias("value")) for m in CUTS])))


@query("n1_model_leaderboard", "select model, " + ", ".join(
    f"max(value) filter (where metric = '{m}') as {m}" for m in CUTS) + " from long group by model", **_LONG)
def leaderboard(spark, folder):
    return reports.model_leaderboard(_metric_rows(spark, folder), CUTS)


@query("n2_delta_vs_best_baseline", """select model, metric, value, best, round(value - best, 6) as delta
       from long join (select metric, max(value) as best from long where model in ('pop', 'mean') group by metric) using (metric)
       where model = 'knn'""", **_LONG)
def deltas(spark, folder):
    return reports.delta_vs_best_baseline(_metric_rows(spark, folder), ["pop", "mean"])


@query("n3_relative_gain", """select metric, a.value as value_a, b.value as value_b, round(a.value - b.value, 6) as difference,
       round((a.value - b.value) * 100 / nullif(b.value, 0), 6) as gain_pct
       from long a join long b using (metric) where a.model = 'knn' and b.model = 'pop'""", **_LONG)
def gain(spark, folder):
    return reports.relative_gain(_metric_rows(spark, folder), "knn", "pop")


_RATING_ROWS = {
    "predictions": """select 'global' as model, rating, (select avg(rating) from train) as p from test union all
        select 'item', t.rating, greatest(least(coalesce(m.mean_rating, (select avg(rating) from train)), 5), 1)
        from test t left join item_means m using (item_id)"""
}


@query("n4_rating_leaderboard", """select model, round(sqrt(avg((p - rating) ** 2)), 6) as rmse, round(avg(abs(p - rating)), 6) as mae,
         null::double as a, null::double as b from predictions group by model
       union all select 'knn', round(sqrt(avg((p - rating) ** 2)), 6), round(avg(abs(p - rating)), 6), round(max(a), 6), round(max(b), 6)
       from (select t.rating, l.a, l.b, greatest(least(l.a * t.score + l.b, 5), 1) as p from test_rated t, line l)""",
       **_RATING_ROWS, **CALIBRATION)
def rating_board(spark, folder):
    train, pairs = _train(spark, folder), _pairs(spark, folder)
    plain = {
        "global": metrics.rating_errors(popular.global_mean_predictor(pairs, train)),
        "item": metrics.rating_errors(popular.popularity_rating(pairs, train)),
    }
    fitted = calibrated(spark, folder).select(
        F.lit("knn").alias("model"), F.col("rmse").alias("rmse_calibrated"), F.col("mae").alias("mae_calibrated"),
        F.col("a").alias("calibration_a"), F.col("b").alias("calibration_b"))
    rows = [df.select(F.lit(m).alias("model"), "rmse", "mae") for m, df in plain.items()]
    return reports.rating_leaderboard(joins.union_splits(*rows, fitted))


@query("n5_best_run", "select model as run, ndcg_10 from components order by ndcg_10 desc, model limit 1", **_LONG)
def best(spark, folder):
    runs = reports.model_leaderboard(_metric_rows(spark, folder), CUTS).withColumnRenamed("model", "run")
    return reports.best_run(runs, "ndcg_10").select("run", "ndcg_10")
