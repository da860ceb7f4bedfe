"""Registered queries: profiles, features, candidates and recommenders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import norm_title_sql
from ..operators import recommend as RC
from ..operators import text as TX
from ..operators.components import released, written
from ..operators.joins import similar_items
from ..operators.windows import SEQ, covisitation_edges, recent_interactions
from ..sources import binding as B
from .q_core import COVIS_BODY
from .q_text import ITEM_TEXT_CAT, tfidf_sql
from .registry import register

PROFILE_CTES = [("prof", """
  SELECT user_id, count(*) AS interaction_count,
         coalesce(avg(dwell_seconds) FILTER (WHERE dwell_seconds > 0), 0.0) AS avg_dwell_time,
         coalesce(avg(rating), 0.0) AS avg_rating
  FROM interactions GROUP BY user_id"""), ("pr", """
  SELECT p.*, coalesce(u.country, 'US') AS country, coalesce(u.device, 'web') AS device,
         coalesce(u.age_group, '25-34') AS age_group
  FROM prof p LEFT JOIN users u ON p.user_id = u.user_id"""), ("cats", """
  SELECT i.user_id, it.category, count(*) AS n FROM interactions i JOIN items it ON i.item_id = it.item_id
  GROUP BY i.user_id, it.category"""), ("types", """
  SELECT i.user_id, it.content_type, count(*) AS n FROM interactions i JOIN items it ON i.item_id = it.item_id
  GROUP BY i.user_id, it.content_type"""), ("tagc", """
  SELECT user_id, tag, count(*) AS n FROM (
    SELECT i.user_id, unnest(it.tags) AS tag FROM interactions i JOIN items it ON i.item_id = it.item_id)
  GROUP BY user_id, tag""")]


def _profiles(spark, sf):
    return RC.user_profiles(B.interactions(spark, sf), B.users(spark, sf), B.items(spark, sf))


@register("user_profiles", "2.5", B.with_ctes("interactions", "items", "users", extra=PROFILE_CTES) + """
SELECT pr.user_id, pr.interaction_count, round(pr.avg_dwell_time, 6) AS avg_dwell_time,
       round(pr.avg_rating, 6) AS avg_rating, pr.country, pr.device, pr.age_group,
       (SELECT count(*) FROM cats c WHERE c.user_id = pr.user_id) AS n_categories,
       (SELECT count(*) FROM types t WHERE t.user_id = pr.user_id) AS n_types,
       (SELECT coalesce(sum(n), 0) FROM tagc g WHERE g.user_id = pr.user_id) AS n_tag_uses
FROM pr""")
def user_profiles_q(spark, sf):
    p = _profiles(spark, sf)
    nc = p["categories"].groupBy("user_id").agg(F.count(F.lit(1)).alias("n_categories"))
    nt = p["types"].groupBy("user_id").agg(F.count(F.lit(1)).alias("n_types"))
    ng = p["tags"].groupBy("user_id").agg(F.sum("n").alias("n_tag_uses"))
    out = p["profile"].join(nc, "user_id", "left").join(nt, "user_id", "left").join(ng, "user_id", "left")
    return out.select("user_id", "interaction_count", F.round("avg_dwell_time", 6).alias("avg_dwell_time"),
                      F.round("avg_rating", 6).alias("avg_rating"), "country", "device", "age_group",
                      F.coalesce("n_categories", F.lit(0)).alias("n_categories"),
                      F.coalesce("n_types", F.lit(0)).alias("n_types"),
                      F.coalesce("n_tag_uses", F.lit(0)).cast("long").alias("n_tag_uses"))


def _feature_sql() -> str:
    ic = "CAST(coalesce(pr.interaction_count, 0) AS DOUBLE)"
    den = f"greatest({ic}, 1.0)"
    views = "CAST(coalesce(it.view_count, 0) AS DOUBLE)"
    asof = "(SELECT max(timestamp) FROM interactions)"
    hours = f"((epoch_us({asof}) - epoch_us(coalesce(it.publish_ts, {asof}))) / 3.6e9)"
    dwell = "CAST(coalesce(p.dwell_seconds, 0) AS DOUBLE)"
    rating = "coalesce(it.rating, 0.0)"
    lv = f"ln(1 + {views})"
    fresh = f"(1.0 / (1.0 + {hours} / 720.0))"
    cat = f"(coalesce(c.n, 0) / {den})"
    age = "coalesce(pr.age_group, '25-34')"
    dev = "coalesce(pr.device, 'web')"
    cols = [ic, "coalesce(pr.avg_dwell_time, 0.0)", "coalesce(pr.avg_rating, 0.0)", rating, lv,
            f"ln(1 + greatest({hours}, 0.0))", cat, dwell, fresh, f"{cat} * {rating}", f"ln(1 + {dwell}) * {lv}",
            f"coalesce(t.n, 0) / {den}", f"coalesce(g.tag_sum, 0) / {den}", f"{lv} * {fresh}", f"ln(1 + {ic})"]
    cols += [f"CASE WHEN it.content_type = '{x}' THEN 1.0 ELSE 0.0 END" for x in RC.K.CONTENT_TYPES]
    cols += [f"CASE WHEN {age} = '{x}' THEN 1.0 ELSE 0.0 END" for x in RC.K.AGE_BUCKETS]
    cols += [f"CASE WHEN {dev} = '{x}' THEN 1.0 ELSE 0.0 END" for x in RC.K.DEVICE_BUCKETS]
    sel = ",\n       ".join(f"round(CAST({c} AS DOUBLE), 6) AS {n}" for c, n in zip(cols, RC.FEATURES))
    return B.with_ctes("interactions", "items", "users", "event_interactions", extra=PROFILE_CTES + [
        ("pairs", "SELECT interaction_id AS pair_id, user_id, item_id, dwell_seconds FROM event_interactions"),
        ("tg", """
  SELECT x.user_id, x.item_id, sum(tc.n) AS tag_sum FROM (
    SELECT d.user_id, d.item_id, unnest(it.tags) AS tag
    FROM (SELECT DISTINCT user_id, item_id FROM pairs) d JOIN items it ON d.item_id = it.item_id) x
  JOIN tagc tc ON x.user_id = tc.user_id AND x.tag = tc.tag GROUP BY x.user_id, x.item_id""")]) + f"""
SELECT p.pair_id, p.user_id, p.item_id,
       {sel}
FROM pairs p LEFT JOIN items it ON p.item_id = it.item_id LEFT JOIN pr ON p.user_id = pr.user_id
LEFT JOIN cats c ON c.user_id = p.user_id AND c.category = it.category
LEFT JOIN types t ON t.user_id = p.user_id AND t.content_type = it.content_type
LEFT JOIN tg g ON g.user_id = p.user_id AND g.item_id = p.item_id"""


@register("features", "2.11", _feature_sql())
def features_q(spark, sf):
    inter = B.interactions(spark, sf)
    pairs = B.event_interactions(spark, sf).select(F.col("interaction_id").alias("pair_id"), "user_id",
                                                   "item_id", "dwell_seconds")
    items = B.items(spark, sf)
    f = RC.features(pairs, RC.profiles_of(pairs, inter, B.users(spark, sf), items), items, B.as_of(inter), keep=["pair_id"])
    return f.select("pair_id", "user_id", "item_id", *[F.round(c, 6).alias(c) for c in RC.FEATURES])


@register("recommend_control", "2.11", B.with_ctes("interactions", "items", "users") + f"""
, pop AS (SELECT item_id, title, {norm_title_sql('title')} AS nt,
                 row_number() OVER (ORDER BY view_count DESC, rating DESC, item_id) AS prank
          FROM items QUALIFY prank <= 30)
, seen AS (SELECT DISTINCT user_id, item_id FROM interactions)
, c AS (SELECT u.user_id, p.* FROM users u CROSS JOIN pop p
        WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = u.user_id AND s.item_id = p.item_id))
, d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY user_id, nt ORDER BY prank) = 1)
SELECT user_id, item_id, title, CAST(row_number() OVER (PARTITION BY user_id ORDER BY prank) AS BIGINT) AS rec_rank,
       'popularity_based' AS algorithm
FROM d QUALIFY rec_rank <= 10""".replace("\n, pop AS", ", pop AS", 1))
def recommend_control_q(spark, sf):
    return RC.recommend_control(spark, B.users(spark, sf), B.interactions(spark, sf), B.items(spark, sf), 10)


@register("item_page", "2.11", B.with_ctes("items", extra=[("keys", """
  SELECT item_id, 'cat:' || category AS key FROM items
  UNION SELECT item_id, 'tag:' || unnest(tags) AS key FROM items"""), ("pairs", """
  SELECT DISTINCT a.item_id, b.item_id AS sim_id FROM keys a JOIN keys b ON a.key = b.key AND a.item_id <> b.item_id"""),
    ("sim", """
  SELECT p.item_id, p.sim_id, row_number() OVER (PARTITION BY p.item_id ORDER BY it.rating DESC, it.view_count DESC,
         p.sim_id) AS rank
  FROM pairs p JOIN items it ON it.item_id = p.sim_id QUALIFY rank <= 10""")]) + """
SELECT i.item_id, i.title, i.category, i.content_type,
       (SELECT string_agg(sim_id, ',' ORDER BY rank) FROM sim s WHERE s.item_id = i.item_id) AS similar
FROM items i""")
def item_page_q(spark, sf):
    items = B.items(spark, sf)
    p = RC.item_page(items, similar_items(items, 10))
    return p.select("item_id", "title", "category", "content_type",
                    F.array_join(F.transform("similar", lambda x: x["sim_id"]), ",").alias("similar"))


@register("profile_page", "2.11", B.with_ctes("users", "interactions", "items") + """
, st AS (SELECT i.user_id, count(*) AS total_interactions, round(avg(i.dwell_seconds), 6) AS avg_dwell_time,
                round(avg(i.rating), 6) AS avg_rating
         FROM interactions i GROUP BY i.user_id)
, rc AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id
                ORDER BY timestamp DESC, seq_a, seq_b, seq_c, seq_d) AS rank FROM interactions QUALIFY rank <= 20)
SELECT u.user_id, u.country, u.device, u.age_group, coalesce(st.total_interactions, 0) AS total_interactions,
       st.avg_dwell_time, st.avg_rating,
       (SELECT string_agg(item_id, ',' ORDER BY rank) FROM rc WHERE rc.user_id = u.user_id) AS recent
FROM users u LEFT JOIN st ON u.user_id = st.user_id""".replace("\n, st AS", ", st AS", 1))
def profile_page_q(spark, sf):
    inter = B.interactions(spark, sf)
    stats = inter.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_interactions"),
                                         F.round(F.avg("dwell_seconds"), 6).alias("avg_dwell_time"),
                                         F.round(F.avg("rating"), 6).alias("avg_rating"))
    rec = recent_interactions(inter, B.items(spark, sf), 20)
    p = RC.profile_page(B.users(spark, sf).select("user_id", "country", "device", "age_group"), stats, rec)
    return p.select("user_id", "country", "device", "age_group",
                    F.coalesce("total_interactions", F.lit(0)).alias("total_interactions"),
                    "avg_dwell_time", "avg_rating",
                    F.when(F.size("recent") > 0, F.array_join(F.transform("recent", lambda x: x["item_id"]), ","))
                    .alias("recent"))


# ----------------------------------------------------------- model-based (R)

_MODELS: dict = {}


def _history(spark, sf):
    """The interactions' columns that candidates are drawn by, joined once:
    five steps read them."""
    with released(spark):
        return written(B.interactions(spark, sf).select("user_id", "item_id", "interaction_type", "timestamp", *SEQ), "history")


def similar_for(spark, items, inter):
    """The 50 most similar items by text of each item that is among some
    user's three newest, as the third strategy asks for no others."""
    with released(spark):
        return written(TX.content_similar(spark, items, 50, of=RC.newest_items(inter, 3)), "similar")


def _once(kind, spark, sf, fit):
    key = (kind, spark.sparkContext.applicationId, sf)
    if key not in _MODELS:
        _MODELS[key] = fit()
    return _MODELS[key]


def ranker(spark, sf):
    """The ranker of a test folder (trained once per session)."""
    def fit():
        inter = B.interactions(spark, sf)
        train = RC.training_set(spark, inter, B.users(spark, sf), B.items(spark, sf), None, B.as_of(inter), 42)
        return RC.fit_ranker(train)
    return _once("ranker", spark, sf, fit)


def latent(spark, sf):
    """The factor model of a test folder (fitted once per session)."""
    return _once("factors", spark, sf, lambda: RC.fit_factors(B.interactions(spark, sf)))


def trained(spark, sf):
    """Ranker and factor model for a test folder."""
    return ranker(spark, sf), latent(spark, sf)


@register("training_set", "2.11")
def training_set_q(spark, sf):
    inter = B.interactions(spark, sf)
    return RC.training_set(spark, inter, B.users(spark, sf), B.items(spark, sf), None, B.as_of(inter), 42)


@register("candidates", "2.11", B.with_ctes("interactions", "items", "users", extra=tfidf_sql("items", "item_id", ITEM_TEXT_CAT, "d") + [("sim", """
  SELECT item_id, sim_id FROM (
    SELECT a.id AS item_id, b.id AS sim_id, round(sum(a.weight * b.weight), 9) AS similarity
    FROM d_vec a JOIN d_vec b ON a.term = b.term AND a.id <> b.id GROUP BY a.id, b.id)
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, sim_id) <= 50""")]) + COVIS_BODY + """
, cov AS (SELECT item_a, item_b FROM covis QUALIFY row_number() OVER (PARTITION BY item_a ORDER BY weight DESC, item_b) <= 20)
, seen AS (SELECT DISTINCT user_id, item_id FROM interactions)
, newest AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, seq_a, seq_b, seq_c, seq_d) AS rank
             FROM interactions QUALIFY rank <= 10)
, pop AS (SELECT item_id, row_number() OVER (ORDER BY view_count DESC, rating DESC, item_id) AS rank FROM items QUALIFY rank <= 500)
, pool AS (SELECT n.user_id, cov.item_b AS item_id FROM newest n JOIN cov ON cov.item_a = n.item_id
           UNION SELECT u.user_id, pop.item_id FROM users u CROSS JOIN pop WHERE pop.rank <= 100
           UNION SELECT n.user_id, sim.sim_id FROM newest n JOIN sim ON sim.item_id = n.item_id WHERE n.rank <= 3)
, cand AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY item_id) AS cand_rank
           FROM pool ANTI JOIN seen USING (user_id, item_id) QUALIFY cand_rank <= 500)
, have AS (SELECT u.user_id, count(c.item_id) AS have FROM users u LEFT JOIN cand c ON c.user_id = u.user_id GROUP BY u.user_id)
, fill AS (SELECT h.user_id, pop.item_id, h.have + row_number() OVER (PARTITION BY h.user_id ORDER BY pop.rank) AS cand_rank
           FROM have h JOIN pop ON pop.rank <= 500 - h.have
           WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = h.user_id AND s.item_id = pop.item_id)
             AND NOT EXISTS (SELECT 1 FROM cand c WHERE c.user_id = h.user_id AND c.item_id = pop.item_id))
SELECT user_id, item_id, CAST(cand_rank AS BIGINT) AS cand_rank FROM cand
UNION ALL SELECT user_id, item_id, CAST(cand_rank AS BIGINT) FROM fill""")
def candidates_q(spark, sf):
    inter, items = _history(spark, sf), B.items(spark, sf)
    return RC.candidates(spark, B.users(spark, sf), inter, items, covisitation_edges(inter), similar_for(spark, items, inter), 500)


@register("rank_candidates", "2.11")
def rank_candidates_q(spark, sf):
    model = ranker(spark, sf)
    inter = B.interactions(spark, sf)
    items = B.items(spark, sf)
    cands = RC.candidates(spark, B.users(spark, sf), inter, items, covisitation_edges(inter), similar_for(spark, items, inter), 500)
    return RC.rank_candidates(cands, _profiles(spark, sf), items, model, B.as_of(inter))


@register("fit_factors", "2.11")
def fit_factors_q(spark, sf):
    factors = latent(spark, sf)
    return factors.items.select(F.col("item_id").alias("item"), F.size("features").alias("rank"))


@register("factor_scores", "2.11", B.with_ctes("event_interactions") + """
, p AS (SELECT DISTINCT user_id, item_id FROM event_interactions)
, e AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
, raw AS (SELECT p.user_id, p.item_id, list_dot_product(a.v, b.v) AS raw FROM p JOIN e a ON a.id = p.user_id JOIN e b ON b.id = p.item_id)
, ends AS (SELECT user_id, min(raw) AS lo, max(raw) AS hi FROM raw GROUP BY user_id)
SELECT user_id, item_id, round(CASE WHEN hi > lo THEN (raw - lo) / (hi - lo) ELSE 0.0 END, 6) AS factor_score
FROM raw JOIN ends USING (user_id)""".replace("\n, p AS", ", p AS", 1))
def factor_scores_q(spark, sf):
    """Scores by given vectors: the embeddings, as vectors of users and items."""
    from ..sources.tables import raw
    e = raw(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("features"))
    given = RC.Factors(e.withColumnRenamed("id", "user_id"), e.withColumnRenamed("id", "item_id"), 64, "given")
    out = RC.factor_scores(B.event_interactions(spark, sf).select("user_id", "item_id"), given)
    return out.select("user_id", "item_id", F.round("factor_score", 6).alias("factor_score"))


def _recommend(spark, sf, n=10, of=None):
    """The model arm for all users, or for those in ``of`` (user_id) only."""
    model, factors = trained(spark, sf)
    inter = B.interactions(spark, sf)
    users, items = B.users(spark, sf), B.items(spark, sf)
    covis, own = covisitation_edges(inter), inter
    if of is not None:
        of = of.select("user_id").distinct()
        users, own = users.join(of, "user_id", "left_semi"), inter.join(of, "user_id", "left_semi")
    return RC.recommend(spark, users, own, items, _profiles(spark, sf), model, factors,
                        covis, similar_for(spark, items, own), B.as_of(inter), n)


@register("recommend", "2.11")
def recommend_q(spark, sf):
    return _recommend(spark, sf).select("user_id", "item_id", "rec_rank", "score", "algorithm")


@register("blend_scores", "2.11", B.with_ctes("event_interactions", "items") + """
, p AS (SELECT DISTINCT e.user_id, e.item_id, CAST(e.user_id AS BIGINT) AS u, CAST(e.item_id AS BIGINT) AS i FROM event_interactions e)
, r AS (SELECT p.user_id, p.item_id, ((u * 7 + i * 13) % 100) / 100.0 AS ml,
               CASE WHEN (u + i) % 4 <> 0 THEN ((u * 3 + i * 5) % 50) / 50.0 END AS fs, it.view_count,
               max(it.view_count) OVER (PARTITION BY p.user_id) AS top
        FROM p JOIN items it ON it.item_id = p.item_id)
SELECT user_id, item_id, round(0.5 * ml + 0.35 * coalesce(fs, 0.0) + 0.15 * view_count / greatest(top, 1), 6) AS score
FROM r""".replace("\n, p AS", ", p AS", 1))
def blend_scores_q(spark, sf):
    """The blend of given model and factor scores (a quarter lack the latter)."""
    u, i = F.col("user_id").cast("long"), F.col("item_id").cast("long")
    p = B.event_interactions(spark, sf).select("user_id", "item_id").distinct()
    ranked = p.withColumn("ml_score", (u * 7 + i * 13) % 100 / F.lit(100.0))
    factors = p.where((u + i) % 4 != 0).withColumn("factor_score", (u * 3 + i * 5) % 50 / F.lit(50.0))
    out = RC.blend_scores(ranked, B.items(spark, sf), factors)
    return out.select("user_id", "item_id", F.round("score", 6).alias("score"))


def _arms(spark, sf):
    """Recommendations of each user by the user's arm; an arm scores its own
    users only."""
    from ..operators.experiments import assign_buckets
    users = B.users(spark, sf)
    buckets = assign_buckets(users, B.EXPERIMENT)
    control = buckets.where("bucket = 'control'").select("user_id")
    inter = B.interactions(spark, sf)
    ctl = RC.recommend_control(spark, users.join(control, "user_id", "left_semi"), inter.join(control, "user_id", "left_semi"), B.items(spark, sf), 10)
    return buckets, RC.recommend_by_arm(spark, buckets, _recommend(spark, sf, of=buckets.where("bucket <> 'control'")), ctl)


@register("recommend_by_arm", "2.11")
def recommend_by_arm_q(spark, sf):
    return _arms(spark, sf)[1]


def _list_checks(spark, sf, recs):
    """What holds for any recommendation lists: ranks from 1 without gaps, at
    most 10, scores in order, nothing seen before, no title twice."""
    recs = recs.select("user_id", "item_id", "rec_rank", "score")
    recs = RC.reliable(recs)
    seen = recs.join(B.interactions(spark, sf).select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_semi")
    titles = recs.join(B.items(spark, sf).select("item_id", RC.norm_title("title").alias("t")), "item_id").groupBy("user_id").agg(
        (F.count("*") - F.countDistinct("t")).alias("twice"))
    later = recs.select("user_id", (F.col("rec_rank") - 1).alias("rec_rank"), F.col("score").alias("next_score"))
    own = recs.groupBy("user_id").agg(F.count("*").alias("n"), F.max("rec_rank").alias("m"), F.countDistinct("rec_rank").alias("d"))
    return own.agg(F.count("*").alias("users"), F.count_if(F.expr("n > 10")).alias("too_long"), F.count_if(F.expr("m <> n or d <> n")).alias("gaps")).crossJoin(
        seen.agg(F.count("*").alias("seen"))).crossJoin(titles.agg(F.coalesce(F.sum("twice"), F.lit(0)).alias("repeated_titles"))).crossJoin(
        recs.join(later, ["user_id", "rec_rank"]).agg(F.count_if(F.expr("next_score > score")).alias("out_of_order")))


LIST_SQL = """
SELECT count(*) AS users, 0 AS too_long, 0 AS gaps, 0 AS seen, 0 AS repeated_titles, 0 AS out_of_order FROM users"""


@register("recommend_checks", "2.11", B.with_ctes("users") + LIST_SQL)
def recommend_checks_q(spark, sf):
    """Every user has a list that keeps its rules."""
    return _list_checks(spark, sf, _recommend(spark, sf))


@register("rank_candidates_checks", "2.11", B.with_ctes("users") + """
SELECT count(*) AS users, 0 AS missing, 0 AS no_score FROM users""")
def rank_candidates_checks_q(spark, sf):
    """Every candidate of every user gets one finite model score."""
    model = ranker(spark, sf)
    inter, items = B.interactions(spark, sf), B.items(spark, sf)
    similar = similar_for(spark, items, inter)
    with released(spark):
        cands = written(RC.candidates(spark, B.users(spark, sf), inter, items, covisitation_edges(inter), similar, 500), "candidates")
    ranked = RC.rank_candidates(cands, _profiles(spark, sf), items, model, B.as_of(inter))
    both = cands.select("user_id", "item_id").join(ranked, ["user_id", "item_id"], "left")
    return both.agg(F.countDistinct("user_id").alias("users"), F.count_if(F.expr("ml_score is null")).alias("missing"),
                    F.count_if(F.expr("isnan(ml_score)")).alias("no_score"))


@register("fit_factors_checks", "2.11", B.with_ctes("interactions") + """
, sizes AS (SELECT count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items FROM interactions)
SELECT CAST(users AS BIGINT) AS users, CAST(items AS BIGINT) AS items, CAST(least(64, users - 1, items - 1) AS BIGINT) AS rank,
       true AS left_orthonormal, true AS right_orthonormal, true AS reproduces FROM sizes""".replace("\n, sizes", ", sizes", 1))
def fit_factors_checks_q(spark, sf):
    """The decomposition's identities on the whole matrix: both sides are
    orthonormal once the roots of the singular values are taken out, and the
    transposed matrix times the left vectors gives the right ones."""
    import numpy as np

    from ..operators.components import dropped
    from ..operators.factorise import gram, times
    inter = B.interactions(spark, sf)
    f = RC.fit_factors(inter)
    s = [float(x) for x in f.values]

    def orthonormal(side):
        return F.lit(bool(np.abs(gram(side.select(F.col("features").alias("x")), len(s)) - np.diag(s)).max() < 1e-6 * s[0]))

    with released(spark):
        data, uid, iid, dims = RC.confidence_entries(inter)
        tall = written(f.users.join(uid, "user_id").select(F.col("u").alias("id"), F.col("features").alias("x")), "left")
        matrix = data.select(F.col("u").alias("row"), F.col("i").alias("col"), F.col("confidence").alias("value"))
        got = times(matrix, "row", "col", tall, [], len(s), {"row": dims["u"] + 1, "col": dims["i"] + 1}, "got")
        dropped(data)
        dropped(tall)
    sums = got.join(iid, got["id"] == iid["i"]).select("item_id", F.col("x").alias("got"))
    scale = F.array(*[F.lit(x) for x in s])
    gap = F.array_max(F.zip_with("got", F.zip_with("features", scale, lambda v, x: v * x), lambda a, b: F.abs(a - b)))
    same = sums.join(f.items, "item_id").agg((F.max(gap) < 1e-6 * s[0] * s[0]).alias("reproduces"))
    return f.users.agg(F.count("*").alias("users")).crossJoin(f.items.agg(F.count("*").alias("items"))).crossJoin(same).select(
        "users", "items", orthonormal(f.users).alias("left_orthonormal"), orthonormal(f.items).alias("right_orthonormal"), "reproduces",
        F.lit(len(s)).cast("long").alias("rank"))


@register("retrain", "2.11")
def retrain_q(spark, sf):
    """Full retrain over the interactions; returns the ranker's feature
    importances (model metadata, 32 rows)."""
    inter = B.interactions(spark, sf)
    out = RC.retrain(spark, inter, B.users(spark, sf), B.items(spark, sf), B.as_of(inter), 42)
    return RC.feature_importances(spark, out["model"])


@register("popularity_ranking", "2.7", B.with_ctes("items", "users", "event_interactions") + """
, c AS (SELECT DISTINCT e.user_id, e.item_id FROM event_interactions e JOIN items it ON e.item_id = it.item_id)
, own AS (SELECT c.user_id, c.item_id, row_number() OVER (PARTITION BY c.user_id
                 ORDER BY it.view_count DESC, it.rating DESC, it.item_id) AS rank
          FROM c JOIN items it ON c.item_id = it.item_id)
, top AS (SELECT item_id, row_number() OVER (ORDER BY view_count DESC, rating DESC, item_id) AS rank
          FROM items QUALIFY rank <= 50)
SELECT user_id, item_id, CAST(0.0 AS DOUBLE) AS score, CAST(rank AS BIGINT) AS rank FROM (
  SELECT * FROM own UNION ALL
  SELECT u.user_id, top.item_id, top.rank FROM users u CROSS JOIN top
  WHERE u.user_id NOT IN (SELECT user_id FROM c))""".replace("\n, c AS", ", c AS", 1))
def popularity_ranking_q(spark, sf):
    from ..operators.ranking import popularity_ranking
    c = B.event_interactions(spark, sf).select("user_id", "item_id").distinct()
    return popularity_ranking(B.items(spark, sf), c, B.users(spark, sf), 50).select("user_id", "item_id", "score", "rank")
