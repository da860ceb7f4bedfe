"""Registered queries: joins, aggregations, sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import ranking as R
from ..sources import binding as B
from .registry import register

CARD_SQL = "item_id, title, content_type, category, description, thumbnail_url, rating, view_count"


# ------------------------------------------------------------------ 2.7 sorts

@register("popular_items", "2.7", B.with_ctes("items") + f"""
SELECT {CARD_SQL}, CAST(row_number() OVER (ORDER BY view_count DESC, rating DESC, item_id) AS BIGINT) AS rank
FROM items QUALIFY rank <= 50""")
def popular_items(spark, sf):
    return R.popular_items(B.items(spark, sf), 50)


@register("popular_items_by_type", "2.7", B.with_ctes("items") + f"""
SELECT {CARD_SQL}, CAST(row_number() OVER (PARTITION BY content_type
       ORDER BY view_count DESC, rating DESC, item_id) AS BIGINT) AS rank
FROM items QUALIFY rank <= 10""")
def popular_items_by_type(spark, sf):
    return R.popular_items_by_type(B.items(spark, sf), 10)


# ------------------------------------------------------------------ 2.4 joins

@register("enrich_interactions", "2.4", B.with_ctes("interactions", "items") + """
SELECT i.item_id, i.interaction_id, i.user_id, i.interaction_type, i.timestamp, i.dwell_seconds,
       i.rating, i.context, i.seq_a, i.seq_b, i.seq_c, i.seq_d, it.title, it.category, it.content_type
FROM interactions i LEFT JOIN items it ON i.item_id = it.item_id""")
def enrich_interactions(spark, sf):
    return J.enrich_interactions(B.interactions(spark, sf), B.items(spark, sf))


# ------------------------------------------------------------ 2.5 aggregates

@register("popular_categories", "2.5", B.with_ctes("interactions", "items") + """
SELECT it.category, count(*) AS interaction_count
FROM interactions i LEFT JOIN items it ON i.item_id = it.item_id
WHERE i.timestamp >= (SELECT max(timestamp) FROM interactions) - INTERVAL 168 HOUR
GROUP BY it.category
ORDER BY interaction_count DESC, it.category NULLS LAST LIMIT 10""")
def popular_categories(spark, sf):
    inter = B.interactions(spark, sf)
    return A.popular_categories(inter, B.items(spark, sf), B.as_of(inter), 7, 10)


# --------------------------------------------------------------- 2.3 scalars

from ..functions import constants as K  # noqa: E402
from ..functions import scalars as S  # noqa: E402
from ..operators import sets as SETS  # noqa: E402
from ..operators import windows as W  # noqa: E402
from ..sources.landed import TMDB_MOVIE_GENRE, YOUTUBE_CATEGORIES  # noqa: E402

SEQ_SQL = "timestamp, seq_a, seq_b, seq_c, seq_d"


@register("norm_title", "2.3", B.with_ctes("corpus") + f"""
SELECT doc_id, {S.norm_title_sql('title')} AS norm_title, {S.title_year_sql('title')} AS title_year
FROM corpus""")
def norm_title_q(spark, sf):
    c = B.corpus(spark, sf)
    return c.select("doc_id", S.norm_title("title").alias("norm_title"),
                    S.title_year("title").alias("title_year"))


@register("norm_title_whole", "2.3", f"""
WITH first_lines AS (SELECT doc_id, split_part(text, chr(10), 1) AS first_line FROM documents)
SELECT doc_id, {S.norm_title_sql('first_line')} AS norm_title, {S.title_year_sql('first_line')} AS title_year
FROM first_lines""")
def norm_title_whole_q(spark, sf):
    """Whole first lines; ``norm_title`` reads the title cut to 80 characters."""
    c = B.corpus(spark, sf)
    return c.select("doc_id", S.norm_title("first_line").alias("norm_title"),
                    S.title_year("first_line").alias("title_year"))


@register("title_year", "2.3", B.with_ctes("items") + f"""
SELECT item_id, {S.title_year_sql("title || ' (' || CAST(1990 + CAST(item_id AS BIGINT) % 30 AS VARCHAR) || ')'")} AS title_year
FROM items""")
def title_year_q(spark, sf):
    it = B.items(spark, sf)
    t = F.concat(F.col("title"), F.lit(" ("), (F.lit(1990) + F.col("item_id").cast("long") % 30).cast("string"),
                 F.lit(")"))
    return it.select("item_id", S.title_year(t).alias("title_year"))


@register("rating_to_interaction", "2.3", B.with_ctes("interactions") + f"""
SELECT interaction_id, seq_a, seq_b, seq_c, seq_d, rating,
       {S.rating_to_interaction_sql('rating')} AS mapped_type
FROM interactions""")
def rating_to_interaction_q(spark, sf):
    i = B.interactions(spark, sf)
    return i.select("interaction_id", "seq_a", "seq_b", "seq_c", "seq_d", "rating",
                    S.rating_to_interaction("rating").alias("mapped_type"))


@register("confidence_weight", "2.3", B.with_ctes("event_interactions") + f"""
SELECT interaction_id, interaction_type, dwell_seconds,
       {S.confidence_weight_sql('interaction_type', 'dwell_seconds')} AS weight,
       {S.training_label_sql('interaction_type', 'dwell_seconds')} AS label
FROM event_interactions""")
def confidence_weight_q(spark, sf):
    e = B.event_interactions(spark, sf)
    return e.select("interaction_id", "interaction_type", "dwell_seconds",
                    S.confidence_weight("interaction_type", "dwell_seconds").alias("weight"),
                    S.training_label("interaction_type", "dwell_seconds").alias("label"))


@register("training_label", "2.3", B.with_ctes("interactions") + f"""
SELECT interaction_type, dwell_seconds > 60 AS long_dwell,
       {S.training_label_sql('interaction_type', 'dwell_seconds')} AS label, count(*) AS n
FROM interactions GROUP BY ALL""")
def training_label_q(spark, sf):
    i = B.interactions(spark, sf)
    return (i.groupBy("interaction_type", (F.col("dwell_seconds") > 60).alias("long_dwell"),
                      S.training_label("interaction_type", "dwell_seconds").alias("label"))
            .agg(F.count(F.lit(1)).alias("n")))


@register("combined_rating", "2.3", B.with_ctes("interactions", "items") + """
, r AS (SELECT item_id, avg(rating) AS dataset_avg, count(rating) AS dataset_n
        FROM interactions WHERE rating > 0 GROUP BY item_id)
SELECT it.item_id, it.rating AS rich_rating, round(r.dataset_avg, 6) AS dataset_avg, r.dataset_n,
       round(CASE WHEN r.dataset_n < 10 THEN it.rating
            ELSE least((1.0 - least(0.65, 0.1 + r.dataset_n / 5000.0)) * it.rating
                       + least(0.65, 0.1 + r.dataset_n / 5000.0) * r.dataset_avg, 5.0) END, 6) AS combined_rating
FROM items it JOIN r ON it.item_id = r.item_id""".replace("\n, r AS", ", r AS", 1))
def combined_rating_q(spark, sf):
    from ..operators.aggregates import ratings_per_target
    i = B.interactions(spark, sf)
    r = ratings_per_target(i.withColumnRenamed("item_id", "target_id")).withColumnRenamed("target_id", "item_id")
    it = B.items(spark, sf).select("item_id", F.col("rating").alias("rich_rating"))
    j = it.join(r, "item_id")
    return j.select("item_id", "rich_rating", F.round("dataset_avg", 6).alias("dataset_avg"),
                    F.col("dataset_n"),
                    F.round(S.combined_rating("rich_rating", "dataset_avg", "dataset_n", rounded=False), 6)
                    .alias("combined_rating"))


@register("normal_cdf", "2.3", B.with_ctes("items") + f"""
SELECT item_id, round({S.normal_cdf_sql('(rating - 2.5) * 1.3')}, 6) AS cdf
FROM items""")
def normal_cdf_q(spark, sf):
    it = B.items(spark, sf)
    return it.select("item_id", F.round(S.normal_cdf((F.col("rating") - 2.5) * 1.3), 6).alias("cdf"))


@register("sha_mod", "2.3", B.with_ctes("users") + f"""
SELECT user_id, {S.sha_mod_sql("user_id || '_recommendation_algorithm_v1'", 100)} AS m100,
       {S.sha_mod_sql('user_id', 7)} AS m7, {S.sha_mod_sql('user_id', 1000003)} AS mbig
FROM users""")
def sha_mod_q(spark, sf):
    u = B.users(spark, sf)
    return u.select("user_id",
                    S.sha_mod(F.concat("user_id", F.lit("_recommendation_algorithm_v1")), 100).alias("m100"),
                    S.sha_mod("user_id", 7).alias("m7"), S.sha_mod("user_id", 1000003).alias("mbig"))


def _case(expr: str, table: dict, default: str) -> str:
    def lit(x):
        return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"CASE {expr} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items()) + f" ELSE {lit(default)} END"


@register("genre_category", "2.3", f"""
SELECT p_partkey AS item, {_case("list_extract(['Action','Comedy','Sci-Fi','Nothing'], p_partkey % 4 + 1)", K.GENRE_CATEGORY, 'Entertainment')} AS category,
       {_case("CAST(p_size AS VARCHAR)", K.AGE_GROUP, '25-34')} AS age_group,
       {_case("p_partkey % 60", TMDB_MOVIE_GENRE, 'Entertainment')} AS tmdb_genre,
       {_case("CAST(p_size AS VARCHAR)", YOUTUBE_CATEGORIES, 'Entertainment')} AS youtube_category
FROM part""")
def genre_category_q(spark, sf):
    """The code tables with their defaults: genres, age codes, movie genre
    numbers and video category numbers, by codes made of the parts' keys."""
    from ..sources.tables import raw
    p = raw(spark, sf, "part")
    genre = F.element_at(F.array(*[F.lit(x) for x in ("Action", "Comedy", "Sci-Fi", "Nothing")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    size = F.col("p_size").cast("string")
    return p.select(F.col("p_partkey").alias("item"), S.code_lookup(genre, K.GENRE_CATEGORY, "Entertainment").alias("category"),
                    S.code_lookup(size, K.AGE_GROUP, "25-34").alias("age_group"),
                    S.code_lookup((F.col("p_partkey") % 60).cast("int"), TMDB_MOVIE_GENRE, "Entertainment").alias("tmdb_genre"),
                    S.code_lookup(size, YOUTUBE_CATEGORIES, "Entertainment").alias("youtube_category"))


@register("validate_requests", "2.3", """
WITH q AS (SELECT conv_id * 1000 + turn AS query_id, text,
                  CASE turn % 4 WHEN 0 THEN NULL WHEN 1 THEN 'movie' WHEN 2 THEN 'film' ELSE 'game' END AS content_type,
                  ([0, 7, 150, 250, -3])[conv_id % 5 + 1] AS "limit" FROM conversations)
SELECT query_id, substr(trim(text), 1, 512) AS text, substr(trim(text), 1, 128) AS suggest_text,
       least(greatest("limit", 1), 100) AS n, least("limit", 100) AS search_limit, least(greatest("limit", 1), 200) AS popular_limit,
       least(greatest("limit", 1), 10) AS suggest_limit,
       content_type IS NULL OR content_type IN ('video','movie','article','product','music','podcast','course','game') AS valid
FROM q""")
def validate_requests_q(spark, sf):
    """Every turn as a request, with limits and types in and out of range."""
    from ..operators.search import validate_requests
    from ..sources.tables import raw
    c = raw(spark, sf, "conversations")
    kind = F.array(F.lit(None).cast("string"), F.lit("movie"), F.lit("film"), F.lit("game"))
    q = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text",
                 F.element_at(kind, (F.col("turn") % 4 + 1).cast("int")).alias("content_type"),
                 F.element_at(F.array(*[F.lit(x) for x in (0, 7, 150, 250, -3)]), (F.col("conv_id") % 5 + 1).cast("int")).alias("limit"))
    return validate_requests(q)


# ------------------------------------------------------------------ 2.4 joins

@register("interactions_with_items", "2.4", B.with_ctes("event_interactions", "items") + """
SELECT i.interaction_id, i.user_id, i.item_id, it.category, it.rating AS item_rating
FROM event_interactions i JOIN items it ON i.item_id = it.item_id""")
def interactions_with_items_q(spark, sf):
    j = J.interactions_with_items(B.event_interactions(spark, sf), B.items(spark, sf))
    return j.select("interaction_id", "user_id", "item_id", "category", "item_rating")


@register("interactions_with_users", "2.4", B.with_ctes("event_interactions", "users") + """
SELECT i.interaction_id, i.user_id, u.country, u.device, u.age_group
FROM event_interactions i LEFT JOIN users u ON i.user_id = u.user_id""")
def interactions_with_users_q(spark, sf):
    j = J.interactions_with_users(B.event_interactions(spark, sf), B.users(spark, sf))
    return j.select("interaction_id", "user_id", "country", "device", "age_group")


@register("items_in", "2.4", B.with_ctes("event_interactions", "items") + f"""
SELECT {CARD_SQL} FROM items WHERE item_id IN (SELECT item_id FROM event_interactions)""")
def items_in_q(spark, sf):
    from ..operators.ranking import CARD
    return J.items_in(B.items(spark, sf), B.event_interactions(spark, sf)).select(*CARD)


@register("exclude_seen", "2.4", B.with_ctes("interactions", "event_interactions") + """
SELECT DISTINCT user_id, item_id FROM event_interactions e
WHERE NOT EXISTS (SELECT 1 FROM interactions i WHERE i.user_id = e.user_id AND i.item_id = e.item_id)""")
def exclude_seen_q(spark, sf):
    cands = B.event_interactions(spark, sf).select("user_id", "item_id").distinct()
    return J.exclude_seen(cands, B.interactions(spark, sf))


@register("similar_items", "2.4", B.with_ctes("items") + """
, keys AS (SELECT item_id, 'cat:' || category AS key FROM items
           UNION SELECT item_id, 'tag:' || unnest(tags) AS key FROM items)
, pairs AS (SELECT DISTINCT a.item_id, b.item_id AS sim_id FROM keys a JOIN keys b
            ON a.key = b.key AND a.item_id <> b.item_id)
SELECT p.item_id, p.sim_id, it.rating AS sim_rating, it.view_count AS sim_views,
       CAST(row_number() OVER (PARTITION BY p.item_id ORDER BY it.rating DESC, it.view_count DESC, p.sim_id) AS BIGINT) AS rank
FROM pairs p JOIN items it ON it.item_id = p.sim_id QUALIFY rank <= 10""")
def similar_items_q(spark, sf):
    return J.similar_items(B.items(spark, sf), 10)


@register("lookahead_join", "2.4", B.with_ctes("interactions") + f"""
, ev AS (SELECT *, lag(timestamp) OVER (PARTITION BY user_id ORDER BY {SEQ_SQL}) AS prev
         FROM interactions)
, b AS (SELECT *, CASE WHEN prev IS NULL OR epoch_us(timestamp) - epoch_us(prev) > 3600000000
                  THEN 1 ELSE 0 END AS brk FROM ev)
, s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY {SEQ_SQL} ROWS UNBOUNDED PRECEDING) AS session_id FROM b)
, p AS (SELECT *, row_number() OVER (PARTITION BY user_id, session_id ORDER BY {SEQ_SQL}) - 1 AS pos FROM s)
SELECT count(*) AS n_pairs, count(DISTINCT a.user_id) AS n_users,
       sum(CAST(a.item_id AS BIGINT) * 7 + CAST(b.item_id AS BIGINT)) AS checksum
FROM p a JOIN p b ON a.user_id = b.user_id AND a.session_id = b.session_id
 AND b.pos BETWEEN a.pos + 1 AND a.pos + 5""")
def lookahead_join_q(spark, sf):
    pairs = W.lookahead_pairs(W.sessionize(B.interactions(spark, sf)), 5)
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("user_id").alias("n_users"),
                     F.sum(F.col("item_a").cast("long") * 7 + F.col("item_b").cast("long")).alias("checksum"))


@register("remap_ids", "2.4", B.with_ctes("items", "event_interactions", extra=[("dup", """
  SELECT item_id AS source_id, first_value(item_id) OVER (PARTITION BY title ORDER BY CAST(item_id AS BIGINT)) AS target_id
  FROM items QUALIFY source_id <> target_id""")]) + """
SELECT e.interaction_id, coalesce(m.target_id, e.item_id) AS item_id
FROM event_interactions e LEFT JOIN dup m ON e.item_id = m.source_id""")
def remap_ids_q(spark, sf):
    """Interactions re-pointed at the first item (by id) carrying the same title."""
    m = J.title_duplicates(B.items(spark, sf))
    return J.remap_ids(B.event_interactions(spark, sf), m).select("interaction_id", "item_id")


# ------------------------------------------------------------ 2.5 aggregates

@register("system_totals", "2.5", B.with_ctes("users", "items", "interactions") + """
SELECT (SELECT count(*) FROM users) AS total_users, (SELECT count(*) FROM items) AS total_items,
       (SELECT count(*) FROM interactions) AS total_interactions""")
def system_totals_q(spark, sf):
    return A.system_totals(spark, B.users(spark, sf), B.items(spark, sf), B.interactions(spark, sf))


@register("active_users", "2.5", B.with_ctes("event_interactions") + """
SELECT count(DISTINCT user_id) AS active_users FROM event_interactions
WHERE timestamp >= (SELECT max(timestamp) FROM event_interactions) - INTERVAL 24 HOUR""")
def active_users_q(spark, sf):
    e = B.event_interactions(spark, sf)
    return A.active_users(e, B.as_of(e), 24)


@register("interactions_recent", "2.5", B.with_ctes("event_interactions") + """
SELECT count(*) AS interactions_recent FROM event_interactions
WHERE timestamp >= (SELECT max(timestamp) FROM event_interactions) - INTERVAL 24 HOUR""")
def interactions_recent_q(spark, sf):
    e = B.event_interactions(spark, sf)
    return A.interactions_recent(e, B.as_of(e), 24)


@register("items_by_type", "2.5", B.with_ctes("items") + """
SELECT content_type, count(*) AS item_count FROM items GROUP BY content_type""")
def items_by_type_q(spark, sf):
    return A.items_by_type(B.items(spark, sf))


@register("categories_by_type", "2.5", B.with_ctes("items") + """
SELECT content_type, category, count(*) AS item_count,
       CAST(row_number() OVER (PARTITION BY content_type ORDER BY count(*) DESC, category) AS BIGINT) AS rank
FROM items GROUP BY content_type, category QUALIFY rank <= 10""")
def categories_by_type_q(spark, sf):
    return A.categories_by_type(B.items(spark, sf), 10)


@register("system_stats", "2.5", B.with_ctes("users", "items", "interactions") + """
, wk AS (SELECT i.item_id FROM interactions i
         WHERE i.timestamp >= (SELECT max(timestamp) FROM interactions) - INTERVAL 168 HOUR)
, dy AS (SELECT user_id FROM interactions
         WHERE timestamp >= (SELECT max(timestamp) FROM interactions) - INTERVAL 24 HOUR)
, cats AS (SELECT it.category, count(*) AS n FROM wk LEFT JOIN items it ON wk.item_id = it.item_id
           GROUP BY it.category ORDER BY n DESC, it.category NULLS LAST LIMIT 1)
SELECT (SELECT count(*) FROM users) AS total_users, (SELECT count(*) FROM items) AS total_items,
       (SELECT count(*) FROM interactions) AS total_interactions,
       (SELECT count(DISTINCT user_id) FROM dy) AS active_users_24h,
       (SELECT count(*) FROM dy) AS interactions_24h,
       (SELECT count(DISTINCT content_type) FROM items) AS content_types,
       (SELECT category FROM cats) AS top_category,
       round((SELECT n FROM cats) / greatest((SELECT count(*) FROM wk), 1) * 100.0, 6) AS top_category_pct
""".replace("\n, wk AS", ", wk AS", 1))
def system_stats_q(spark, sf):
    inter = B.interactions(spark, sf)
    return A.system_stats(spark, B.users(spark, sf), B.items(spark, sf), inter, B.as_of(inter))


@register("system_stats_full", "2.5", B.with_ctes("users", "items", "interactions") + """
, wk AS (SELECT i.item_id FROM interactions i
         WHERE i.timestamp >= (SELECT max(timestamp) FROM interactions) - INTERVAL 168 HOUR)
, dy AS (SELECT user_id FROM interactions
         WHERE timestamp >= (SELECT max(timestamp) FROM interactions) - INTERVAL 24 HOUR)
, cats AS (SELECT it.category, count(*) AS n FROM wk LEFT JOIN items it ON wk.item_id = it.item_id
           GROUP BY it.category ORDER BY n DESC, it.category NULLS LAST LIMIT 10)
, types AS (SELECT content_type, count(*) AS n FROM items GROUP BY content_type)
SELECT (SELECT count(*) FROM users) AS total_users, (SELECT count(*) FROM items) AS total_items,
       (SELECT count(*) FROM interactions) AS total_interactions,
       (SELECT count(DISTINCT user_id) FROM dy) AS active_users_24h,
       (SELECT count(*) FROM dy) AS interactions_24h,
       (SELECT count(DISTINCT content_type) FROM items) AS content_types,
       (SELECT category FROM cats ORDER BY n DESC, category NULLS LAST LIMIT 1) AS top_category,
       round((SELECT max(n) FROM cats) / greatest((SELECT count(*) FROM wk), 1) * 100.0, 6) AS top_category_pct,
       (SELECT list(content_type ORDER BY content_type NULLS LAST) FROM types) AS item_types,
       (SELECT list(n ORDER BY content_type NULLS LAST) FROM types) AS item_type_counts,
       (SELECT list(category ORDER BY n DESC, category NULLS LAST) FROM cats) AS categories,
       (SELECT list(n ORDER BY n DESC, category NULLS LAST) FROM cats) AS category_counts
""".replace("\n, wk AS", ", wk AS", 1))
def system_stats_full_q(spark, sf):
    inter = B.interactions(spark, sf)
    return A.system_stats_full(spark, B.users(spark, sf), B.items(spark, sf), inter, B.as_of(inter))


@register("user_interaction_stats", "2.5", B.with_ctes("event_interactions", "items") + """
SELECT i.user_id,
       array_to_string(list_sort(list(it.category) FILTER (WHERE it.category IS NOT NULL)), '|') AS categories,
       array_to_string(list_sort(list(it.content_type) FILTER (WHERE it.content_type IS NOT NULL)), '|') AS content_types,
       array_to_string(list_sort(flatten(list(coalesce(it.tags, [])))), '|') AS tags,
       round(avg(i.dwell_seconds), 6) AS avg_dwell_time, round(avg(i.rating), 6) AS avg_rating,
       count(*) AS total_interactions
FROM event_interactions i LEFT JOIN items it ON i.item_id = it.item_id GROUP BY i.user_id""")
def user_interaction_stats_q(spark, sf):
    return A.user_interaction_stats(B.event_interactions(spark, sf), B.items(spark, sf))


@register("user_total_interactions", "2.5", B.with_ctes("interactions") + """
SELECT user_id, count(*) AS total_interactions FROM interactions GROUP BY user_id""")
def user_total_interactions_q(spark, sf):
    return A.user_total_interactions(B.interactions(spark, sf))


@register("confidence_matrix", "2.5", B.with_ctes("interactions") + f"""
SELECT user_id, item_id, round(sum({S.confidence_weight_sql('interaction_type', 'dwell_seconds')}), 6) AS confidence
FROM interactions GROUP BY user_id, item_id""")
def confidence_matrix_q(spark, sf):
    c = A.confidence_matrix(B.interactions(spark, sf))
    return c.withColumn("confidence", F.round("confidence", 6))


COVIS_BODY = f"""
, ev AS (SELECT *, lag(timestamp) OVER (PARTITION BY user_id ORDER BY {SEQ_SQL}) AS prev
         FROM interactions WHERE interaction_type IN ('view', 'click', 'like'))
, b AS (SELECT *, CASE WHEN prev IS NULL OR epoch_us(timestamp) - epoch_us(prev) > 3600000000
                  THEN 1 ELSE 0 END AS brk FROM ev)
, s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY {SEQ_SQL} ROWS UNBOUNDED PRECEDING) AS session_id FROM b)
, p AS (SELECT *, row_number() OVER (PARTITION BY user_id, session_id ORDER BY {SEQ_SQL}) - 1 AS pos FROM s)
, pairs AS (SELECT a.item_id AS item_a, b.item_id AS item_b FROM p a JOIN p b
            ON a.user_id = b.user_id AND a.session_id = b.session_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 5)
, covis AS (SELECT item_a, item_b, count(*) AS weight
            FROM (SELECT item_a, item_b FROM pairs UNION ALL SELECT item_b, item_a FROM pairs) GROUP BY item_a, item_b)
"""


@register("covisitation_edges", "2.5", B.with_ctes("interactions") + COVIS_BODY + "SELECT * FROM covis")
def covisitation_edges_q(spark, sf):
    return W.covisitation_edges(B.interactions(spark, sf))


@register("catalogue_type_report", "2.5", B.with_ctes("items") + """
, t AS (SELECT * FROM (VALUES ('video', 0), ('movie', 1), ('article', 2), ('product', 3), ('music', 4),
        ('podcast', 5), ('course', 6), ('game', 7)) v(content_type, type_order))
SELECT t.content_type, t.type_order, coalesce(c.n, 0) AS item_count,
       CASE WHEN coalesce(c.n, 0) < 10 THEN 'LOW' ELSE 'OK' END AS status
FROM t LEFT JOIN (SELECT content_type, count(*) AS n FROM items GROUP BY content_type) c
  ON t.content_type = c.content_type""".replace("\n, t AS", ", t AS", 1))
def catalogue_type_report_q(spark, sf):
    return A.catalogue_type_report(spark, B.items(spark, sf))


@register("ratings_per_target", "2.5", B.with_ctes("interactions") + """
SELECT item_id AS target_id, round(avg(rating / 2.0), 6) AS dataset_avg, count(*) AS dataset_n
FROM interactions WHERE rating > 0 GROUP BY item_id""")
def ratings_per_target_q(spark, sf):
    r = A.ratings_per_target(B.interactions(spark, sf).withColumnRenamed("item_id", "target_id"), 2.0)
    return r.withColumn("dataset_avg", F.round("dataset_avg", 6))


@register("view_boost", "2.5", B.with_ctes("items", extra=[("dup", """
  SELECT item_id AS source_id, first_value(item_id) OVER (PARTITION BY title ORDER BY CAST(item_id AS BIGINT)) AS target_id
  FROM items QUALIFY source_id <> target_id""")]) + """
SELECT it.item_id, it.view_count + coalesce(a.extra, 0) AS view_count
FROM items it LEFT JOIN (SELECT d.target_id, sum(s.view_count) AS extra FROM dup d
                         JOIN items s ON s.item_id = d.source_id GROUP BY d.target_id) a
  ON it.item_id = a.target_id""")
def view_boost_q(spark, sf):
    it = B.items(spark, sf)
    return A.view_boost(it, J.title_duplicates(it)).select("item_id", F.col("view_count").cast("long").alias("view_count"))


# ------------------------------------------------------------------ 2.6 windows

@register("recent_interactions", "2.6", B.with_ctes("interactions", "items") + f"""
, top AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, seq_a, seq_b, seq_c, seq_d)
                   AS BIGINT) AS rank FROM interactions QUALIFY rank <= 20)
SELECT t.user_id, t.item_id, t.interaction_id, t.interaction_type, {S.ts_str_sql('t.timestamp')} AS ts, t.rank,
       it.title, it.category, it.content_type
FROM top t LEFT JOIN items it ON t.item_id = it.item_id""".replace("\n, top AS", ", top AS", 1))
def recent_interactions_q(spark, sf):
    r = W.recent_interactions(B.interactions(spark, sf), B.items(spark, sf), 20)
    return r.select("user_id", "item_id", "interaction_id", "interaction_type",
                    S.ts_str("timestamp").alias("ts"), "rank", "title", "category", "content_type")


@register("sessionize", "2.6", B.with_ctes("event_interactions") + """
, ev AS (SELECT *, lag(timestamp) OVER (PARTITION BY user_id ORDER BY timestamp, seq_a) AS prev
         FROM event_interactions WHERE interaction_type IN ('view', 'click', 'like'))
, b AS (SELECT *, CASE WHEN prev IS NULL OR epoch_us(timestamp) - epoch_us(prev) > 3600000000
                  THEN 1 ELSE 0 END AS brk FROM ev)
, s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY timestamp, seq_a ROWS UNBOUNDED PRECEDING) AS session_id FROM b)
SELECT user_id, item_id, seq_a, session_id,
       row_number() OVER (PARTITION BY user_id, session_id ORDER BY timestamp, seq_a) - 1 AS pos
FROM s""".replace("\n, ev AS", ", ev AS", 1))
def sessionize_q(spark, sf):
    s = W.sessionize(B.event_interactions(spark, sf), 3600, ["view", "click", "like"])
    return s.select("user_id", "item_id", "seq_a", "session_id", "pos")


@register("session_position", "2.6", B.with_ctes("interactions") + f"""
, ev AS (SELECT *, lag(timestamp) OVER (PARTITION BY user_id ORDER BY {SEQ_SQL}) AS prev FROM interactions)
, b AS (SELECT *, CASE WHEN prev IS NULL OR epoch_us(timestamp) - epoch_us(prev) > 3600000000
                  THEN 1 ELSE 0 END AS brk FROM ev)
, s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY {SEQ_SQL} ROWS UNBOUNDED PRECEDING) AS session_id FROM b)
SELECT user_id, session_id, count(*) AS n_events, max(pos) AS max_pos, sum(pos) AS sum_pos
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, session_id ORDER BY {SEQ_SQL}) - 1 AS pos FROM s)
GROUP BY user_id, session_id""".replace("\n, ev AS", ", ev AS", 1))
def session_position_q(spark, sf):
    s = W.sessionize(B.interactions(spark, sf))
    return s.groupBy("user_id", "session_id").agg(F.count(F.lit(1)).alias("n_events"),
                                                  F.max("pos").alias("max_pos"), F.sum("pos").alias("sum_pos"))


@register("last_n_events", "2.6", B.with_ctes("experiment_events") + """
SELECT experiment_id, event_id, user_id, bucket, event_type,
       CAST(row_number() OVER (PARTITION BY experiment_id ORDER BY timestamp DESC, event_id DESC) AS BIGINT) AS rank
FROM experiment_events QUALIFY rank <= 1000""")
def last_n_events_q(spark, sf):
    return W.last_n_events(B.experiment_events(spark, sf), 1000).select(
        "experiment_id", "event_id", "user_id", "bucket", "event_type", "rank")


@register("dedup_by_title", "2.6", B.with_ctes("items") + f"""
, k AS (SELECT *, {S.norm_title_sql('title')} AS nt FROM items)
, f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY content_type, nt
        ORDER BY view_count DESC, rating DESC, item_id) = 1)
SELECT content_type, item_id, title, view_count,
       CAST(row_number() OVER (PARTITION BY content_type ORDER BY view_count DESC, rating DESC, item_id) AS BIGINT) AS rank
FROM f QUALIFY rank <= 10""".replace("\n, k AS", ", k AS", 1))
def dedup_by_title_q(spark, sf):
    from ..operators.ranking import popular_order
    d = W.dedup_by_title(B.items(spark, sf), ["content_type"], popular_order(), 10)
    return d.select("content_type", "item_id", "title", "view_count", "rank")


@register("minmax_per_user", "2.6", B.with_ctes("interactions") + f"""
, c AS (SELECT user_id, item_id, sum({S.confidence_weight_sql('interaction_type', 'dwell_seconds')}) AS confidence
        FROM interactions GROUP BY user_id, item_id)
SELECT user_id, item_id, round(CASE WHEN max(confidence) OVER w > min(confidence) OVER w
       THEN (confidence - min(confidence) OVER w) / (max(confidence) OVER w - min(confidence) OVER w)
       ELSE 0.0 END, 6) AS confidence_norm
FROM c WINDOW w AS (PARTITION BY user_id)""".replace("\n, c AS", ", c AS", 1))
def minmax_per_user_q(spark, sf):
    c = A.confidence_matrix(B.interactions(spark, sf))
    m = W.minmax_per_user(c, "confidence")
    return m.select("user_id", "item_id", F.round("confidence_norm", 6).alias("confidence_norm"))


@register("popularity_norm", "2.6", B.with_ctes("event_interactions", "items") + """
, c AS (SELECT DISTINCT e.user_id, e.item_id, it.view_count FROM event_interactions e
        JOIN items it ON e.item_id = it.item_id)
SELECT user_id, item_id, round(view_count / CAST(greatest(max(view_count) OVER (PARTITION BY user_id), 1) AS DOUBLE), 6)
       AS popularity FROM c""".replace("\n, c AS", ", c AS", 1))
def popularity_norm_q(spark, sf):
    e = B.event_interactions(spark, sf).select("user_id", "item_id").distinct()
    c = e.join(B.items(spark, sf).select("item_id", "view_count"), "item_id")
    return W.popularity_norm(c).select("user_id", "item_id", F.round("popularity", 6).alias("popularity"))


@register("top_affinities", "2.6", B.with_ctes("interactions", "items") + """
, c AS (SELECT i.user_id, it.category, count(*) AS n FROM interactions i JOIN items it ON i.item_id = it.item_id
        GROUP BY ALL)
, t AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n DESC, category) AS BIGINT) AS rank
        FROM c QUALIFY rank <= 8)
SELECT user_id, category, n, rank, round(n * 100.0 / max(n) OVER (PARTITION BY user_id), 6) AS pct_of_top
FROM t""".replace("\n, c AS", ", c AS", 1))
def top_affinities_q(spark, sf):
    j = J.interactions_with_items(B.interactions(spark, sf), B.items(spark, sf))
    c = j.groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("n"))
    t = W.top_affinities(c, "category", 8)
    return t.select("user_id", "category", "n", "rank", F.round("pct_of_top", 6).alias("pct_of_top"))


@register("recent_searches", "2.6", B.with_ctes("event_interactions", "items") + """
, log AS (SELECT e.user_id, it.title AS text, e.timestamp AS ts FROM event_interactions e
          JOIN items it ON e.item_id = it.item_id)
, l AS (SELECT user_id, text, max(ts) AS ts FROM log GROUP BY ALL)
SELECT user_id, text, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, text) AS BIGINT) AS rank
FROM l QUALIFY rank <= 5""".replace("\n, log AS", ", log AS", 1))
def recent_searches_q(spark, sf):
    """Search log derived from the event log: the viewed item's title."""
    e = B.event_interactions(spark, sf)
    log = e.join(B.items(spark, sf).select("item_id", "title"), "item_id").select(
        "user_id", F.col("title").alias("text"), F.col("timestamp").alias("ts"))
    return W.recent_searches(log, 5).select("user_id", "text", "rank")


# ------------------------------------------------------------------ 2.8 sets

@register("union_sources", "2.8", B.with_ctes("items", "event_interactions") + """
, s AS (SELECT item_id, title, 0 AS source_rank FROM items
        UNION ALL SELECT DISTINCT item_id, 'event item ' || item_id, 1 FROM event_interactions
        UNION ALL SELECT DISTINCT CAST(l_suppkey AS VARCHAR), 'supplier line ' || CAST(l_suppkey AS VARCHAR), 2 FROM lineitem)
SELECT item_id, title, source_rank FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY source_rank) = 1
""".replace("\n, s AS", ", s AS", 1))
def union_sources_q(spark, sf):
    """Three landed sources with overlapping ids; the first source wins."""
    from ..sources.tables import raw
    a = B.items(spark, sf).select("item_id", "title")
    b = (B.event_interactions(spark, sf).select("item_id").distinct()
         .select("item_id", F.concat(F.lit("event item "), F.col("item_id")).alias("title")))
    c = (raw(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("item_id")).distinct()
         .select("item_id", F.concat(F.lit("supplier line "), F.col("item_id")).alias("title")))
    return SETS.union_sources([a, b, c]).select("item_id", "title", F.col("source_rank").cast("int"))


@register("candidate_union", "2.8", B.with_ctes("interactions", "event_interactions") + """
, s AS (SELECT DISTINCT user_id, item_id, 'orders' AS strategy FROM interactions
        UNION ALL SELECT DISTINCT user_id, item_id, 'events' FROM event_interactions)
SELECT user_id, item_id, array_to_string(list_sort(list(DISTINCT strategy)), ',') AS strategies
FROM s GROUP BY user_id, item_id""".replace("\n, s AS", ", s AS", 1))
def candidate_union_q(spark, sf):
    c = SETS.candidate_union({"orders": B.interactions(spark, sf), "events": B.event_interactions(spark, sf)})
    return c.select("user_id", "item_id", F.array_join("strategies", ",").alias("strategies"))


@register("candidate_except", "2.8", B.with_ctes("interactions", "event_interactions") + """
SELECT DISTINCT e.user_id, e.item_id FROM event_interactions e
ANTI JOIN interactions i ON i.user_id = e.user_id AND i.item_id = e.item_id""")
def candidate_except_q(spark, sf):
    c = B.event_interactions(spark, sf).select("user_id", "item_id").distinct()
    return SETS.candidate_except(c, B.interactions(spark, sf))


# --------------------------------------------------------------- 2.2 keyed writes

@register("upsert", "2.2", B.with_ctes("items", "event_interactions") + """
, upd AS (SELECT e.item_id, max(e.timestamp) AS ts, count(*) AS n FROM event_interactions e GROUP BY e.item_id)
SELECT it.item_id, CASE WHEN u.item_id IS NOT NULL THEN it.view_count + u.n ELSE it.view_count END AS view_count
FROM items it LEFT JOIN upd u ON it.item_id = u.item_id
UNION ALL SELECT 'event_' || u.item_id, u.n FROM upd u""".replace("\n, upd AS", ", upd AS", 1))
def upsert_q(spark, sf):
    it = B.items(spark, sf).select("item_id", "view_count", F.lit(None).cast("timestamp_ntz").alias("ts"))
    e = B.event_interactions(spark, sf)
    upd = (e.groupBy("item_id").agg(F.max("timestamp").alias("ts"), F.count(F.lit(1)).alias("n"))
           .join(it.select("item_id", F.col("view_count").alias("v0")), "item_id", "left"))
    known = upd.where("v0 is not null").select("item_id", (F.col("v0") + F.col("n")).alias("view_count"), "ts")
    new = upd.select(F.concat(F.lit("event_"), "item_id").alias("item_id"), F.col("n").alias("view_count"), "ts")
    return SETS.upsert(it, known.unionByName(new), "item_id", "ts").select("item_id", F.col("view_count").cast("long"))


@register("append_interactions", "2.2", B.with_ctes("event_interactions") + """
, mx AS (SELECT max(timestamp) AS t FROM event_interactions)
, log AS (SELECT * FROM event_interactions WHERE timestamp < (SELECT t FROM mx) - INTERVAL 15 DAY)
, new AS (SELECT * FROM event_interactions WHERE timestamp >= (SELECT t FROM mx) - INTERVAL 20 DAY)
SELECT DISTINCT interaction_id, user_id, item_id FROM new
WHERE interaction_id NOT IN (SELECT interaction_id FROM log)""".replace("\n, mx AS", ", mx AS", 1))
def append_interactions_q(spark, sf):
    """Append a batch overlapping the log by five days, delivered twice."""
    e = B.event_interactions(spark, sf)
    t = B.as_of(e)
    log = e.filter(F.col("timestamp") < t - F.make_interval(days=F.lit(15)))
    new = e.filter(F.col("timestamp") >= t - F.make_interval(days=F.lit(20)))
    return SETS.append_interactions(log, new.unionByName(new)).select("interaction_id", "user_id", "item_id")


@register("insert_if_absent", "2.2", B.with_ctes("experiment_events") + """
, first AS (SELECT user_id, experiment_id, bucket FROM experiment_events
            QUALIFY row_number() OVER (PARTITION BY user_id, experiment_id ORDER BY timestamp, event_id) = 1)
, stored AS (SELECT user_id, experiment_id, 'earlier' AS bucket FROM first WHERE CAST(user_id AS BIGINT) % 2 = 0
             UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'exp_before', 'control' FROM customer)
SELECT user_id, experiment_id, bucket FROM stored
UNION ALL SELECT user_id, experiment_id, bucket FROM first WHERE CAST(user_id AS BIGINT) % 2 <> 0""".replace("\n, first AS", ", first AS", 1))
def insert_if_absent_q(spark, sf):
    """Half of the users were assigned earlier, to another bucket, which
    stays; so do assignments to an earlier experiment."""
    from ..operators.topk import first_per_key
    from ..sources.tables import raw
    ev = B.experiment_events(spark, sf)
    first = first_per_key(ev, ["user_id", "experiment_id"], ["timestamp", "event_id"]).select("user_id", "experiment_id", "bucket")
    stored = (first.where(F.col("user_id").cast("long") % 2 == 0).withColumn("bucket", F.lit("earlier"))
              .unionByName(raw(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("user_id"),
                                                             F.lit("exp_before").alias("experiment_id"), F.lit("control").alias("bucket"))))
    return SETS.insert_if_absent(stored, first)


@register("rebuild_counters", "2.2", B.with_ctes("users", "items", "interactions") + """
SELECT 'user' AS kind, u.user_id AS id, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM users u LEFT JOIN (SELECT user_id, count(*) AS n FROM interactions GROUP BY user_id) c ON u.user_id = c.user_id
UNION ALL
SELECT 'item', it.item_id, CAST(coalesce(v.n, 0) AS BIGINT)
FROM items it LEFT JOIN (SELECT item_id, count(*) AS n FROM interactions WHERE interaction_type = 'view'
                         GROUP BY item_id) v ON it.item_id = v.item_id""")
def rebuild_counters_q(spark, sf):
    """Both halves: interactions per user and views per item."""
    u, i = SETS.rebuild_counters(B.users(spark, sf), B.items(spark, sf), B.interactions(spark, sf))
    return (u.select(F.lit("user").alias("kind"), F.col("user_id").alias("id"), F.col("total_interactions").alias("n"))
            .unionByName(i.select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), F.col("view_count").alias("n"))))
