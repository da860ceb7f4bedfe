"""Intent-routed search over a table of queries.

``classify_intent`` evaluates each pattern once (``regexp_extract``, JVM-side)
and takes the first pattern that matched; each route is a set-oriented job
over the subset of queries with that intent, and ``answer_queries`` unions
them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalars import strip_ws
from . import search as SE
from .topk import rank_within

# FIXED VALUES — intent patterns in evaluation order (first hit wins; the
# target is capture group 1, stripped).
INTENT_PATTERNS = [
    ("similar_to", r"similar to (.+)"),
    ("similar_to", r"like (.+)"),
    ("similar_to", r"related to (.+)"),
    ("similar_to", r"comparable to (.+)"),
    ("category_filter", r"(.+) (video|movie|article|product|music|podcast|course|game)s?"),
    ("category_filter", r"(video|movie|article|product|music|podcast|course|game)s? about (.+)"),
    ("category_filter", r"show me (.+) content"),
    ("recommendation_request", r"recommend (.+)"),
    ("recommendation_request", r"suggest (.+)"),
    ("recommendation_request", r"find me (.+)"),
    ("recommendation_request", r"i want (.+)"),
    ("recommendation_request", r"looking for (.+)"),
    ("educational", r"learn (.+)"),
    ("educational", r"how to (.+)"),
    ("educational", r"tutorial (.+)"),
    ("educational", r"guide (.+)"),
    ("trending", r"trending (.+)"),
    ("trending", r"popular (.+)"),
    ("trending", r"hot (.+)"),
    ("trending", r"viral (.+)"),
]

# FIXED VALUES — content type keyword lists in evaluation order (first list
# with a substring hit gives the type hint).
TYPE_KEYWORDS = [
    ("video", ["video", "watch", "clip", "movie", "film", "show"]),
    ("movie", ["movie", "film", "cinema", "blockbuster", "hollywood"]),
    ("article", ["article", "read", "blog", "news", "story", "post"]),
    ("product", ["product", "buy", "purchase", "shop", "item", "goods"]),
    ("music", ["music", "song", "track", "album", "artist", "band"]),
    ("podcast", ["podcast", "listen", "episode", "show", "audio"]),
    ("course", ["course", "learn", "tutorial", "lesson", "class", "education"]),
    ("game", ["game", "play", "gaming", "entertainment", "fun"]),
]

SCORES = {"similar_to": 0.8, "category_filter": 0.9, "educational": 0.85, "trending": 0.9}


def normalised_query(col="text") -> F.Column:
    return F.lower(strip_ws(F.col(col)))


def classify_intent(queries: DataFrame) -> DataFrame:
    """Adds ``q`` (normalised text), ``intent``, ``target`` and ``type_hint``."""
    q = normalised_query()
    # Group 1 of every pattern is non-empty exactly when the pattern
    # matches, so one extract per pattern serves as both test and target.
    base = queries.select("*", q.alias("q"))
    ex = F.array(*[F.regexp_extract(F.col("q"), "(?i)" + pat, 1) for _, pat in INTENT_PATTERNS])
    base = base.withColumn("_ex", ex).withColumn(
        "_i", F.array_position(F.transform("_ex", lambda x: x != ""), True).cast("int"))
    names = F.array(*[F.lit(n) for n, _ in INTENT_PATTERNS])
    intent = F.when(F.col("_i") > 0, F.element_at(names, F.greatest(F.col("_i"), F.lit(1)))) \
        .otherwise(F.lit("general"))
    target = F.when(F.col("_i") > 0, strip_ws(F.element_at("_ex", F.greatest(F.col("_i"), F.lit(1))))) \
        .otherwise(F.col("q"))
    q = F.col("q")
    hint = F.lit(None).cast("string")
    for ctype, words in reversed(TYPE_KEYWORDS):
        hit = reduce(lambda a, b: a | b, [q.contains(w) for w in words])
        hint = F.when(hit, F.lit(ctype)).otherwise(hint)
    return base.select(*queries.columns, "q", intent.alias("intent"), target.alias("target"),
                       hint.alias("type_hint"))


def classify_intent_sql(text_expr: str) -> tuple[str, str, str]:
    q = f"lower(regexp_replace({text_expr}, '^[\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+$', '', 'g'))"
    intent = " ".join(f"WHEN regexp_matches({q}, '{p}', 'i') THEN '{n}'" for n, p in INTENT_PATTERNS)
    target = " ".join(
        f"WHEN regexp_matches({q}, '{p}', 'i') THEN regexp_replace(regexp_extract({q}, '{p}', 1, 'i'), "
        f"'^[\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+$', '', 'g')" for _, p in INTENT_PATTERNS)
    hint = " ".join(f"WHEN " + " OR ".join(f"contains({q}, '{w}')" for w in ws) + f" THEN '{t}'"
                    for t, ws in TYPE_KEYWORDS)
    return (f"CASE {intent} ELSE 'general' END", f"CASE {target} ELSE {q} END", f"CASE {hint} END")


def _scored(df: DataFrame, intent: str, score) -> DataFrame:
    return df.select("query_id", F.lit(intent).alias("intent"), "rank", "item_id",
                     (score if not isinstance(score, float) else F.lit(score)).alias("search_score"))


def _as_queries(c: DataFrame, text: str, ctype) -> DataFrame:
    return c.select("query_id", F.col("user_id"), F.col(text).alias("text"), ctype.alias("content_type"),
                    F.col("limit"))


def _most(c: DataFrame) -> int:
    """The largest limit of the queries: no route needs more rows of one."""
    return max(1, int(c.agg(F.max("limit")).first()[0] or 1))


def route_similar(spark: SparkSession, c: DataFrame, items: DataFrame) -> DataFrame:
    """Top-5 text hits for the target, 10 similar items each, first
    occurrence in (hit rank, similar rank) order, cut to the limit."""
    from .joins import similar_items
    q = _as_queries(c, "target", F.lit(None).cast("string"))
    hits = SE.text_search(spark, q, items, 5).select("query_id", F.col("item_id").alias("src"),
                                                    F.col("rank").alias("hit_rank"))
    from .components import reliable
    hits = reliable(hits)
    sim = similar_items(items, 10, of=hits.select(F.col("src").alias("item_id"))).select(F.col("item_id").alias("src"), F.col("sim_id").alias("item_id"),
                                          F.col("rank").alias("sim_rank"))
    cand = hits.join(sim, "src")
    first = rank_within(cand, ["query_id", "item_id"], ["hit_rank", "sim_rank"], 1, "_f").drop("_f")
    lim = c.select("query_id", "limit")
    out = rank_within(first, ["query_id"], ["hit_rank", "sim_rank"], _most(c)).join(lim, "query_id")
    return _scored(out.filter(F.col("rank") <= F.col("limit")), "similar_to", 0.8)


def route_category(spark: SparkSession, c: DataFrame, items: DataFrame) -> DataFrame:
    """Literal category match with the type hint (else the request type),
    views then rating; queries without a hit fall back to text search."""
    ctype = F.coalesce(F.col("type_hint"), F.col("content_type"))
    q = _as_queries(c, "target", ctype)
    order, k = [F.col("view_count").desc(), F.col("rating").desc(), F.col("item_id").asc()], _most(c)
    hits = SE.literal_hits(spark, q, items, fields=("category",), tags=None, order=order, k=k)
    j = (hits.join(items.select("item_id", "content_type", "view_count", "rating"), "item_id")
         .join(q.select("query_id", F.col("content_type").alias("want"), "limit"), "query_id")
         .filter(F.col("want").isNull() | (F.col("content_type") == F.col("want"))))
    top = rank_within(j, ["query_id"], order, k).filter(F.col("rank") <= F.col("limit"))
    rest = q.join(top.select("query_id").distinct(), "query_id", "left_anti")
    fb = SE.text_search(spark, rest, items, k).join(rest.select("query_id", "limit"), "query_id") \
        .filter(F.col("rank") <= F.col("limit"))
    return _scored(top, "category_filter", 0.9).unionByName(_scored(fb, "category_filter", 0.9))


def route_educational(spark: SparkSession, c: DataFrame, items: DataFrame) -> DataFrame:
    """Course, article, video and podcast items literally matching the
    target; rating then views."""
    q = _as_queries(c, "target", F.lit(None).cast("string"))
    edu = items.filter(F.col("content_type").isin(*K.EDUCATIONAL_TYPES))
    r = SE.literal_search(spark, q, edu, _most(c), order="rating").join(q.select("query_id", "limit"), "query_id")
    return _scored(r.filter(F.col("rank") <= F.col("limit")), "educational", 0.85)


def route_trending(spark: SparkSession, c: DataFrame, items: DataFrame) -> DataFrame:
    """Literal match of the target (blank target: everything) under the
    request type; views then rating."""
    q = _as_queries(c, "target", F.col("content_type"))
    r = SE.literal_search(spark, q, items, _most(c)).join(q.select("query_id", "limit"), "query_id")
    return _scored(r.filter(F.col("rank") <= F.col("limit")), "trending", 0.9)


def route_recommend(spark: SparkSession, c: DataFrame, items: DataFrame, recs: DataFrame) -> DataFrame:
    """Recommendations (2 x limit) whose title, description, category or tags
    contain any target word; queries without a user go to trending."""
    anon = c.filter(F.col("user_id").isNull())
    known = c.filter(F.col("user_id").isNotNull()).select(
        "query_id", "user_id", "limit", F.split("target", r"\s+").alias("words"))
    r = recs.join(items.select("item_id", "title", "description", "category", "tags"), "item_id")
    j = known.join(r, "user_id").filter(F.col("rank") <= F.col("limit") * 2)
    text = F.lower(F.concat_ws(" ", "title", "description", "category",
                               F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")))
    j = j.filter(F.exists("words", lambda w: (w != "") & text.contains(w)))
    out = rank_within(j.withColumnRenamed("rank", "rec_rank"), ["query_id"], ["rec_rank"], _most(c)) \
        .filter(F.col("rank") <= F.col("limit"))
    return _scored(out, "recommendation_request", F.col("score") if "score" in recs.columns else 0.0) \
        .unionByName(route_trending(spark, anon, items).withColumn("intent", F.lit("recommendation_request")))


def route_general(spark: SparkSession, c: DataFrame, items: DataFrame) -> DataFrame:
    q = _as_queries(c, "q", F.col("content_type"))
    r = SE.enhanced_search(spark, q, items, _most(c)).join(q.select("query_id", "limit"), "query_id") \
        .filter(F.col("rank") <= F.col("limit"))
    return r.select("query_id", F.lit("general").alias("intent"), F.col("enhanced_rank").alias("rank"),
                    "item_id", "search_score")


def answer_queries(spark: SparkSession, queries: DataFrame, items: DataFrame,
                   recs: DataFrame | None = None) -> DataFrame:
    """Classify every query, run each intent's route on its subset, union.

    Queries and items are written once, and each route's rows before the next
    route is planned, so that what one of them broadcasts does not add up with
    the others' in the driver."""
    from .components import reliable
    c, items = reliable(classify_intent(queries)), reliable(items)
    by = lambda name: c.filter(F.col("intent") == name)
    parts = [reliable(route_similar(spark, by("similar_to"), items)),
             reliable(route_category(spark, by("category_filter"), items)),
             reliable(route_educational(spark, by("educational"), items)),
             reliable(route_trending(spark, by("trending"), items)),
             reliable(route_general(spark, by("general"), items))]
    rr = by("recommendation_request")
    if recs is not None:
        parts.append(reliable(route_recommend(spark, rr, items, recs)))
    else:
        parts.append(reliable(route_trending(spark, rr, items).withColumn("intent", F.lit("recommendation_request"))))
    return reduce(lambda a, b: a.unionByName(b), parts)
