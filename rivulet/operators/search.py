"""Search operators over a table of queries.

* ``text_search``: inverted index ``(term, item_id, tf)`` joined to the query
  terms; score = sum of the item's term frequencies over the query's distinct
  terms (title + description + tags), no stemming.
* ``literal_hits``: case-insensitive literal substring in title, description,
  category or any tag.  Exact and join-based: a query of 3+ characters can
  only match items containing every one of its trigrams, so each query is
  joined on its rarest trigram only, then verified with ``contains``.  Texts
  shorter than 3 characters form a bounded set (at most |alphabet|^2 distinct
  values) and are matched against a broadcast of those texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalars import literal_match, strip_ws
from .text import stop_words, tokenize
from .topk import rank_within

CARD = ["item_id", "title", "content_type", "category", "description",
        "thumbnail_url", "rating", "view_count"]


def validate_requests(q: DataFrame) -> DataFrame:
    """Trim, cut and clamp request parameters; flag unknown content types
    (``valid`` false: the rows to reject).  Request texts are cut here and
    nowhere else."""
    lim = F.col("limit")
    return q.select(
        "query_id",
        F.substring(F.trim("text"), 1, 512).alias("text"),
        F.substring(F.trim("text"), 1, 128).alias("suggest_text"),
        F.least(F.greatest(lim, F.lit(1)), F.lit(100)).alias("n"),
        F.least(lim, F.lit(100)).alias("search_limit"),
        F.least(F.greatest(lim, F.lit(1)), F.lit(200)).alias("popular_limit"),
        F.least(F.greatest(lim, F.lit(1)), F.lit(10)).alias("suggest_limit"),
        (F.col("content_type").isNull() | F.col("content_type").isin(*K.CONTENT_TYPES)).alias("valid"))


def query_text(col="text") -> F.Column:
    return F.lower(strip_ws(F.col(col)))


# ------------------------------------------------------------ literal match

def _trigrams(s: F.Column) -> F.Column:
    return F.when(F.length(s) >= 3, F.transform(F.sequence(F.lit(1), F.length(s) - 2),
                                                lambda i: F.substring(s, i, 3))).otherwise(
        F.array().cast("array<string>"))


def _short_grams(s: F.Column) -> F.Column:
    """All pieces of one and two characters."""
    n = F.coalesce(F.length(s), F.lit(0))
    cut = lambda w: F.transform(F.filter(F.sequence(F.lit(0), n - (w - 1)), lambda i: i > 0), lambda i: F.substring(s, i, w))
    return F.concat(F.when(n >= 1, cut(1)).otherwise(F.array().cast("array<string>")), F.when(n >= 2, cut(2)).otherwise(F.array().cast("array<string>")))


def literal_hits(spark: SparkSession, queries: DataFrame, items: DataFrame,
                 fields=("title", "description", "category"), tags: str | None = "tags",
                 order: list | None = None, k: int | None = None) -> DataFrame:
    """(query_id, item_id) for every item literally matching the query text.
    An empty text matches every item.

    Items of the same texts are matched once.  Queries of three characters and
    more meet texts by their rarest trigram and are verified; only trigrams
    that some query has are counted.  Shorter ones are themselves keys of a
    posting list.  Given the result's ``order`` and ``k``, a text stands for its
    first k items of each content type only, as no query can return others."""
    q = queries.select("query_id", query_text().alias("qt"))
    texts = q.select("qt").distinct()
    empty = F.array().cast("array<string>")
    cols = [*fields, *([tags] if tags else [])]
    members = items.select("*", F.sha2(F.to_json(F.struct(*cols)), 256).alias("tid"))
    it = members.groupBy("tid").agg(*[F.first(c).alias(c) for c in cols])
    fcols = [F.lower(F.col(f)) for f in fields]
    tag_arr = F.coalesce(F.transform(F.col(tags), lambda t: F.lower(t)), empty) if tags else empty
    all_fields = F.concat(F.array(*fcols), tag_arr)
    match = literal_match(F.col("qt"), *fields, tags=F.col(tags) if tags else None)

    # 1. long queries: rarest-trigram join, then exact verification
    long_t = texts.filter(F.length("qt") >= 3)
    qg = long_t.select("qt", F.explode(F.array_distinct(_trigrams(F.col("qt")))).alias("g"))
    grams = (it.select("tid", F.explode(F.array_distinct(F.flatten(F.transform(all_fields, _trigrams)))).alias("g"))
             .join(qg.select("g").distinct(), "g", "left_semi"))
    gdf = grams.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    rare = rank_within(qg.join(gdf, "g"), ["qt"], [F.col("df").asc(), F.col("g").asc()], 1, "_r")
    missing = qg.join(gdf, "g", "left_anti").select("qt").distinct()  # a trigram that no item has
    # the long side streams past the few queries of a key
    cand = grams.join(rare.join(missing, "qt", "left_anti").select("qt", "g"), "g").select("qt", "tid")
    long_hits = cand.join(it, "tid").filter(match).select("qt", "tid")

    # 2. short queries: posting lists of the pieces that are asked for
    short_t = texts.filter(F.length("qt") < 3)
    keys = F.array_distinct(F.concat(F.array(F.lit("")), F.flatten(F.transform(all_fields, _short_grams))))
    posts = it.select("tid", F.explode(keys).alias("qt")).join(short_t, "qt", "left_semi").select("qt", "tid")
    known = members.where("item_id is not null")
    if k is not None:
        members = known = rank_within(known, ["tid", "content_type"], order, k, "_r")
        short_hits = rank_within(posts.join(members, "tid"), ["qt", "content_type"], order, k, "_s").select("qt", "item_id")
    else:
        short_hits = posts.join(members.select("tid", "item_id"), "tid").select("qt", "item_id")
    hits = long_hits.join(known.select("tid", "item_id"), "tid").select("qt", "item_id").unionByName(short_hits)
    return hits.join(q, "qt").select("query_id", "item_id")


BY_VIEWS = ("view_count", "rating")
BY_RATING = ("rating", "view_count")


def _best_first(columns) -> list:
    return [F.col(c).desc() for c in columns] + [F.col("item_id").asc()]


def literal_search(spark: SparkSession, queries: DataFrame, items: DataFrame, k: int = 20,
                   order: str = "views") -> DataFrame:
    """Literal match, optional per-query type filter, views desc then rating
    desc (or rating then views), top k per query; only winners carry text."""
    o = _best_first(BY_VIEWS if order == "views" else BY_RATING)
    hits = literal_hits(spark, queries, items, order=o, k=k)
    j = (hits.join(items.select("item_id", "content_type", "view_count", "rating"), "item_id")
         .join(queries.select("query_id", F.col("content_type").alias("want_type")), "query_id")
         .filter(F.col("want_type").isNull() | (F.col("content_type") == F.col("want_type"))))
    top = rank_within(j, ["query_id"], o, k).select("query_id", "item_id", "rank")
    return top.join(items.select(*CARD, "tags"), "item_id")


# ------------------------------------------------------------ text index

def item_text(items: DataFrame) -> F.Column:
    return F.concat_ws(" ", F.col("title"), F.col("description"),
                       F.array_join(F.coalesce(F.col("tags"), F.array().cast("array<string>")), " "))


def inverted_index(spark: SparkSession, items: DataFrame, text: F.Column | None = None) -> DataFrame:
    """(term, item_id, tf) without stop words."""
    t = items.select("item_id", F.explode(tokenize(text if text is not None else item_text(items))).alias("term"))
    t = t.join(F.broadcast(stop_words(spark)), "term", "left_anti")
    return t.groupBy("term", "item_id").agg(F.count(F.lit(1)).alias("tf"))


def query_terms(spark: SparkSession, queries: DataFrame) -> DataFrame:
    t = queries.select("query_id", F.explode(F.array_distinct(tokenize(query_text()))).alias("term"))
    return t.join(F.broadcast(stop_words(spark)), "term", "left_anti")


def text_search(spark: SparkSession, queries: DataFrame, items: DataFrame, k: int = 20,
                index: DataFrame | None = None) -> DataFrame:
    """Any-term match ranked by summed term frequency, top k per query;
    a query's ``content_type`` (when set) filters the items.  Items of the same
    text are scored once (a given ``index`` is of items, each on its own)."""
    terms = query_terms(spark, queries)
    want = queries.select("query_id", F.col("content_type").alias("want_type"))
    if index is None:
        rows = items.select("item_id", F.struct("content_type").alias("kind"), item_text(items).alias("text")).where("item_id is not null")
        docs = rows.groupBy("item_id").agg(F.sort_array(F.collect_list("text")).alias("texts"), F.collect_list("kind").alias("kinds"))
        docs = docs.select("item_id", "kinds", "texts", F.sha2(F.to_json(F.struct("texts")), 256).alias("tid"))
        index = docs.groupBy("tid").agg(F.first("texts").alias("texts")).select(F.col("tid").alias("item_id"), F.explode("texts").alias("text"))
        index = inverted_index(spark, index, F.col("text"))
        members = docs.select("tid", "item_id", F.explode("kinds").alias("kind"))
        members = rank_within(members.select("tid", "item_id", "kind.content_type"), ["tid", "content_type"], [F.col("item_id").asc()], k, "_r").drop("_r")
    else:
        members = items.select(F.col("item_id").alias("tid"), "item_id", "content_type")
    index = index.join(terms.select("term").distinct(), "term", "left_semi").withColumnRenamed("item_id", "tid")
    # postings stream past the few queries of a term
    scores = index.join(terms, "term").groupBy("query_id", "tid").agg(F.sum("tf").cast("double").alias("score"))
    # the k texts (of one type each) that come first by their smallest id hold the first k items
    heads = members.groupBy("tid", "content_type").agg(F.min("item_id").alias("first"))
    j = (scores.join(want, "query_id").join(heads, "tid")
         .filter(F.col("want_type").isNull() | (F.col("content_type") == F.col("want_type"))))
    best = rank_within(j, ["query_id"], [F.col("score").desc(), F.col("first").asc()], k, "_r").select("query_id", "tid", "score", F.col("content_type").alias("kind"))
    j = best.join(members, "tid").where(F.col("kind").eqNullSafe(F.col("content_type"))).select("query_id", "item_id", "score")
    top = rank_within(j, ["query_id"], [F.col("score").desc(), F.col("item_id").asc()], k)
    return items.select(*CARD, "tags").join(top, "item_id").select(*top.columns, *CARD[1:], "tags")  # only the winners carry text


def enhanced_search(spark: SparkSession, queries: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """Text hits re-scored: +0.2 per query word inside the title, +0.3 when
    any word is inside the category, +0.1 per (word, tag) containment."""
    hits = text_search(spark, queries, items, k)
    words = queries.select("query_id", F.filter(F.split(F.lower(F.trim("text")), r"\s+"),
                                                lambda w: w != "").alias("words"))
    j = hits.join(words, "query_id")
    title_m = F.size(F.filter("words", lambda w: F.lower(F.col("title")).contains(w)))
    cat_m = F.exists("words", lambda w: F.lower(F.col("category")).contains(w))
    tag_m = F.aggregate("words", F.lit(0), lambda acc, w: acc + F.size(
        F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(t).contains(w))))
    scored = j.withColumn("search_score", F.round(F.col("score") + title_m * 0.2 +
                                                  F.when(cat_m, 0.3).otherwise(0.0) + tag_m * 0.1, 6))
    return rank_within(scored.drop("words"), ["query_id"],
                       [F.col("search_score").desc(), F.col("rank").asc()], None, "enhanced_rank")


def suggest(spark: SparkSession, queries: DataFrame, items: DataFrame, k: int = 6,
            prefix_len: int = 4) -> DataFrame:
    """Autocomplete: text hits first; queries without any hit fall back to
    a case-insensitive title prefix, by an index of short beginnings or an
    equi-join on the first ``prefix_len`` characters."""
    q = queries.select("query_id", strip_ws(F.col("text")).alias("text"),
                       "content_type").filter(F.col("text") != "")
    kk = F.least(F.greatest(F.lit(k), F.lit(1)), F.lit(10))
    hits = text_search(spark, q, items, 10).filter(F.col("rank") <= kk).select(
        "query_id", "rank", "title", "content_type", "category", F.lit("text").alias("via"))
    rest = q.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    lt = F.lower(F.col("title"))
    it = items.select("item_id", "title", "content_type", "category")
    rq = rest.select("query_id", F.lower("text").alias("lq"), F.col("content_type").alias("want_type"))
    wanted = F.col("want_type").isNull() | (F.col("content_type") == F.col("want_type"))
    # up to prefix_len characters: an index of beginnings with each one's first
    # k items of a type, as the order does not depend on the query
    pre = it.select("*", F.explode(F.sequence(F.lit(1), F.least(F.length(lt), F.lit(prefix_len)))).alias("L")).where(F.length(lt) > 0)
    index = rank_within(pre.withColumn("lq", F.substring(lt, 1, F.col("L"))), ["lq", "content_type"], [F.col("item_id").asc()], k, "_r").drop("_r", "L")
    short = rq.filter(F.length("lq") <= prefix_len).join(index, "lq").filter(wanted)
    # longer ones: their first prefix_len characters, then the whole beginning
    longer = (rq.filter(F.length("lq") > prefix_len).withColumn("p", F.substring("lq", 1, prefix_len))
              .join(it.withColumn("p", F.substring(lt, 1, prefix_len)), "p").filter(lt.startswith(F.col("lq")) & wanted).drop("p"))
    fb = rank_within(short.unionByName(longer), ["query_id"], [F.col("item_id").asc()], k).select(
        "query_id", "rank", "title", "content_type", "category", F.lit("prefix").alias("via"))
    return hits.unionByName(fb)


def hybrid_score(vec_hits: DataFrame, text_hits: DataFrame, w_vec: float = 0.65,
                 w_text: float = 0.35, k: int = 10) -> DataFrame:
    """Full outer join of vector and text results; text score scaled by the
    best text score of the query; weighted sum, top k."""
    from pyspark.sql import Window
    t = text_hits.select("query_id", "item_id", "score").withColumn(
        "text_norm", F.col("score") / F.max("score").over(Window.partitionBy("query_id")))
    v = vec_hits.select("query_id", "item_id", "similarity")
    j = v.join(t.select("query_id", "item_id", "text_norm"), ["query_id", "item_id"], "full_outer")
    j = j.withColumn("hybrid", F.round(F.lit(w_vec) * F.coalesce("similarity", F.lit(0.0)) +
                                       F.lit(w_text) * F.coalesce("text_norm", F.lit(0.0)), 6))
    return rank_within(j, ["query_id"], [F.col("hybrid").desc(), F.col("item_id").asc()], k)
