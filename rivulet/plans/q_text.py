"""Registered queries: text, vectors and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import literal_match_sql
from ..operators import search as SE
from ..operators import text as TX
from ..operators.components import reliable
from ..operators.ranking import sort_results
from ..sources import binding as B
from ..sources.tables import raw
from .registry import register

STOP = TX.stop_words_sql()
PAT = TX.TOKEN_RE
QT = "lower(regexp_replace(text, '^[\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+$', '', 'g'))"
ITEM_TEXT = "concat_ws(' ', title, description, array_to_string(coalesce(tags, []), ' '))"
ITEM_TEXT_CAT = "concat_ws(' ', title, description, category, array_to_string(coalesce(tags, []), ' '))"


def tfidf_sql(src: str, id_expr: str, text_expr: str, prefix: str, vocab_from: str | None = None,
              max_features: int = 1000) -> list[tuple[str, str]]:
    """CTEs computing ``{prefix}_tc`` term counts and ``{prefix}_vec``
    unit tf-idf vectors (and ``{prefix}_vocab`` unless ``vocab_from``)."""
    ctes = [(f"{prefix}_tc", f"""
  SELECT id, term, count(*) AS tf FROM (
    SELECT {id_expr} AS id, unnest(regexp_extract_all(lower({text_expr}), '{PAT}')) AS term FROM {src})
  WHERE term NOT IN {STOP} GROUP BY id, term""")]
    vocab = vocab_from or f"{prefix}_vocab"
    if vocab_from is None:
        ctes.append((f"{prefix}_vocab", f"""
  SELECT term, cf, df, ln((1.0 + (SELECT count(*) FROM {src})) / (1.0 + df)) + 1.0 AS idf
  FROM (SELECT term, sum(tf) AS cf, count(*) AS df FROM {prefix}_tc GROUP BY term)
  ORDER BY cf DESC, term LIMIT {max_features}"""))
    ctes.append((f"{prefix}_vec", f"""
  SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight
  FROM (SELECT t.id, t.term, t.tf * v.idf AS w FROM {prefix}_tc t JOIN {vocab} v ON t.term = v.term)"""))
    return ctes


def bench_queries_sql() -> tuple[str, str]:
    return ("bq", """
  SELECT item_id AS query_id, CAST(NULL AS VARCHAR) AS user_id,
         text,
         CAST(NULL AS VARCHAR) AS content_type, 10 AS "limit"
  FROM benchmark""")


# ------------------------------------------------------------------ tf-idf

@register("tokenize", "2.9", B.with_ctes("corpus", extra=[("t", f"""
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '{PAT}')) AS term FROM corpus""")]) + f"""
SELECT doc_id, count(*) AS n_tokens, count(DISTINCT term) AS n_terms FROM t
WHERE term NOT IN {STOP} GROUP BY doc_id""")
def tokenize_q(spark, sf):
    rows = TX.term_rows(spark, B.corpus(spark, sf), "doc_id", "text")
    return rows.groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_tokens"),
                                                        F.countDistinct("term").alias("n_terms"))


@register("fit_tfidf", "2.9", B.with_ctes("corpus", extra=tfidf_sql("corpus", "doc_id", "text", "d")) + """
SELECT term, cf, df, round(idf, 6) AS idf FROM d_vocab""")
def fit_tfidf_q(spark, sf):
    v = TX.fit_tfidf(spark, B.corpus(spark, sf), "doc_id", "text", 1000)
    return v.select("term", "cf", "df", F.round("idf", 6).alias("idf"))


@register("tfidf_vectors", "2.9", B.with_ctes("corpus", extra=tfidf_sql("corpus", "doc_id", "text", "d")) + """
SELECT id AS doc_id, count(*) AS n_terms, round(sum(weight), 6) AS weight_sum,
       round(max(weight), 6) AS weight_max FROM d_vec GROUP BY id""")
def tfidf_vectors_q(spark, sf):
    c = B.corpus(spark, sf)
    counts = TX.counted(spark, c, "doc_id", "text")
    vec = TX.tfidf_vectors(spark, c, "doc_id", "text", TX.fit_tfidf(spark, c, "doc_id", "text", 1000, counts), counts)
    return vec.groupBy(F.col("id").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("weight"), 6).alias("weight_sum"),
        F.round(F.max("weight"), 6).alias("weight_max"))


VS_SQL = B.with_ctes("corpus", extra=[bench_queries_sql()] + tfidf_sql("corpus", "doc_id", "text", "d")
                     + tfidf_sql("bq", "query_id", QT, "q", vocab_from="d_vocab") + [("s", """
  SELECT q.id AS query_id, d.id AS item_id, round(sum(q.weight * d.weight), 9) AS similarity
  FROM q_vec q JOIN d_vec d ON q.term = d.term GROUP BY q.id, d.id""")])


@register("vector_search", "2.9", VS_SQL + """
SELECT query_id, item_id, round(similarity, 6) AS similarity,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS BIGINT) AS rank
FROM s WHERE similarity > 0.01 QUALIFY rank <= 10""")
def vector_search_q(spark, sf):
    r = TX.vector_search(spark, B.benchmark_queries(spark, sf), B.corpus(spark, sf), "doc_id", "text", 10)
    return r.select("query_id", "item_id", F.round("similarity", 6).alias("similarity"), "rank")


@register("topk_similarity", "2.7", VS_SQL + """
SELECT query_id, item_id, round(similarity, 6) AS similarity,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS BIGINT) AS rank
FROM s WHERE similarity > 0.05 QUALIFY rank <= 3""")
def topk_similarity_q(spark, sf):
    from ..operators.ranking import topk_similarity
    c = B.corpus(spark, sf)
    counts = TX.counted(spark, c, "doc_id", "text")
    vocab = TX.fit_tfidf(spark, c, "doc_id", "text", 1000, counts)
    dvec = TX.tfidf_vectors(spark, c, "doc_id", "text", vocab, counts)
    qvec = TX.tfidf_vectors(spark, B.benchmark_queries(spark, sf), "query_id", "text", vocab)
    s = TX.score_queries(qvec, dvec).withColumn("similarity", F.round("similarity", 9))
    r = topk_similarity(s, 3, 0.05)
    return r.select("query_id", "item_id", F.round("similarity", 6).alias("similarity"), "rank")


@register("content_similar", "2.9", B.with_ctes("items", extra=tfidf_sql(
    "items", "item_id", ITEM_TEXT_CAT, "d") + [("s", """
  SELECT a.id AS item_id, b.id AS sim_id, round(sum(a.weight * b.weight), 9) AS similarity
  FROM d_vec a JOIN d_vec b ON a.term = b.term AND a.id <> b.id GROUP BY a.id, b.id""")]) + """
SELECT item_id, sim_id, round(similarity, 6) AS similarity,
       CAST(row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, sim_id) AS BIGINT) AS rank
FROM s QUALIFY rank <= 10""")
def content_similar_q(spark, sf):
    r = TX.content_similar(spark, B.items(spark, sf), 10)
    return r.select("item_id", "sim_id", F.round("similarity", 6).alias("similarity"), "rank")


@register("dense_cosine_topk", "2.9", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM e),
s AS (SELECT a.vec_id, b.vec_id AS neighbour, round(list_dot_product(a.u, b.u), 9) AS similarity
      FROM n a JOIN n b ON a.vec_id <> b.vec_id)
SELECT vec_id, neighbour, round(similarity, 6) AS similarity,
       CAST(row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) AS BIGINT) AS rank
FROM s QUALIFY rank <= 5""")
def dense_cosine_topk_q(spark, sf):
    e = raw(spark, sf, "embeddings")
    r = TX.dense_cosine_topk(e, "vec_id", "embedding", 64, 5)
    return r.select("vec_id", "neighbour", F.round("similarity", 6).alias("similarity"), "rank")


# ------------------------------------------------------------------ search

TS_CTES = [("idx", f"""
  SELECT term, item_id, count(*) AS tf FROM (
    SELECT item_id, unnest(regexp_extract_all(lower({ITEM_TEXT}), '{PAT}')) AS term FROM items)
  WHERE term NOT IN {STOP} GROUP BY term, item_id"""), ("qt", f"""
  SELECT DISTINCT query_id, term FROM (
    SELECT query_id, unnest(regexp_extract_all({QT}, '{PAT}')) AS term FROM part_queries)
  WHERE term NOT IN {STOP}"""), ("sc", """
  SELECT q.query_id, i.item_id, CAST(sum(i.tf) AS DOUBLE) AS score
  FROM qt q JOIN idx i ON q.term = i.term GROUP BY q.query_id, i.item_id"""), ("ts", """
  SELECT sc.query_id, sc.item_id, it.title, it.category, it.tags, sc.score,
         CAST(row_number() OVER (PARTITION BY sc.query_id ORDER BY sc.score DESC, sc.item_id) AS BIGINT) AS rank
  FROM sc JOIN items it ON sc.item_id = it.item_id QUALIFY rank <= 20""")]


@register("text_search", "2.9", B.with_ctes("items", "part_queries", extra=TS_CTES) + """
SELECT query_id, item_id, title, score, rank FROM ts""")
def text_search_q(spark, sf):
    r = SE.text_search(spark, B.part_queries(spark, sf), B.items(spark, sf), 20)
    return r.select("query_id", "item_id", "title", "score", "rank")


@register("rank_by_text_score", "2.7", B.with_ctes("items", "part_queries", extra=TS_CTES) + """
SELECT query_id, item_id, score, rank FROM ts WHERE rank <= 5""")
def rank_by_text_score_q(spark, sf):
    r = SE.text_search(spark, B.part_queries(spark, sf), B.items(spark, sf), 5)
    return r.select("query_id", "item_id", "score", "rank")


@register("enhanced_search", "2.9", B.with_ctes("items", "part_queries", extra=TS_CTES + [("w", """
  SELECT query_id, list_filter(string_split_regex(lower(trim(text)), '\\s+'), lambda x: x <> '') AS words
  FROM part_queries""")]) + """
SELECT ts.query_id, ts.item_id, ts.rank,
       round(ts.score + 0.2 * len(list_filter(w.words, lambda x: contains(lower(ts.title), x)))
             + CASE WHEN len(list_filter(w.words, lambda x: contains(lower(ts.category), x))) > 0 THEN 0.3 ELSE 0.0 END
             + 0.1 * list_sum(list_transform(w.words, lambda x: len(list_filter(coalesce(ts.tags, []),
                                                                       lambda t: contains(lower(t), x))))), 6) AS search_score,
       CAST(row_number() OVER (PARTITION BY ts.query_id ORDER BY
            round(ts.score + 0.2 * len(list_filter(w.words, lambda x: contains(lower(ts.title), x)))
             + CASE WHEN len(list_filter(w.words, lambda x: contains(lower(ts.category), x))) > 0 THEN 0.3 ELSE 0.0 END
             + 0.1 * list_sum(list_transform(w.words, lambda x: len(list_filter(coalesce(ts.tags, []),
                                                                       lambda t: contains(lower(t), x))))), 6) DESC,
            ts.rank) AS BIGINT) AS enhanced_rank
FROM ts JOIN w ON ts.query_id = w.query_id""")
def enhanced_search_q(spark, sf):
    r = SE.enhanced_search(spark, B.part_queries(spark, sf), B.items(spark, sf), 20)
    return r.select("query_id", "item_id", "rank", "search_score", "enhanced_rank")


LQ_CTES = [("lq", """
  SELECT query_id, text, content_type FROM part_queries
  UNION ALL SELECT DISTINCT CAST(('0x' || substr(sha256(lower(substr(p_type, 1, 2))), 1, 15)) AS BIGINT),
         lower(substr(p_type, 1, 2)), CAST(NULL AS VARCHAR) FROM part""")]


def lit_queries(spark, sf):
    short = (raw(spark, sf, "part").select(F.lower(F.substring("p_type", 1, 2)).alias("text")).distinct()
             .select(B.text_id("text").alias("query_id"), "text", F.lit(None).cast("string").alias("content_type")))
    return B.part_queries(spark, sf).select("query_id", "text", "content_type").unionByName(short)


@register("literal_match", "2.3", B.with_ctes("items", "part_queries", extra=LQ_CTES) + f"""
SELECT q.query_id, i.item_id FROM lq q JOIN items i
  ON {literal_match_sql('q.text', ['i.title', 'i.description', 'i.category'], 'i.tags')}""")
def literal_match_q(spark, sf):
    return SE.literal_hits(spark, lit_queries(spark, sf), B.items(spark, sf))


LS_SQL = B.with_ctes("items", "part_queries", extra=LQ_CTES) + f"""
SELECT q.query_id, i.item_id, i.title, i.view_count, i.rating,
       CAST(row_number() OVER (PARTITION BY q.query_id ORDER BY i.view_count DESC, i.rating DESC, i.item_id) AS BIGINT) AS rank
FROM lq q JOIN items i ON {literal_match_sql('q.text', ['i.title', 'i.description', 'i.category'], 'i.tags')}
WHERE q.content_type IS NULL OR i.content_type = q.content_type
QUALIFY rank <= 20"""


@register("literal_search", "2.9", LS_SQL)
def literal_search_q(spark, sf):
    r = SE.literal_search(spark, lit_queries(spark, sf), B.items(spark, sf), 20)
    return r.select("query_id", "item_id", "title", "view_count", "rating", "rank")


@register("sort_results", "2.7", "WITH ls AS (" + LS_SQL.replace("WITH ", "WITH ", 1) + """)
, m AS (SELECT ls.query_id, ls.item_id, ls.rank, ls.rating, ls.view_count, 1.0 / ls.rank AS search_score,
              (SELECT min(l_shipdate) FROM lineitem WHERE CAST(l_partkey AS VARCHAR) = ls.item_id) AS shipped FROM ls)
SELECT 'rating' AS mode, query_id, item_id, rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rating DESC, item_id) AS BIGINT) AS sort_rank FROM m
UNION ALL SELECT 'views', query_id, item_id, rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY view_count DESC, item_id) AS BIGINT) FROM m
UNION ALL SELECT 'relevance', query_id, item_id, rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY search_score DESC, item_id) AS BIGINT) FROM m
UNION ALL SELECT 'newest', query_id, item_id, rank, CAST(row_number() OVER (PARTITION BY query_id
       ORDER BY coalesce(shipped, TIMESTAMP '1995-01-01') DESC, item_id) AS BIGINT) FROM m""")
def sort_results_q(spark, sf):
    """All four sort modes over the same hits."""
    items = B.items(spark, sf)
    r = (SE.literal_search(spark, lit_queries(spark, sf), items, 20).withColumn("search_score", F.lit(1.0) / F.col("rank"))
         .join(items.select("item_id", "publish_ts"), "item_id"))
    out = None
    for mode in ("rating", "views", "relevance", "newest"):
        part = sort_results(r, mode, ["query_id"]).select(F.lit(mode).alias("mode"), "query_id", "item_id", "rank", "sort_rank")
        out = part if out is None else out.unionByName(part)
    return out


SUG_CTES = [("sq", """
  SELECT DISTINCT CAST(('0x' || substr(sha256(substr(p_name, 1, 4)), 1, 15)) AS BIGINT) AS query_id,
         CAST(NULL AS VARCHAR) AS user_id, substr(p_name, 1, 4) AS text, CAST(NULL AS VARCHAR) AS content_type
  FROM part"""), ("qt", f"""
  SELECT DISTINCT query_id, term FROM (
    SELECT query_id, unnest(regexp_extract_all({QT}, '{PAT}')) AS term FROM sq)
  WHERE term NOT IN {STOP}"""), ("idx", TS_CTES[0][1]), ("sc", """
  SELECT q.query_id, i.item_id, CAST(sum(i.tf) AS DOUBLE) AS score
  FROM qt q JOIN idx i ON q.term = i.term GROUP BY q.query_id, i.item_id"""), ("hits", """
  SELECT sc.query_id, it.title, it.content_type, it.category, 'text' AS via,
         CAST(row_number() OVER (PARTITION BY sc.query_id ORDER BY sc.score DESC, sc.item_id) AS BIGINT) AS rank
  FROM sc JOIN items it ON sc.item_id = it.item_id QUALIFY rank <= 6"""), ("fb", """
  SELECT q.query_id, it.title, it.content_type, it.category, 'prefix' AS via,
         CAST(row_number() OVER (PARTITION BY q.query_id ORDER BY it.item_id) AS BIGINT) AS rank
  FROM sq q JOIN items it ON starts_with(lower(it.title), lower(q.text))
  WHERE q.query_id NOT IN (SELECT query_id FROM hits) QUALIFY rank <= 6""")]


@register("suggest", "2.9", B.with_ctes("items", extra=SUG_CTES) + """
SELECT query_id, rank, title, content_type, category, via FROM hits
UNION ALL SELECT query_id, rank, title, content_type, category, via FROM fb""")
def suggest_q(spark, sf):
    q = (raw(spark, sf, "part").select(F.substring("p_name", 1, 4).alias("text")).distinct()
         .select(B.text_id("text").alias("query_id"), F.lit(None).cast("string").alias("user_id"), "text",
                 F.lit(None).cast("string").alias("content_type")))
    return SE.suggest(spark, q, B.items(spark, sf), 6)


@register("hybrid_score", "2.9", B.with_ctes("items", "part_queries", extra=TS_CTES + tfidf_sql(
    "items", "item_id", ITEM_TEXT_CAT, "d") + tfidf_sql("part_queries", "query_id", QT, "q", vocab_from="d_vocab") + [
    ("vs", """
  SELECT q.id AS query_id, d.id AS item_id, round(sum(q.weight * d.weight), 9) AS similarity
  FROM q_vec q JOIN d_vec d ON q.term = d.term GROUP BY q.id, d.id"""), ("vt", """
  SELECT * FROM vs WHERE similarity > 0.01
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) <= 20"""), ("tn", """
  SELECT query_id, item_id, score / max(score) OVER (PARTITION BY query_id) AS text_norm FROM ts"""), ("h", """
  SELECT coalesce(v.query_id, t.query_id) AS query_id, coalesce(v.item_id, t.item_id) AS item_id,
         round(0.65 * coalesce(v.similarity, 0.0) + 0.35 * coalesce(t.text_norm, 0.0), 6) AS hybrid
  FROM vt v FULL OUTER JOIN tn t ON v.query_id = t.query_id AND v.item_id = t.item_id""")]) + """
SELECT query_id, item_id, hybrid,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, item_id) AS BIGINT) AS rank
FROM h QUALIFY rank <= 10""")
def hybrid_score_q(spark, sf):
    items = B.items(spark, sf)
    q = B.part_queries(spark, sf)
    text = F.concat_ws(" ", "title", "description", "category",
                       F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "))
    docs = items.select("item_id", text.alias("text"))
    vec = TX.vector_search(spark, q, docs, "item_id", "text", 20)
    th = SE.text_search(spark, q, items, 20)
    r = SE.hybrid_score(vec, th, 0.65, 0.35, 10)
    return r.select("query_id", "item_id", "hybrid", "rank")


# ------------------------------------------------------------------ intents

from ..operators import intents as IN  # noqa: E402

_I, _T, _H = IN.classify_intent_sql("text")

INTENT_Q = [("iq", """
  SELECT query_id, text FROM part_queries
  UNION ALL SELECT conv_id * 1000 + turn, text FROM conversations""")]


def intent_queries(spark, sf):
    conv = raw(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
                                                  "text")
    return B.part_queries(spark, sf).select("query_id", "text").unionByName(conv)


@register("classify_intent", "2.10", B.with_ctes("part_queries", extra=INTENT_Q) + f"""
SELECT query_id, {_I} AS intent, {_T} AS target, {_H} AS type_hint FROM iq""")
def classify_intent_q(spark, sf):
    return IN.classify_intent(intent_queries(spark, sf)).select("query_id", "intent", "target", "type_hint")


@register("content_type_hint", "2.10", B.with_ctes("part_queries", extra=INTENT_Q) + f"""
SELECT {_H} AS type_hint, count(*) AS n FROM iq GROUP BY 1""")
def content_type_hint_q(spark, sf):
    return IN.classify_intent(intent_queries(spark, sf)).groupBy("type_hint").agg(F.count(F.lit(1)).alias("n"))


@register("route_trending", "2.10", B.with_ctes("items", "part_queries", extra=[("c", f"""
  SELECT query_id, "limit", content_type, {_I} AS intent, {_T} AS target FROM part_queries""")]) + f"""
SELECT q.query_id, 'trending' AS intent, i.item_id, CAST(0.9 AS DOUBLE) AS search_score,
       CAST(row_number() OVER (PARTITION BY q.query_id ORDER BY i.view_count DESC, i.rating DESC, i.item_id) AS BIGINT) AS rank
FROM c q JOIN items i ON {literal_match_sql('q.target', ['i.title', 'i.description', 'i.category'], 'i.tags')}
WHERE q.intent = 'trending' AND (q.content_type IS NULL OR i.content_type = q.content_type)
QUALIFY rank <= q."limit\"""")
def route_trending_q(spark, sf):
    c = reliable(IN.classify_intent(B.part_queries(spark, sf))).filter(F.col("intent") == "trending")
    return IN.route_trending(spark, c, B.items(spark, sf))


@register("answer_queries", "2.10")
def answer_queries_q(spark, sf):
    """Every intent route over the part-name and conversation queries."""
    q = intent_queries(spark, sf).select("query_id", F.lit(None).cast("string").alias("user_id"), "text",
                                         F.lit(None).cast("string").alias("content_type"),
                                         F.lit(10).alias("limit"))
    return IN.answer_queries(spark, q, B.items(spark, sf))
