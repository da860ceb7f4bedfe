"""Registered queries: entity resolution on the corpus.

The ratio is not available in DuckDB, so these have no SQL oracle; tests
compare them with a brute-force Python evaluation on the same titles.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import norm_title
from ..operators import resolve as RS
from ..sources import binding as B
from ..sources.tables import raw
from .registry import register


def corpus_titles(spark, sf):
    """Corpus titles in (source, doc_id) order."""
    c = B.corpus(spark, sf)
    # a struct orders like the pair (source, doc_id) without a global window
    return c.select(F.col("doc_id").alias("id"), "title", "lang", "source",
                    F.struct("source", "doc_id").alias("ord"))


@register("token_sort_similarity", "2.12")
def token_sort_similarity_q(spark, sf):
    """Every pair of distinct normalised corpus titles with a token-sort
    ratio >= 88, with the number of documents carrying each."""
    t = B.corpus(spark, sf).select(norm_title("title").alias("key"))
    return RS.key_pairs(t, 88.0).withColumn("score", F.round("score", 6))


@register("fuzzy_best_match", "2.4")
def fuzzy_best_match_q(spark, sf):
    """Each document's whole second line against all corpus
    titles: the best title with ratio >= 88, ties to the lowest doc id."""
    c = B.corpus(spark, sf)
    second = F.try_element_at(F.split("text", "\n"), F.lit(2))
    left = (c.select(F.col("doc_id").alias("id"), norm_title(second).alias("key"))
            .filter(F.col("key").isNotNull() & (F.col("key") != "")))
    right = c.select(F.col("doc_id").alias("id"), norm_title("title").alias("key"), F.col("doc_id").alias("ord"))
    return RS.fuzzy_best_match(left, right, 88.0).select("l_id", "r_id", F.round("score", 6).alias("score"))


@register("dedup_articles", "2.12")
def dedup_articles_q(spark, sf):
    return RS.dedup_articles(spark, corpus_titles(spark, sf).select("id", "title", "ord"), 90.0)


@register("dedup_videos", "2.12")
def dedup_videos_q(spark, sf):
    """English titles all kept; the others filtered against both lists."""
    t = corpus_titles(spark, sf)
    first = t.filter(F.col("lang") == "en").select("id", "title", "ord")
    second = t.filter(F.col("lang") != "en").select("id", "title", "ord")
    return RS.dedup_videos(spark, first, second, 90.0)
