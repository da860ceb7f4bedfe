"""Aggregation operators.

All are declarative group-bys, so Spark plans a partial (map-side) aggregate
before each shuffle; a hot key only costs one partial row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from .topk import top_k


def _count():
    return F.count(F.lit(1))


def system_totals(spark: SparkSession, users: DataFrame, items: DataFrame,
                  inter: DataFrame) -> DataFrame:
    """One row: users, items, interactions (three scalar subqueries)."""
    return spark.range(1).select(
        users.select(_count()).scalar().alias("total_users"),
        items.select(_count()).scalar().alias("total_items"),
        inter.select(_count()).scalar().alias("total_interactions"))


def _since(inter: DataFrame, as_of, hours: int) -> DataFrame:
    return inter.filter(F.col("timestamp") >= as_of - F.make_interval(hours=F.lit(hours)))


def active_users(inter: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Distinct users with an interaction in the trailing window."""
    return _since(inter, as_of, hours).select(F.countDistinct("user_id").alias("active_users"))


def interactions_recent(inter: DataFrame, as_of, hours: int = 24) -> DataFrame:
    return _since(inter, as_of, hours).select(_count().alias("interactions_recent"))


def items_by_type(items: DataFrame) -> DataFrame:
    return items.groupBy("content_type").agg(_count().alias("item_count"))


def popular_categories(inter: DataFrame, items: DataFrame, as_of, days: int = 7,
                       k: int = 10) -> DataFrame:
    """Interactions per item category over the trailing days; orphans under null."""
    recent = _since(inter, as_of, 24 * days).select("item_id")
    j = recent.join(items.select("item_id", "category"), "item_id", "left")
    counts = j.groupBy("category").agg(_count().alias("interaction_count"))
    return top_k(counts, [F.col("interaction_count").desc(), F.col("category").asc_nulls_last()], k)


def categories_by_type(items: DataFrame, k: int = 10) -> DataFrame:
    """Per content type, the k categories with most items (flat rows + rank)."""
    from .topk import rank_within
    counts = items.groupBy("content_type", "category").agg(_count().alias("item_count"))
    return rank_within(counts, ["content_type"],
                       [F.col("item_count").desc(), F.col("category").asc()], k)


def system_stats(spark: SparkSession, users: DataFrame, items: DataFrame, inter: DataFrame,
                 as_of) -> DataFrame:
    """The dashboard record, flat: totals, trailing activity, type count and
    the top category with its share of the 7-day interactions."""
    cats = popular_categories(inter, items, as_of, 7, 1)
    # one pass over the interactions, one over the items
    at = inter.select("user_id", "timestamp", as_of.alias("_now"))
    day = F.col("timestamp") >= F.col("_now") - F.make_interval(hours=F.lit(24))
    week = F.col("timestamp") >= F.col("_now") - F.make_interval(hours=F.lit(24 * 7))
    acts = at.agg(_count().alias("total_interactions"), F.countDistinct(F.when(day, F.col("user_id"))).alias("active_users_24h"),
                  F.count_if(day).alias("interactions_24h"), F.count_if(week).alias("_week"))
    kinds = items.agg(_count().alias("total_items"), F.countDistinct("content_type").alias("content_types"))
    top = cats.select(F.col("category").alias("top_category"), F.col("interaction_count").alias("_top"))
    one = users.agg(_count().alias("total_users"))
    out = one.join(kinds, how="cross").join(acts, how="cross").join(top, how="left", on=F.lit(True))  # one row each
    return out.select("total_users", "total_items", "total_interactions", "active_users_24h", "interactions_24h", "content_types",
                      "top_category", F.round(F.col("_top") / F.greatest("_week", F.lit(1)) * 100.0, 6).alias("top_category_pct"))


def system_stats_full(spark: SparkSession, users: DataFrame, items: DataFrame, inter: DataFrame,
                      as_of, k: int = 10) -> DataFrame:
    """The whole dashboard record in one row: ``system_stats`` with items by
    type and the ``k`` popular categories as arrays of names and counts."""
    def lists(df, order, **cols):
        # one row per type, or k rows
        rows = F.array_sort(F.collect_list(F.struct(*order, *cols.values())))
        return df.agg(rows.alias("_rows")).select(*[F.col(f"_rows.{c}").alias(name) for name, c in cols.items()])

    types = lists(items_by_type(items), [F.col("content_type").isNull().alias("_last")],
                  item_types="content_type", item_type_counts="item_count")
    cats = lists(popular_categories(inter, items, as_of, 7, k),
                 [(-F.col("interaction_count")).alias("_n"), F.col("category").isNull().alias("_last")],
                 categories="category", category_counts="interaction_count")
    return system_stats(spark, users, items, inter, as_of).join(types, how="cross").join(cats, how="cross")  # one row each


def user_interaction_stats(inter: DataFrame, items: DataFrame) -> DataFrame:
    """Per user: category / type / tag lists (with repeats), mean dwell over
    all rows, mean rating over non-null, count.  Lists are sorted and joined
    with ``|`` so the result is flat and order-free; they are put together
    from one count per user and value, taken map-side first."""
    j = inter.join(items.select("item_id", "category", "content_type", "tags"), "item_id", "left")
    out = j.groupBy("user_id").agg(F.round(F.avg("dwell_seconds"), 6).alias("avg_dwell_time"),
                                   F.round(F.avg("rating"), 6).alias("avg_rating"), _count().alias("total_interactions"))
    lists = {"categories": F.col("category"), "content_types": F.col("content_type"), "tags": F.explode("tags")}
    for name, value in lists.items():
        counts = j.select("user_id", value.alias("v")).where("v is not null").groupBy("user_id", "v").agg(F.count(F.lit(1)).cast("int").alias("n"))
        own = counts.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("vs"))
        text = F.array_join(F.flatten(F.transform("vs", lambda x: F.array_repeat(x["v"], x["n"]))), "|")
        out = out.join(own.select("user_id", text.alias(name)), "user_id", "left").withColumn(name, F.coalesce(name, F.lit("")))
    return out.select("user_id", *lists, "avg_dwell_time", "avg_rating", "total_interactions")


def user_total_interactions(inter: DataFrame) -> DataFrame:
    return inter.groupBy("user_id").agg(_count().alias("total_interactions"))


def confidence_matrix(inter: DataFrame) -> DataFrame:
    """Sum of confidence weights per (user, item); duplicates add up."""
    from ..functions.scalars import confidence_weight
    return (inter.select("user_id", "item_id",
                         confidence_weight("interaction_type", "dwell_seconds").alias("w"))
            .groupBy("user_id", "item_id").agg(F.sum("w").alias("confidence")))


def ratings_per_target(ratings: DataFrame, scale: float = 1.0) -> DataFrame:
    """Dataset ratings > 0 grouped on the merged target id."""
    r = ratings.filter(F.col("rating") > 0)
    return r.groupBy("target_id").agg(
        F.avg(F.col("rating") / scale).alias("dataset_avg"), _count().alias("dataset_n"))


def view_boost(items: DataFrame, absorbed: DataFrame) -> DataFrame:
    """Add the view counts of absorbed items (source_id -> target_id) to targets."""
    add = (absorbed.join(items.select(F.col("item_id").alias("source_id"),
                                      F.col("view_count").alias("absorbed_views")), "source_id")
           .groupBy("target_id").agg(F.sum("absorbed_views").alias("extra_views")))
    return (items.join(add, items.item_id == add.target_id, "left")
            .withColumn("view_count", F.col("view_count") + F.coalesce("extra_views", F.lit(0)))
            .drop("target_id", "extra_views"))


def catalogue_type_report(spark: SparkSession, items: DataFrame, low: int = 10) -> DataFrame:
    """Items per type, all eight types listed, flagged LOW under ``low``."""
    types = spark.createDataFrame([(t, i) for i, t in enumerate(K.CONTENT_TYPES)],
                                  "content_type string, type_order int")
    counts = items.groupBy("content_type").agg(_count().alias("item_count"))
    return (types.join(counts, "content_type", "left")
            .select("content_type", "type_order",
                    F.coalesce("item_count", F.lit(0)).alias("item_count"))
            .withColumn("status", F.when(F.col("item_count") < low, "LOW").otherwise("OK")))


def resolution_summary(matches: DataFrame) -> DataFrame:
    """Counts of resolution outcomes per stage."""
    return matches.groupBy("stage", "outcome").agg(_count().alias("n"))
