"""Join operators.

Dimension sides are joined with plain equi-joins: Spark/AQE chooses broadcast
when the runtime size of a side is under ``autoBroadcastJoinThreshold`` and a
sort-merge join otherwise, so no side is broadcast on assumption.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import norm_title, title_year


def enrich_interactions(inter: DataFrame, items: DataFrame) -> DataFrame:
    """Left outer join adding title, category and content type; orphans kept."""
    it = items.select("item_id", "title", "category", "content_type")
    return inter.join(it, "item_id", "left")


def interactions_with_items(inter: DataFrame, items: DataFrame) -> DataFrame:
    """Inner join: only interactions whose item is known (item columns
    carried with an ``item_`` prefix where names clash)."""
    it = items.select("item_id", "title", "category", "content_type", "tags",
                      F.col("rating").alias("item_rating"), "view_count", "publish_ts")
    return inter.join(it, "item_id", "inner")


def interactions_with_users(inter: DataFrame, users: DataFrame) -> DataFrame:
    u = users.select("user_id", "country", "device", "age_group")
    return inter.join(u, "user_id", "left")


def items_in(items: DataFrame, ids: DataFrame, id_col: str = "item_id") -> DataFrame:
    """Semi join: items whose id occurs in ``ids``."""
    return items.join(ids.select(F.col(id_col).alias("item_id")), "item_id", "left_semi")


def exclude_seen(cands: DataFrame, seen: DataFrame, keys=("user_id", "item_id")) -> DataFrame:
    """Anti join: drop (user, item) pairs already seen."""
    return cands.join(seen.select(*keys), list(keys), "left_anti")


def remap_ids(inter: DataFrame, id_map: DataFrame) -> DataFrame:
    """Re-point interactions at merged item ids (unmapped ids unchanged)."""
    m = id_map.select(F.col("source_id").alias("item_id"), F.col("target_id"))
    return (inter.join(m, "item_id", "left")
            .withColumn("item_id", F.coalesce("target_id", "item_id")).drop("target_id"))


def bridge_join(left: DataFrame, links: DataFrame, right: DataFrame) -> DataFrame:
    """left.source_key -> links(source_id, target_id) -> right.item_id.

    The target id must have at least three ``_`` parts, the last all digits.
    """
    valid = links.filter(F.element_at(F.split("target_id", "_"), -1).rlike(r"^[0-9]+$") &
                         (F.size(F.split("target_id", "_")) >= 3))
    j = left.join(valid, left.source_key == valid.source_id, "inner")
    r = right.select(F.col("item_id").alias("target_id"))
    return j.join(r, "target_id", "inner")


def title_year_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Composite equi-join on normalised title and year; a title without a
    year joins nothing."""
    lk = left.withColumn("_nt", norm_title("title")).withColumn("_yr", F.coalesce("year", title_year("title")))
    rk = right.withColumn("_nt", norm_title("title")).withColumn("_yr", F.coalesce("year", title_year("title")))
    known = (F.col("_yr").isNotNull()) & (F.col("_yr") != "")
    return lk.filter(known).alias("l").join(rk.filter(known).alias("r"), ["_nt", "_yr"], "inner")


def year_guard(l_year, r_year):
    """Reject a pair when both years are known and differ by more than one."""
    ly, ry = l_year.cast("int"), r_year.cast("int")
    return ly.isNull() | ry.isNull() | (F.abs(ly - ry) <= 1)


def similar_items(items: DataFrame, k: int = 10, of: DataFrame | None = None) -> DataFrame:
    """Per item: other items sharing its category or any tag, best k by
    (rating desc, views desc, id); given ``of`` (item_id), for those items only.

    A category key can hold a third of the catalogue, so the self-join never
    pairs whole groups: each key first keeps only its top k+1 items by the
    global order (exact, since the order does not depend on the reference
    item).  Items with the same keys share one list, made once and as an array.
    """
    from .topk import rank_within

    base = items.select("item_id", "category", "tags", "rating", "view_count")
    keys = base.select(
        "item_id", "rating", "view_count",
        F.explode(F.array_union(F.array(F.concat(F.lit("cat:"), F.col("category"))),
                                F.transform(F.coalesce("tags", F.array().cast("array<string>")),
                                            lambda t: F.concat(F.lit("tag:"), t)))).alias("key"))
    order = [F.col("rating").desc(), F.col("view_count").desc(), F.col("item_id").asc()]
    # in the order's direction, nulls last
    place = F.struct(F.col("rating").isNull().alias("a"), (-F.col("rating")).alias("b"), F.col("view_count").isNull().alias("c"),
                     (-F.col("view_count")).alias("d"), F.col("item_id").alias("sim_id"))
    keys = keys.where("item_id is not null")
    leaders = rank_within(keys, ["key"], order, k + 1, "_r").groupBy("key").agg(F.collect_list(place).alias("near"))
    own = keys.select("item_id", "key").where("key is not null")
    if of is not None:
        own = own.join(of.select("item_id").distinct(), "item_id", "left_semi")
    sets = own.groupBy("item_id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    lists = sets.select("keys").distinct().select("keys", F.explode("keys").alias("key")).join(leaders, "key")
    lists = lists.groupBy("keys").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"))
    # an item's own rows, which drop out, are as many as its copies
    copies = F.array_max(F.transform("near", lambda x: F.size(F.filter("near", lambda y: y["sim_id"] == x["sim_id"]))))
    lists = lists.select("keys", F.slice("near", F.lit(1), copies + k).alias("near"))
    others = F.slice(F.filter("near", lambda x: x["sim_id"] != F.col("item_id")), 1, k)
    out = sets.join(lists, "keys").select("item_id", F.posexplode(others).alias("pos", "s"))
    return out.select("item_id", F.col("s.sim_id").alias("sim_id"), (-F.col("s.b")).alias("sim_rating"), (-F.col("s.d")).alias("sim_views"),
                      (F.col("pos") + 1).cast("long").alias("rank"))


def title_duplicates(items: DataFrame) -> DataFrame:
    """Merge map (source_id -> target_id): every item points at the first
    item (numeric id order) carrying exactly the same title."""
    # Aggregate (partial, map-side) rather than a window: a boiler-plate
    # title shared by a third of the catalogue never lands in one task.
    first = items.groupBy("title").agg(
        F.min_by("item_id", F.col("item_id").cast("long")).alias("target_id"))
    return (items.select("item_id", "title").join(first, "title")
            .filter(F.col("item_id") != F.col("target_id"))
            .select(F.col("item_id").alias("source_id"), "target_id"))
