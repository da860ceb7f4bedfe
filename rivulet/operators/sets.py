"""Set operations and keyed writes (SURVEY 2.2)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topk import first_per_key


def union_sources(dfs: list[DataFrame], key: str = "item_id") -> DataFrame:
    """Concatenate sources; the earliest source wins per key."""
    tagged = [d.withColumn("source_rank", F.lit(i)) for i, d in enumerate(dfs)]
    allrows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    order = [F.col("source_rank").asc()] + (
        [F.col("source_order").asc()] if "source_order" in allrows.columns else [])
    return first_per_key(allrows, [key], order)


def assemble_catalogue(parts: list[DataFrame]) -> DataFrame:
    """Union of resolved item lists, one row per item id (first list wins)."""
    return union_sources(parts, "item_id").drop("source_rank")


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def candidate_union(strategies: dict[str, DataFrame]) -> DataFrame:
    """Distinct (user, item) union of candidate strategies; the strategies
    that produced a pair are kept as a sorted array."""
    parts = [d.select("user_id", "item_id", F.lit(name).alias("strategy"))
             for name, d in strategies.items()]
    return (union_all(parts).groupBy("user_id", "item_id")
            .agg(F.array_sort(F.collect_set("strategy")).alias("strategies")))


def candidate_except(cands: DataFrame, seen: DataFrame) -> DataFrame:
    return cands.join(seen.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


# ------------------------------------------------------------ keyed writes

def upsert(current: DataFrame, updates: DataFrame, key: str, order_col: str) -> DataFrame:
    """Insert-or-replace by key: the newest ``order_col`` wins (updates win ties)."""
    tagged = (current.withColumn("_u", F.lit(0))
              .unionByName(updates.withColumn("_u", F.lit(1)), allowMissingColumns=True))
    return first_per_key(tagged, [key], [F.col(order_col).desc_nulls_last(), F.col("_u").desc()]).drop("_u")


def append_interactions(log: DataFrame, new: DataFrame, key: str = "interaction_id") -> DataFrame:
    """Append rows whose id is new (first copy of a repeated id); returns the
    rows to append."""
    fresh = new.dropDuplicates([key])
    return fresh.join(log.select(key), key, "left_anti")


def insert_if_absent(assignments: DataFrame, new: DataFrame,
                     keys=("user_id", "experiment_id")) -> DataFrame:
    """The first assignment per key is kept for ever: returns the full table."""
    add = new.dropDuplicates(list(keys)).join(assignments.select(*keys), list(keys), "left_anti")
    return assignments.unionByName(add, allowMissingColumns=True)


def rebuild_counters(users: DataFrame, items: DataFrame, inter: DataFrame):
    """Counters the bulk path skips: interactions per user, views per item."""
    per_user = inter.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_interactions"))
    views = (inter.filter(F.col("interaction_type") == "view")
             .groupBy("item_id").agg(F.count(F.lit(1)).alias("views")))
    u = (users.drop("total_interactions").join(per_user, "user_id", "left")
         .withColumn("total_interactions", F.coalesce("total_interactions", F.lit(0)).cast("long")))
    i = (items.join(views, "item_id", "left")
         .withColumn("view_count", F.coalesce("views", F.lit(0)).cast("long")).drop("views"))
    return u, i


def write_catalogue(items: DataFrame, users: DataFrame, inter: DataFrame, path: str,
                    mode: str = "overwrite") -> None:
    """Persist the catalogue: items partitioned by type, the others plain."""
    items.write.mode(mode).partitionBy("content_type").parquet(f"{path}/items")
    users.write.mode(mode).parquet(f"{path}/users")
    inter.write.mode(mode).parquet(f"{path}/interactions")
