"""Top-k building blocks.

``row_number() <= k`` over a window is planned by Spark (3.5+) with a partial
``WindowGroupLimit`` before the shuffle, so a hot partition key only ever
moves k rows per map task, never the whole group.  Every order ends with a
unique key so results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(xs):
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def rank_within(df: DataFrame, by: list, order: list, k: int | None,
                rank_col: str = "rank") -> DataFrame:
    """Keep the first ``k`` rows per ``by`` group in ``order``; add 1-based rank.
    Without ``by`` the whole table is one group, ranked without one task."""
    if not by and k is None:
        return rank_all(df, order, rank_col)
    if not by:
        df = top_k(df, order, k)
    w = Window.partitionBy(*_cols(by)).orderBy(*_cols(order)) if by else Window.orderBy(*_cols(order))
    # Filter on the bare row_number so the optimizer can infer a partial
    # WindowGroupLimit below the shuffle; cast only afterwards.
    out = df.withColumn("_rn_", F.row_number().over(w))
    if k is not None:
        out = out.filter(F.col("_rn_") <= k)
    return out.withColumn(rank_col, F.col("_rn_").cast("long")).drop("_rn_")


def rank_all(df: DataFrame, order: list, rank_col: str = "rank") -> DataFrame:
    """Rank of every row of a table: a range-partitioned sort, numbered inside
    its partitions, which start where the counts of those before them end.
    The sorted table is checkpointed, so that a row keeps its partition."""
    from .components import reliable
    kept = df.columns
    held = reliable(df.orderBy(*_cols(order)).withColumn("_at_", F.monotonically_increasing_id()))
    part, nth = F.shiftright("_at_", 33), F.col("_at_").bitwiseAND((1 << 33) - 1)
    counts = held.groupBy(part.alias("_p_")).agg(F.count(F.lit(1)).alias("_c_"))  # one row per partition
    before = Window.orderBy("_p_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_p_", F.coalesce(F.sum("_c_").over(before), F.lit(0)).alias("_s_"))
    return held.withColumn("_p_", part).join(starts, "_p_").select(*kept, (F.col("_s_") + nth + 1).cast("long").alias(rank_col))


def top_k(df: DataFrame, order: list, k: int) -> DataFrame:
    """Global top-k: per-partition top-k then one bounded merge (TakeOrdered)."""
    return df.orderBy(*_cols(order)).limit(k)


def first_per_key(df: DataFrame, by: list, order: list) -> DataFrame:
    return rank_within(df, by, order, 1, "_rn").drop("_rn")
