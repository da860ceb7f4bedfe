"""Window operators.

Sessionization is the one place where a per-user timeline must be scanned in
order.  A single user can own a third of all rows, so the timeline is never
sorted as one window: rows are windowed per (user, time chunk) and the chunk
boundaries are stitched with small per-chunk summary tables (prefix sums
over chunks), which are tiny next to the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalars import norm_title
from .topk import rank_within

SEQ = ["seq_a", "seq_b", "seq_c", "seq_d"]


def _seq_cols(df: DataFrame) -> list[str]:
    return [c for c in SEQ if c in df.columns]


def _micros(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


def recent_interactions(inter: DataFrame, items: DataFrame, n: int = 100) -> DataFrame:
    """Newest n interactions per user, then enriched (top-k before the join)."""
    order = [F.col("timestamp").desc()] + [F.col(c).asc() for c in _seq_cols(inter)]
    top = rank_within(inter, ["user_id"], order, n)
    it = items.select("item_id", "title", "category", "content_type")
    return top.join(it, "item_id", "left")


def sessionize(inter: DataFrame, gap_seconds: int = 3600, types=None,
               chunk_seconds: int = 86400) -> DataFrame:
    """Split each user's timeline into sessions: a new session starts when
    the gap to the previous event is strictly greater than ``gap_seconds``.

    Returns the events with ``session_id`` (1-based per user) and ``pos``
    (0-based position in the session).  Order: timestamp, then seq columns.
    """
    seq = _seq_cols(inter)
    ev = inter if types is None else inter.filter(F.col("interaction_type").isin(*types))
    ev = ev.select("user_id", "item_id", "interaction_type", "timestamp", *seq)
    ev = ev.withColumn("_us", _micros("timestamp")).withColumn(
        "chunk", F.floor(F.col("_us") / F.lit(chunk_seconds * 1_000_000)))
    gap = gap_seconds * 1_000_000
    w = Window.partitionBy("user_id", "chunk").orderBy("_us", *seq)
    ev = (ev.withColumn("_prev", F.lag("_us").over(w))
            .withColumn("_rn", F.row_number().over(w)))

    # Per-chunk summary: last timestamp of the previous non-empty chunk.
    wc = Window.partitionBy("user_id").orderBy("chunk")
    cs = (ev.groupBy("user_id", "chunk").agg(F.max("_us").alias("_last"), F.count(F.lit(1)).alias("_n"))
          .withColumn("_prev_last", F.lag("_last").over(wc))
          .withColumn("_rows_before", F.coalesce(
              F.sum("_n").over(wc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    ev = ev.join(cs.select("user_id", "chunk", "_prev_last", "_rows_before"), ["user_id", "chunk"])
    prev = F.when(F.col("_rn") == 1, F.col("_prev_last")).otherwise(F.col("_prev"))
    ev = (ev.withColumn("_brk", (prev.isNull() | ((F.col("_us") - prev) > gap)).cast("int"))
            .withColumn("_idx", F.col("_rows_before") + F.col("_rn"))
            .withColumn("_local_sid", F.sum("_brk").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("_local_start", F.max(F.when(F.col("_brk") == 1, F.col("_idx")))
                        .over(w.rowsBetween(Window.unboundedPreceding, 0))))

    # Carry break counts and the last session start across chunks.
    cb = (ev.groupBy("user_id", "chunk")
          .agg(F.sum("_brk").alias("_b"), F.max(F.when(F.col("_brk") == 1, F.col("_idx"))).alias("_ls"))
          .withColumn("_brk_before", F.coalesce(
              F.sum("_b").over(wc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
          .withColumn("_start_before",
                      F.max("_ls").over(wc.rowsBetween(Window.unboundedPreceding, -1))))
    ev = ev.join(cb.select("user_id", "chunk", "_brk_before", "_start_before"), ["user_id", "chunk"])
    start = F.coalesce(F.col("_local_start"), F.col("_start_before"))
    return ev.select(
        "user_id", "item_id", "interaction_type", "timestamp", *seq,
        (F.col("_brk_before") + F.col("_local_sid")).cast("long").alias("session_id"),
        (F.col("_idx") - start).cast("long").alias("pos"))


def lookahead_pairs(sess: DataFrame, ahead: int = 5) -> DataFrame:
    """Pairs (p, p+1..p+ahead) inside each session.

    Sessions are cut into runs of at least 64 positions and a run sees the
    first ``ahead`` rows of the next one, so that a row is sent once (few of
    them twice) and even a huge session is no window of its own.
    """
    run = max(64, ahead)
    own = F.floor(F.col("pos") / run).cast("long")
    seen_by = F.when((F.col("pos") >= run) & (F.col("pos") % run < ahead), F.array(own - 1, own)).otherwise(F.array(own))
    rows = sess.where("user_id is not null and pos is not null").select("user_id", "session_id", "pos", "item_id", F.explode(seen_by).alias("_run"))
    w = Window.partitionBy("user_id", "session_id", "_run").orderBy("pos")
    near = [F.lead(F.struct(F.col("pos").alias("pos_b"), F.col("item_id").alias("item_b")), j).over(w) for j in range(1, ahead + 1)]
    led = rows.withColumn("_near", F.array(*near)).where(own == F.col("_run"))
    met = led.select("user_id", "session_id", F.col("pos").alias("pos_a"), F.col("item_id").alias("item_a"),
                     F.explode(F.filter("_near", lambda x: x.isNotNull())).alias("_b"))
    return met.select("user_id", "session_id", "pos_a", "_b.pos_b", "item_a", "_b.item_b")


def covisitation_edges(inter: DataFrame, gap_seconds: int = 3600, ahead: int = 5,
                       types=tuple(K.SESSION_TYPES)) -> DataFrame:
    """Weighted co-visitation graph, both directions stored."""
    pairs = lookahead_pairs(sessionize(inter, gap_seconds, list(types) if types else None), ahead)
    ways = F.array(F.struct(F.col("item_a").alias("a"), F.col("item_b").alias("b")), F.struct(F.col("item_b").alias("a"), F.col("item_a").alias("b")))
    both = pairs.select(F.explode(ways).alias("e")).select(F.col("e.a").alias("item_a"), F.col("e.b").alias("item_b"))
    return both.groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("weight"))


def last_n_events(events: DataFrame, n: int = 1000) -> DataFrame:
    """Newest n experiment events per experiment."""
    order = [F.col("timestamp").desc(), F.col("event_id").desc()]
    return rank_within(events, ["experiment_id"], order, n)


def dedup_by_title(df: DataFrame, by: list, order: list, n: int | None = None,
                   title_col: str = "title") -> DataFrame:
    """First row per normalised title (in ``order``) per group, then top n."""
    keyed = df.withColumn("_nt", norm_title(title_col))
    first = rank_within(keyed, by + ["_nt"], order, 1, "_r").drop("_r", "_nt")
    return rank_within(first, by, order, n)


def minmax_per_user(df: DataFrame, col: str, by: str = "user_id", out: str | None = None) -> DataFrame:
    """(x - min) / (max - min) within the group; all equal -> 0.  Extremes
    are partial aggregates joined back, so a hot group is not one window."""
    ends = df.groupBy(by).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    j = df.alias("d").join(ends.withColumnRenamed(by, "_by"), F.col(f"d.{by}").eqNullSafe(F.col("_by")))
    lo, hi = F.col("_lo"), F.col("_hi")
    return j.select("d.*", F.when(hi > lo, (F.col(f"d.{col}") - lo) / (hi - lo)).otherwise(F.lit(0.0)).alias(out or f"{col}_norm"))


def popularity_norm(df: DataFrame, by: str = "user_id") -> DataFrame:
    """views / max(max views in the list, 1)."""
    most = df.groupBy(by).agg(F.greatest(F.max("view_count"), F.lit(1)).cast("double").alias("_most"))
    j = df.alias("d").join(most.withColumnRenamed(by, "_by"), F.col(f"d.{by}").eqNullSafe(F.col("_by")))
    return j.select("d.*", (F.col("d.view_count") / F.col("_most")).alias("popularity"))


def top_affinities(counts: DataFrame, key: str, k: int = 8) -> DataFrame:
    """Top k keys per user by count, with the share of the top one (%)."""
    order = [F.col("n").desc(), F.col(key).asc()]
    top = rank_within(counts, ["user_id"], order, k)
    w = Window.partitionBy("user_id")
    return top.withColumn("pct_of_top", F.col("n") * 100.0 / F.max("n").over(w))


def recent_searches(log: DataFrame, k: int = 5) -> DataFrame:
    """Last k distinct queries per user, newest first."""
    latest = log.groupBy("user_id", "text").agg(F.max("ts").alias("ts"))
    return rank_within(latest, ["user_id"], [F.col("ts").desc(), F.col("text").asc()], k)


def suggestion_merge(live: DataFrame, recent: DataFrame, defaults: DataFrame, k: int = 8) -> DataFrame:
    """Live suggestions, then recent ones not listed, then defaults when a
    user has no live suggestion; k in all, first occurrence of each text."""
    has_live = live.select("user_id").distinct().withColumn("_live", F.lit(True))
    src = (live.select("user_id", "text", F.lit(0).alias("src"), F.col("rank").alias("src_rank"))
           .unionByName(recent.select("user_id", "text", F.lit(1).alias("src"),
                                      F.col("rank").alias("src_rank")))
           .unionByName(defaults.select("user_id", "text", F.lit(2).alias("src"),
                                        F.col("rank").alias("src_rank"))))
    src = src.join(has_live, "user_id", "left").filter(~((F.col("src") == 2) & F.col("_live").isNotNull()))
    order = [F.col("src").asc(), F.col("src_rank").asc()]
    first = rank_within(src, ["user_id", "text"], order, 1, "_r").drop("_r", "_live")
    return rank_within(first, ["user_id"], order, k)
