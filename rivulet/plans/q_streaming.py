"""Registered queries: streaming operators.

Each query runs its stream over the events file to completion
(``availableNow``) and returns the sink table it wrote; the oracle is the
batch answer over the same rows (for windowed outputs: the closed windows).
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalars import ts_str_sql
from ..operators.experiments import ab_significance
from ..sources import binding as B
from ..streaming import jobs as SJ
from .q_experiments import POST_SQL, SIG_COLS, metrics_sql, sig_sql
from .registry import register


def _events(spark, sf):
    return SJ.stream_events(SJ.raw_event_stream(spark, sf))


def _ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


EV_SQL = B.with_ctes("event_interactions")


@register("stream_events", "2.14", EV_SQL + """
SELECT interaction_id, user_id, item_id, interaction_type AS type, dwell_seconds, 'valid' AS sink
FROM event_interactions""")
def stream_events_q(spark, sf):
    base = SJ.stream_base(spark, "stream_events")
    tables = SJ.write_validated(_events(spark, sf), base)
    return tables.read("events").withColumn("sink", F.lit("valid")).unionByName(
        tables.read("quarantine").withColumn("sink", F.lit("quarantine"))).select(
        "interaction_id", "user_id", "item_id", "type", "dwell_seconds", "sink")


@register("stream_append", "2.14", EV_SQL + """
SELECT DISTINCT interaction_id, user_id, item_id, interaction_type AS type FROM event_interactions""")
def stream_append_q(spark, sf):
    base = SJ.stream_base(spark, "stream_append")
    SJ.stream_append(_events(spark, sf), base)
    return spark.read.parquet(os.path.join(base, "log")).select("interaction_id", "user_id", "item_id", "type")


@register("stream_counters", "2.14", EV_SQL + """
SELECT 'user' AS kind, user_id AS key, count(*) AS n FROM event_interactions GROUP BY user_id
UNION ALL SELECT 'item_views', item_id, count(*) FROM event_interactions WHERE interaction_type = 'view'
GROUP BY item_id""")
def stream_counters_q(spark, sf):
    base = SJ.stream_base(spark, "stream_counters")
    users, items = SJ.stream_counters(_events(spark, sf), base)
    u = users.read().select(F.lit("user").alias("kind"), F.col("user_id").alias("key"), "n")
    i = items.read().select(F.lit("item_views").alias("kind"), F.col("item_id").alias("key"), "n")
    return u.unionByName(i)


@register("stream_event_counts", "2.14", EV_SQL + """
SELECT interaction_type AS type, count(*) AS n FROM event_interactions GROUP BY 1""")
def stream_event_counts_q(spark, sf):
    base = SJ.stream_base(spark, "stream_event_counts")
    SJ.stream_event_counts(_events(spark, sf), base)
    return SJ.latest_rows(spark, os.path.join(base, "counts"))


@register("stream_activity", "2.14", EV_SQL + f"""
, w AS (SELECT user_id, date_trunc('hour', timestamp) - to_hours(k) AS ws
        FROM event_interactions, range(0, 24) r(k))
, c AS (SELECT ws, count(DISTINCT user_id) AS active_users, count(*) AS events FROM w GROUP BY ws)
SELECT {ts_str_sql("ws + INTERVAL 24 HOUR - INTERVAL 1 MICROSECOND")} AS window_time, active_users, events
FROM c WHERE ws + INTERVAL 24 HOUR <= (SELECT max(timestamp) FROM event_interactions) - INTERVAL 1 HOUR
""".replace("\n, w AS", ", w AS", 1))
def stream_activity_q(spark, sf):
    base = SJ.stream_base(spark, "stream_activity")
    a = SJ.stream_activity(_events(spark, sf), base).read("activity")
    return a.select(_ts("wt").alias("window_time"), "active_users", "events")


@register("stream_sessions", "2.14", EV_SQL + f"""
, ev AS (SELECT *, lag(timestamp) OVER (PARTITION BY user_id ORDER BY timestamp, seq_a) AS prev FROM event_interactions)
, b AS (SELECT *, CASE WHEN prev IS NULL OR epoch_us(timestamp) - epoch_us(prev) > 3600000000 THEN 1 ELSE 0 END AS brk
        FROM ev)
, s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY timestamp, seq_a ROWS UNBOUNDED PRECEDING) AS sid FROM b)
, g AS (SELECT user_id, sid, min(timestamp) AS st, max(timestamp) + INTERVAL 1 HOUR AS en, count(*) AS n_events
        FROM s GROUP BY user_id, sid)
SELECT user_id, {ts_str_sql('st')} AS session_start, {ts_str_sql('en')} AS session_end, n_events FROM g
WHERE en <= (SELECT max(timestamp) FROM event_interactions) - INTERVAL 1 HOUR""".replace("\n, ev AS", ", ev AS", 1))
def stream_sessions_q(spark, sf):
    base = SJ.stream_base(spark, "stream_sessions")
    SJ.stream_sessions(_events(spark, sf), base)
    s = spark.read.parquet(os.path.join(base, "sessions"))
    return s.select("user_id", _ts("session_start").alias("session_start"), _ts("session_end").alias("session_end"),
                    "n_events")


COVIS_SQL = EV_SQL + """
, ev AS (SELECT *, lag(timestamp) OVER (PARTITION BY user_id ORDER BY timestamp, seq_a) AS prev FROM event_interactions
         WHERE interaction_type IN ('view', 'click', 'like'))
, b AS (SELECT *, CASE WHEN prev IS NULL OR epoch_us(timestamp) - epoch_us(prev) > 3600000000 THEN 1 ELSE 0 END AS brk
        FROM ev)
, s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY timestamp, seq_a ROWS UNBOUNDED PRECEDING) AS sid FROM b)
, p AS (SELECT *, row_number() OVER (PARTITION BY user_id, sid ORDER BY timestamp, seq_a) AS pos,
               max(timestamp) OVER (PARTITION BY user_id, sid) + INTERVAL 1 HOUR AS en FROM s)
, c AS (SELECT * FROM p WHERE en <= (SELECT max(timestamp) FROM ev) - INTERVAL 1 HOUR)
, pairs AS (SELECT x.item_id AS item_a, y.item_id AS item_b FROM c x JOIN c y
            ON x.user_id = y.user_id AND x.sid = y.sid AND y.pos BETWEEN x.pos + 1 AND x.pos + 5)
SELECT item_a, item_b, count(*) AS weight
FROM (SELECT item_a, item_b FROM pairs UNION ALL SELECT item_b, item_a FROM pairs) GROUP BY item_a, item_b
""".replace("\n, ev AS", ", ev AS", 1)


@register("stream_covisitation", "2.14", COVIS_SQL)
def stream_covisitation_q(spark, sf):
    base = SJ.stream_base(spark, "stream_covisitation")
    SJ.stream_sessions(_events(spark, sf), base, types=K.SESSION_TYPES)
    sessions = spark.read.parquet(os.path.join(base, "sessions"))
    return SJ.session_covisitation(sessions, B.event_interactions(spark, sf))


@register("stream_pairs", "2.14", COVIS_SQL)
def stream_pairs_q(spark, sf):
    """The same edges from the stream's own state, without a second read."""
    base = SJ.stream_base(spark, "stream_pairs")
    return SJ.pair_edges(SJ.stream_pairs(_events(spark, sf), base).read("rows"))


SIG = ["z_score", "p_value", "lift_pct", "control_ctr", "treatment_ctr"]


@register("stream_experiment_metrics", "2.14", B.with_ctes("experiment_events", extra=[
    ("m", metrics_sql("experiment_events"))]) + """
SELECT experiment_id, total_events, control_events, treatment_events, control_interactions,
       treatment_interactions, control_requests, treatment_requests FROM m""")
def stream_experiment_metrics_q(spark, sf):
    base = SJ.stream_base(spark, "stream_experiment_metrics")
    SJ.stream_experiment_metrics(_events(spark, sf), base)
    m = SJ.latest_rows(spark, os.path.join(base, "metrics"))
    return m.select("experiment_id", "total_events", "control_events", "treatment_events", "control_interactions",
                    "treatment_interactions", "control_requests", "treatment_requests")


SIG_KEYS = ["experiment_id", "control_requests", "control_interactions", "treatment_requests", "treatment_interactions"]


@register("stream_experiment_significance", "2.14", B.with_ctes("experiment_events", extra=[
    ("m", metrics_sql("experiment_events"))]) + sig_sql("m", ", ".join(SIG_KEYS)))
def stream_experiment_significance_q(spark, sf):
    """The z-test on the stream's running counts."""
    base = SJ.stream_base(spark, "stream_experiment_significance")
    SJ.stream_experiment_metrics(_events(spark, sf), base)
    s = ab_significance(SJ.latest_rows(spark, os.path.join(base, "metrics")))
    return s.select(*SIG_KEYS, *[F.round(c, 6).alias(c) for c in SIG_COLS], "is_significant", "status")


@register("stream_last_n", "2.14", B.with_ctes("experiment_events") + """
SELECT experiment_id, event_id, user_id, bucket, event_type FROM experiment_events
QUALIFY row_number() OVER (PARTITION BY experiment_id ORDER BY timestamp DESC, event_id DESC) <= 1000""")
def stream_last_n_q(spark, sf):
    base = SJ.stream_base(spark, "stream_last_n")
    SJ.stream_last_n(_events(spark, sf), base, 1000)
    return SJ.latest_last_n(spark, base).select("experiment_id", "event_id", "user_id", "bucket", "event_type")


@register("stream_bandit", "2.14", POST_SQL + "SELECT experiment_id, arm, alpha, beta FROM post")
def stream_bandit_q(spark, sf):
    base = SJ.stream_base(spark, "stream_bandit")
    SJ.stream_bandit(_events(spark, sf), base)
    c = SJ.latest_rows(spark, os.path.join(base, "bandit"))
    return c.select("experiment_id", "arm", (F.lit(1.0) + F.col("pos")).alias("alpha"),
                    (F.lit(1.0) + F.col("neg").cast("double")).alias("beta"))


@register("stream_retrain_trigger", "2.14", EV_SQL + """
SELECT CAST(k * 100 AS BIGINT) AS at_event
FROM range(1, CAST(floor((SELECT count(*) FROM event_interactions) / 100) AS BIGINT) + 1) r(k)""")
def stream_retrain_trigger_q(spark, sf):
    base = SJ.stream_base(spark, "stream_retrain_trigger")
    return SJ.stream_retrain_trigger(_events(spark, sf), base, 100).read("triggers").select("at_event")


@register("stream_user_dirty", "2.14", EV_SQL + "SELECT DISTINCT user_id FROM event_interactions")
def stream_user_dirty_q(spark, sf):
    base = SJ.stream_base(spark, "stream_user_dirty")
    return SJ.stream_user_dirty(_events(spark, sf), base).read("dirty").select("user_id").distinct()


@register("stream_retrain_progress", "2.14", EV_SQL + """
SELECT CAST(count(*) AS BIGINT) AS total, round((count(*) % 100) * 100.0 / 100, 6) AS progress_pct FROM event_interactions""")
def stream_retrain_progress_q(spark, sf):
    base = SJ.stream_base(spark, "stream_retrain_progress")
    totals = SJ.stream_retrain_trigger(_events(spark, sf), base, 100).read_latest("totals")
    return totals.select("total", F.round("progress_pct", 6).alias("progress_pct"))
