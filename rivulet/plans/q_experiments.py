"""Registered queries: experiments, bandit and counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalars import normal_cdf_sql, sha_mod_sql
from ..operators import experiments as X
from ..operators.intents import classify_intent, classify_intent_sql
from ..sources import binding as B
from ..sources.tables import raw
from .registry import register

EXP = K.DEFAULT_EXPERIMENT


def metrics_sql(src: str, by: str = "") -> str:
    keys = "experiment_id" + (", " + by if by else "")
    return f"""
  SELECT {keys}, count(*) AS total_events,
         count(*) FILTER (WHERE bucket = 'control') AS control_events,
         count(*) FILTER (WHERE bucket = 'treatment') AS treatment_events,
         count(DISTINCT user_id) FILTER (WHERE bucket = 'control') AS control_users,
         count(DISTINCT user_id) FILTER (WHERE bucket = 'treatment') AS treatment_users,
         count(*) FILTER (WHERE bucket = 'control' AND starts_with(event_type, 'interaction_')) AS control_interactions,
         count(*) FILTER (WHERE bucket = 'treatment' AND starts_with(event_type, 'interaction_')) AS treatment_interactions,
         count(*) FILTER (WHERE bucket = 'control' AND event_type = 'recommendation_request') AS control_requests,
         count(*) FILTER (WHERE bucket = 'treatment' AND event_type = 'recommendation_request') AS treatment_requests
  FROM {src} GROUP BY {keys}"""


def sig_sql(m: str, cols: str) -> str:
    n1, c1, n2, c2 = "control_requests", "control_interactions", "treatment_requests", "treatment_interactions"
    p1, p2 = f"(CAST({c1} AS DOUBLE) / {n1})", f"(CAST({c2} AS DOUBLE) / {n2})"
    pool = f"(CAST({c1} + {c2} AS DOUBLE) / ({n1} + {n2}))"
    se = f"sqrt({pool} * (1.0 - {pool}) * (1.0 / {n1} + 1.0 / {n2}))"
    z = f"(({p2} - {p1}) / {se})"
    pv = f"(2.0 * (1.0 - {normal_cdf_sql(f'abs({z})')}))"
    few = f"({n1} < 5 OR {n2} < 5)"
    above = f"({pool} > 1.0)"
    ok = f"(NOT {few} AND NOT {above})"
    flat = f"({se} = 0.0)"
    return f"""
SELECT {cols},
  round(CASE WHEN {ok} AND {flat} THEN 0.0 WHEN {ok} THEN {z} END, 6) AS z_score,
  round(CASE WHEN {ok} AND {flat} THEN 1.0 WHEN {ok} THEN {pv} END, 6) AS p_value,
  coalesce({ok} AND NOT {flat} AND {pv} < 0.05, false) AS is_significant,
  round(CASE WHEN {ok} AND {flat} THEN 0.0 WHEN {ok} AND {p1} > 0 THEN ({p2} - {p1}) / {p1} * 100.0 END, 6) AS lift_pct,
  round(CASE WHEN {ok} AND NOT {flat} THEN {p1} * 100.0 END, 6) AS control_ctr,
  round(CASE WHEN {ok} AND NOT {flat} THEN {p2} * 100.0 END, 6) AS treatment_ctr,
  CASE WHEN {few} THEN 'insufficient' WHEN {above} THEN 'rate_above_one' WHEN {flat} THEN 'no variance'
       WHEN {pv} < 0.05 THEN 'significant' ELSE 'not significant' END AS status
FROM {m}"""


SIG_COLS = ["z_score", "p_value", "lift_pct", "control_ctr", "treatment_ctr"]


def _round_sig(df):
    for c in SIG_COLS:
        df = df.withColumn(c, F.round(c, 6))
    return df


@register("assign_buckets", "2.13", B.with_ctes("users") + f"""
SELECT user_id, '{EXP}' AS experiment_id, {B.bucket_sql('user_id')} AS bucket FROM users""")
def assign_buckets_q(spark, sf):
    return X.assign_buckets(B.users(spark, sf), EXP)


@register("sticky_buckets", "2.13", B.with_ctes("users", "experiment_events") + f"""
, st AS (SELECT DISTINCT user_id, CASE bucket WHEN 'control' THEN 'treatment' ELSE 'control' END AS bucket
         FROM experiment_events WHERE CAST(user_id AS BIGINT) % 3 = 0)
SELECT u.user_id, '{EXP}' AS experiment_id, coalesce(st.bucket, {B.bucket_sql('u.user_id')}) AS bucket,
       st.bucket IS NOT NULL AS was_stored
FROM users u LEFT JOIN st ON u.user_id = st.user_id""".replace("\n, st AS", ", st AS", 1))
def sticky_buckets_q(spark, sf):
    # a third of the users were stored in the other bucket, which must win
    stored = (B.experiment_events(spark, sf).where(F.col("user_id").cast("long") % 3 == 0)
              .select("user_id", "experiment_id", F.when(F.col("bucket") == "control", "treatment").otherwise("control").alias("bucket")).distinct())
    return X.sticky_buckets(B.users(spark, sf), stored, EXP)


@register("arm_info", "2.13", B.with_ctes("users") + f"""
, a AS (SELECT user_id, '{EXP}' AS experiment_id, {B.bucket_sql('user_id')} AS bucket FROM users
        UNION ALL SELECT user_id, 'exp_unknown', 'control' FROM users)
SELECT user_id, experiment_id, bucket,
       CASE WHEN experiment_id = '{EXP}' THEN (CASE WHEN bucket = 'treatment' THEN 'xgboost_ml' ELSE 'popularity_based' END)
            ELSE bucket END AS arm,
       CASE WHEN experiment_id = '{EXP}' THEN 'ML vs Popularity Algorithm Test' ELSE 'Unknown Experiment' END
         AS experiment_name
FROM a""".replace("\n, a AS", ", a AS", 1))
def arm_info_q(spark, sf):
    u = B.users(spark, sf)
    a = X.assign_buckets(u, EXP).unionByName(X.assign_buckets(u, "exp_unknown"))
    return X.arm_info(spark, a)


@register("assign_n_arms", "2.13", B.with_ctes("users") + f"""
SELECT user_id, '{EXP}' AS experiment_id,
       (['a', 'b', 'c'])[{sha_mod_sql("user_id || '_" + EXP + "'", 3)} + 1] AS arm FROM users""")
def assign_n_arms_q(spark, sf):
    return X.assign_n_arms(B.users(spark, sf), EXP, ["a", "b", "c"])


@register("experiment_events", "2.13", B.with_ctes("experiment_events") + """
SELECT experiment_id, bucket, event_type, count(*) AS n, count(DISTINCT user_id) AS users
FROM experiment_events GROUP BY ALL""")
def experiment_events_q(spark, sf):
    e = B.experiment_events(spark, sf)
    return e.groupBy("experiment_id", "bucket", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


def _metrics_cols(df):
    return df.withColumn("control_interaction_rate", F.round("control_interaction_rate", 6)) \
             .withColumn("treatment_interaction_rate", F.round("treatment_interaction_rate", 6))


@register("ab_arm_metrics", "2.5", B.with_ctes("experiment_events", extra=[("m", metrics_sql("experiment_events"))]) + """
SELECT *, round(CASE WHEN control_requests > 0 THEN control_interactions / control_requests ELSE 0.0 END, 6)
          AS control_interaction_rate,
          round(CASE WHEN treatment_requests > 0 THEN treatment_interactions / treatment_requests ELSE 0.0 END, 6)
          AS treatment_interaction_rate
FROM m""")
def ab_arm_metrics_q(spark, sf):
    return _metrics_cols(X.ab_arm_metrics(B.experiment_events(spark, sf)))


DAILY = [("ed", """
  SELECT *, strftime(timestamp, '%Y-%m-%d') AS day FROM experiment_events"""),
         ("m", metrics_sql("ed", "day"))]


@register("ab_significance", "2.5", B.with_ctes("experiment_events", extra=DAILY) + sig_sql(
    "m", "experiment_id, day, control_requests, control_interactions, treatment_requests, treatment_interactions"))
def ab_significance_q(spark, sf):
    e = B.experiment_events(spark, sf).withColumn("day", F.date_format("timestamp", "yyyy-MM-dd"))
    m = X.ab_arm_metrics(e, ["day"])
    s = X.ab_significance(m).select("experiment_id", "day", "control_requests", "control_interactions",
                                    "treatment_requests", "treatment_interactions", *SIG_COLS,
                                    "is_significant", "status")
    return _round_sig(s)


@register("experiment_report", "2.13", B.with_ctes("experiment_events", extra=[("lastn", """
  SELECT * FROM experiment_events
  QUALIFY row_number() OVER (PARTITION BY experiment_id ORDER BY timestamp DESC, event_id DESC) <= 1000"""),
    ("m", metrics_sql("lastn"))]) + sig_sql(
    "m", f"experiment_id, 'ML vs Popularity Algorithm Test' AS name, 0.5 AS traffic_split, total_events, "
         "control_requests, control_interactions, treatment_requests, treatment_interactions"))
def experiment_report_q(spark, sf):
    r = X.experiment_report(spark, B.experiment_events(spark, sf), 1000)
    r = r.select("experiment_id", "name", "traffic_split", "total_events", "control_requests",
                 "control_interactions", "treatment_requests", "treatment_interactions", *SIG_COLS,
                 "is_significant", "status")
    return _round_sig(r)


def _arms(spark):
    return spark.createDataFrame([(EXP, "control"), (EXP, "treatment")], "experiment_id string, arm string")


POST_SQL = B.with_ctes("outcomes", extra=[("arms", f"""
  SELECT * FROM (VALUES ('{EXP}', 'control'), ('{EXP}', 'treatment')) v(experiment_id, arm)"""), ("post", """
  SELECT a.experiment_id, a.arm,
         1.0 + coalesce(sum(CASE WHEN o.reward > 0 THEN o.reward ELSE 0.0 END), 0.0) AS alpha,
         1.0 + CAST(coalesce(count(*) FILTER (WHERE o.reward <= 0), 0) AS DOUBLE) AS beta
  FROM arms a LEFT JOIN outcomes o ON a.experiment_id = o.experiment_id AND a.arm = o.arm
  GROUP BY a.experiment_id, a.arm""")])


@register("bandit_posterior", "2.5", POST_SQL + "SELECT experiment_id, arm, alpha, beta FROM post")
def bandit_posterior_q(spark, sf):
    return X.bandit_posterior(spark, B.outcomes(spark, sf), _arms(spark))


@register("bandit_stats", "2.5", POST_SQL + """
SELECT experiment_id, arm, alpha, beta, round(alpha / (alpha + beta), 6) AS estimated_ctr,
       CAST(greatest(0, floor(alpha + beta - 2)) AS BIGINT) AS observations,
       round(alpha / (alpha + beta) * 100.0 / sum(alpha / (alpha + beta) * 100.0) OVER (PARTITION BY experiment_id)
             * 100.0, 6) AS traffic_pct
FROM post""")
def bandit_stats_q(spark, sf):
    s = X.bandit_stats(X.bandit_posterior(spark, B.outcomes(spark, sf), _arms(spark)))
    return s.withColumn("estimated_ctr", F.round("estimated_ctr", 6)).withColumn("traffic_pct", F.round("traffic_pct", 6))


@register("thompson_assign", "2.13")
def thompson_assign_q(spark, sf):
    """Random draw (seeded): checked by invariants in tests, no oracle."""
    post = X.bandit_posterior(spark, B.outcomes(spark, sf), _arms(spark))
    users = B.users(spark, sf).select("user_id", F.lit(EXP).alias("experiment_id"))
    return X.thompson_assign(users, post, 42)


@register("request_rollup", "2.5", B.with_ctes("experiment_events") + """
SELECT 'events' AS metric, event_type AS label, count(*) AS count FROM events GROUP BY event_type
UNION ALL SELECT 'recommendations', CASE WHEN bucket = 'treatment' THEN 'xgboost_ml' ELSE 'popularity_based' END,
       count(*) FROM experiment_events WHERE event_type = 'recommendation_request' GROUP BY 2
UNION ALL SELECT 'assignments', experiment_id || ':' || bucket, count(*)
       FROM (SELECT DISTINCT user_id, experiment_id, bucket FROM experiment_events) GROUP BY 2
UNION ALL SELECT 'searches', """ + classify_intent_sql("text")[0] + """, count(*) FROM conversations GROUP BY 2""")
def request_rollup_q(spark, sf):
    """Requests by label; searches are the conversations' texts by intent.
    The tables hold no cache, so there is no hit rate to count."""
    searches = classify_intent(raw(spark, sf, "conversations").select("text")).select(F.col("intent").alias("label"))
    ev = raw(spark, sf, "events").select(F.col("event_type").alias("label"))
    ee = B.experiment_events(spark, sf)
    recs = ee.filter(F.col("event_type") == "recommendation_request").select(
        F.when(F.col("bucket") == "treatment", "xgboost_ml").otherwise("popularity_based").alias("label"))
    asg = ee.select("user_id", "experiment_id", "bucket").distinct().select(
        F.concat_ws(":", "experiment_id", "bucket").alias("label"))
    return X.request_rollup({"events": ev, "recommendations": recs, "assignments": asg, "searches": searches})


@register("latency_histogram", "2.5", """
WITH b AS (SELECT * FROM (VALUES ('0.05', 0.05, 0), ('0.1', 0.1, 1), ('0.25', 0.25, 2), ('0.5', 0.5, 3),
           ('1.0', 1.0, 4), ('2.0', 2.0, 5), ('5.0', 5.0, 6), ('10.0', 10.0, 7)) v(le, bound, i)),
o AS (SELECT event_type, value / 10.0 AS seconds FROM events)
SELECT g.event_type, b.le, count(*) FILTER (WHERE o.seconds <= b.bound) AS bucket_count,
       round(any_value(g.s), 6) AS sum, any_value(g.n) AS count
FROM (SELECT event_type, sum(value / 10.0) AS s, count(*) AS n FROM events GROUP BY event_type) g
JOIN o ON o.event_type = g.event_type CROSS JOIN b GROUP BY g.event_type, b.le
UNION ALL SELECT event_type, '+Inf', count(*), round(sum(value / 10.0), 6), count(*) FROM events GROUP BY event_type""")
def latency_histogram_q(spark, sf):
    """Event values read as durations (value / 10 seconds) per event type."""
    o = raw(spark, sf, "events").select("event_type", (F.col("value") / 10.0).alias("seconds"))
    h = X.latency_histogram(o, ["event_type"], "seconds")
    return h.withColumn("sum", F.round("sum", 6))
