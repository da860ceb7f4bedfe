"""Experiment operators: hash bucketing, arm metrics,
two-proportion z-test, Beta-Bernoulli bandit, request counters.

Everything is a column expression or a partial aggregate, except the
Thompson draw, which is a vectorised pandas UDF seeded per (seed, user, arm)
so that it is repeatable and independent of partitioning.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalars import normal_cdf, sha_mod


def experiments_table(spark: SparkSession) -> DataFrame:
    """Experiment configuration (a small fixed dimension)."""
    return spark.createDataFrame(
        [row for row in K.EXPERIMENTS],
        "experiment_id string, name string, description string, traffic_split double, "
        "control_arm string, treatment_arm string, status string")


def _split_of(experiment_id: str) -> float | None:
    for e in K.EXPERIMENTS:
        if e[0] == experiment_id:
            return e[3]
    return None


def assign_buckets(users: DataFrame, experiment_id: str, split: float | None = None) -> DataFrame:
    """sha256(user_experiment) mod 100 < split * 100 -> treatment; an
    unknown experiment puts everyone in control."""
    split = split if split is not None else _split_of(experiment_id)
    key = F.concat(F.col("user_id").cast("string"), F.lit("_" + experiment_id))
    bucket = (F.lit("control") if split is None else
              F.when(sha_mod(key, 100) < F.lit(split * 100), "treatment").otherwise("control"))
    return users.select("user_id", F.lit(experiment_id).alias("experiment_id"), bucket.alias("bucket"))


def sticky_buckets(users: DataFrame, stored: DataFrame, experiment_id: str) -> DataFrame:
    """A stored assignment wins; otherwise the computed one (to be stored)."""
    computed = assign_buckets(users, experiment_id)
    s = stored.filter(F.col("experiment_id") == experiment_id).select(
        "user_id", F.col("bucket").alias("stored_bucket"))
    j = computed.join(s, "user_id", "left")
    return j.select("user_id", "experiment_id", F.coalesce("stored_bucket", "bucket").alias("bucket"),
                    F.col("stored_bucket").isNotNull().alias("was_stored"))


def arm_info(spark: SparkSession, assignments: DataFrame) -> DataFrame:
    """bucket -> arm name and experiment name, with defaults for unknown ones."""
    cfg = experiments_table(spark).select("experiment_id", "name", "control_arm", "treatment_arm")
    j = assignments.join(F.broadcast(cfg), "experiment_id", "left")
    arm = F.when(F.col("bucket") == "treatment", F.coalesce("treatment_arm", F.lit("treatment"))) \
           .otherwise(F.coalesce("control_arm", F.lit("control")))
    return j.select("user_id", "experiment_id", "bucket", arm.alias("arm"),
                    F.coalesce("name", F.lit("Unknown Experiment")).alias("experiment_name"))


def assign_n_arms(users: DataFrame, experiment_id: str, arms: list[str]) -> DataFrame:
    """Fixed-split mode: arms[sha256(user_experiment) mod n]."""
    key = F.concat(F.col("user_id").cast("string"), F.lit("_" + experiment_id))
    idx = sha_mod(key, len(arms))
    arm = F.element_at(F.array(*[F.lit(a) for a in arms]), (idx + 1).cast("int"))
    return users.select("user_id", F.lit(experiment_id).alias("experiment_id"), arm.alias("arm"))


# ------------------------------------------------------------ arm metrics

def ab_arm_metrics(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per experiment (and optional extra keys): events, users, requests,
    interactions and rates per arm."""
    ctl, trt = F.col("bucket") == "control", F.col("bucket") == "treatment"
    inter = F.col("event_type").startswith("interaction_")
    req = F.col("event_type") == "recommendation_request"
    m = events.groupBy("experiment_id", *(by or [])).agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(ctl).alias("control_events"), F.count_if(trt).alias("treatment_events"),
        F.countDistinct(F.when(ctl, F.col("user_id"))).alias("control_users"),
        F.countDistinct(F.when(trt, F.col("user_id"))).alias("treatment_users"),
        F.count_if(ctl & inter).alias("control_interactions"),
        F.count_if(trt & inter).alias("treatment_interactions"),
        F.count_if(ctl & req).alias("control_requests"),
        F.count_if(trt & req).alias("treatment_requests"))
    rate = lambda c, n: F.when(F.col(n) > 0, F.col(c) / F.col(n)).otherwise(F.lit(0.0))
    return (m.withColumn("control_interaction_rate", rate("control_interactions", "control_requests"))
             .withColumn("treatment_interaction_rate", rate("treatment_interactions", "treatment_requests")))


def ab_significance(df: DataFrame, n1="control_requests", c1="control_interactions",
                    n2="treatment_requests", c2="treatment_interactions") -> DataFrame:
    """Two-proportion z-test as columns: z_score, p_value, is_significant,
    lift_pct, control_ctr, treatment_ctr, status (unrounded values)."""
    N1, C1, N2, C2 = (F.col(x).cast("double") for x in (n1, c1, n2, c2))
    div = F.try_divide  # ANSI mode: a zero divisor gives null, not an error
    p1, p2 = div(C1, N1), div(C2, N2)
    pool = div(C1 + C2, N1 + N2)
    var = pool * (F.lit(1.0) - pool) * (div(F.lit(1.0), N1) + div(F.lit(1.0), N2))
    se = F.sqrt(var)
    z = div(p2 - p1, se)
    p = F.lit(2.0) * (F.lit(1.0) - normal_cdf(F.abs(z)))
    few = (F.col(n1) < 5) | (F.col(n2) < 5)
    above = pool > 1.0
    flat = se == 0.0
    status = (F.when(few, "insufficient").when(above, "rate_above_one").when(flat, "no variance")
              .when(p < 0.05, "significant").otherwise("not significant"))
    ok = ~few & ~above
    return df.select(
        "*",
        F.when(ok & flat, F.lit(0.0)).when(ok, z).alias("z_score"),
        F.when(ok & flat, F.lit(1.0)).when(ok, p).alias("p_value"),
        (ok & ~flat & (p < 0.05)).alias("is_significant"),
        F.when(ok & flat, F.lit(0.0)).when(ok & (p1 > 0), div(p2 - p1, p1) * 100.0).alias("lift_pct"),
        F.when(ok & ~flat, p1 * 100.0).alias("control_ctr"),
        F.when(ok & ~flat, p2 * 100.0).alias("treatment_ctr"),
        status.alias("status"))


def experiment_report(spark: SparkSession, events: DataFrame, last_n: int | None = 1000) -> DataFrame:
    """Config + arm metrics + significance for every experiment, over the
    newest ``last_n`` events of each (the rolling buffer), or all events."""
    from .windows import last_n_events
    ev = last_n_events(events, last_n).drop("rank") if last_n else events
    m = ab_significance(ab_arm_metrics(ev))
    cfg = experiments_table(spark).withColumnRenamed("status", "experiment_status")
    return cfg.join(m, "experiment_id", "left")


# ------------------------------------------------------------ bandit

def bandit_posterior(spark: SparkSession, outcomes: DataFrame, arms: DataFrame) -> DataFrame:
    """alpha = 1 + sum of positive rewards, beta = 1 + count of rewards <= 0;
    outcomes for unknown arms are ignored (inner side of the arms join)."""
    agg = outcomes.groupBy("experiment_id", "arm").agg(
        F.sum(F.when(F.col("reward") > 0, F.col("reward")).otherwise(F.lit(0.0))).alias("pos"),
        F.count_if(F.col("reward") <= 0).alias("neg"))
    j = arms.join(agg, ["experiment_id", "arm"], "left")
    return j.select("experiment_id", "arm",
                    (F.lit(1.0) + F.coalesce("pos", F.lit(0.0))).alias("alpha"),
                    (F.lit(1.0) + F.coalesce("neg", F.lit(0)).cast("double")).alias("beta"))


def bandit_stats(posterior: DataFrame) -> DataFrame:
    """Mean, observations and traffic share normalised to 100 per experiment."""
    mean = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    w = Window.partitionBy("experiment_id")
    s = posterior.withColumn("estimated_ctr", mean)
    return s.select(
        "experiment_id", "arm", "alpha", "beta", "estimated_ctr",
        F.greatest(F.lit(0), (F.col("alpha") + F.col("beta") - 2).cast("long")).alias("observations"),
        (F.col("estimated_ctr") * 100.0 / F.sum(F.col("estimated_ctr") * 100.0).over(w) * 100.0).alias("traffic_pct"))


def _uniforms(keys: np.ndarray, step: int) -> np.ndarray:
    """The ``step``-th number in (0, 1) of each 64-bit key: a counter put
    through a bit mixer, so that draws need no generator of their own."""
    x = keys + np.uint64(step) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def gamma_draws(shape: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """One Gamma(shape, 1) draw per key, by rejection over whole arrays: each
    round draws anew for the rows that were not accepted yet."""
    boost = shape < 1.0
    d = np.where(boost, shape + 1.0, shape) - 1.0 / 3.0
    c = 1.0 / np.sqrt(9.0 * d)
    out, open_ = np.zeros(len(shape)), np.arange(len(shape))
    step = 1
    while len(open_):
        k, dd = keys[open_], d[open_]
        normal = np.sqrt(-2.0 * np.log(_uniforms(k, step))) * np.cos(2.0 * np.pi * _uniforms(k, step + 1))
        v = (1.0 + c[open_] * normal) ** 3
        with np.errstate(divide="ignore", invalid="ignore"):
            taken = (v > 0) & (np.log(_uniforms(k, step + 2)) < 0.5 * normal ** 2 + dd - dd * v + dd * np.log(v))
        out[open_[taken]] = (dd * v)[taken]
        open_, step = open_[~taken], step + 3
    return np.where(boost, out * _uniforms(keys, 0) ** (1.0 / shape), out)


def thompson_assign(users: DataFrame, posterior: DataFrame, seed: int = 42) -> DataFrame:
    """One Beta(alpha, beta) draw per (user, arm); the arm with the highest
    draw wins.  Users meet their experiment's arms by an equi-join on the
    experiment id (left to Spark, which broadcasts arms it has measured
    small).  A draw depends on a hash of (seed, user, arm) only, however rows
    are partitioned, and is made for whole Arrow batches at a time."""

    @F.pandas_udf("double")
    def draw(key: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        keys = key.to_numpy(np.int64).view(np.uint64)
        x = gamma_draws(a.to_numpy(np.float64), keys)
        y = gamma_draws(b.to_numpy(np.float64), keys ^ np.uint64(0x5851F42D4C957F2D))
        return pd.Series(x / (x + y))

    j = users.select("user_id", "experiment_id").join(posterior.select("experiment_id", "arm", "alpha", "beta"), "experiment_id")
    d = j.withColumn("draw", draw(F.xxhash64(F.lit(seed), F.col("user_id").cast("string"), "arm"), "alpha", "beta"))
    return d.groupBy("user_id", "experiment_id").agg(F.max_by("arm", F.struct("draw", "arm")).alias("arm"),
                                                     F.max("draw").alias("draw"))


# ------------------------------------------------------------ counters

def request_rollup(frames: dict[str, DataFrame]) -> DataFrame:
    """Counter rows (metric, label, count) from log tables, one per label set:
    ``frames`` maps a metric name to a DataFrame with a ``label`` column."""
    from .sets import union_all
    parts = [d.groupBy("label").agg(F.count(F.lit(1)).alias("count"))
             .select(F.lit(name).alias("metric"), "label", "count") for name, d in frames.items()]
    return union_all(parts)


def latency_histogram(obs: DataFrame, by: list[str], value: str, buckets=None) -> DataFrame:
    """Cumulative ``le`` bucket counts plus sum and count, in one pass: a
    conditional count per fixed bound, then the bounds unpivoted to rows."""
    bounds = list(buckets or K.LATENCY_BUCKETS)
    aggs = [F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)]
    g = obs.groupBy(*by).agg(*aggs, F.count(F.lit(1)).alias("le_inf"), F.sum(value).alias("sum"),
                             F.count(F.lit(1)).alias("count"))
    stack = F.explode(F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"le_{i}").alias("n"))
                                for i, b in enumerate(bounds)],
                              F.struct(F.lit("+Inf").alias("le"), F.col("le_inf").alias("n"))))
    return g.select(*by, stack.alias("b"), "sum", "count").select(*by, "b.le", F.col("b.n").alias("bucket_count"),
                                                                 "sum", "count")
