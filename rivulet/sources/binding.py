"""Binding of the driver's test tables to the canonical tables.

Every canonical relation exists twice from one definition: a Spark builder
and a DuckDB CTE for the oracle.  Only raw tables are read, so every query's
work grows with the input.

Timestamps stay ``timestamp_ntz`` (as in the files) for batch jobs; streaming
jobs cast to ``timestamp`` before a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalars import pick, pick_sql, sha_mod, sha_mod_sql
from .tables import raw

DEVICES_FIXTURE = ["web", "mobile", "tablet", "smart_tv"]
AGES_FIXTURE = ["18-24", "25-34", "35-44", "45-54", "55-64", "65+"]
DEFAULT_PUBLISH = "1995-01-01 00:00:00"
EXPERIMENT = K.DEFAULT_EXPERIMENT
TRAFFIC_SPLIT = 0.5


def _ntz(s: str):
    return F.lit(s).cast("timestamp_ntz")


# ---------------------------------------------------------------- Spark side

def items(spark: SparkSession, sf: str) -> DataFrame:
    part = raw(spark, sf, "part")
    stats = (raw(spark, sf, "lineitem")
             .groupBy("l_partkey")
             .agg(F.count(F.lit(1)).alias("n_lines"), F.min("l_shipdate").alias("first_ship")))
    p = part.join(stats, part.p_partkey == stats.l_partkey, "left")
    return p.select(
        F.col("p_partkey").cast("string").alias("item_id"),
        F.col("p_name").alias("title"),
        pick(K.CONTENT_TYPES, F.col("p_size") % 8).alias("content_type"),
        F.col("p_type").alias("category"),
        F.array(F.col("p_brand"), F.split_part("p_name", F.lit(" "), F.lit(1)),
                F.split_part("p_name", F.lit(" "), F.lit(2))).alias("tags"),
        F.concat_ws(" ", "p_type", "p_brand", "p_name").alias("description"),
        F.lit("").alias("thumbnail_url"),
        F.coalesce(F.col("first_ship"), _ntz(DEFAULT_PUBLISH)).alias("publish_ts"),
        (F.col("p_size") * 60).cast("int").alias("duration_seconds"),
        ((F.col("p_size") % 11).cast("double") / 2.0).alias("rating"),
        F.coalesce(F.col("n_lines"), F.lit(0)).cast("long").alias("view_count"),
    )


def users(spark: SparkSession, sf: str) -> DataFrame:
    c = raw(spark, sf, "customer")
    n = raw(spark, sf, "nation")
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "left").select(
        F.col("c_custkey").cast("string").alias("user_id"),
        _ntz(DEFAULT_PUBLISH).alias("signup_ts"),
        F.col("n_name").alias("country"),
        pick(DEVICES_FIXTURE, F.col("c_custkey") % 4).alias("device"),
        pick(AGES_FIXTURE, F.col("c_custkey") % 6).alias("age_group"),
        F.array("c_mktsegment").alias("preferences"),
    )


def interactions(spark: SparkSession, sf: str) -> DataFrame:
    """Large binding: lineitem joined to orders (a multiset, ids repeat)."""
    li = raw(spark, sf, "lineitem")
    o = raw(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    itype = (F.when(F.col("l_returnflag") == "A", "view")
             .when(F.col("l_returnflag") == "N", "click")
             .when(F.col("l_linestatus") == "O", "like")
             .otherwise("purchase"))
    return j.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("interaction_id"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("l_partkey").cast("string").alias("item_id"),
        itype.alias("interaction_type"),
        F.col("o_orderdate").alias("timestamp"),
        (F.col("l_quantity") * 2).cast("int").alias("dwell_seconds"),
        F.when(F.col("l_linenumber") % 2 == 0,
               ((F.col("l_linenumber") % 5) + 1).cast("double")).alias("rating"),
        F.lit(None).cast("string").alias("context"),
        F.col("l_orderkey").alias("seq_a"), F.col("l_linenumber").cast("long").alias("seq_b"),
        F.col("l_partkey").alias("seq_c"), F.col("l_suppkey").alias("seq_d"),
    )


def event_interactions(spark: SparkSession, sf: str) -> DataFrame:
    """Event-log binding: ids unique, 150 users, items 0..99."""
    e = raw(spark, sf, "events")
    itype = (F.when(F.col("event_type") == "signup", "bookmark")
             .when(F.col("event_type") == "error", "dislike")
             .otherwise(F.col("event_type")))
    return e.select(
        F.col("event_id").cast("string").alias("interaction_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.get_json_object("props", "$.k").alias("item_id"),
        itype.alias("interaction_type"),
        F.col("ts").alias("timestamp"),
        F.floor("value").cast("int").alias("dwell_seconds"),
        F.lit(None).cast("double").alias("rating"),
        F.col("props").alias("context"),
        F.col("event_id").alias("seq_a"),
    )


def bucket_of(user_col, experiment: str = EXPERIMENT, split: float = TRAFFIC_SPLIT):
    key = F.concat(F.col(user_col).cast("string"), F.lit("_" + experiment))
    return F.when(sha_mod(key, 100) < F.lit(split * 100), "treatment").otherwise("control")


def experiment_events(spark: SparkSession, sf: str) -> DataFrame:
    e = raw(spark, sf, "events").filter(F.col("event_type").isin("view", "click", "purchase"))
    return e.select(
        F.col("ts").alias("timestamp"),
        F.col("user_id").cast("string").alias("user_id"),
        F.lit(EXPERIMENT).alias("experiment_id"),
        bucket_of("user_id").alias("bucket"),
        F.when(F.col("event_type") == "view", "recommendation_request")
         .otherwise(F.concat(F.lit("interaction_"), F.col("event_type"))).alias("event_type"),
        F.col("props").alias("event_data"),
        F.col("event_id"),
    )


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    e = raw(spark, sf, "events").filter(F.col("event_type").isin("view", "purchase"))
    return e.select(
        F.lit(EXPERIMENT).alias("experiment_id"),
        bucket_of("user_id").alias("arm"),
        F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0).alias("reward"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("ts").alias("ts"),
    )


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their whole first line as the title."""
    d = raw(spark, sf, "documents")
    first = F.substring_index("text", "\n", 1)
    return d.select(
        "doc_id", "text", "lang", "source",
        first.alias("title"),
        first.alias("first_line"),
    )


def part_queries(spark: SparkSession, sf: str, limit: int = 20) -> DataFrame:
    """Query table: the distinct part names, numbered by name."""
    names = raw(spark, sf, "part").select(F.col("p_name").alias("text")).distinct()
    return names.select(
        text_id("text").alias("query_id"),
        F.lit(None).cast("string").alias("user_id"),
        "text",
        F.lit(None).cast("string").alias("content_type"),
        F.lit(limit).alias("limit"),
    )


def benchmark_queries(spark: SparkSession, sf: str, limit: int = 10) -> DataFrame:
    """Query table: each benchmark passage."""
    b = raw(spark, sf, "benchmark")
    return b.select(
        F.col("item_id").alias("query_id"),
        F.lit(None).cast("string").alias("user_id"),
        "text",
        F.lit(None).cast("string").alias("content_type"),
        F.lit(limit).alias("limit"),
    )


def text_id(col) -> F.Column:
    """Stable 60-bit id of a text (first 15 hex digits of its SHA-256)."""
    return F.conv(F.substring(F.sha2(F.col(col), 256), 1, 15), 16, 10).cast("long")


def text_id_sql(expr: str) -> str:
    return f"CAST(('0x' || substr(sha256({expr}), 1, 15)) AS BIGINT)"


def as_of(df: DataFrame, col: str = "timestamp"):
    """Scalar subquery: the newest timestamp of ``df`` (replaces now())."""
    return df.agg(F.max(col)).scalar()


# ---------------------------------------------------------------- SQL side

_SQL: dict[str, tuple[list[str], str]] = {}


def _define(name: str, deps: list[str], body: str) -> None:
    _SQL[name] = (deps, body)


_define("items", [], f"""
  SELECT CAST(p.p_partkey AS VARCHAR) AS item_id,
         p.p_name AS title,
         {pick_sql(K.CONTENT_TYPES, 'p.p_size % 8')} AS content_type,
         p.p_type AS category,
         [p.p_brand, split_part(p.p_name, ' ', 1), split_part(p.p_name, ' ', 2)] AS tags,
         concat_ws(' ', p.p_type, p.p_brand, p.p_name) AS description,
         '' AS thumbnail_url,
         coalesce(s.first_ship, TIMESTAMP '{DEFAULT_PUBLISH}') AS publish_ts,
         CAST(p.p_size * 60 AS INTEGER) AS duration_seconds,
         CAST(p.p_size % 11 AS DOUBLE) / 2.0 AS rating,
         CAST(coalesce(s.n_lines, 0) AS BIGINT) AS view_count
  FROM part p LEFT JOIN (SELECT l_partkey, count(*) AS n_lines, min(l_shipdate) AS first_ship
                         FROM lineitem GROUP BY l_partkey) s ON p.p_partkey = s.l_partkey""")

_define("users", [], f"""
  SELECT CAST(c.c_custkey AS VARCHAR) AS user_id,
         TIMESTAMP '{DEFAULT_PUBLISH}' AS signup_ts,
         n.n_name AS country,
         {pick_sql(DEVICES_FIXTURE, 'c.c_custkey % 4')} AS device,
         {pick_sql(AGES_FIXTURE, 'c.c_custkey % 6')} AS age_group,
         [c.c_mktsegment] AS preferences
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""")

_define("interactions", [], """
  SELECT concat_ws('-', l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey) AS interaction_id,
         CAST(o.o_custkey AS VARCHAR) AS user_id,
         CAST(l.l_partkey AS VARCHAR) AS item_id,
         CASE WHEN l.l_returnflag = 'A' THEN 'view' WHEN l.l_returnflag = 'N' THEN 'click'
              WHEN l.l_linestatus = 'O' THEN 'like' ELSE 'purchase' END AS interaction_type,
         o.o_orderdate AS timestamp,
         CAST(l.l_quantity * 2 AS INTEGER) AS dwell_seconds,
         CASE WHEN l.l_linenumber % 2 = 0 THEN CAST(l.l_linenumber % 5 + 1 AS DOUBLE) END AS rating,
         CAST(NULL AS VARCHAR) AS context,
         l.l_orderkey AS seq_a, CAST(l.l_linenumber AS BIGINT) AS seq_b,
         l.l_partkey AS seq_c, l.l_suppkey AS seq_d
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""")

_define("event_interactions", [], """
  SELECT CAST(event_id AS VARCHAR) AS interaction_id,
         CAST(user_id AS VARCHAR) AS user_id,
         json_extract_string(props, '$.k') AS item_id,
         CASE event_type WHEN 'signup' THEN 'bookmark' WHEN 'error' THEN 'dislike'
              ELSE event_type END AS interaction_type,
         ts AS timestamp,
         CAST(floor(value) AS INTEGER) AS dwell_seconds,
         CAST(NULL AS DOUBLE) AS rating,
         props AS context,
         event_id AS seq_a
  FROM events""")


def bucket_sql(user_expr: str, experiment: str = EXPERIMENT, split: float = TRAFFIC_SPLIT) -> str:
    key = f"(CAST({user_expr} AS VARCHAR) || '_{experiment}')"
    return f"CASE WHEN {sha_mod_sql(key, 100)} < {split * 100} THEN 'treatment' ELSE 'control' END"


_define("experiment_events", [], f"""
  SELECT ts AS timestamp, CAST(user_id AS VARCHAR) AS user_id,
         '{EXPERIMENT}' AS experiment_id,
         {bucket_sql('user_id')} AS bucket,
         CASE WHEN event_type = 'view' THEN 'recommendation_request'
              ELSE 'interaction_' || event_type END AS event_type,
         props AS event_data, event_id
  FROM events WHERE event_type IN ('view', 'click', 'purchase')""")

_define("outcomes", [], f"""
  SELECT '{EXPERIMENT}' AS experiment_id, {bucket_sql('user_id')} AS arm,
         CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END AS reward,
         CAST(user_id AS VARCHAR) AS user_id, ts
  FROM events WHERE event_type IN ('view', 'purchase')""")

_define("corpus", [], """
  SELECT doc_id, text, lang, source,
         split_part(text, chr(10), 1) AS title
  FROM documents""")

_define("part_queries", [], """
  SELECT CAST(('0x' || substr(sha256(text), 1, 15)) AS BIGINT) AS query_id,
         CAST(NULL AS VARCHAR) AS user_id, text,
         CAST(NULL AS VARCHAR) AS content_type, 20 AS "limit"
  FROM (SELECT DISTINCT p_name AS text FROM part)""")


def with_ctes(*names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` clause holding the named bindings (and their dependencies),
    followed by ``extra`` (name, body) CTEs in order."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        if n in ordered:
            return
        for d in _SQL[n][0]:
            visit(d)
        ordered.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({_SQL[n][1]}\n)" for n in ordered]
    parts += [f"{n} AS ({body}\n)" for n, body in (extra or [])]
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""
