"""Canonical schemas and typed reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

USERS = T.StructType([
    T.StructField("user_id", T.StringType(), False),
    T.StructField("signup_ts", T.TimestampType()),
    T.StructField("country", T.StringType()),
    T.StructField("device", T.StringType()),
    T.StructField("age_group", T.StringType()),
    T.StructField("preferences", T.ArrayType(T.StringType())),
    T.StructField("total_interactions", T.LongType()),
])

ITEMS = T.StructType([
    T.StructField("item_id", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("content_type", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("description", T.StringType()),
    T.StructField("thumbnail_url", T.StringType()),
    T.StructField("publish_ts", T.TimestampType()),
    T.StructField("duration_seconds", T.IntegerType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("view_count", T.LongType()),
])

INTERACTIONS = T.StructType([
    T.StructField("interaction_id", T.StringType(), False),
    T.StructField("user_id", T.StringType(), False),
    T.StructField("item_id", T.StringType(), False),
    T.StructField("interaction_type", T.StringType(), False),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("dwell_seconds", T.IntegerType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("context", T.StringType()),
])

EVENTS = T.StructType([
    T.StructField("user_id", T.StringType(), False),
    T.StructField("item_id", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("ts", T.TimestampType()),
    T.StructField("dwell_seconds", T.IntegerType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("context", T.StringType()),
])

EXPERIMENT_EVENTS = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("experiment_id", T.StringType()),
    T.StructField("bucket", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("event_data", T.StringType()),
])

QUERIES = T.StructType([
    T.StructField("query_id", T.LongType(), False),
    T.StructField("user_id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("limit", T.IntegerType()),
])

SCHEMAS = {"users": USERS, "items": ITEMS, "interactions": INTERACTIONS,
           "events": EVENTS, "experiment_events": EXPERIMENT_EVENTS, "queries": QUERIES}


def read_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Typed Parquet read: the declared schema, never inference."""
    if isinstance(schema, str):
        schema = SCHEMAS[schema]
    return spark.read.schema(schema).parquet(path)


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
