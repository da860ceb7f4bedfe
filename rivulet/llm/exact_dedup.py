"""Exact deduplication by a stream with disk-backed keyed state.

A Structured Streaming job reads the table's files and keeps, per digest of
the text and without expiry, the largest id with its content locator (file
and row) and how many rows had that digest.  The state lives in RocksDB under
the shared checkpoint folder; a restarted job reads on where it stopped.

Rows whose digest the state holds more than once are hits: their full bytes
are compared with the bytes at the kept row's locator.  Rows that differ (a
digest collision) are grouped anew by the text itself.  Large groups are
salted by their counted size, and the kept text is copied to each salt.

Only DataFrame operations are used.

Defined cases: null text equals the empty text; a null id is smaller than any
other; a repeated row (same id and text) is a row of the group, and of rows
with the largest id the last by locator stays; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch

#: State on disk; executors close a partition's store when they have committed
#: it, as one run rarely returns to it (an open store holds 4 MB of disk).
STATE = {"spark.sql.streaming.stateStore.providerClass":
         "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         "spark.sql.streaming.stateStore.unloadOnCommit": "true"}
BROADCAST_ROWS = 100_000
SALT_ROWS = 256
MAX_SALTS = 65_536


def sha256_of(text):
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def _rows(source: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return source.select(F.col(id_col).alias("doc_id"), text.alias("text"), digest(text).alias("digest"),
                         F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row")).alias("locator"))


def update_ledger(spark: SparkSession, path: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text",
                  digest=sha256_of, max_files_per_trigger: int | None = None) -> DataFrame:
    """Take in the files under ``path`` not seen before by this checkpoint and
    return the state: digest, keeper (doc_id, locator), n."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    # a pattern, as the stream's reader takes a plain path for a folder and this may be one file
    files = reader.parquet(f"{path[:-1]}[{path[-1]}]")
    state = (_rows(files, id_col, text_col, digest)
             .groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("keeper"), F.count("*").alias("n")))
    before = {key: spark.conf.get(key) for key in STATE}
    for key, value in STATE.items():
        spark.conf.set(key, value)
    try:
        query = (state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    held = spark.read.format("statestore").load(checkpoint)
    keeper, n = held.schema["value"].dataType.names[:2]
    return held.select(F.col("key")[held.schema["key"].dataType.names[0]].alias("digest"),
                       F.col("value")[keeper].alias("keeper"), F.col("value")[n].alias("n"))


def exact_dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text",
                digest=sha256_of, max_files_per_trigger: int | None = None) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, digest."""
    source = spark.read.parquet(path)
    if source.limit(1).count() == 0:
        none = _rows(source, id_col, text_col, digest)
        return none.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"),
                           F.lit(True).alias("kept"), "digest")
    ledger = update_ledger(spark, path, scratch(spark, "dedup-state"), id_col, text_col, digest, max_files_per_trigger)
    repeated = materialise(ledger.where("n > 1"), "dedup-repeated")
    small = repeated.count() <= BROADCAST_ROWS
    known = F.broadcast(repeated) if small else repeated

    rows = _rows(source, id_col, text_col, digest)
    hits = rows.join(known, "digest").withColumn("salts", F.least(F.ceil(F.col("n") / SALT_ROWS), F.lit(MAX_SALTS)).cast("int"))
    is_keeper = F.col("locator") == F.col("keeper.locator")
    texts = (hits.where(is_keeper).select("digest", F.col("text").alias("kept_text"),
                                          F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")))
    others = hits.where(~is_keeper).withColumn("salt", F.pmod(F.xxhash64("locator"), F.col("salts")).cast("int"))
    differ = materialise(others.join(texts, ["digest", "salt"]).where("text <> kept_text")
                         .select("digest", "locator", "doc_id", "text"), "dedup-collisions")

    grouped = rows.select("doc_id", "digest", "locator").join(known, "digest", "left")
    if differ.limit(1).count():
        lost = differ.groupBy("digest").agg(F.count("*").alias("lost"))
        apart = differ.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "locator")).alias("own_keeper"), F.count("*").alias("own_n"))
        own = differ.join(apart, ["digest", "text"]).select("locator", "own_keeper", "own_n")
        grouped = (grouped.join(own, "locator", "left").join(lost, "digest", "left")
                   .withColumn("n", F.coalesce("own_n", F.col("n") - F.coalesce("lost", F.lit(0))))
                   .withColumn("keeper", F.coalesce("own_keeper", "keeper")))
    alone = F.col("n").isNull()
    return grouped.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keeper.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("locator") == F.col("keeper.locator"))).alias("kept"), "digest")
