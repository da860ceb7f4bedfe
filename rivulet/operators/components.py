"""Connected components of a link table, by alternating star joins.

Each round links every larger neighbour of a node to the smallest node it
sees, then every smaller one; the links become a forest of stars in a
logarithmic number of rounds.  Every round is cut off by ``save``."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def reliable(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder, of which readers take the columns that
    they need; smaller than a checkpoint."""
    path = f"{checkpoint_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the tables that ``written`` made and ``df`` reads; nothing may
    read them later."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def released(spark):
    """Within, a query's shuffle files are deleted when it has been run."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def components(links: DataFrame, save=reliable) -> DataFrame:
    """``links`` (a, b) of any orderable type -> (u, root) for every linked
    node but the roots; root is the smallest node of its component.  Self
    links and repeated links are allowed; null ends are ignored."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = save(edges)
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        seen = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(seen, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = save(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        roots = edges.select(F.col("v").alias("u")).distinct()
        deep = edges.join(roots, "u", "left_semi").limit(1).count()
        if not deep and not edges.groupBy("u").count().where("count > 1").limit(1).count():
            break
    return edges.select("u", F.col("v").alias("root"))
