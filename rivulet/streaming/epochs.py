"""Tables that streams write exactly once.

A stream's sink writes each epoch (micro-batch) into folders of its own and
then publishes the epoch by one small commit file, renamed into place.
Readers take committed epochs only.  A replayed epoch that is committed is
left alone; one that is not (the driver was lost between the writes and the
commit) overwrites its own folders.  What a sink reads back is from commits
strictly below the running epoch, so a replay sees what the first run saw.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Files:
    """Small files through the file system that Spark uses for ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def put(self, name: str, text: str) -> None:
        draft = self.path(f"{name}.{uuid.uuid4().hex}.draft")
        out = self.fs.create(draft, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if not self.fs.rename(draft, self.path(name)) and not self.fs.exists(self.path(name)):
            raise OSError(f"cannot publish {name}")

    def get(self, name: str) -> str:
        held = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8")
        finally:
            held.close()

    def names(self, folder: str) -> list[str]:
        where = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(where)] if self.fs.exists(where) else []


class EpochStore:
    """Tables of one stream under ``root``, visible epoch by epoch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root, _Files(spark, root)

    def _commit_file(self, epoch: int) -> str:
        return f"{self.root}/_commits/{epoch:012d}.json"

    def folder(self, table: str, epoch: int) -> str:
        return f"{self.root}/{table}/epoch-{epoch:012d}"

    def committed(self, below: int | None = None) -> list[int]:
        """Committed epochs in order, those under ``below`` if given."""
        epochs = sorted(int(n[:-5]) for n in self.files.names(f"{self.root}/_commits") if n.endswith(".json"))
        return epochs if below is None else [e for e in epochs if e < below]

    def commit_of(self, epoch: int) -> dict:
        return json.loads(self.files.get(self._commit_file(epoch)))

    def publish(self, epoch: int, tables: dict[str, DataFrame], note=None, partition_by: str | None = None) -> bool:
        """Write and commit an epoch's tables; False if it was committed
        before.  ``note()``, taken once the tables are written, goes with it."""
        if self.files.fs.exists(self.files.path(self._commit_file(epoch))):
            return False
        for name, df in tables.items():
            writer = df.write.mode("overwrite")
            (writer.partitionBy(partition_by) if partition_by else writer).parquet(self.folder(name, epoch))
        self.files.put(self._commit_file(epoch), json.dumps({"schemas": {n: d.schema.json() for n, d in tables.items()}, "note": note() if note else {}}))
        return True

    def read(self, table: str, epochs: list[int] | None = None) -> DataFrame:
        """Rows of all committed epochs (or of ``epochs``)."""
        epochs = self.committed() if epochs is None else epochs
        if not epochs:
            raise FileNotFoundError(f"no committed epoch under {self.root}")
        schema = T.StructType.fromJson(json.loads(self.commit_of(epochs[-1])["schemas"][table]))
        return self.spark.read.schema(schema).parquet(*[self.folder(table, e) for e in epochs])

    def read_latest(self, table: str, below: int | None = None) -> DataFrame | None:
        """Rows of the newest committed epoch, of those under ``below`` if
        given; None if there is none."""
        epochs = self.committed(below)
        return self.read(table, epochs[-1:]) if epochs else None


class KeyedTable:
    """A table merged by key, in hash buckets.  A batch rewrites the buckets
    that hold its keys and no others; a commit says which epoch's folder each
    bucket is in (at most ``buckets`` numbers)."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], buckets: int = 64):
        self.spark, self.keys, self.buckets = spark, keys, buckets
        self.store = EpochStore(spark, root)

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _places(self, below: int | None = None) -> tuple[dict[int, int], T.StructType | None]:
        epochs = self.store.committed(below)
        if not epochs:
            return {}, None
        commit = self.store.commit_of(epochs[-1])
        schema = T.StructType.fromJson(json.loads(commit["schemas"]["rows"]))
        return {int(b): e for b, e in commit["note"]["places"].items()}, T.StructType([f for f in schema if f.name != "_bucket"])

    def _read(self, places: dict[int, int], schema: T.StructType) -> DataFrame:
        paths = [f"{self.store.folder('rows', e)}/_bucket={b}" for b, e in places.items()]
        return self.spark.read.schema(schema).parquet(*paths)

    def merge(self, rows: DataFrame, epoch: int, replaced: DataFrame | None = None) -> list[int]:
        """``rows`` take the place of all rows with their keys, or with the
        keys in ``replaced``; returns the buckets that were rewritten."""
        replaced = (rows if replaced is None else replaced).select(*self.keys).distinct()
        touched = sorted(r["b"] for r in replaced.select(self._bucket().alias("b")).distinct().collect())
        places, schema = self._places(below=epoch)
        held = {b: places[b] for b in touched if b in places}
        new = rows
        if held:
            new = self._read(held, schema).join(replaced, self.keys, "left_anti").unionByName(rows)
        if touched:
            new = new.repartition(len(touched), self._bucket())

        def now_in() -> dict:  # buckets that lost their last row have no folder
            written = [int(n.split("=")[1]) for n in self.store.files.names(self.store.folder("rows", epoch)) if n.startswith("_bucket=")]
            return {"places": {b: e for b, e in places.items() if b not in touched} | {b: epoch for b in written}}

        fresh = self.store.publish(epoch, {"rows": new.withColumn("_bucket", self._bucket())}, now_in, "_bucket")
        return touched if fresh else []

    def read(self) -> DataFrame:
        places, schema = self._places()
        if schema is None:
            raise FileNotFoundError(f"no committed epoch under {self.store.root}")
        return self._read(places, schema) if places else self.spark.createDataFrame([], schema)
