"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.session import checkpoint_dir, ship_package

MEMO_ENTRIES = 75_000
CHUNK_CHARS = 2_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Cut the lineage with a written table in the shared folder."""
    path = scratch(df.sparkSession, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prepare(df: DataFrame) -> SparkSession:
    """The session of ``df``, ready to run this package's Python functions."""
    ship_package()
    return df.sparkSession


def file_bytes(path: str) -> bytes:
    """A vocabulary file, read where the job is built (a few MB at most) so
    that executors need no copy of it."""
    with open(path, "rb") as f:
        return f.read()


def held_out(doc_id, modulus: int, remainder: int):
    """crc32 of the id as text, mod ``modulus``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def worker_state(key, build):
    """``build()`` once per Python worker process.  Functions of this package
    travel by value, so their globals do not outlive a task; this does.  A
    worker keeps the last state only, so that memory is that of one operator."""
    home = sys.modules.setdefault("_rivulet_worker_state", types.ModuleType("_rivulet_worker_state"))
    if getattr(home, "key", None) != key:
        home.key = home.state = None
        # give the memory back before more is taken, also what operators without a state left behind
        gc.collect()
        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)
        home.state = build()
        home.key = key
    return home.state


class Memo:
    """Values of repeated small keys, in two generations of bounded size."""

    def __init__(self, compute, entries: int = MEMO_ENTRIES):
        self.compute, self.entries = compute, entries
        self.young: dict = {}
        self.old: dict = {}

    def over(self, keys) -> dict:
        """A dict holding at least all of ``keys``."""
        if len(self.young) > self.entries:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = []
        for k in set(keys).difference(young):
            v = old.get(k)
            if v is None:
                missing.append(k)
            else:
                young[k] = v
        if missing:
            young.update(zip(missing, self.compute(missing)))
        return young


def slices(batches, rows: int = 512):
    """Arrow batches in pieces of few rows, so that Python objects of only
    some texts exist at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def runs(pairs, size: int = CHUNK_CHARS):
    """Lists of consecutive (key, text) pairs of about ``size`` characters."""
    out, n = [], 0
    for k, t in pairs:
        out.append((k, t))
        n += len(t)
        if n >= size:
            yield out
            out, n = [], 0
    if out:
        yield out
