"""A bounded sample of labelled training rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: Rows of each class a model is fitted on, at most.
FIT_PER_CLASS = 2_000


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int,
               per_class: int = FIT_PER_CLASS) -> tuple[DataFrame, dict[int, float]]:
    """(rows, weights): doc_id, y and text of up to ``per_class`` rows of each
    class, chosen by a hash of the id among rows that are not held out, and
    the weight that restores each class's share.  Null labels and ids drop out;
    of repeated labels of an id the larger counts, of repeated rows of an id
    the text with the smallest hash."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
             .where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
             .where(~held_out(F.col("doc_id"), modulus, remainder)))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in counts:
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        chosen = known
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = (text.join(F.broadcast(chosen), "doc_id")  # at most 2 * per_class ids
            .groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text")))
    return rows, {y: n / min(n, per_class) for y, n in counts.items()}
