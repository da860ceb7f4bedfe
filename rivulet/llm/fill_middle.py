"""Fill-in-the-middle transformation by in-place block rotation.

A text's units are a word with the white space before it, or white space at
the end.  Two cuts, drawn from a hash of the document's id, part it in prefix,
middle and suffix.  The text is put in one byte buffer, a sentinel goes in
front of each part, and neighbouring parts exchange places by three reversals
within the buffer (a block of fixed size is all that is held beside it).
Restoring undoes the same rotations and takes the sentinels out; it reads the
output and its form only.

Defined cases: null text counts as empty; empty texts and texts that hold a
sentinel stay plain; a null id is hashed as an empty string and stays null;
repeated rows are transformed alike, each; texts of any length are read whole;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Percent of documents that are transformed, and of those that start with the suffix.
FIM_PERCENT, SPM_PERCENT = 50, 80
#: Bytes that a reversal holds outside the buffer.
BLOCK = 1 << 16

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def unit_ends(data: np.ndarray) -> np.ndarray:
    """Byte offsets where the units of a text end."""
    if not len(data):
        return np.zeros(0, np.int64)
    space = SPACE[data]
    return np.r_[np.flatnonzero(~space[:-1] & space[1:]) + 1, len(data)]


def reverse(view: np.ndarray, start: int, end: int) -> None:
    """Reverse view[start:end] in place, swapping blocks from both ends."""
    while end - start > 1:
        n = min(BLOCK, (end - start) // 2)
        left = view[start:start + n][::-1].copy()
        view[start:start + n] = view[end - n:end][::-1]
        view[end - n:end] = left
        start, end = start + n, end - n


def exchange(buffer: bytearray, start: int, cut: int, end: int) -> None:
    """Swap the neighbours buffer[start:cut] and buffer[cut:end] in place."""
    with memoryview(buffer) as held:
        view = np.frombuffer(held, np.uint8)
        reverse(view, start, cut)
        reverse(view, cut, end)
        reverse(view, start, end)
        del view


def rotate(text: bytes, first: int, second: int, form: str) -> bytearray:
    """The text cut at two byte offsets, as psm or spm."""
    buffer = bytearray(text)
    for at, sentinel in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):
        buffer[at:at] = sentinel
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    exchange(buffer, middle, suffix, len(buffer))      # prefix, suffix, middle
    if form == "spm":
        exchange(buffer, 0, middle, middle + len(buffer) - suffix)
    return buffer


def unrotate(output: bytes, form: str) -> bytearray:
    """The text that ``rotate`` was given."""
    buffer = bytearray(output)
    if form == "plain":
        return buffer
    middle = buffer.index(MIDDLE)
    if form == "spm":
        exchange(buffer, 0, buffer.index(PREFIX), middle)
    suffix = buffer.index(SUFFIX)
    exchange(buffer, suffix, middle, len(buffer))      # prefix, middle, suffix
    tail = suffix + len(buffer) - middle
    for at, sentinel in ((tail, SUFFIX), (suffix, MIDDLE), (0, PREFIX)):
        del buffer[at:at + len(sentinel)]
    return buffer


def characters(data: np.ndarray) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def draws(doc_id, seed: int = 42) -> list:
    """Four 32-bit numbers of a document's id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, seed: int = 42, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """Per row: doc_id, n (units), form, prefix_chars, middle_chars (null if
    plain) and output."""
    prepare(docs)
    h = [d.alias(f"h{k}") for k, d in enumerate(draws(F.col("doc_id"), seed))]
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), *h)
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
                           T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
                           T.StructField("output", T.BinaryType())])

    def one(text: bytes, h1: int, h2: int, h3: int, h4: int):
        data = np.frombuffer(text, np.uint8)
        ends = unit_ends(data)
        n = len(ends)
        if not n or h3 % 100 >= fim_percent or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
            return n, "plain", None, None, text
        first, second = (int(ends[u - 1]) if u else 0 for u in sorted((h1 % (n + 1), h2 % (n + 1))))
        form = "spm" if h4 % 100 < spm_percent else "psm"
        return n, form, characters(data[:first]), characters(data[first:second]), bytes(rotate(text, first, second, form))

    def run(batches):
        for batch in slices(batches):
            made = [one(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("text", "h0", "h1", "h2", "h3")))]
            n, form, prefix, middle, output = zip(*made) if made else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                 pa.array(middle, pa.int64()), pa.array(output, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema).withColumn("output", F.col("output").cast("string"))


def restore(rows: DataFrame) -> DataFrame:
    """All columns of ``rows`` (form and output among them) and ``restored``,
    the text before the transformation.  Null output stays null."""
    prepare(rows)
    kept = [c for c in rows.columns if c != "restored"]
    given = rows.select(F.struct(*kept).alias("row"), F.coalesce("form", F.lit("plain")).alias("form"),
                        F.col("output").cast("binary").alias("output"))
    schema = T.StructType([given.schema["row"], T.StructField("restored", T.BinaryType())])

    def run(batches):
        for batch in slices(batches):
            back = [None if o is None else bytes(unrotate(o, f))
                    for f, o in zip(batch.column("form").to_pylist(), batch.column("output").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(back, pa.binary())], names=schema.names)

    return given.mapInArrow(run, schema).select("row.*", F.col("restored").cast("string").alias("restored"))
