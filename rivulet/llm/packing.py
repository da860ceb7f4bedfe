"""Best-fit-decreasing packing of tokenised documents into sequences.

Pieces of equal length are interchangeable, so the exact best-fit-decreasing
plan follows from how many pieces there are of each length (at most
``capacity`` numbers).  A segment tree over remaining capacities finds the
tightest open bin for a length in logarithmic time; equal bins are kept as
ranges of bin numbers.  Every range is refilled at most log2(capacity) times
and a length splits at most two ranges, so the plan has a bounded number of
rows whatever the input size.  Pieces are numbered within their length by
counts per partition (no length meets in one task) and look up their place.

Defined cases: null text counts as empty; an empty document is its end id
alone; only documents over ``capacity`` are cut; repeated rows are packed
each; a null id stays null; an empty table gives an empty result.
"""

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, file_bytes, materialise, prepare, worker_state
from .rank_merge import byte_alphabet

#: White space beyond ASCII, and separators that only some splitters take for it.
NOT_SPACE = "[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


#: A plain word: Latin letters, perhaps with one mark after them.
PLAIN = "^[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+[.,;:!?|]?$"
MARKS = ".,;:!?|"

#: Characters of a key that a memo keeps, and rows of an Arrow batch on both
#: sides of a Python worker (a row is a whole text).
MEMO_KEY, BATCH_ROWS = 256, 1_000

#: Rows and bytes of text whose words are looked up together.
GROUP_ROWS, GROUP_BYTES = 4_000, 12_000_000

#: Stems that a worker remembers: it costs time, not results, to remember
#: fewer of them.
REMEMBERED = 400_000


class ShortMemo(Memo):
    """A memo that holds long keys until its next call only."""

    def __init__(self, compute, entries: int):
        super().__init__(compute, entries)
        self.passing: list[str] = []

    def over(self, keys) -> dict:
        for k in self.passing:
            self.young.pop(k, None)
            self.old.pop(k, None)
        keys = set(keys)
        self.passing = [k for k in keys if len(k) > MEMO_KEY]
        return super().over(keys)


class WordIds:
    """Ids of whole texts by the ``tokenizers`` library.  Its pattern drops
    white space and no token spans it, so repeated words are encoded once."""

    def __init__(self, raw: bytes, remembered: int):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(raw.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.alphabet = byte_alphabet()
        self.memo = ShortMemo(self.encode, remembered)
        self.marks = np.zeros(256, np.int64)  # 0: no mark, else its place in MARKS from 1
        self.marks[list(MARKS.encode())] = np.arange(1, len(MARKS) + 1)
        self.mark_ids = self.encode(list(MARKS))

    def stems(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Words without their mark, and the number of the mark.  Case is
        ignored and letters never join with a mark after them, so plain words
        are looked up in lower case without it, others as they are."""
        plain = pc.match_substring_regex(words, PLAIN)
        ends, data = np.frombuffer(words.buffers()[1], np.int32)[words.offset + 1:words.offset + len(words) + 1], words.buffers()[2]
        last = np.frombuffer(data, np.uint8)[np.maximum(ends, 1) - 1] if data else np.zeros(len(words), np.uint8)
        mark = np.where(plain.to_numpy(zero_copy_only=False), self.marks[last], 0)
        whole = pc.binary_slice(words.cast(pa.binary()), 0, -1).cast(pa.string(), safe=False)
        cut = pc.if_else(pa.array(mark > 0), whole, words)
        return pc.if_else(plain, pc.utf8_lower(cut), cut), mark

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids of words; a run of lower-case Latin letters is one pre-token
        and goes to the library's model at once."""
        out: list = [None] * len(words)
        rest, tokenize, alphabet = [], self.tokenizer.model.tokenize, self.alphabet
        for k, w in enumerate(words):
            if w.isalpha() and w.islower() and (w.isascii() or max(w) <= "\xff"):
                name = w if w.isascii() else "".join([alphabet[b] for b in w.encode()])
                ids = [t.id for t in tokenize(name)]
                out[k] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                rest.append(k)
        for at in range(0, len(rest), 20_000):
            part = rest[at:at + 20_000]
            found = self.tokenizer.encode([words[k] for k in part], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(found.ids, np.uint32)
            cuts = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(part) + 1)) * 4
            data = ids.tobytes()
            for k, a, b in zip(part, cuts[:-1].tolist(), cuts[1:].tolist()):
                out[k] = data[a:b]
        return out

    def __call__(self, text: str) -> bytes:
        """Ids of a text that holds white space which only the library splits alike."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def many(self, texts: pa.Array) -> list[bytes]:
        """Packed ids of texts: distinct stems are encoded, then gathered."""
        odd = pc.match_substring_regex(texts, NOT_SPACE)
        split = pc.ascii_split_whitespace(pc.if_else(odd, "", texts))
        coded = split.flatten().dictionary_encode()
        stems, mark = self.stems(coded.dictionary)
        stems = stems.dictionary_encode()
        names = stems.dictionary.to_pylist()
        known = self.memo.over(s for s in names if s)
        pieces = [known[s] if s else b"" for s in names] + [b""] + self.mark_ids
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        # a word is its stem's ids, then its mark's
        parts = np.stack([stems.indices.to_numpy(), len(names) + mark], 1)
        data = gather(np.frombuffer(b"".join(pieces), np.uint32), (np.cumsum(size) - size)[parts.ravel()], size[parts.ravel()])
        size = size[parts].sum(1)
        first, at = np.cumsum(size) - size, coded.indices.to_numpy()
        offsets = split.offsets.to_numpy()
        offsets, out = offsets - offsets[0], []
        for a in range(0, len(texts), BATCH_ROWS):
            cuts = offsets[a:a + BATCH_ROWS + 1]
            some = at[cuts[0]:cuts[-1]]
            ids, ends = gather(data, first[some], size[some]), np.r_[0, np.cumsum(size[some])][cuts - cuts[0]].tolist()
            out += [ids[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:])]
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[k] = self(texts[k].as_py())
        return out


def gather(data: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs data[first:first + n], one after the other."""
    ends = np.cumsum(n)
    return data[np.repeat(first - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


def groups(batches, rows: int = GROUP_ROWS, size: int = GROUP_BYTES):
    """(doc_id, text) arrays of consecutive Arrow batches, joined up to about
    ``rows`` rows or ``size`` bytes: a word that returns is looked up once."""
    held, n, used = [], 0, 0
    for batch in batches:
        held.append(batch)
        n, used = n + len(batch), used + batch.nbytes
        if n >= rows or used >= size:
            yield [pa.concat_arrays([b.column(c) for b in held]) for c in ("doc_id", "text")]
            held, n, used = [], 0, 0
    if n:
        yield [pa.concat_arrays([b.column(c) for b in held]) for c in ("doc_id", "text")]


def token_pieces(docs: DataFrame, vocab_path: str, capacity: int = 4096, end_id: int = 1, remembered: int = REMEMBERED) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (packed uint32),
    ids_crc32, and its number among equal lengths in its partition."""
    prepare(docs).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    raw = file_bytes(vocab_path)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                           T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
                           T.StructField("ids_crc32", T.LongType()), T.StructField("part", T.IntegerType()),
                           T.StructField("nth", T.LongType())])
    end = np.array([end_id], np.uint32).tobytes()

    def run(batches):
        encode = worker_state(("packing", hash(raw), remembered), lambda: WordIds(raw, remembered))
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for doc_id, text in groups(batches):
            encoded = encode.many(text)
            for at in range(0, len(encoded), BATCH_ROWS):
                index, cols = [], [[] for _ in range(6)]
                for k, ids in enumerate(encoded[at:at + BATCH_ROWS], at):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[start:start + 4 * capacity]
                        n = len(cut) // 4
                        index.append(k)
                        for c, v in zip(cols, (piece, start // 4, n, cut, zlib.crc32(cut), int(seen[n]))):
                            c.append(v)
                        seen[n] += 1
                ids_of = doc_id.take(pa.array(index, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids_of, pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                     pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.int64()),
                     pa.array([part] * len(index), pa.int32()), pa.array(cols[5], pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


class CapacityTree:
    """Which remaining capacities have open bins; ``tightest(n)`` is the
    smallest one of at least n, in O(log capacity)."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.any = bytearray(2 * self.size)

    def set(self, capacity: int, is_open: bool):
        at = self.size + capacity
        self.any[at] = is_open
        while at > 1:
            at >>= 1
            self.any[at] = self.any[2 * at] | self.any[2 * at + 1]

    def tightest(self, n: int) -> int:
        at = self.size + n
        while not self.any[at]:
            while at & 1:  # right child: go up
                at >>= 1
                if at <= 1:
                    return -1
            at += 1
        while at < self.size:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.size


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first number, first bin, pieces per bin, offset): the
    pieces of a length from that number on fill bins from that one on.
    Longest first, each into the tightest open bin, a new one if none fits."""
    tree, open_bins = CapacityTree(capacity), [[] for _ in range(capacity + 1)]
    plan, bins = [], 0

    def keep(left: int, first: int, n: int):
        if n and left:
            open_bins[left].append((first, n))
            tree.set(left, True)

    for length in sorted((n for n in counts if counts[n] > 0), reverse=True):
        done, total = 0, counts[length]
        while done < total:
            left = tree.tightest(length)
            if left < 0:
                left = capacity
                first, n = bins, -(-(total - done) // (capacity // length))
                bins += n
            else:
                first, n = open_bins[left].pop()
                if not open_bins[left]:
                    tree.set(left, False)
            per_bin = left // length
            full = min(n, (total - done) // per_bin)
            if full:
                plan.append((length, done, first, per_bin, capacity - left))
                done += full * per_bin
                keep(left - per_bin * length, first, full)
            rest = total - done
            if full < n:
                if 0 < rest:
                    plan.append((length, done, first + full, per_bin, capacity - left))
                    done = total
                    keep(left - rest * length, first + full, 1)
                    full += 1
                keep(left, first + full, n - full)
    return plan


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Places the rows of ``token_pieces`` (a written table): adds
    sequence_id and offset.  Columns that are not selected later, such as
    ``ids``, are not read again."""
    spark = prepare(pieces)
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    plan = np.array(best_fit_plan(totals, capacity), np.int64).reshape(-1, 5)
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    shared = spark.sparkContext.broadcast(plan[order])  # bounded by the capacity, see above

    @F.pandas_udf("struct<sequence_id long, offset long>")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        plan = shared.value
        n, k = length.to_numpy(np.int64), number.to_numpy(np.int64)
        key = plan[:, 0] << 45 | plan[:, 1]
        row = plan[np.searchsorted(key, n << 45 | k, side="right") - 1]
        k = k - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 2] + k // row[:, 3], "offset": row[:, 4] + k % row[:, 3] * n})

    numbered = pieces.join(bases.select("part", "length", "base"), ["part", "length"])
    placed = numbered.withColumn("_place", place("length", F.col("base") + F.col("nth")))
    return placed.select("doc_id", "piece", "start", "length", "ids", "ids_crc32",
                         F.col("_place.sequence_id").alias("sequence_id"), F.col("_place.offset").alias("offset"))


def pack_documents(docs: DataFrame, vocab_path: str, capacity: int = 4096, end_id: int = 1, remembered: int = REMEMBERED) -> DataFrame:
    """Tokenise once into a written table, then place every piece."""
    return pack(materialise(token_pieces(docs, vocab_path, capacity, end_id, remembered), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, length, ids."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"),
                                              F.sum("length").alias("length"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return parts.select("sequence_id", "length", joined.alias("ids"))
