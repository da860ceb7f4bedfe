"""Cross-tokenizer alignment over distinct texts.

The table is shuffled by its full texts, so that each distinct text is
tokenised by both vocabularies and aligned once, with the number of its
copies.  Two tokens are linked where they end at the same byte; ends that
both sides share cut the text into groups.  Linked tokens end alike, so the
bytes of one are a suffix of the other's: the pairs that can occur at all
follow from the two vocabularies (a few hundred thousand), and everything
that is gathered or sent about pairs is an array over them.  Pair counts are
weighted by copies; the measures of a text are joined back to the ids of its
documents by the SHA-256 of the text.

Defined cases: null or empty text, and text that either vocabulary does not
give back byte by byte, has no tokens: zeros and an empty digest, and counts
for nothing; a null id stays null; repeated rows count each; an empty table
gives an empty result; other columns are not read.  Texts are tokenised whole,
so a task holds the tokens of one whole text at least.
"""

from __future__ import annotations

import hashlib
import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, file_bytes, materialise, prepare, runs, slices, worker_state
from .rank_merge import byte_alphabet

#: Characters of texts that are tokenised and aligned together.
TOGETHER = 400_000
#: Pre-tokens of the first vocabulary that a worker remembers, in each of two generations.
MEMO_WORDS = 150_000


def entry_bytes(raw: bytes) -> list[bytes]:
    """Bytes of each entry of a byte-level vocabulary file, by id."""
    from tokenizers import Tokenizer
    vocab = Tokenizer.from_str(raw.decode()).get_vocab(with_added_tokens=True)
    byte = {c: b for b, c in enumerate(byte_alphabet())}
    out = [b""] * (max(vocab.values()) + 1)
    for entry, k in vocab.items():
        out[k] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
    return out


def piece_bytes(raw: bytes) -> list[bytes]:
    """Bytes of each piece of a sentence-piece model, by id."""
    from sentencepiece import SentencePieceProcessor
    model = SentencePieceProcessor(model_proto=raw)
    return [bytes([int(piece[3:5], 16)]) if model.is_byte(k) else piece.replace("▁", " ").encode()
            for k, piece in enumerate(map(model.id_to_piece, range(model.get_piece_size())))]


def possible_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Sorted keys a << 32 | b of all ids of which one is a suffix of the other."""
    def ids_of(entries):
        out: dict[bytes, list[int]] = {}
        for k, e in enumerate(entries):
            out.setdefault(e, []).append(k)
        return out

    of_a, of_b = ids_of(a), ids_of(b)
    keys = {(x << 32) | k for k, e in enumerate(b) for at in range(len(e)) for x in of_a.get(e[at:], ())}
    keys.update((k << 32) | y for k, e in enumerate(a) for at in range(len(e)) for y in of_b.get(e[at:], ()))
    return np.array(sorted(keys), np.int64)


class Aligner:
    def __init__(self, raw_a: bytes, raw_b: bytes, pattern: str):
        import regex
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        spec = json.loads(raw_a)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("the first vocabulary must be plain byte-level BPE")
        self.model, self.words = Tokenizer.from_str(raw_a.decode()).model, regex.compile(pattern)
        self.second = SentencePieceProcessor(model_proto=raw_b)
        self.alphabet = {b: c for b, c in enumerate(byte_alphabet())}
        self.bytes_a, self.bytes_b = entry_bytes(raw_a), piece_bytes(raw_b)
        self.size_a, self.size_b = (np.array([len(e) for e in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.pairs = possible_pairs(self.bytes_a, self.bytes_b)
        self.memo = Memo(self.word_ids, MEMO_WORDS)
        # an id in decimal and what follows it, within a group and at its end
        self.names = [f"{k}{c}" for k in range(len(self.bytes_a)) for c in ",|"] + [f"{k}{c}" for k in range(len(self.bytes_b)) for c in ",;"]

    def word_ids(self, words: list[str]) -> list[bytes]:
        """Packed ids of pre-tokens by the library's model; none where they do
        not give the pre-token back."""
        out = []
        for w in words:
            data = w.encode("utf-8", "surrogatepass")
            ids = [t.id for t in self.model.tokenize(data.decode("latin-1").translate(self.alphabet))]
            out.append(struct.pack(f"<{len(ids)}I", *ids) if b"".join([self.bytes_a[i] for i in ids]) == data else b"")
        return out

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides; none where either does not give the text back."""
        found = [self.words.findall(" " + t) for t in texts]
        known = self.memo.over([w for f in found for w in f])
        first = [np.frombuffer(b"".join(map(known.__getitem__, f)), np.uint32) for f in found]
        second = self.second.encode(texts, num_threads=1)
        for k, t in enumerate(texts):
            data = (" " + t).encode("utf-8", "surrogatepass")
            if not t or self.size_a[first[k]].sum() != len(data) or b"".join(map(self.bytes_b.__getitem__, second[k])) != data:
                first[k], second[k] = np.zeros(0, np.uint32), []
        return first, [np.array(ids, np.uint32) for ids in second]

    def align(self, texts: list[str]) -> list[tuple]:
        """Per text: n_a, n_b, n_groups, groups digest, and its linked pairs
        as places in ``pairs`` with their numbers of occurrences."""
        first, second = self.encode(texts)
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(texts)) for ids in (first, second))
        a, b = (np.concatenate(side).astype(np.int64) for side in (first, second))
        # both sides of a text have the same bytes, so ends run on alike
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        shared, at_a, at_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
        linked, which = np.unique((a[at_a] << 32) | b[at_b], return_inverse=True)
        place = np.searchsorted(self.pairs, linked).astype(np.uint32)[which]

        # order of the digest: a group's tokens of the one side, then of the other
        group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        order = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[at_a] = last_b[at_b] = 1
        order[np.arange(len(a)) + np.r_[0, at_b + 1][group_a]] = 2 * a + last_a
        order[np.arange(len(b)) + (at_a + 1)[group_b]] = 2 * (b + len(self.bytes_a)) + last_b

        cut_a, cut_b = np.r_[0, np.cumsum(n_a)], np.r_[0, np.cumsum(n_b)]
        cut = np.searchsorted(at_a, cut_a)
        out = []
        for k in range(len(texts)):
            if not n_a[k]:
                out.append((0, 0, 0, "", place[:0], place[:0]))
                continue
            names = "".join(map(self.names.__getitem__, order[cut_a[k] + cut_b[k]:cut_a[k + 1] + cut_b[k + 1]].tolist()))
            held, times = np.unique(place[cut[k]:cut[k + 1]], return_counts=True)
            out.append((int(n_a[k]), int(n_b[k]), int(cut[k + 1] - cut[k]), hashlib.sha256(names[:-1].encode()).hexdigest(),
                        held, times.astype(np.uint32)))
        return out


def _key(text):
    return F.unhex(F.sha2(text.cast("binary"), 256))


def align_texts(docs: DataFrame, raw_a: bytes, raw_b: bytes, pattern: str) -> DataFrame:
    """One row per distinct text: key (SHA-256), copies, n_a, n_b, n_groups,
    n_links, groups_sha256, and its pairs with their numbers (packed uint32)."""
    texts = docs.where("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    rows = texts.select(_key(F.col("text")).alias("key"), "copies", "text")
    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("copies", T.LongType()),
                           *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")],
                           T.StructField("groups_sha256", T.StringType()),
                           T.StructField("pairs", T.BinaryType()), T.StructField("times", T.BinaryType())])

    def run(batches):
        aligner = worker_state(("token_align", hash(raw_a), hash(raw_b)), lambda: Aligner(raw_a, raw_b, pattern))
        for batch in slices(batches):
            made = [m for part in runs(enumerate(batch.column("text").to_pylist()), TOGETHER) for m in aligner.align([t for _, t in part])]
            n_a, n_b, groups, digest, held, times = zip(*made) if made else ((),) * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("copies"), *[pa.array(c, pa.int64()) for c in (n_a, n_b, groups)],
                 pa.array([int(t.sum()) for t in times], pa.int64()), pa.array(digest, pa.string()),
                 pa.array([h.tobytes() for h in held], pa.binary()), pa.array([t.tobytes() for t in times], pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame, n_pairs: int) -> DataFrame:
    """(place, n): links of the corpus that hold the pair linked; each task
    adds up its texts in one array over the possible pairs first."""
    def run(batches):
        total = np.zeros(n_pairs, np.int64)
        for batch in batches:
            for copies, held, times in zip(*(batch.column(c).to_pylist() for c in ("copies", "pairs", "times"))):
                total[np.frombuffer(held, np.uint32)] += copies * np.frombuffer(times, np.uint32).astype(np.int64)
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(total[place], pa.int64())], names=["place", "n"])

    return aligned.select("copies", "pairs", "times").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))


def highest_of_second(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether a pair's count is the highest of its second id, ties included."""
    second = pairs & 0xFFFFFFFF
    top = np.zeros(int(second.max(initial=0)) + 1, np.int64)
    np.maximum.at(top, second, counts)
    return (counts == top[second]) & (counts > 0)


def align_documents(docs: DataFrame, path_a: str, path_b: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs).  documents, per row: doc_id, n_a, n_b, n_groups,
    n_links, n_best, count_sum, groups_sha256.  pairs: id_a, id_b, n."""
    spark = prepare(docs)
    raw_a, raw_b = file_bytes(path_a), file_bytes(path_b)
    keys = possible_pairs(entry_bytes(raw_a), piece_bytes(raw_b))
    aligned = materialise(align_texts(docs, raw_a, raw_b, pattern), "aligned")
    counts = np.zeros(len(keys), np.int64)
    counted = materialise(pair_counts(aligned, len(keys)), "pair-counts")
    for batch in counted.toArrow().to_batches():  # at most one row per possible pair
        counts[batch.column("place").to_numpy()] = batch.column("n").to_numpy()
    tables = spark.sparkContext.broadcast((counts, highest_of_second(keys, counts)))  # 9 bytes per possible pair

    schema = T.StructType([*[f for f in aligned.schema if f.name not in ("copies", "pairs", "times")],
                           T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def run(batches):
        n, best = tables.value
        for batch in batches:
            sums, bests = [], []
            for held, times in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist()):
                place, times = np.frombuffer(held, np.uint32), np.frombuffer(times, np.uint32).astype(np.int64)
                sums.append(int((n[place] * times).sum()))
                bests.append(int(times[best[place]].sum()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in schema.names[:-2]], pa.array(bests, pa.int64()),
                                              pa.array(sums, pa.int64())], names=schema.names)

    measures = aligned.drop("copies").mapInArrow(run, schema)
    rows = docs.select("doc_id", F.when(F.col("text") != "", _key(F.col("text"))).alias("key"))
    none = {c: 0 for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")} | {"groups_sha256": ""}
    out = rows.join(measures, "key", "left").select("doc_id", *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in none.items()])
    names = spark.createDataFrame(pa.table({"place": np.arange(len(keys)), "id_a": keys >> 32, "id_b": keys & 0xFFFFFFFF}))
    return out, counted.join(names, "place").select("id_a", "id_b", "n")
