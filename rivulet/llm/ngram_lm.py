"""Language-model scores from a sharded Elias-Fano n-gram trie.

The model interpolates: p(w | u) = c(u w) / (c(u) + K) + K / (c(u) + K) p(w)
with p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)).  The trie's levels are the
vocabulary (counts) and, per context, its successors with the first term as
one quantised byte (about 0.02 in log10).

Nothing of the corpus's size meets in one place.  Documents are tokenised
once into a written table of blocks (local word numbers).  Blocks send their
distinct words to vocabulary shards by hash and get dense word ids and counts
back; they send their distinct word pairs with training counts to trie shards
by context (a hot context is spread over all shards by successor), which
merge them, build their part of the trie and answer with codes.  The number
of shards follows the number of tokens.

Defined cases: null text counts as empty (its end token alone); a null id is
never held out; repeated rows count and are scored each; without training
tokens every token has probability 1; an empty table gives an empty result;
a document longer than a block is a block of its own; other columns are not
read.
"""

import re
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, held_out, materialise, prepare, worker_state
from .elias_fano import TrieLevel

BLOCK_TOKENS = 2_000_000
SHARD_TOKENS = 2_000_000
#: K: weight of the unigram distribution, in counts.
PRIOR = 8.0
#: Of a code, in log10.
STEP = 0.04
ADD = 0.1
U32, U64 = np.uint32, np.uint64
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def squeeze(a: np.ndarray, rising: bool = False) -> bytes:
    """Bytes of an unsigned array: deltas if sorted, byte planes, zstd."""
    if rising and len(a):
        a = np.concatenate([a[:1], a[1:] - a[:-1]])
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T)
    return len(a).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def expand(data: bytes, kind, rising: bool = False) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    raw = pa.Codec("zstd").decompress(data[8:], n * size, asbytes=True)
    a = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel()
    return np.cumsum(a, dtype=kind) if rising else a


class Words:
    def __init__(self):
        import xxhash
        self.end = U64(xxhash.xxh64_intdigest(b" "))  # no word holds a space
        self.memo = Memo(lambda words: [xxhash.xxh64_intdigest(w) for w in words])

    def __call__(self, text: str) -> np.ndarray:
        """Hashes of the text's words, then the end."""
        data = text.encode("utf-8", "surrogatepass").lower()
        if len(data) < 1_000_000:
            words = data.split()
            return np.append(np.fromiter(map(self.memo.over(words).__getitem__, words), U64, len(words)), self.end)
        out, found = [], (m.group() for m in WORD.finditer(data))
        while part := list(islice(found, 100_000)):
            out.append(np.fromiter(map(self.memo.over(part).__getitem__, part), U64, len(part)))
        return np.concatenate([*out, np.array([self.end])])


BLOCK = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType())),
                      T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("sizes", T.ArrayType(T.IntegerType())),
                      T.StructField("toks", T.BinaryType()), T.StructField("words", T.BinaryType()),
                      T.StructField("train", T.BinaryType()), T.StructField("n_train", T.LongType()),
                      T.StructField("n", T.LongType())])


def token_blocks(docs: DataFrame, modulus: int, remainder: int) -> DataFrame:
    """Documents as blocks: ids, sizes and numbers into the block's sorted
    distinct word hashes, with the words' counts in training documents."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), modulus, remainder).alias("held"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches):
        hashes = worker_state("lm-words", Words)
        part, serial = TaskContext.get().partitionId(), 0
        ids, held, found, size = [], [], [], 0

        def block():
            flat = np.concatenate(found)
            sizes = np.array([len(f) for f in found])
            words, toks = np.unique(flat, return_inverse=True)
            train = ~np.repeat(np.array(held), sizes)
            counts = np.bincount(toks[train], minlength=len(words)).astype(U32)
            values = [[part << 32 | serial], [ids], [held], [sizes.tolist()], [squeeze(toks.astype(U32))],
                      [squeeze(words, True)], [squeeze(counts)], [int(train.sum())], [len(flat)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (
                pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(),
                pa.binary(), pa.int64(), pa.int64()))], names=BLOCK.names)

        for batch in batches:
            for i, h, t in zip(batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(), batch.column("text").to_pylist()):
                w = hashes(t)
                if size and size + len(w) > BLOCK_TOKENS:
                    yield block()
                    serial += 1
                    ids, held, found, size = [], [], [], 0
                ids.append(i)
                held.append(h)
                found.append(w)
                size += len(w)
        if size:
            yield block()

    return rows.mapInArrow(run, BLOCK)


def _word_messages(blocks: DataFrame, shards: int) -> DataFrame:
    def run(frames):
        for f in frames:
            for block, words, train in zip(f["block"], f["words"], f["train"]):
                w, c = expand(words, U64, True), expand(train, U32)
                home = (w % U64(shards)).astype(np.int64)
                yield pd.DataFrame([(s, block, squeeze(w[home == s], True), squeeze(c[home == s])) for s in np.unique(home).tolist()],
                                   columns=["shard", "block", "words", "train"])

    return blocks.select("block", "words", "train").mapInPandas(run, "shard long, block long, words binary, train binary")


#: One table of all that is sent back: word answers (ids, counts) and code
#: answers to blocks; with a null block the shard's own output.
ANSWER = "shard long, block long, ids binary, counts binary, codes binary, model binary, distinct long, hot array<struct<id:long,n:long>>"


def _rows(values) -> pd.DataFrame:
    return pd.DataFrame(values, columns=["shard", "block", "ids", "counts", "codes", "model", "distinct", "hot"]).astype({"block": "Int64", "distinct": "Int64"})


def vocabulary(blocks: DataFrame, shards: int, hot_from: float) -> DataFrame:
    """Level 1: dense ids (rank * shards + shard) and training counts."""
    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        words = [expand(w, U64, True) for w in f["words"]]
        every = np.unique(np.concatenate(words))
        total = np.zeros(len(every), np.int64)
        for w, c in zip(words, f["train"]):
            total[np.searchsorted(every, w)] += expand(c, U32)
        known = total > 0
        rank = np.cumsum(known) - 1
        ids = np.where(known, rank * shards + shard, 0)
        if len(ids) and ids.max() >= 1 << 32:
            raise ValueError("more than 2**32 words")
        out = []
        for block, w in zip(f["block"], words):
            at = np.searchsorted(every, w)
            # unknown words repeat the id before them, so that ids rise; their count is 0
            out.append((shard, block, squeeze(np.maximum(rank[at], 0).astype(U32), True), squeeze(total[at].astype(U64)), None, None, None, None))
        hot = np.flatnonzero(total > hot_from)
        out.append((shard, None, None, None, None, squeeze(total[known].astype(U64)), int(known.sum()),
                    [{"id": int(ids[h]), "n": int(total[h])} for h in hot]))
        return _rows(out)

    return _word_messages(blocks, shards).groupBy("shard").applyInPandas(run, ANSWER)


class Block:
    """A block with its words' ids and counts: known pairs and their homes."""

    def __init__(self, row, answers: pd.DataFrame, shards: int, hot: np.ndarray):
        words = expand(row["words"], U64, True)
        self.ids, self.counts = np.zeros(len(words), U64), np.zeros(len(words), np.int64)
        home = (words % U64(shards)).astype(np.int64)
        for s, ids, counts in zip(answers["shard"], answers["ids"], answers["counts"]):
            mine = home == s
            self.ids[mine] = expand(ids, U32, True).astype(U64) * U64(shards) + U64(s)
            self.counts[mine] = expand(counts, U64).astype(np.int64)
        self.toks = expand(row["toks"], U32)
        self.sizes = np.array(row["sizes"], np.int64)
        self.starts = np.r_[0, np.cumsum(self.sizes)[:-1]]
        before = np.empty_like(self.toks)
        before[1:] = self.toks[:-1]
        before[self.starts] = self.toks[-1]  # every document ends with the end: it also stands before the first word
        self.before = before
        known = self.counts > 0
        self.paired = known[self.toks] & known[before]
        context, word = self.ids[before[self.paired]], self.ids[self.toks[self.paired]]
        self.pairs, self.which = np.unique(context << U64(32) | word, return_inverse=True)
        context, word = self.pairs >> U64(32), self.pairs & U64(0xFFFFFFFF)
        spread = np.isin(context, hot)
        self.home = np.where(spread, (context + word * U64(0x9E3779B1)) % U64(shards), context % U64(shards)).astype(np.int64)


def _pair_messages(blocks: DataFrame, answers: DataFrame, shards: int, hot: np.ndarray) -> DataFrame:
    def run(key: tuple, rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        row = rows.iloc[0]
        b = Block(row, got, shards, hot)
        train = ~np.repeat(np.array(row["held"], bool), b.sizes)[b.paired]
        counts = np.bincount(b.which[train], minlength=len(b.pairs)).astype(U32)
        return pd.DataFrame([(s, row["block"], squeeze(b.pairs[b.home == s], True), squeeze(counts[b.home == s]))
                             for s in np.unique(b.home).tolist()], columns=["shard", "block", "pairs", "counts"])

    left = blocks.select("block", "held", "sizes", "toks", "words").groupBy("block")
    right = answers.where("block is not null").select(F.col("block").alias("to"), "shard", "ids", "counts").groupBy("to")
    return left.cogroup(right).applyInPandas(run, "shard long, block long, pairs binary, counts binary")


def successors(messages: DataFrame, hot: dict[int, int]) -> DataFrame:
    """Level 2: each shard's part of the trie, and codes for what was asked."""
    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        asked = [expand(p, U64, True) for p in f["pairs"]]
        every = np.unique(np.concatenate(asked))
        total = np.zeros(len(every), np.int64)
        for p, c in zip(asked, f["counts"]):
            total[np.searchsorted(every, p)] += expand(c, U32)
        pairs, n = every[total > 0], total[total > 0]
        context, word = pairs >> U64(32), pairs & U64(0xFFFFFFFF)
        own, first = np.unique(context, return_index=True)
        sums = np.add.reduceat(n, first) if len(n) else n
        for k in np.flatnonzero(np.isin(own, np.fromiter(hot, U64, len(hot)))).tolist():
            sums[k] = hot[int(own[k])]  # its successors are spread over all shards
        share = n / (np.repeat(sums, np.diff(np.r_[first, len(n)])) + PRIOR)
        codes = np.clip(1 + np.rint(-np.log10(share) / STEP), 1, 255).astype(np.uint8)
        data = TrieLevel.build(context, word, codes).dump()
        level = TrieLevel.mapped(data)
        found = np.concatenate([level.lookup(every[at:at + 500_000] >> U64(32), every[at:at + 500_000] & U64(0xFFFFFFFF))
                                for at in range(0, max(1, len(every)), 500_000)])
        out = [(int(key[0]), block, None, None, squeeze(found[np.searchsorted(every, p)]), None, None, None)
               for block, p in zip(f["block"], asked)]
        out.append((int(key[0]), None, None, None, None, data, len(pairs), None))
        return _rows(out)

    return messages.groupBy("shard").applyInPandas(run, ANSWER)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(blocks: DataFrame, answers: DataFrame, codes: DataFrame, shards: int, hot: np.ndarray, n_train: int, n_words: int) -> DataFrame:
    def run(key: tuple, rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        row = rows.iloc[0]
        b = Block(row, got[got["ids"].notna()], shards, hot)
        code = np.zeros(len(b.pairs), np.uint8)
        coded = got[got["codes"].notna()]
        for s, c in zip(coded["shard"], coded["codes"]):
            code[b.home == s] = expand(c, np.uint8)
        c_word, c_context = b.counts[b.toks], b.counts[b.before]
        p = (c_word + ADD) / (n_train + ADD * (n_words + 1))
        seen = np.zeros(len(b.toks))
        mine = code[b.which].astype(np.float64)
        seen[b.paired] = np.where(mine > 0, 10.0 ** (-(mine - 1) * STEP), 0)
        score = np.log10(seen + PRIOR / (c_context + PRIOR) * p)
        return pd.DataFrame({"doc_id": pd.array(row["ids"], dtype="Int64") if any(i is None for i in row["ids"]) else row["ids"],
                             "held_out": row["held"], "n_tokens": b.sizes,
                             "n_known": np.add.reduceat((c_word > 0).astype(np.int64), b.starts), "train_tokens": n_train,
                             "base_score": np.add.reduceat(np.log10(p), b.starts), "score": np.add.reduceat(score, b.starts)})

    back = (answers.select("block", "shard", "ids", "counts", "codes").unionByName(codes.select("block", "shard", "ids", "counts", "codes"))
            .where("block is not null").withColumnRenamed("block", "to"))
    left = blocks.select("block", "ids", "held", "sizes", "toks", "words").groupBy("block")
    return left.cogroup(back.groupBy("to")).applyInPandas(run, SCORES)


def train_and_score(docs: DataFrame, modulus: int = 10, remainder: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """(scores, model): scores per document, learned from the rows that are
    not held out; the model's shards as a table (shard, level, data)."""
    spark = prepare(docs)
    blocks = materialise(token_blocks(docs, modulus, remainder), "lm-blocks")
    sizes = blocks.agg(F.sum("n").alias("n"), F.sum("n_train").alias("t")).first()
    if not sizes["n"]:
        return spark.createDataFrame([], SCORES), None
    n_train = sizes["t"]
    shards = -(-sizes["n"] // SHARD_TOKENS)
    answers = materialise(vocabulary(blocks, shards, n_train / (4 * shards)), "lm-vocabulary")
    own = answers.where("block is null")
    n_words = own.agg(F.sum("distinct")).first()[0]
    # words with over 1 / (4 shards) of the tokens: at most 4 * shards of them
    hot = {r["id"]: r["n"] for r in own.select(F.explode("hot").alias("h")).select("h.*").collect()}
    hot_ids = np.array(sorted(hot), U64)
    codes = materialise(successors(_pair_messages(blocks, answers, shards, hot_ids), hot), "lm-successors")
    model = (own.select("shard", F.lit(1).alias("level"), F.col("model").alias("data"))
             .unionByName(codes.where("block is null").select("shard", F.lit(2).alias("level"), F.col("model").alias("data"))))
    return _scores(blocks, answers, codes, shards, hot_ids, n_train, n_words), model
