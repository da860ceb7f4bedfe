"""Token counts by rank-synchronous merging.

Pre-tokens of a batch are held as one flat numpy array of symbols with
sequence boundaries.  Each round finds every sequence's lowest-ranked adjacent
pair and merges it in all sequences at once; a sequence with no mergeable
pair leaves the batch, and its surviving symbols are its tokens.

Defined cases: null or empty text counts 0 bytes and 0 tokens; repeated rows
are counted each; a null id stays null; texts of any length are read whole
(a long one in pieces of pre-tokens); an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import json
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, file_bytes, prepare, runs, worker_state

NONE = np.int32(2**31 - 1)


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class PairTable:
    """Vectorised (left, right) -> merge number, by two hash levels without
    collisions; ids are below 2**16 per side packed in 64 bits."""

    def __init__(self, left, right, bits: int = 20):
        keys = (np.asarray(left, np.uint64) << np.uint64(32)) | np.asarray(right, np.uint64)
        self.shift = np.uint64(64 - bits)
        rest, values = keys, np.arange(len(keys), dtype=np.int32)
        self.levels = []
        rng = np.random.default_rng(1)
        while len(rest):
            mult = np.uint64(rng.integers(1, 2**63) | 1)
            at = (rest * mult) >> self.shift
            table = np.full(1 << bits, np.uint64(2**64 - 1))
            rank = np.full(1 << bits, NONE, np.int32)
            _, first = np.unique(at, return_index=True)
            table[at[first]], rank[at[first]] = rest[first], values[first]
            self.levels.append((mult, table, rank))
            left_over = np.ones(len(rest), bool)
            left_over[first] = False
            rest, values = rest[left_over], values[left_over]

    def __call__(self, left, right):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        out = np.full(len(keys), NONE, np.int32)
        for mult, table, rank in self.levels:
            at = (keys * mult) >> self.shift
            hit = table[at] == keys
            out[hit] = rank[at[hit]]
        return out


class RankMerger:
    """Byte-pair merges of a tokenizer file of the ``tokenizers`` library."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix",
                                               "byte_fallback", "ignore_merges"))
        if not plain or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only plain byte-level BPE files are supported")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that absorb their surroundings are not supported")
        self.specials = [t["content"] for t in spec["added_tokens"]]
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs])
        right = np.array([vocab[b] for _, b in pairs])
        self.product = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.first = np.array([vocab[c] for c in byte_alphabet()], np.int32)
        self.pairs = PairTable(left, right)
        # merging all occurrences at once equals one at a time if no pair
        # holding a merge's product ranks before that merge
        born: dict[int, int] = {}
        for r, p in enumerate(self.product.tolist()):
            born.setdefault(p, r)
        self.together = all(born.get(x, -1) < r for r, ab in enumerate(zip(left.tolist(), right.tolist())) for x in ab) \
            and len(born) == len(self.product)

    def counts(self, tokens: list[str]) -> list[int]:
        """Surviving symbols of each pre-token."""
        data = [t.encode("utf-8", "surrogatepass") for t in tokens]
        size = np.fromiter(map(len, data), np.int64, len(data))
        out = size.copy()
        sym = self.first[np.frombuffer(b"".join(data), np.uint8)]
        seq = np.repeat(np.arange(len(data), dtype=np.int32), size)
        while len(sym):
            rank = np.full(len(sym), NONE, np.int32)
            inner = np.flatnonzero(seq[1:] == seq[:-1])
            rank[inner] = self.pairs(sym[inner], sym[inner + 1])
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            length = np.diff(np.r_[starts, len(seq)])
            least = np.minimum.reduceat(rank, starts)
            done = least == NONE
            out[seq[starts[done]]] = length[done]
            if done.all():
                break
            at = np.flatnonzero((rank == np.repeat(least, length)) & (rank != NONE))
            if self.together:  # of overlapping occurrences (a a a) every second, from the left
                head = np.r_[True, (at[1:] != at[:-1] + 1)]
                run = np.flatnonzero(head)
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            else:
                at = at[np.r_[True, seq[at[1:]] != seq[at[:-1]]]]
            sym[at] = self.product[rank[at]]
            keep = np.repeat(~done, length)
            keep[at + 1] = False
            sym, seq = sym[keep], seq[keep]
        return out.tolist()


class Counter:
    """Counts tokens of texts; repeated pre-tokens are merged once."""

    def __init__(self, raw: bytes, pattern: str):
        import re

        import regex
        self.merger = RankMerger(raw)
        self.words = regex.compile(pattern)
        self.special = re.compile("|".join(map(re.escape, sorted(self.merger.specials, key=len, reverse=True))) or r"(?!)")
        self.memo = Memo(self.merger.counts)

    def many(self, texts: list[str]) -> list[int]:
        found, out = [], []
        for t in texts:
            n = 0
            if any(s in t for s in self.merger.specials):
                n = len(self.special.findall(t))
                parts = self.special.split(t)
            else:
                parts = [t]
            if len(t) > 1_000_000:
                for p in parts:
                    it = (m.group() for m in self.words.finditer(p))
                    while piece := list(islice(it, 100_000)):
                        n += sum(map(self.memo.over(piece).__getitem__, piece))
                found.append([])
            else:
                found.append(self.words.findall(t) if len(parts) == 1 else [w for p in parts for w in self.words.findall(p)])
            out.append(n)
        known = self.memo.over([w for f in found for w in f])
        return [n + sum(map(known.__getitem__, f)) for n, f in zip(out, found)]


def count_tokens(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id",
                 text_col: str = "text", limit: int = 512) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens and over_limit (> ``limit``)."""
    prepare(docs)
    raw = file_bytes(vocab_path)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = rows.select("doc_id", F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens")).schema

    def count(batches):
        counter = worker_state(("rank_merge", hash(raw), pattern), lambda: Counter(raw, pattern))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            tokens = [n for part in runs(enumerate(texts), 1_000_000) for n in counter.many([t for _, t in part])]
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(tokens, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
