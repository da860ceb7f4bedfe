"""Byte-level BPE encoding by a lazily determinised transducer, and streaming
decoding by an incremental UTF-8 machine.

Encoding.  In a sequence that merging by rank yields, every adjacent pair of
tokens is one that merging alone would not change, and every prefix of the
text has exactly one such sequence.  A transducer state is the set of live
readings after some bytes: (place in the vocabulary trie, token before it,
tokens not yet emitted).  A byte advances every reading; the one that ends a
fitting token opens a new reading.  Tokens on which all readings agree are
emitted, so the lookahead is bounded by the longest token.  States and
transitions are made when first met and kept in a table of bounded size.

Decoding.  ``Utf8Stream`` takes ids in pieces, gives whole characters as soon
as they are complete and holds back at most three bytes.

Defined cases: null counts as the empty text (no ids, hashes of no bytes);
repeated rows are encoded each; a null id stays null; an empty table gives an
empty result; long texts are encoded in pieces of pre-tokens.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, file_bytes, prepare, runs, worker_state

ROOT = 0
READINGS = -1
FOREVER = 1 << 40


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """``token-in-base64 rank`` lines."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int], until: int = 1) -> list[bytes]:
    """Plain merging, lowest rank first, leftmost on ties, down to ``until`` parts."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > until:
        best, at = min(((ranks.get(parts[i] + parts[i + 1], FOREVER), i) for i in range(len(parts) - 1)))
        if best == FOREVER:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


def last_merges(ranks: dict[bytes, int]) -> dict[bytes, tuple[bytes, bytes]]:
    """Token -> the two parts merged last, for each token that merging reaches."""
    out = {}
    for t in ranks:
        if len(t) > 1:
            parts = merge_by_rank(t, ranks, 2)
            if len(parts) == 2:
                out[t] = (parts[0], parts[1])
    return out


class Transducer:
    def __init__(self, ranks: dict[bytes, int], last: dict[bytes, tuple[bytes, bytes]], max_arcs: int = 800_000):
        self.ranks, self.max_arcs = ranks, max_arcs
        self.bytes_of = {i: t for t, i in ranks.items()}
        # trie: arcs of each node by byte, and the token that ends there
        self.arcs: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for t, i in ranks.items():
            if len(t) > 1 and t not in last:
                continue  # merging never yields it
            node = ROOT
            for b in t:
                nxt = self.arcs[node].get(b)
                if nxt is None:
                    nxt = self.arcs[node][b] = len(self.arcs)
                    self.arcs.append({})
                    self.token.append(-1)
                node = nxt
            self.token[node] = i
        # parts of a token that lie at its right (left) edge while it forms:
        # [(part, rank at which it is merged into the next)], smallest first
        self.right = {i: self._edge(t, last, 1) for t, i in ranks.items() if len(t) == 1 or t in last}
        self.left = {i: self._edge(t, last, 0) for t, i in ranks.items() if len(t) == 1 or t in last}
        # edges whose ranks do not rise (possible in odd vocabularies) are checked by merging
        self.odd = {i for i in self.right for e in (self.right[i], self.left[i])
                    if any(e[k][1] > e[k + 1][1] for k in range(len(e) - 1))}
        self.fitting: dict[int, bool] = {}
        self.hope: dict[int, bool] = {}
        self._reset()

    def _reset(self):
        """The start state alone.  A state is a dict byte -> (next state,
        emitted tokens) that holds its readings under READINGS."""
        for state in getattr(self, "ids", {}).values():
            state.clear()  # states refer to each other
        self.ids, self.made = {}, 0
        self.start = self._state(((ROOT, -1, ()),))

    def _edge(self, t, last, side):
        out, until = [], FOREVER
        while True:
            out.append((t, until))
            if len(t) == 1 or t not in last:
                return out[::-1]
            until, t = self.ranks[t], last[t][side]

    def fits(self, a: int, b: int) -> bool:
        """Merging a's and b's bytes gives a, b: no pair across the border
        ranks before the merges that would cover it."""
        if a < 0:
            return True
        key = a << 32 | b
        known = self.fitting.get(key)
        if known is None:
            if len(self.fitting) + len(self.hope) > 2 * self.max_arcs:
                self.fitting, self.hope = {}, {}
            if a in self.odd or b in self.odd:
                x, y = self.bytes_of[a], self.bytes_of[b]
                known = merge_by_rank(x + y, self.ranks) == [x, y]
            else:
                known = self._fits(self.right[a], self.left[b])
            self.fitting[key] = known
        return known

    def _fits(self, xs, ys) -> bool:
        i = j = 0
        ranks = self.ranks
        while True:
            (x, x_until), (y, y_until) = xs[i], ys[j]
            r = ranks.get(x + y, FOREVER)
            # on equal ranks the left occurrence is merged first
            if r < FOREVER and r < x_until and r <= y_until:
                return False
            if x_until == FOREVER and y_until == FOREVER:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def hopeful(self, before: int, node: int) -> bool:
        """Some longer token through ``node`` fits after ``before``."""
        if before < 0:
            return True
        key = before << 32 | node
        known = self.hope.get(key)
        if known is None:
            known = any((self.token[n] >= 0 and self.fits(before, self.token[n])) or (self.arcs[n] and self.hopeful(before, n))
                        for n in self.arcs[node].values())
            self.hope[key] = known
        return known

    def _step(self, state: dict, byte: int) -> tuple[dict, tuple]:
        readings = state[READINGS]
        if self.made > self.max_arcs:
            self._reset()
            state = self._state(readings)
        live, opened = [], None
        for node, before, pending in readings:
            nxt = self.arcs[node].get(byte)
            if nxt is None:
                continue
            t = self.token[nxt]
            if t >= 0 and self.fits(before, t):
                opened = (ROOT, t, (*pending, t))
            if self.arcs[nxt] and self.hopeful(before, nxt):
                live.append((nxt, before, pending))
        live.append(opened)
        same = 0
        shortest = min(len(p) for _, _, p in live)
        while same < shortest and len({p[same] for _, _, p in live}) == 1:
            same += 1
        arc = state[byte] = (self._state(tuple((n, b, p[same:]) for n, b, p in live)), opened[2][:same])
        self.made += 1
        return arc

    def _state(self, readings: tuple) -> dict:
        state = self.ids.get(readings)
        if state is None:
            state = self.ids[readings] = {READINGS: readings}
        return state

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        state = self.start
        for b in piece:
            state, emitted = state.get(b) or self._step(state, b)
            if emitted:
                out += emitted
        out += state[READINGS][-1][2]  # what the reading that ends here holds
        return out


class Utf8Stream:
    """Ids in, whole characters out.  ``feed`` returns the text that is
    complete so far; ``close`` turns a cut character into U+FFFD.  ``data``
    receives the raw bytes."""

    def __init__(self, tokens: list[bytes], whole: np.ndarray):
        self.tokens, self.whole = tokens, whole
        self.held = b""

    @staticmethod
    def table(ranks: dict[bytes, int]) -> tuple[list[bytes], np.ndarray]:
        """Token bytes by id, and which of them are whole characters."""
        n = max(ranks.values(), default=-1) + 1
        tokens = [b""] * n
        whole = np.zeros(n, bool)
        for t, i in ranks.items():
            tokens[i] = t
            try:
                t.decode()
                whole[i] = True
            except UnicodeDecodeError:
                pass
        return tokens, whole

    @staticmethod
    def advance(held: bytes, data: bytes) -> tuple[str, bytes]:
        """The UTF-8 machine byte by byte: text now complete, bytes held back."""
        out: list[str] = []
        at = 0
        data = held + data
        while at < len(data):
            b = data[at]
            if b < 0x80:
                out.append(chr(b))
                at += 1
                continue
            need = 1 if 0xC2 <= b < 0xE0 else 2 if 0xE0 <= b < 0xF0 else 3 if 0xF0 <= b < 0xF5 else 0
            low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(b, (0x80, 0xBF))
            got = 0
            while got < need and at + 1 + got < len(data) and low <= data[at + 1 + got] <= high:
                got, low, high = got + 1, 0x80, 0xBF
            if got == need and need:
                out.append(data[at:at + 1 + need].decode())
            elif need and at + 1 + got == len(data):
                return "".join(out), data[at:]
            else:
                out.append("\ufffd")
            at += 1 + got
        return "".join(out), b""

    def feed(self, ids: np.ndarray, data=None) -> str:
        out, at, tokens = [], 0, self.tokens
        listed = ids.tolist()
        for p in [*np.flatnonzero(~self.whole[ids]).tolist(), len(listed)]:
            if p > at:  # a run of whole characters
                chunk = b"".join([tokens[i] for i in listed[at:p]])
                if data is not None:
                    data(chunk)
                if self.held:  # cut off by a token that begins anew
                    out.append(self.close())
                out.append(chunk.decode())
            if p < len(listed):
                chunk = tokens[listed[p]]
                if data is not None:
                    data(chunk)
                text, self.held = self.advance(self.held, chunk)
                out.append(text)
            at = p + 1
        return "".join(out)

    def close(self) -> str:
        text, self.held = self.held.decode("utf-8", "replace"), b""
        return text


class Codec:
    def __init__(self, raw: bytes, pattern: str, last: dict):
        import regex
        ranks = read_ranks(raw)
        self.words = regex.compile(pattern)
        self.machine = Transducer(ranks, last)
        self.table = Utf8Stream.table(ranks)
        self.memo = Memo(lambda words: [np.array(self.machine.encode(w.encode("utf-8", "surrogatepass")), np.uint32).tobytes()
                                        for w in words])

    def many(self, texts: list[str]):
        """For each text its packed ids (little-endian uint32) in pieces."""
        for part in runs(enumerate(texts), 1_000_000):
            found = [self.words.findall(t) if len(t) < 1_000_000 else None for _, t in part]
            known = self.memo.over({w for f in found if f for w in f})
            for (_, t), f in zip(part, found):
                yield self.encode(t) if f is None else (b"".join(map(known.__getitem__, f)),)

    def encode(self, text: str):
        """Packed ids of one text, in pieces of pre-tokens."""
        it = (m.group() for m in self.words.finditer(text))
        while piece := list(islice(it, 100_000)):
            yield b"".join(map(self.memo.over(piece).__getitem__, piece))

    def decode(self, pieces, data=None) -> str:
        stream = Utf8Stream(*self.table)
        return "".join([*(stream.feed(np.frombuffer(p, np.uint32), data) for p in pieces), stream.close()])


def _codec(docs, vocab_path, pattern):
    prepare(docs)
    raw = file_bytes(vocab_path)
    last = last_merges(read_ranks(raw))

    def build():
        gc.set_threshold(100_000, 50, 100)  # many small dicts that stay
        return Codec(raw, pattern, last)

    return lambda: worker_state(("transducer", hash(raw), pattern), build)


def encode_documents(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """Per row: id, ``ids`` (packed little-endian uint32), n_tokens."""
    codec = _codec(docs, vocab_path, pattern)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        c = codec()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                ids = [b"".join(p) for p in c.many(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    out = rows.mapInArrow(run, rows.select("doc_id", F.lit(b"").alias("ids")).schema)
    return out.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def decode_documents(encoded: DataFrame, vocab_path: str, pattern: str) -> DataFrame:
    """Adds ``decoded`` (bytes) and ``decoded_text`` to rows of ``encode_documents``.
    Null ids decode to nothing."""
    codec = _codec(encoded, vocab_path, pattern)
    rows = encoded.select("doc_id", "ids", "n_tokens")

    def run(batches):
        c = codec()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                raw, text = [], []
                for ids in part.column("ids").to_pylist():
                    got: list[bytes] = []
                    ids = ids or b""
                    text.append(c.decode((ids[k:k + 400_000] for k in range(0, len(ids), 400_000)), got.append))
                    raw.append(b"".join(got))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary()), pa.array(text, pa.string())],
                                                 names=[*part.schema.names, "decoded", "decoded_text"])

    return rows.mapInArrow(run, rows.select("*", F.lit(b"").alias("decoded"), F.lit("").alias("decoded_text")).schema)


def round_trip_digests(docs: DataFrame, vocab_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and sha256 of the ids and of the bytes decoded from
    them, hashed piece by piece where they are made, in one pass."""
    codec = _codec(docs, vocab_path, pattern)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches):
        c = codec()
        for batch in batches:
            n, a, b = [], [], []
            for pieces in c.many(batch.column("text").to_pylist()):
                ids_hash, bytes_hash, count = hashlib.sha256(), hashlib.sha256(), 0
                stream = Utf8Stream(*c.table)
                for piece in pieces:
                    ids_hash.update(piece)
                    count += len(piece) // 4
                    stream.feed(np.frombuffer(piece, np.uint32), bytes_hash.update)
                stream.close()
                n.append(count)
                a.append(ids_hash.hexdigest())
                b.append(bytes_hash.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, rows.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"),
                                            F.lit("").alias("decoded_sha256")).schema)
