"""Elias-Fano sequences and the n-gram trie level made of them, in numpy.

A monotone sequence keeps the low bits of each value packed and the high bits
in unary; a successor search jumps to the values that share the high bits
(select over zeros) and compares low bits among those few.  Everything lies
in flat arrays that are written to one file and memory-mapped.
"""

import mmap
import tempfile

import numpy as np

_POP = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: position of the k-th zero bit (from the low end) of a byte
_ZERO = np.array([[next((p for p in range(8) if not b >> p & 1 and bin(~b & ((1 << p) - 1)).count("1") == k), 8) for k in range(8)]
                  for b in range(256)], np.uint8)
U64 = np.uint64


class EliasFano:
    """A sorted uint64 sequence: ``low``, ``high`` words and, per high word,
    the zeros before it."""

    FIELDS = ("low", "high", "zeros")

    def __init__(self, n: int, width: int, low, high, zeros):
        self.n, self.width, self.low, self.high, self.zeros = n, width, low, high, zeros

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> "EliasFano":
        n = len(values)
        width = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        low = cls._pack(values & U64((1 << width) - 1), width)
        ones = (values >> U64(width)).astype(np.int64) + np.arange(n)
        size = int(universe >> width) + n + 2
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[ones] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        per_word = 64 - _POP[high.view(np.uint8).reshape(-1, 8)].sum(1, dtype=np.int64)
        return cls(n, width, low, high, np.r_[0, np.cumsum(per_word)[:-1]].astype(np.uint32 if size < 1 << 32 else np.uint64))

    @staticmethod
    def _pack(values: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros(len(values) * width // 64 + 2, U64)
        if width:
            at = np.arange(len(values), dtype=np.int64) * width
            word, shift = at >> 6, (at & 63).astype(U64)
            np.bitwise_or.at(out, word, values << shift)
            over = (at & 63) + width > 64
            np.bitwise_or.at(out, word[over] + 1, values[over] >> (U64(64) - shift[over]))
        return out

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), U64)
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(U64)
        first = self.low[word] >> shift
        # shifting by 64 is undefined: shift in two steps
        second = (self.low[word + 1] << (U64(63) - shift)) << U64(1)
        return (first | second) & U64((1 << self.width) - 1)

    def select0(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th zero of the high bits."""
        word = np.searchsorted(self.zeros, k, side="right") - 1
        rest = k - self.zeros[word].astype(np.int64)
        data = np.ascontiguousarray(self.high[word]).view(np.uint8).reshape(-1, 8)
        upto = np.cumsum(8 - _POP[data].astype(np.int64), axis=1)
        byte = (upto <= rest[:, None]).sum(1)
        rows = np.arange(len(k))
        byte = np.minimum(byte, 7)
        before = np.where(byte > 0, upto[rows, byte - 1], 0)
        return word * 64 + byte * 8 + _ZERO[data[rows, byte], np.minimum(rest - before, 7)]

    def successor(self, x: np.ndarray, first=None, last=None) -> np.ndarray:
        """Index of the first value >= x, within [first, last) if given."""
        h = (x >> U64(self.width)).astype(np.int64)
        lo = np.where(h > 0, self.select0(np.maximum(h - 1, 0)) + 1 - h, 0)
        hi = self.select0(h) - h
        if first is not None:
            lo, hi = np.maximum(lo, first), np.maximum(np.minimum(hi, last), first)
        want = x & U64((1 << self.width) - 1)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.lows(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        return lo

    def find(self, x: np.ndarray, first=None, last=None) -> np.ndarray:
        """Index of x, or -1."""
        i = self.successor(x, first, last)
        h = (x >> U64(self.width)).astype(np.int64)
        end = self.select0(h) - h
        if last is not None:
            end = np.minimum(end, last)
        inside = i < end
        same = self.lows(np.where(inside, i, 0)) == (x & U64((1 << self.width) - 1)) if self.n else inside
        return np.where(inside & same, i, -1)

    def at(self, i: np.ndarray) -> np.ndarray:
        """Values by index, by search over the high bits (few lookups)."""
        ones = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little"))[:self.n]
        return ((ones - np.arange(self.n))[i].astype(U64) << U64(self.width)) | self.lows(i)


class TrieLevel:
    """Successors of contexts.  ``contexts`` and ``pointers`` are monotone;
    ``words`` holds each context's successors relative to the context's place
    (place * width + word), so one search finds a pair and the pointers keep
    it inside its context.  ``codes`` are quantised log probabilities."""

    def __init__(self, span: int, contexts: EliasFano, pointers: np.ndarray, words: EliasFano, codes: np.ndarray):
        self.span, self.contexts, self.pointers, self.words, self.codes = span, contexts, pointers, words, codes

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, codes: np.ndarray) -> "TrieLevel":
        """From pairs sorted by (context, word)."""
        own, first = np.unique(context, return_index=True)
        place = np.repeat(np.arange(len(own)), np.diff(np.r_[first, len(context)]))
        span = int(word.max(initial=0)) + 1
        values = place.astype(U64) * U64(span) + word
        pointers = EliasFano.build(np.r_[first, len(context)].astype(U64), len(context) + 1)
        return cls(span, EliasFano.build(own, int(own.max(initial=0)) + 1), pointers,
                   EliasFano.build(values, max(1, len(own)) * span), codes.astype(np.uint8))

    def lookup(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Code of each pair, 0 where it is absent."""
        out = np.zeros(len(context), np.uint8)
        if not self.words.n or not len(context):
            return out
        top = self._bound(self.contexts)
        inside = np.flatnonzero((context < top) & (word < self.span))
        place = self.contexts.find(context[inside])
        inside, place = inside[place >= 0], place[place >= 0]
        starts = self._starts()
        at = self.words.find(place.astype(U64) * U64(self.span) + word[inside], starts[place], starts[place + 1])
        out[inside[at >= 0]] = self.codes[at[at >= 0]]
        return out

    @staticmethod
    def _bound(ef: EliasFano) -> np.uint64:
        total_zeros = len(ef.high) * 64 - ef.n
        return U64(max(0, total_zeros - 1)) << U64(ef.width) if total_zeros < 1 << 40 else U64(2**64 - 1)

    def _starts(self) -> np.ndarray:
        if not hasattr(self, "_from"):
            self._from = self.pointers.at(np.arange(self.pointers.n)).astype(np.int64)
        return self._from

    # --- one file -----------------------------------------------------
    def dump(self) -> bytes:
        parts, head = [], [self.span]
        for ef in (self.contexts, self.pointers, self.words):
            head += [ef.n, ef.width]
            for f in EliasFano.FIELDS:
                a = getattr(ef, f)
                a = a.astype("<u8") if f == "zeros" else a
                head.append(len(a))
                parts.append(a.tobytes())
        return np.array(head, "<u8").tobytes() + b"".join(parts) + self.codes.tobytes()

    @classmethod
    def load(cls, data) -> "TrieLevel":
        """Over any buffer; nothing is copied."""
        head = np.frombuffer(data, "<u8", 1 + 3 * 5)
        at, efs = head.nbytes, []
        for k in range(3):
            n, width, *sizes = (int(v) for v in head[1 + 5 * k:6 + 5 * k])
            arrays = []
            for size in sizes:
                arrays.append(np.frombuffer(data, "<u8", size, at))
                at += 8 * size
            efs.append(EliasFano(n, width, *arrays))
        return cls(int(head[0]), *efs, np.frombuffer(data, np.uint8, efs[2].n, at))

    @classmethod
    def mapped(cls, data: bytes) -> "TrieLevel":
        """Memory-mapped from a file of its own that leaves no name behind."""
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            return cls.load(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
