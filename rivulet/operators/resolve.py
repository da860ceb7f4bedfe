"""Entity resolution: similarity join and ordered greedy dedup.

Similarity is the token-sort ratio: words sorted and re-joined, then
``100 * 2 * LCS / (len a + len b)`` on characters.

The join is exact on whole keys.  A ratio of at least t means at most
d = (1 - t) (la + lb) insertions and deletions, and each of them changes the
counts of a key's q-grams by at most 2q - 1.  Every distinct key gets a
signature of hashed q-gram counts (q = 1, 2, 3) of fixed size; hashing and
clipping only bring counts nearer, so keys whose signatures are further apart
than (2q - 1) d cannot match.  Keys meet by band of length, split into blocks
of bounded size; a task compares the signatures of two blocks as arrays, and
verifies the pairs that all three bounds allow by the exact ratio there and
then, many pairs at a time.  Only pairs that match leave it.  Only distinct keys
take part, so a boiler-plate title repeated by a third of the rows is one key.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import norm_title
from ..session import checkpoint_dir
from .components import components
from .joins import year_guard
from .topk import rank_within


# ------------------------------------------------------------ scalar helpers

def token_sort(col) -> F.Column:
    c = F.col(col) if isinstance(col, str) else col
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    return F.array_join(F.array_sort(words), " ")


def lcs_len(a: str, b: str) -> int:
    """Length of the longest common subsequence (bit-parallel, Hyyro 2004)."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def _masks(a: str) -> dict[str, int]:
    m: dict[str, int] = {}
    for i, ch in enumerate(a):
        m[ch] = m.get(ch, 0) | (1 << i)
    return m


def _lcs_with(masks: dict[str, int], la: int, b: str) -> int:
    full = (1 << la) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return la - bin(v).count("1")


def shared_ends(a: str, b: str) -> tuple[int, int]:
    """Lengths of the common beginning, and of the common end after it; both
    belong to some longest common subsequence."""
    n = min(len(a), len(b))
    x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (a, b))
    differ = np.flatnonzero(x[:n] != y[:n])
    if not len(differ):
        return n, 0
    head = int(differ[0])
    m = n - head
    differ = np.flatnonzero(x[len(a) - m:][::-1] != y[len(b) - m:][::-1])
    return head, int(differ[0]) if len(differ) else m


def ratio_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratios for many pairs.  Common ends are taken off by array comparison;
    what is left between them goes through the bit-parallel recurrence."""
    out = []
    for x, y in zip(a, b):
        x, y = x or "", y or ""
        if not x or not y:
            out.append(100.0 if x == y else 0.0)
            continue
        head, tail = shared_ends(x, y)
        p, q = sorted((x[head:len(x) - tail], y[head:len(y) - tail]), key=len)
        same = head + tail + (_lcs_with(_masks(p), len(p), q) if p else 0)
        out.append(200.0 * same / (len(x) + len(y)))
    return pd.Series(out)


#: Pairs that are compared at a time, words of their state, numbers of the
#: masks of their left keys, characters between two looks at what a pair can
#: still reach, and the share of pairs below which the others wait for more.
PAIRS, STATE_WORDS, MASK_WORDS, LOOK, FEW = 8192, 1 << 18, 1 << 20, 32, 1 / 16
#: Fewer pairs than these are compared one by one, by whole numbers.
TOGETHER = 256
#: Bits of a word that hold places; the highest one takes the carry.
BITS = 63


class _Texts:
    """Keys as arrays, sorted by length: ``text`` and ``start`` hold the codes
    of all keys in a row, ``steps`` a row per place with the keys' codes
    there, behind a key's end the code that no key has."""

    def __init__(self, keys: list[str]):
        self.length = np.fromiter(map(len, keys), np.int64, len(keys))
        self.order = np.argsort(self.length, kind="stable")
        self.keys, self.length = [keys[i] for i in self.order], self.length[self.order]
        self.points = np.frombuffer("".join(self.keys).encode("utf-32-le"), np.uint32)
        self.start = np.cumsum(self.length) - self.length
        self.steps = self.rest = None

    def rests(self, size: int) -> np.ndarray:
        """How often each character is in a key from every LOOK-th place on;
        a key's rows begin at ``rest_at``."""
        if self.rest is None:
            n = BUCKETS[0]
            rows = self.length // LOOK + 1
            self.rest_at = np.cumsum(rows) - rows
            self.rest = np.zeros((int(rows.sum()), n), np.int16 if self.length[-1] < 1 << 15 else np.int32)
            bucket = _buckets(size)
            for at, k, m in zip(self.start, self.rest_at, self.length):
                r = int(m) // LOOK + 1
                own = np.bincount(np.arange(m) // LOOK * n + bucket[self.text[at:at + m]], minlength=r * n).reshape(r, n)
                self.rest[k:k + r] = own[::-1].cumsum(axis=0)[::-1]
        return self.rest

    def laid_out(self, size: int) -> np.ndarray:
        if self.steps is None:
            steps = np.full((int(self.length.max()), len(self.keys)), size, np.uint16 if size < 1 << 16 else np.uint32)
            for k, (at, n) in enumerate(zip(self.start, self.length)):
                steps[:n, k] = self.text[at:at + n]
            self.steps = steps
        return self.steps


def _coded(*sides: _Texts) -> int:
    """Numbers the characters of all sides from 0, the most frequent first;
    how many there are."""
    counts = np.zeros(1 + max((int(x.points.max()) for x in sides if len(x.points)), default=0), np.int64)
    for x in sides:
        counts += np.bincount(x.points, minlength=len(counts))
    present = np.flatnonzero(counts)
    table = np.zeros(len(counts), np.uint32)
    table[present[np.argsort(-counts[present], kind="stable")]] = np.arange(len(present))
    for x in sides:
        x.text = table[x.points]
    return len(present)


def _buckets(size: int) -> np.ndarray:
    """The bucket of each of ``size`` characters; frequent ones are alone."""
    alone = BUCKETS[0] if size <= BUCKETS[0] else BUCKETS[0] * 2 // 3
    bucket = np.arange(max(size, 1))
    bucket[alone:] = alone + (bucket[alone:] - alone) % max(BUCKETS[0] - alone, 1)
    return bucket


def _lcs_reaching(left: _Texts, right: _Texts, i: np.ndarray, j: np.ndarray, size: int, tp: float, wait: bool = False) -> np.ndarray:
    """Lengths of the longest common subsequences of the keys (i, j), in the
    order of i, that reach ``tp`` / 2 of the keys' characters, and less than
    that for the other pairs: the bit-parallel recurrence on all pairs at once.
    A subsequence that is long enough leaves out few characters, so it matches
    places at most that many apart; only the words of such places are carried
    on.  A pair is dropped as soon as the characters in the rest of both keys
    cannot lift it any more.  With ``wait``, -2 for the last few pairs."""
    la, lb = left.length[i], right.length[j]
    need = tp / 2.0 * (la + lb) - 1e-6
    own, g = np.unique(i, return_inverse=True)
    words = -(-int(la.max()) // BITS)
    sizes = left.length[own]
    who = np.repeat(np.arange(len(own)), sizes)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    masks = np.zeros((words, len(own) * (size + 1)), np.uint64)
    # places of a key have bits of their own, so adding sets them
    np.add.at(masks, (place // BITS, who * (size + 1) + left.text[left.start[own][who] + place]), np.left_shift(np.uint64(1), (place % BITS).astype(np.uint64)))
    base, steps = (g * (size + 1)).astype(np.intp), right.laid_out(size)
    rest_a, rest_b = left.rests(size), right.rests(size)
    before, behind = int((la - need).max()) + 1, int((lb - need).max()) + 1
    all_set, top = np.uint64((1 << BITS) - 1), np.uint64(BITS)
    v = np.full((words, len(i)), all_set)
    out, alive, fixed, first, last = np.full(len(i), -1, np.int64), np.arange(len(i)), np.zeros(len(i), np.int64), 0, 0

    def zeros(x):
        return BITS * len(x) - np.bitwise_count(x).sum(axis=0, dtype=np.int64)

    for t in range(0, int(lb.max()), LOOK):
        low = min(max(0, (t - behind) // BITS), words)
        if low > first:  # these words are left behind
            fixed, first = fixed + zeros(v[first:low]), low
        if t:
            lacks = need - fixed - zeros(v[first:last])
            some = np.maximum(lb - t, 0) >= lacks
            if some.any():
                at = np.flatnonzero(some)
                ends = rest_a[left.rest_at[i[at]] + np.minimum(max(0, t - behind) // LOOK, la[at] // LOOK)], rest_b[right.rest_at[j[at]] + np.minimum(t // LOOK, lb[at] // LOOK)]
                some[at] = (np.minimum(*ends).sum(axis=1, dtype=np.int64) >= lacks[at]) | (lb[at] <= t)
            if not some.any():
                return out
            if some.mean() < 0.8:
                alive, v, fixed, i, j, la, lb, need, base = alive[some], v[:, some], fixed[some], i[some], j[some], la[some], lb[some], need[some], base[some]
                if wait and len(alive) < FEW * len(out):
                    out[alive] = -2
                    return out
        last = max(min(words, (t + LOOK + before) // BITS + 1), first)
        now = steps[t:t + LOOK].take(j, axis=1).astype(np.intp)
        now += base
        total, u, carry = np.empty(len(j), np.uint64), np.empty(len(j), np.uint64), np.empty(len(j), np.uint64)
        for at in now:
            for w in range(first, last):
                mine = v[w]
                np.take(masks[w], at, out=u, mode="clip")
                np.bitwise_and(u, mine, out=u)
                np.add(mine, u, out=total)
                np.bitwise_xor(mine, u, out=u)
                if w > first:
                    np.add(total, carry, out=total)
                if w + 1 < last:
                    np.right_shift(total, top, out=carry)
                np.bitwise_or(total, u, out=mine)
                np.bitwise_and(mine, all_set, out=mine)
    out[alive] = fixed + zeros(v[first:])
    return out


def _lcs_one_by_one(left: _Texts, right: _Texts, i: np.ndarray, j: np.ndarray, tp: float) -> np.ndarray:
    """The same lengths, pair by pair; -1 for a pair as soon as the rest of the
    right key cannot lift it any more."""
    out, of = np.full(len(i), -1, np.int64), -1
    for n, (x, y) in enumerate(zip(i, j)):
        if x != of:
            of, la = x, int(left.length[x])
            a = left.text[left.start[x]:left.start[x] + la]
            masks = {int(c): int.from_bytes(np.packbits(a == c, bitorder="little").tobytes(), "little") for c in np.unique(a)}
            full = (1 << la) - 1
        lb = int(right.length[y])
        b = right.text[right.start[y]:right.start[y] + lb].tolist()
        need, v = tp / 2.0 * (la + lb) - 1e-6, full
        for t in range(0, lb, 4 * LOOK):
            if la - v.bit_count() + lb - t < need:
                break
            for c in b[t:t + 4 * LOOK]:
                u = v & masks.get(c, 0)
                v = ((v + u) | (v - u)) & full
        else:
            out[n] = la - v.bit_count()
    return out


def _batches(left: _Texts, i: np.ndarray, size: int):
    """Slices of pairs in the order of their left keys that are compared at a
    time, bounded by pairs and by the memory that they take."""
    at = 0
    while at < len(i):
        step = min(PAIRS, len(i) - at)
        words = -(-int(left.length[i[at:at + step]].max()) // BITS)
        end = at + max(1, min(step, STATE_WORDS // words))
        most = max(1, MASK_WORDS // (words * (size + 1)))  # left keys
        new = np.flatnonzero(np.diff(i[at:end], prepend=-1))
        if len(new) > most:
            end = at + int(new[most])
        yield slice(at, end)
        at = end


def _scores(left: _Texts, right: _Texts, i: np.ndarray, j: np.ndarray, size: int, t: float) -> np.ndarray:
    """Ratios of the pairs (i, j), exact from t on."""
    same = np.full(len(i), -1, np.int64)
    for some in _batches(left, i, size):
        few = some.stop - some.start < TOGETHER
        same[some] = -2 if few else _lcs_reaching(left, right, i[some], j[some], size, t / 100.0, wait=True)
    waited = np.flatnonzero(same == -2)
    for some in _batches(left, i[waited], size):
        at = waited[some]
        same[at] = _lcs_one_by_one(left, right, i[at], j[at], t / 100.0) if len(at) < TOGETHER else _lcs_reaching(left, right, i[at], j[at], size, t / 100.0)
    return np.where(same < 0, -1.0, 200.0 * same / (left.length[i] + right.length[j]))


def ratios_reaching(a: list[str], b: list[str], t: float) -> np.ndarray:
    """Ratios of pairs of keys that are not empty, exact from t on; any number
    below t for the others."""
    left, right = _Texts(a), _Texts(b)
    at = np.empty(len(b), np.int64)
    at[right.order] = np.arange(len(b))
    out = np.empty(len(a))
    out[left.order] = _scores(left, right, np.arange(len(a)), at[left.order], _coded(left, right), t)
    return out


def ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (len a + len b); two empty strings score 100."""
    if not a and not b:
        return 100.0
    return 100.0 * 2.0 * lcs_len(a, b) / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


_UDF = {}


def ratio_udf(a, b) -> F.Column:
    """Vectorised (Arrow-batched) ratio of two string columns."""
    if "ratio" not in _UDF:
        @F.pandas_udf("double")
        def _ratio(x: pd.Series, y: pd.Series) -> pd.Series:
            return ratio_batch(x, y)
        _UDF["ratio"] = _ratio
    return _UDF["ratio"](F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def token_sort_similarity(a, b) -> F.Column:
    """Column helper: token-sort ratio of two string columns."""
    return ratio_udf(token_sort(a), token_sort(b))


# ------------------------------------------------------------ similarity join

#: Buckets of a signature's counts of single characters, pairs and triples.
BUCKETS = (48, 96, 112)
#: Keys of a block at least and at most, blocks of a band in between (a key is
#: sent to those of its own band and of the two beside it), and characters of
#: a block; a task compares two of them.
BLOCK_KEYS, BLOCK_KEYS_MOST, BAND_BLOCKS, BLOCK_CHARS = 1024, 16_384, 6, 1 << 22


def _grams(points: np.ndarray, row: np.ndarray, keys: int, q: int) -> np.ndarray:
    """Counts (keys x buckets) of the hashed q-grams of keys in a row, whose
    characters belong to the keys ``row``."""
    n, c = BUCKETS[q - 1], points.astype(np.uint64)
    if len(c) < q:
        return np.zeros((keys, n), np.int64)
    gram = np.zeros(len(c) - q + 1, np.uint64)
    for k in range(q):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + c[k:len(c) - q + 1 + k] + np.uint64(1)
    mixed = (gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    own = row[:len(gram)] == row[q - 1:]
    at = row[:len(gram)] * n + ((mixed >> np.uint64(33)) % np.uint64(n)).astype(np.int64)
    return np.bincount(at[own], minlength=keys * n).reshape(keys, n)


def signature(key: str) -> bytes:
    """Counts of the key's hashed q-grams, as packed 16-bit numbers."""
    points, row = np.frombuffer(key.encode("utf-32-le"), np.uint32), np.zeros(len(key), np.int64)
    return np.minimum(np.concatenate([_grams(points, row, 1, q)[0] for q in range(1, len(BUCKETS) + 1)]), 0x7FFF).astype("<i2").tobytes()


def _counts(side: _Texts, size: int, kind) -> list[np.ndarray]:
    """Counts of the keys' characters (buckets x keys) and of their hashed
    pairs and triples (keys x buckets); frequent characters have a bucket of
    their own."""
    n, bucket = BUCKETS[0], _buckets(size)
    parts, at = [], 0
    while at < len(side.keys):  # a million characters at a time
        end = max(at + 1, int(np.searchsorted(side.start + side.length, side.start[at] + (1 << 20), "right")))
        cut = slice(side.start[at], side.start[end - 1] + side.length[end - 1])
        row = np.repeat(np.arange(end - at), side.length[at:end])
        own = [np.bincount(row * n + bucket[side.text[cut]], minlength=(end - at) * n).reshape(end - at, n)]
        own += [_grams(side.points[cut], row, end - at, q) for q in range(2, len(BUCKETS) + 1)]
        parts.append([x.astype(kind) for x in own])
        at = end
    first, *rest = [np.concatenate(x) for x in zip(*parts)]
    return [np.ascontiguousarray(first.T), *rest]


#: Left keys and right keys whose characters are counted against each other
#: at a time, pairs that show whether a longer gram is worth its time, and
#: pairs that are kept for the comparison.
LEFT, RIGHT, TRIED, HELD = 16, 4096, 256, 1 << 17


def near_counts(left: _Texts, lc: list, right: _Texts, rc: list, lf: np.ndarray, rf: np.ndarray, t: float, within: bool):
    """Arrays of places (i, j), in the order of i, of pairs whose lengths and
    counts allow a ratio >= t.  lf, rf: sides a key is on (1, 2 or 3); a pair
    needs one on each.  ``within``: both sides are the same, each pair counts
    once.  Longer grams are left out where they would drop few pairs."""
    tp = t / 100.0
    reach = (2.0 - tp) / tp * (1 + 1e-9)
    used = np.flatnonzero(lc[0].any(axis=1) | rc[0].any(axis=1))
    for at in range(0, len(left.keys), LEFT):
        la = left.length[at:at + LEFT]
        low, high = np.searchsorted(right.length, la[0] / reach), np.searchsorted(right.length, la[-1] * reach, "right")
        found = []
        for r in range(max(low, at + 1) if within else low, high, RIGHT):
            cut = slice(r, min(r + RIGHT, high))
            lb = right.length[cut]
            apart = np.zeros((len(la), len(lb)), lc[0].dtype)
            gap = np.empty_like(apart)
            for c in used:
                np.subtract(rc[0][c, cut], lc[0][c, at:at + LEFT, None], out=gap)
                np.abs(gap, out=gap)
                apart += gap
            i, j = np.nonzero(apart <= (1.0 - tp) * (la[:, None] + lb) + 1e-6)
            found.append((i + at, j + r))
        if not found:
            continue
        i, j = (np.concatenate(x) for x in zip(*found))
        keep = ((lf[i] & 1) & (rf[j] >> 1)) | ((lf[i] >> 1) & (rf[j] & 1)) != 0
        if within:
            keep &= j > i
        i, j = i[keep], j[keep]
        for q in range(2, len(BUCKETS) + 1):
            def near(i, j):
                return np.concatenate([np.zeros(0, bool)] + [
                    np.abs(lc[q - 1][i[k:k + 2048]] - rc[q - 1][j[k:k + 2048]]).sum(axis=1, dtype=np.int64)
                    <= (2 * q - 1) * ((1.0 - tp) * (left.length[i[k:k + 2048]] + right.length[j[k:k + 2048]]) + 1e-6) for k in range(0, len(i), 2048)])
            tried = slice(None, None, max(1, len(i) // TRIED))
            if len(i) > 4 * TRIED and near(i[tried], j[tried]).mean() > 0.8:
                continue
            keep = near(i, j)
            i, j = i[keep], j[keep]
        order = np.argsort(i, kind="stable")
        yield i[order], j[order]


def _parallelism(df: DataFrame) -> int:
    """Task count for CPU-heavy stages: twice the cluster's cores."""
    return max(2, df.sparkSession.sparkContext.defaultParallelism * 2)


def similar_pairs(keys: DataFrame, t: float) -> DataFrame:
    """(ka, kb, score): ka < kb of the keys (k, side) with ratio >= t.  Lengths
    of partners differ by a factor of (2 - t) / t at most, so they are in the
    same band of that width or in the next one."""
    tp = t / 100.0
    step = math.log((2.0 - tp) / tp * 1.0001)
    keys = keys.withColumn("band", F.floor(F.log(F.length("k").cast("double")) / step).cast("int"))
    # bands are a logarithm of the longest key: a few dozen numbers
    sizes = keys.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("k").cast("long")).alias("chars")).collect()
    blocks = {}
    for r in sizes:
        own = min(max(BLOCK_KEYS, -(-r["n"] // BAND_BLOCKS)), max(BLOCK_KEYS, BLOCK_KEYS_MOST))
        blocks[r["band"]] = max(-(-r["n"] // own), -(-r["chars"] // BLOCK_CHARS))
    if not blocks:
        return keys.select(F.col("k").alias("ka"), F.col("k").alias("kb"), F.lit(0.0).alias("score")).where(F.lit(False))
    table = F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv])

    def count(band):
        return F.coalesce(F.try_element_at(table, band), F.lit(0))

    def others(n):  # block numbers 0 to n - 1
        return F.filter(F.sequence(F.lit(-1), n - 1), lambda x: x >= 0)

    band = F.col("band")
    placed = keys.withColumn("block", F.pmod(F.xxhash64("k"), count(band)).cast("int"))
    block = F.col("block")
    meets = F.concat(
        F.transform(others(count(band)), lambda j: F.struct(band.alias("p"), F.least(block, j).alias("i"), band.alias("q"), F.greatest(block, j).alias("j"),
                                                             F.when(block == j, 2).when(block < j, 0).otherwise(1).alias("part"))),
        F.transform(others(count(band + 1)), lambda j: F.struct(band.alias("p"), block.alias("i"), (band + 1).alias("q"), j.alias("j"), F.lit(0).alias("part"))),
        F.transform(others(count(band - 1)), lambda j: F.struct((band - 1).alias("p"), j.alias("i"), band.alias("q"), block.alias("j"), F.lit(1).alias("part"))))
    dealt = placed.select("k", "side", F.explode(meets).alias("m")).select("k", "side", "m.*")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        def texts(part):
            own = pdf[pdf["part"].isin(part)]
            side = _Texts(own["k"].tolist())
            return side, own["side"].to_numpy(np.int64)[side.order]

        within = bool((pdf["part"] == 2).any())
        left, lf = texts((0, 2))
        right, rf = (left, lf) if within else texts((1, 2))
        out = []
        if len(left.keys) and len(right.keys):
            size = _coded(left, right)
            kind = np.int16 if left.length[-1] + right.length[-1] < 1 << 15 else np.int32
            lc = _counts(left, size, kind)
            rc = lc if within else _counts(right, size, kind)
            held, n = [], 0

            def verified():
                i, j = (np.concatenate(x) for x in zip(*held))
                score = _scores(left, right, i, j, size, t)
                for x in np.flatnonzero(score >= t):
                    a, b = left.keys[i[x]], right.keys[j[x]]
                    out.append((min(a, b), max(a, b), score[x]))

            for pairs in near_counts(left, lc, right, rc, lf, rf, t, within):
                held.append(pairs)
                n += len(pairs[0])
                if n >= HELD:
                    verified()
                    held, n = [], 0
            if n:
                verified()
        return pd.DataFrame(out, columns=["ka", "kb", "score"])

    # without a count of its own, AQE would put the few small groups into one task
    pairs = sum(n * (n + 1) // 2 + n * blocks.get(p + 1, 0) for p, n in blocks.items())
    tasks = max(_parallelism(keys), min(pairs, 1024))
    return dealt.repartition(tasks, "p", "i", "q", "j").groupBy("p", "i", "q", "j").applyInPandas(compare, "ka string, kb string, score double")


def similar_keys(keys: DataFrame, t: float, partners: DataFrame | None = None) -> DataFrame:
    """(ka, kb, score) for distinct token-sorted keys ka < kb with ratio >= t;
    given ``partners``, only pairs of a key of ``keys`` and one of those.
    Works on distinct whole keys, so a key repeated by many rows costs one
    key; empty and null keys match nothing."""
    own = keys.select("k", F.lit(1 if partners is not None else 3).alias("side"))
    if partners is not None:
        own = own.unionByName(partners.select("k", F.lit(2).alias("side")))
    own = _cut(own.where("k <> ''").groupBy("k").agg(F.bit_or("side").alias("side")))
    return _cut(similar_pairs(own, t))


def key_pairs(rows: DataFrame, t: float, key: str = "key") -> DataFrame:
    """Similar distinct keys with how many rows carry each: (ka, kb, score,
    n_a, n_b) over token-sorted keys, ka < kb."""
    k = rows.select(token_sort(key).alias("k"))
    counts = k.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    sk = similar_keys(counts.select("k"), t)
    return (sk.join(counts.select(F.col("k").alias("ka"), F.col("n").alias("n_a")), "ka")
              .join(counts.select(F.col("k").alias("kb"), F.col("n").alias("n_b")), "kb")
              .select("ka", "kb", "score", "n_a", "n_b"))


def fuzzy_best_match(left: DataFrame, right: DataFrame, t: float) -> DataFrame:
    """For every left row (id, key), the right row (id, key, ord) with the
    highest ratio >= t; ties go to the first right row in ``ord`` order.
    Right rows sharing a key are represented by their first row."""
    lk = left.select("id", token_sort("key").alias("k"))
    rk = right.select("id", "ord", token_sort("key").alias("k"))
    rep = rank_within(rk, ["k"], [F.col("ord").asc()], 1, "_r").drop("_r")
    sk = similar_keys(lk.select("k"), t, rep.select("k"))
    both = (sk.select("ka", "kb", "score")
            .unionByName(sk.select(F.col("kb").alias("ka"), F.col("ka").alias("kb"), "score"))
            .unionByName(rep.select(F.col("k").alias("ka"), F.col("k").alias("kb"), F.lit(100.0).alias("score"))))
    cand = (both.join(lk.select(F.col("k").alias("ka")).distinct(), "ka")
            .join(rep.select(F.col("k").alias("kb"), F.col("id").alias("r_id"), F.col("ord").alias("r_ord")), "kb"))
    best = rank_within(cand, ["ka"], [F.col("score").desc(), F.col("r_ord").asc()], 1, "_r").drop("_r")
    return (lk.select(F.col("id").alias("l_id"), F.col("k").alias("ka")).join(best, "ka")
            .select("l_id", "r_id", "score", "r_ord"))


# ------------------------------------------------------------ greedy dedup

#: Links of a component that one task walks through; larger components are
#: decided by rounds of joins.
WALK_LINKS = 200_000


def greedy_keep(spark: SparkSession, nodes: DataFrame, edges: DataFrame, walk_links: int = WALK_LINKS) -> DataFrame:
    """Lexicographically-first maximal independent set in ``ord`` order.

    nodes(id, ord, pre_kept bool), edges(l_id, r_id) undirected.  A node is
    kept when no earlier neighbour is kept; pre-kept nodes are kept whatever
    their neighbours.  Components of bounded size are walked in order, one
    task each, as a chain of n titles needs n steps; in larger ones every
    round of joins decides at least the first open node of each component,
    until none is open."""
    checkpoint_dir(spark)
    o = nodes.select("id", "ord")
    edges = _cut(edges.select("l_id", "r_id").where("l_id <> r_id"))
    e = _cut(edges.select(F.col("l_id").alias("u"), F.col("r_id").alias("v"))
             .unionByName(edges.select(F.col("r_id").alias("u"), F.col("l_id").alias("v")))
             .join(o.select(F.col("id").alias("u"), F.col("ord").alias("ou")), "u")
             .join(o.select(F.col("id").alias("v"), F.col("ord").alias("ov")), "v")
             .filter(F.col("ou") < F.col("ov")).select("u", "v").distinct())
    roots = components(e.select(F.col("u").alias("a"), F.col("v").alias("b")))
    owner = e.join(roots.withColumnRenamed("root", "_root"), "u", "left").withColumn("root", F.coalesce("_root", "u")).drop("_root")
    sizes = owner.groupBy("root").agg(F.count(F.lit(1)).alias("links"))
    small = sizes.filter(F.col("links") <= walk_links).select("root")
    walked = _walk(owner.join(small, "root", "left_semi"), nodes)
    state = nodes.select("id", "ord", "pre_kept").join(walked, "id", "left")
    state = state.select("id", "ord", F.when(F.col("pre_kept"), "kept")
                         .when(F.col("walked").isNotNull(), F.when(F.col("walked"), "kept").otherwise("dropped"))
                         .otherwise("undecided").alias("st"))
    state = _cut(state)
    large = _cut(owner.join(small, "root", "left_anti").select("u", "v"))
    if not large.limit(1).count():  # what is left has no neighbours
        return state.select("id", "ord", (F.col("st") != "dropped").alias("kept"))
    # neighbours of pre-kept nodes are dropped (unless pre-kept themselves)
    state = _cut(_drop_neighbours(state, large, "kept"))
    while state.filter(F.col("st") == "undecided").limit(1).count():
        blockers = state.filter(F.col("st").isin("kept", "undecided")).select(F.col("id").alias("u"))
        blocked = (large.join(blockers, "u").select(F.col("v").alias("id")).distinct()
                   .withColumn("blocked", F.lit(True)))
        state = (state.join(blocked, "id", "left")
                 .withColumn("st", F.when((F.col("st") == "undecided") & F.col("blocked").isNull(), "new")
                             .otherwise(F.col("st"))).drop("blocked"))
        state = _drop_neighbours(state, large, "new")
        state = _cut(state.withColumn("st", F.when(F.col("st") == "new", "kept").otherwise(F.col("st"))))
    return state.select("id", "ord", (F.col("st") == "kept").alias("kept"))


def _walk(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, walked) for the nodes of ``links`` (root, u, v; u before v):
    whether each is kept when its component is walked in order."""
    n = nodes.select(F.col("id").alias("u"), F.col("ord").alias("ou"), F.col("pre_kept").alias("pu"))
    rows = links.join(n, "u").join(n.select(F.col("u").alias("v"), F.col("ou").alias("ov"), F.col("pu").alias("pv")), "v")
    # ord may be a struct: number it inside the component
    ends = (rows.select("root", F.col("u").alias("id"), F.col("ou").alias("ord"), F.col("pu").alias("pre"))
            .unionByName(rows.select("root", F.col("v").alias("id"), F.col("ov").alias("ord"), F.col("pv").alias("pre"))).distinct())
    ends = ends.withColumn("pos", F.row_number().over(Window.partitionBy("root").orderBy("ord")))
    both = (ends.select("root", "id", "pos", "pre", F.lit(None).cast(nodes.schema["id"].dataType).alias("after"))
            .unionByName(links.select("root", F.col("u").alias("id"), F.lit(None).cast("int").alias("pos"),
                                      F.lit(None).cast("boolean").alias("pre"), F.col("v").alias("after"))))
    kind = nodes.schema["id"].dataType.simpleString()

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["pos"].notna()].sort_values("pos")
        near: dict = {}
        for u, v in zip(pdf.loc[pdf["pos"].isna(), "id"], pdf.loc[pdf["pos"].isna(), "after"]):
            near.setdefault(u, []).append(v)
            near.setdefault(v, []).append(u)
        dropped, kept = set(), []
        pre = set(own.loc[own["pre"].astype(bool), "id"])
        for u in pre:
            dropped.update(near.get(u, ()))
        dropped -= pre
        for u in own["id"]:
            kept.append(u in pre or u not in dropped)
            if kept[-1]:
                dropped.update(v for v in near.get(u, ()) if v not in pre)
        return pd.DataFrame({"id": own["id"], "walked": kept})

    return both.select("root", F.col("id").cast(kind), "pos", "pre", F.col("after").cast(kind)).groupBy("root").applyInPandas(walk, f"id {kind}, walked boolean")


def _cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (shared folder) of a persisted frame: computed
    once, lineage cut, memory released."""
    df = df.persist()
    out = df.checkpoint()
    df.unpersist()
    return out


def _drop_neighbours(state: DataFrame, e: DataFrame, src: str) -> DataFrame:
    srcs = state.filter(F.col("st") == src).select(F.col("id").alias("u"))
    hit = (e.join(srcs, "u").select(F.col("v").alias("id"))
           .unionByName(e.join(srcs.select(F.col("u").alias("v")), "v").select(F.col("u").alias("id")))
           .distinct().withColumn("hit", F.lit(True)))
    return (state.join(hit, "id", "left")
            .withColumn("st", F.when((F.col("st") == "undecided") & F.col("hit").isNotNull(), "dropped")
                        .otherwise(F.col("st"))).drop("hit"))


def dedup_ordered(spark: SparkSession, items: DataFrame, t: float = 90.0,
                  pre_kept: DataFrame | None = None) -> DataFrame:
    """Keep a row unless its normalised title is >= t similar to an earlier
    kept one.  items(id, title, ord); ``pre_kept`` ids are always kept.

    Rows with identical keys are similar to exactly the same rows, so only
    the first of them (by ord) can survive: the greedy pass runs on one
    representative per key, and the other rows of a key are dropped unless
    pre-kept."""
    keyed = items.select("id", "ord", token_sort(norm_title("title")).alias("k"))
    if pre_kept is not None:
        keyed = keyed.join(pre_kept.select("id", F.lit(True).alias("pk")), "id", "left")
    else:
        keyed = keyed.withColumn("pk", F.lit(None).cast("boolean"))
    keyed = keyed.withColumn("pk", F.coalesce("pk", F.lit(False)))
    nodes = keyed.groupBy("k").agg(F.min("ord").alias("kord"), F.max("pk").alias("kpk"))
    edges = similar_keys(keyed.select("k"), t).select(F.col("ka").alias("l_id"), F.col("kb").alias("r_id"))
    state = greedy_keep(spark, nodes.select(F.col("k").alias("id"), F.col("kord").alias("ord"),
                                            F.col("kpk").alias("pre_kept")), edges)
    out = keyed.join(nodes, "k").join(state.select(F.col("id").alias("k"), F.col("kept").alias("key_kept")), "k")
    kept = F.col("pk") | (~F.col("kpk") & F.col("key_kept") & (F.col("ord") == F.col("kord")))
    return out.select("id", "ord", kept.alias("kept"))


def dedup_articles(spark: SparkSession, articles: DataFrame, t: float = 90.0) -> DataFrame:
    """Articles in source order: drop one >= t similar to an already kept one."""
    return dedup_ordered(spark, articles, t)


def dedup_videos(spark: SparkSession, first: DataFrame, second: DataFrame, t: float = 90.0) -> DataFrame:
    """All of ``first`` kept; ``second`` filtered greedily against both."""
    n1 = first.select("id", "title", F.struct(F.lit(0).alias("l"), F.col("ord").alias("o")).alias("ord"))
    n2 = second.select("id", "title", F.struct(F.lit(1).alias("l"), F.col("ord").alias("o")).alias("ord"))
    return dedup_ordered(spark, n1.unionByName(n2), t, pre_kept=first.select("id"))


# ------------------------------------------------------------ resolvers

def _ord(df: DataFrame) -> F.Column:
    """List order for first-wins ties: an explicit ``ord`` column, else the id."""
    return F.col("ord") if "ord" in df.columns else F.col("item_id")


def _first_year(title_col: F.Column, fallback: F.Column | None = None) -> F.Column:
    y = F.regexp_extract(title_col, r"\(([0-9]{4})\)", 1)
    y = F.when(y == "", F.lit(None)).otherwise(y)
    return F.coalesce(y, fallback) if fallback is not None else y


def fuzzy_stage(rich: DataFrame, other: DataFrame, t: float) -> DataFrame:
    """Best rich match (ratio >= t, ties to the first rich row) for each
    other row: (source_id, target_id, score)."""
    left = other.select(F.col("item_id").alias("id"), norm_title("title").alias("key"))
    right = rich.select(F.col("item_id").alias("id"), norm_title("title").alias("key"), _ord(rich).alias("ord"))
    return fuzzy_best_match(left, right, t).select(F.col("l_id").alias("source_id"),
                                                   F.col("r_id").alias("target_id"), "score")


def absorb(rich: DataFrame, other: DataFrame, matches: DataFrame) -> DataFrame:
    """Add the view counts of matched ``other`` items to their targets."""
    extra = (matches.join(other.select(F.col("item_id").alias("source_id"), "view_count"), "source_id")
             .groupBy("target_id").agg(F.sum("view_count").alias("extra")))
    return (rich.join(extra, rich.item_id == extra.target_id, "left")
            .withColumn("view_count", (F.col("view_count") + F.coalesce("extra", F.lit(0))).cast("long"))
            .drop("target_id", "extra"))


def combine_ratings(rich: DataFrame, inter: DataFrame, matches: DataFrame, max_weight: float,
                    scale: float = 1.0) -> DataFrame:
    """Blend each target's rating with the matched dataset ratings > 0."""
    from ..functions.scalars import combined_rating
    r = (inter.filter(F.col("rating") > 0).join(matches.select(F.col("source_id").alias("item_id"), "target_id"),
                                                "item_id")
         .groupBy("target_id").agg(F.avg(F.col("rating") / scale).alias("ds_avg"), F.count(F.lit(1)).alias("ds_n")))
    j = rich.join(r, rich.item_id == r.target_id, "left")
    base = F.when(F.coalesce(F.col("rating"), F.lit(0.0)) == 0.0, F.lit(3.0)).otherwise(F.col("rating"))
    new = F.when(F.col("ds_n").isNull(), F.col("rating")).otherwise(
        combined_rating(base, F.col("ds_avg"), F.col("ds_n"), max_weight))
    return j.withColumn("rating", new).drop("target_id", "ds_avg", "ds_n")


def remap(inter: DataFrame, matches: DataFrame) -> DataFrame:
    from .joins import remap_ids
    return remap_ids(inter, matches.select("source_id", "target_id"))


def _unmatched(other: DataFrame, matches: DataFrame) -> DataFrame:
    return other.join(matches.select(F.col("source_id").alias("item_id")), "item_id", "left_anti")


def resolve_movies(spark: SparkSession, rich: DataFrame, ml_items: DataFrame, ml_inter: DataFrame,
                   links: DataFrame | None = None, t: float = 88.0) -> dict[str, DataFrame]:
    """Bridge ids (movieId -> tmdbId -> rich id with a numeric suffix), then
    normalised title + year (the last rich item with a key wins), then fuzzy
    >= t with the year guard; absorb views, combine ratings (max weight
    0.65), re-point interactions; unmatched dataset movies are kept."""
    from ..functions.scalars import fix_trailing_article
    r = rich.withColumn("_yr", _first_year(F.col("title"), F.year("publish_ts").cast("string")))
    o = ml_items.withColumn("_clean", fix_trailing_article("title")).withColumn(
        "_yr", _first_year(F.col("_clean"), F.regexp_extract("description", r"Year: ([0-9]{4})", 1)))
    o = o.withColumn("_yr", F.when(F.col("_yr") == "", F.lit(None)).otherwise(F.col("_yr")))
    stages = []
    rest = o
    if links is not None:
        parts = F.split(F.col("item_id"), "_")
        num = F.element_at(parts, -1)
        by_num = (rich.filter((F.size(parts) >= 3) & num.rlike("^[0-9]+$"))
                  .select(num.alias("tmdb_id"), F.col("item_id").alias("target_id"), _ord(rich).alias("_o")))
        by_num = by_num.groupBy("tmdb_id").agg(F.max_by("target_id", "_o").alias("target_id"))
        src = o.select("item_id", F.element_at(F.split("item_id", "_"), -1).alias("source_id"))
        m1 = (src.join(links.select("source_id", "tmdb_id"), "source_id").join(by_num, "tmdb_id")
              .select(F.col("item_id").alias("source_id"), "target_id", F.lit("bridge").alias("stage")))
        stages.append(m1)
        rest = rest.join(m1.select(F.col("source_id").alias("item_id")), "item_id", "left_anti")
    rk = r.filter(F.col("_yr").isNotNull()).select(norm_title("title").alias("_n"), "_yr",
                                                   F.col("item_id").alias("target_id"), _ord(r).alias("_o"))
    rk = rk.groupBy("_n", "_yr").agg(F.max_by("target_id", "_o").alias("target_id"))
    m2 = (rest.filter(F.col("_yr").isNotNull()).select("item_id", norm_title("_clean").alias("_n"), "_yr")
          .join(rk, ["_n", "_yr"]).select(F.col("item_id").alias("source_id"), "target_id",
                                          F.lit("exact").alias("stage")))
    stages.append(m2)
    rest = rest.join(m2.select(F.col("source_id").alias("item_id")), "item_id", "left_anti")
    fz = fuzzy_stage(r, rest.withColumn("title", F.col("_clean")), t)
    fz = (fz.join(rest.select(F.col("item_id").alias("source_id"), F.col("_yr").alias("oy")), "source_id")
          .join(r.select(F.col("item_id").alias("target_id"), F.col("_yr").alias("ry")), "target_id"))
    fz = _cut(fz)
    guard = year_guard(F.col("oy"), F.col("ry"))
    stages.append(fz.filter(guard).select("source_id", "target_id", F.lit("fuzzy").alias("stage")))
    matches = stages[0]
    for m in stages[1:]:
        matches = matches.unionByName(m)
    matches = _cut(matches)  # four tables are made from it
    out_rich = combine_ratings(absorb(rich, ml_items, matches), ml_inter, matches, 0.65)
    items = out_rich.unionByName(_unmatched(ml_items, matches), allowMissingColumns=True)
    return {"items": items, "interactions": remap(ml_inter, matches), "matches": matches,
            "year_rejected": fz.filter(~guard).select("source_id", "target_id")}


def resolve_books(spark: SparkSession, rich: DataFrame, bx_items: DataFrame, bx_inter: DataFrame,
                  t: float = 88.0) -> dict[str, DataFrame]:
    """Cover from the ISBN where empty; exact normalised title (first rich
    item), else fuzzy >= t; absorb views; ratings (1-10) halved and blended
    with max weight 0.60; re-point interactions; unmatched books kept."""
    isbn = F.regexp_replace("item_id", "^bx_", "")
    bx = bx_items.withColumn("thumbnail_url", F.when(F.coalesce(F.col("thumbnail_url"), F.lit("")) == "",
                                                     F.concat(F.lit("https://covers.openlibrary.org/b/isbn/"), isbn,
                                                              F.lit("-M.jpg"))).otherwise(F.col("thumbnail_url")))
    rk = (rich.select(norm_title("title").alias("_n"), F.col("item_id").alias("target_id"), _ord(rich).alias("_o"))
          .groupBy("_n").agg(F.min_by("target_id", "_o").alias("target_id")))
    m1 = (bx.select("item_id", norm_title("title").alias("_n")).join(rk, "_n")
          .select(F.col("item_id").alias("source_id"), "target_id", F.lit("exact").alias("stage")))
    rest = bx.join(m1.select(F.col("source_id").alias("item_id")), "item_id", "left_anti")
    m2 = fuzzy_stage(rich, rest, t).select("source_id", "target_id", F.lit("fuzzy").alias("stage"))
    matches = _cut(m1.unionByName(m2))
    out_rich = combine_ratings(absorb(rich, bx, matches), bx_inter, matches, 0.60, scale=2.0)
    items = out_rich.unionByName(_unmatched(bx, matches), allowMissingColumns=True)
    return {"items": items, "interactions": remap(bx_inter, matches), "matches": matches}


def resolve_games(spark: SparkSession, rawg: DataFrame, steam: DataFrame, t: float = 88.0) -> dict[str, DataFrame]:
    """Fuzzy >= t; absorb views; a target description shorter than 50
    characters is replaced in match order by non-empty matched descriptions
    until one of 50+ characters lands (first long one, else the last)."""
    matches = _cut(fuzzy_stage(rawg, steam, t).select("source_id", "target_id", F.lit("fuzzy").alias("stage")))
    d = (matches.join(steam.select(F.col("item_id").alias("source_id"), F.col("description").alias("sd"),
                                   _ord(steam).alias("so")), "source_id")
         .filter(F.coalesce(F.col("sd"), F.lit("")) != "")
         .groupBy("target_id").agg(
             F.min_by(F.when(F.length("sd") >= 50, F.col("sd")), F.when(F.length("sd") >= 50, F.col("so"))).alias("first_long"),
             F.max_by("sd", "so").alias("last_any")))
    g = absorb(rawg, steam, matches)
    g = g.join(d, g.item_id == d.target_id, "left")
    g = g.withColumn("description", F.when((F.length(F.coalesce("description", F.lit(""))) < 50) &
                                           F.col("last_any").isNotNull(),
                                           F.coalesce("first_long", "last_any")).otherwise(F.col("description")))
    g = g.drop("target_id", "first_long", "last_any")
    return {"items": g.unionByName(_unmatched(steam, matches), allowMissingColumns=True), "matches": matches}


def resolve_music(spark: SparkSession, spotify: DataFrame, lastfm: DataFrame, t: float = 80.0) -> dict[str, DataFrame]:
    """Artist (text after the last em dash) fuzzy >= t against distinct
    Spotify artists; the listeners go to the artist's first album; matched
    tracks are dropped, unmatched ones kept."""
    def artist(col):
        has = F.col(col).contains("—")
        return F.when(has, norm_title(F.substring_index(F.col(col), "—", -1))).otherwise(norm_title(F.col(col)))
    sp = spotify.withColumn("_a", artist("title")).withColumn("_o", _ord(spotify))
    first_album = sp.groupBy("_a").agg(F.min_by("item_id", "_o").alias("album_id"), F.min("_o").alias("a_ord"))
    right = first_album.select(F.col("album_id").alias("id"), F.col("_a").alias("key"), F.col("a_ord").alias("ord"))
    left = lastfm.select(F.col("item_id").alias("id"), artist("title").alias("key"))
    hit = fuzzy_best_match(left, right, t).select(F.col("l_id").alias("source_id"), F.col("r_id").alias("target_id"))
    matches = _cut(hit.withColumn("stage", F.lit("artist")))
    out = absorb(spotify, lastfm, matches)
    return {"items": out.unionByName(_unmatched(lastfm, matches), allowMissingColumns=True), "matches": matches}


def resolution_summary(results: dict[str, DataFrame], counts: dict[tuple[str, str], DataFrame] | None = None) -> DataFrame:
    """Rows (stage, n, resolver): matches per resolver and stage, and for each
    (resolver, measure) of ``counts`` how many rows its table has."""
    from .sets import union_all
    parts = [m.groupBy("stage").agg(F.count(F.lit(1)).alias("n")).withColumn("resolver", F.lit(name))
             for name, m in results.items()]
    parts += [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(measure).alias("stage"), "n", F.lit(name).alias("resolver"))
              for (name, measure), d in (counts or {}).items()]
    return union_all(parts)


def build_catalogue(spark: SparkSession, src: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Resolve every domain in order, union the resolved lists (the first
    list wins per id) and report items per type."""
    from .aggregates import catalogue_type_report
    from .sets import assemble_catalogue, union_all
    mv = resolve_movies(spark, src["tmdb_movies"], src["ml_items"], src["ml_interactions"], src.get("ml_links"))
    bk = resolve_books(spark, src["openlibrary"], src["bx_items"], src["bx_interactions"])
    gm = resolve_games(spark, src["rawg"], src["steam"])
    mu = resolve_music(spark, src["spotify"], src["lastfm"])
    art = src["newsdata"].withColumn("_src", F.lit(0)).unionByName(src["newsapi"].withColumn("_src", F.lit(1)))
    art = art.withColumn("ord", F.struct(F.col("_src"), _ord(art).alias("o")))
    kept_art = dedup_articles(spark, art.select(F.col("item_id").alias("id"), "title", "ord"), 90.0)
    articles = art.join(kept_art.filter("kept").select(F.col("id").alias("item_id")), "item_id", "left_semi") \
        .drop("_src", "ord")
    tv, yt = src["tmdb_tv"], src["youtube"]
    kept_v = dedup_videos(spark, tv.select(F.col("item_id").alias("id"), "title", _ord(tv).alias("ord")),
                          yt.select(F.col("item_id").alias("id"), "title", _ord(yt).alias("ord")), 90.0)
    videos = tv.unionByName(yt).join(kept_v.filter("kept").select(F.col("id").alias("item_id")), "item_id",
                                     "left_semi")
    products = src["food"].unionByName(src["amazon"], allowMissingColumns=True)
    cols = [c for c in mv["items"].columns if c != "ord"]
    lists = [x.select(*[c for c in cols if c in x.columns]) for x in
             (mv["items"], bk["items"], gm["items"], mu["items"], articles, videos, products)]
    items = assemble_catalogue(lists)
    inter = union_all([mv["interactions"], bk["interactions"], src.get("other_interactions", mv["interactions"].limit(0))])
    resolved = {"movies": (mv, src["ml_items"]), "books": (bk, src["bx_items"]), "games": (gm, src["steam"]), "music": (mu, src["lastfm"])}
    counts = {(name, "unmatched"): _unmatched(given, out["matches"]) for name, (out, given) in resolved.items()}
    counts |= {(name, "combined"): out["matches"].join(inter.where("rating > 0").select(F.col("item_id").alias("source_id")).distinct(),
                                                       "source_id", "left_semi").select("target_id").distinct()
               for name, out, inter in (("movies", mv, src["ml_interactions"]), ("books", bk, src["bx_interactions"]))}
    counts |= {("movies", "year_mismatch"): mv["year_rejected"], ("articles", "deduped"): kept_art.where("NOT kept"),
               ("videos", "deduped"): kept_v.where("NOT kept")}
    summary = resolution_summary({name: out["matches"] for name, (out, _) in resolved.items()}, counts)
    return {"items": items, "interactions": inter, "report": catalogue_type_report(spark, items),
            "summary": summary}
