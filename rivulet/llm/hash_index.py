"""Nearest neighbours by multi-index hashing.

Vectors get 64-bit codes by a learned rotation (ITQ, fitted on a bounded
sample).  A code is split into substrings and each is an index of all rows:
two codes within Hamming radius R agree within r_i bits on at least one
substring i when the (r_i + 1) add up to R + 1 (pigeonhole).  A query probes
in every index all keys within r_i, which retrieves every code within R; the
survivors of the whole-code test are ranked by the double-precision inner
product of the original vectors.  R is the smallest radius that held the
target share of true neighbours on the sample.  Queries that find fewer than
k within R are answered anew over all radii, so that none falls short.

Larger inner products need not mean smaller angles when norms differ: codes
are made of (x, sqrt(M^2 - |x|^2)) with M the largest norm.

Index rows lie in shards by (substring, first bits of its key), split into
blocks by count; queries come to the shards their probes reach, in blocks.
Of equal vectors only the k + 1 smallest ids are indexed, which is exact, as
ties go to smaller ids.

Defined cases: vectors that are null, empty, zero, of another length than
most of the sample, or that hold null or non-finite components take no part,
neither as queries nor as candidates; null ids take no part; of repeated rows
(same id) the smallest vector counts; an empty table gives an empty result.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, prepare

BITS, SUBSTRINGS = 64, 4
WIDTH = BITS // SUBSTRINGS
FIT_ROWS = 10_000
FIT_QUERIES = 300
SHARD_ROWS = 8192
QUERY_BLOCK = 4096


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) with vectors as arrays of doubles."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0")
    good = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return rows.where(good & F.exists("v", lambda x: x != 0))


class Codes:
    """The learned rotation and the radius."""

    def __init__(self, sample: np.ndarray, largest: float, k: int, recall: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.largest, dim = largest, sample.shape[1] + 1
        x = self.lift(sample)
        values, vectors = np.linalg.eigh(x.T @ x / len(x))
        first = vectors[:, ::-1][:, :BITS]
        if first.shape[1] < BITS:  # fewer dimensions than bits: random directions on top
            first = np.hstack([first, rng.normal(size=(dim, BITS - first.shape[1]))])
        z = x @ first
        r = np.linalg.qr(rng.normal(size=(BITS, BITS)))[0]
        for _ in range(30):
            u, _, w = np.linalg.svd(np.sign(z @ r).T @ z)
            r = (u @ w).T
        self.matrix = first @ r
        self.radius = self._radius(sample, k, recall, rng)

    def lift(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        extra = np.zeros(len(v)) if query else np.sqrt(np.maximum(0, self.largest ** 2 - (v * v).sum(1)))
        return np.hstack([v, extra[:, None]])

    def __call__(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        bits = self.lift(v, query) @ self.matrix > 0
        return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)

    def _radius(self, sample, k, recall, rng) -> int:
        """Smallest radius holding ``recall`` of the sample's true neighbours."""
        if len(sample) < 2:
            return BITS
        at = rng.permutation(len(sample))[:FIT_QUERIES]
        scores = sample[at] @ sample.T
        scores[np.arange(len(at)), at] = -np.inf
        top = np.argsort(-scores, axis=1)[:, :min(k, len(sample) - 1)]
        far = np.bitwise_count(self(sample[at], True)[:, None] ^ self(sample)[top])
        return int(np.quantile(far, recall, method="higher"))


def budgets(radius: int) -> list[int]:
    """r_i of each substring: the (r_i + 1) add up to radius + 1; -1 is no probe."""
    base, more = divmod(radius + 1, SUBSTRINGS)
    return [min(WIDTH, base - 1 + (i < more)) for i in range(SUBSTRINGS)]


def substring(codes: np.ndarray, i: int) -> np.ndarray:
    return ((codes >> np.uint64(WIDTH * (SUBSTRINGS - 1 - i))) & np.uint64((1 << WIDTH) - 1)).astype(np.uint16)


def probe(codes, rows_v, row_ids, q_codes, q_v, q_ids, q_least, i: int, r: list[int], radius: int, k: int, tile: int = 64):
    """Within one shard of index i: each query's k best rows among the codes
    within the radius that index i is the first to retrieve, and of scores
    that the query's bound allows."""
    order = np.argsort(substring(codes, i), kind="stable")
    codes, rows_v, row_ids = codes[order], rows_v[order], row_ids[order]
    keys, starts = np.unique(substring(codes, i), return_index=True)
    sizes = np.diff(np.r_[starts, len(codes)])
    out = []
    for at in range(0, len(q_ids), tile):
        qc, qv, qi = q_codes[at:at + tile], q_v[at:at + tile], q_ids[at:at + tile]
        # the keys present that lie among the query's probes
        q, key = np.nonzero(np.bitwise_count(substring(qc, i)[:, None] ^ keys[None, :]) <= r[i])
        n = sizes[key]
        q = np.repeat(q, n)
        row = np.repeat(starts[key] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(len(q))
        differ = qc[q] ^ codes[row]
        near = (np.bitwise_count(differ) <= radius) & (row_ids[row] != qi[q])
        q, row, differ = q[near], row[near], differ[near]
        for j in range(i):  # an earlier index retrieves it too
            late = np.bitwise_count(substring(differ, j)) > r[j]
            q, row, differ = q[late], row[late], differ[late]
        score = np.concatenate([np.einsum("ij,ij->i", qv[q[s:s + 50_000]], rows_v[row[s:s + 50_000]])
                                for s in range(0, max(1, len(q)), 50_000)])
        high = score >= q_least[at:at + tile][q]
        q, ids, score = q[high], row_ids[row[high]], score[high]
        best = np.lexsort((ids, -score, q))
        q, ids, score = q[best], ids[best], score[best]
        first = np.searchsorted(q, np.arange(len(qi)))
        top = np.arange(len(q)) - first[q] < k
        out.append((qi[q[top]], ids[top], score[top]))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def _encode(rows: DataFrame, codes, query: bool, sample=None, k: int = 0) -> DataFrame:
    """(vec_id, code, v), and for queries ``least``: the k-th best score among
    the other rows of the sample, which no row among the k nearest is below
    (here of 2 k, so that k are mostly found among those within the radius)."""
    def run(frames):
        for f in frames:
            v = np.array(f["v"].tolist(), np.float64).reshape(len(f), -1)
            out = pd.DataFrame({"vec_id": f["vec_id"], "code": codes(v, query).view(np.int64), "v": [x.tobytes() for x in v]})
            if query:
                ids, vectors = sample.value
                least = np.full(len(f), -np.inf)
                if len(ids) > k:
                    for at in range(0, len(f), 256):
                        scores = v[at:at + 256] @ vectors.T
                        scores[f["vec_id"].to_numpy()[at:at + 256, None] == ids[None, :]] = -np.inf
                        # rounding differs between ways to add up a product
                        least[at:at + 256] = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] - 1e-9 * codes.largest ** 2
                out["least"] = least
            yield out

    return rows.mapInPandas(run, "vec_id long, code long, v binary" + ", least double" * query)


def _search(queries: DataFrame, index: DataFrame, n_rows: int, n_queries: int, radius: int, k: int) -> DataFrame:
    r = budgets(radius)
    bits = max(0, min(WIDTH, int(np.ceil(np.log2(max(1, n_rows / SHARD_ROWS))))))

    def key(i):
        return F.shiftrightunsigned("code", WIDTH * (SUBSTRINGS - 1 - i)).bitwiseAND(F.lit((1 << WIDTH) - 1))

    def prefix(i):
        return F.shiftright(key(i), WIDTH - bits).cast("int")

    used = [i for i in range(SUBSTRINGS) if r[i] >= 0]
    placed = index.withColumn("at", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), prefix(i).alias("p")) for i in used])))
    placed = placed.select("vec_id", "code", "v", "at.i", "at.p")
    counts = placed.groupBy("i", "p").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("blocks"))  # <= 4 * 2**16 rows
    n_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    q_block = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int")
    rows = (placed.join(F.broadcast(counts), ["i", "p"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
            .withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
            .select("i", "p", "block", "q_block", "vec_id", "code", "v"))
    reach = F.array(*[F.struct(F.lit(i).alias("i"), prefix(i).alias("own"), F.lit(r[i]).alias("r")) for i in used])
    sent = (queries.withColumn("at", F.explode(reach)).select("vec_id", "code", "v", "least", "at.*")
            .join(F.broadcast(counts), "i").where(F.bit_count(F.col("own").bitwiseXOR(F.col("p"))) <= F.col("r"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("q_block", q_block)
            .select(F.col("i").alias("qi"), F.col("p").alias("qp"), F.col("block").alias("qb"), F.col("q_block").alias("qq"),
                    "vec_id", "code", "v", "least"))

    def run(key: tuple, some: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

        def arrays(f):
            return (f["code"].to_numpy(np.int64).view(np.uint64),
                    np.frombuffer(b"".join(f["v"]), np.float64).reshape(len(f), -1), f["vec_id"].to_numpy(np.int64))

        q, v, s = probe(*arrays(some), *arrays(asked), asked["least"].to_numpy(np.float64), int(key[0]), r, radius, k)
        return pd.DataFrame({"query_id": q, "vec_id": v, "score": s})

    found = rows.groupBy("i", "p", "block", "q_block").cogroup(sent.groupBy("qi", "qp", "qb", "qq")).applyInPandas(run, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            recall: float = 0.94) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of ``vectors`` for each
    row of ``queries`` by inner product, not counting the query's own id."""
    spark = prepare(vectors)
    kind = "query_id long, rank int, vec_id long, score double"
    def rows(df):
        return valid_vectors(df, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v"))

    valid = materialise(rows(vectors), "vectors")
    sample = [(r["vec_id"], r["v"]) for r in valid.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).collect()]
    if not sample:
        return spark.createDataFrame([], kind)
    lengths, counts = np.unique([len(v) for _, v in sample], return_counts=True)
    dim = int(lengths[np.argmax(counts)])
    valid = valid.where(F.size("v") == dim)
    largest = valid.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    ids, kept = np.array([i for i, v in sample if len(v) == dim]), np.array([v for _, v in sample if len(v) == dim], np.float64)
    fitted = Codes(kept, largest, k, recall)
    shared = spark.sparkContext.broadcast((ids, kept))  # FIT_ROWS vectors
    same = Window.partitionBy("v").orderBy("vec_id")
    distinct = valid.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1).select("vec_id", "v")
    index = materialise(_encode(distinct, fitted, False), "index")
    asked = materialise(_encode(rows(queries).where(F.size("v") == dim), fitted, True, shared, 2 * k), "queries")
    n_rows, n_queries = index.count(), asked.count()
    found = materialise(_search(asked, index, n_rows, n_queries, fitted.radius, k), "found")
    if fitted.radius >= BITS:
        return found
    # fewer than k candidates within the radius: all of them, exactly
    enough = found.where(F.col("rank") == min(k, n_rows - 1)).select(F.col("query_id").alias("vec_id"))
    short = materialise(asked.join(enough, "vec_id", "left_anti"), "short")
    n_short = short.count()
    if not n_short:
        return found
    again = _search(short, index, n_rows, n_short, BITS, k)
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
