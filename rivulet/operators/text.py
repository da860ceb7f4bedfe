"""Text and vector operators.

Vectors are kept in long form ``(id, term, weight)`` or as rows of term
numbers and weights.  The k documents with the largest inner product are found
with bounds: distinct vectors are laid out in blocks by the term that weighs
most in them, a block's largest weight per term bounds every score in it, and a
query goes only to blocks whose bound reaches the k-th score that it already
has.  A task multiplies one block with the queries that need it and lets at
most k rows per query out.  The number of blocks stays the same over a wide
range of sizes, so that no vector is sent more often as the tables grow.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from .topk import rank_within, top_k

TOKEN_RE = r"[\p{L}\p{N}_]{2,}"


def tokenize(col) -> F.Column:
    """Lower-case words of two or more word characters (stop words kept)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_RE), 0)


def tokenize_sql(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), '{TOKEN_RE}')"


def stop_words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in K.STOP_WORDS], "term string")


def stop_words_sql() -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in K.STOP_WORDS) + ")"


def term_rows(spark: SparkSession, docs: DataFrame, id_col: str, text) -> DataFrame:
    """(id, term) rows, one per token occurrence, stop words removed by a
    broadcast anti join against the fixed stop-word table."""
    t = docs.select(F.col(id_col).alias("id"), F.explode(tokenize(text)).alias("term"))
    return t.join(F.broadcast(stop_words(spark)), "term", "left_anti")


def term_counts(spark: SparkSession, docs: DataFrame, id_col: str, text) -> DataFrame:
    return term_rows(spark, docs, id_col, text).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def counted(spark: SparkSession, docs: DataFrame, id_col: str, text) -> DataFrame:
    """``term_counts`` as a written table: the vocabulary and the vectors are
    both made from it, and the texts are split into words once."""
    from .components import written
    return written(term_counts(spark, docs, id_col, text), "terms")


def fit_tfidf(spark: SparkSession, docs: DataFrame, id_col: str, text,
              max_features: int = 1000, counts: DataFrame | None = None) -> DataFrame:
    """Vocabulary: the ``max_features`` most frequent terms (corpus count
    desc, term); smoothed idf = ln((1 + N) / (1 + df)) + 1."""
    tc = counts if counts is not None else term_counts(spark, docs, id_col, text)
    stats = tc.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))
    vocab = top_k(stats, [F.col("cf").desc(), F.col("term").asc()], max_features)
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    return vocab.withColumn("idf", F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0)


def tfidf_vectors(spark: SparkSession, docs: DataFrame, id_col: str, text,
                  vocab: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """L2-normalised tf-idf weights in long form (id, term, weight).

    The vocabulary has at most ``max_features`` rows (a proven bound), so it
    is broadcast."""
    tc = counts if counts is not None else term_counts(spark, docs, id_col, text)
    w = tc.join(F.broadcast(vocab.select("term", "idf")), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return (w.join(norms, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("weight")))


def score_queries(qvec: DataFrame, dvec: DataFrame) -> DataFrame:
    """Cosine (dot of unit vectors) of each query with each document sharing
    a term; work is bounded by the postings of the query terms."""
    q = qvec.select(F.col("id").alias("query_id"), "term", F.col("weight").alias("qw"))
    d = dvec.select(F.col("id").alias("item_id"), "term", F.col("weight").alias("dw"))
    return (q.join(d, "term").groupBy("query_id", "item_id")
            .agg(F.sum(F.col("qw") * F.col("dw")).alias("similarity")))


def vector_search(spark: SparkSession, queries: DataFrame, docs: DataFrame, id_col: str, text,
                  k: int = 10, max_features: int = 1000, threshold: float = 0.01) -> DataFrame:
    """Query text through the corpus model; cosine > threshold; top k."""
    counts = counted(spark, docs, id_col, text)
    vocab = fit_tfidf(spark, docs, id_col, text, max_features, counts)
    dvec = sparse_rows(tfidf_vectors(spark, docs, id_col, text, vocab, counts), vocab)
    qvec = sparse_rows(tfidf_vectors(spark, queries, "query_id", "text", vocab), vocab)
    out = topk_inner(qvec, dvec, max_features, k).where(F.col("similarity") > threshold)
    return out.select(F.col("id").alias("query_id"), F.col("other").alias("item_id"), "similarity", "rank")


# ------------------------------------------------------ top-k inner products

#: A side is laid out in about BLOCKS blocks of BLOCK_ROWS to BLOCK_MOST
#: vectors each, so that a vector is sent about BLOCKS times at most; a query's
#: first scores come from SEEDS of them.  A task multiplies TOGETHER queries
#: with BLOCK_ROWS documents at a time.
BLOCK_ROWS, BLOCK_MOST, BLOCKS, TOGETHER, SEEDS = 1024, 65_536, 16, 512, 2
#: Below the smallest gap between two bounds or scores that counts.
SLACK = 1e-8


def _coded(rows: DataFrame) -> DataFrame:
    """(id, cls, idx, val) of the usable rows; rows of one ``cls`` have the
    same vector to 12 digits."""
    val = F.transform("val", lambda x: F.rint(x * 1e12))
    same = F.unhex(F.substring(F.sha2(F.to_json(F.struct("idx", val.alias("val"))), 256), 1, 32))
    finite = F.forall("val", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("val").isNotNull() & finite).select("id", same.alias("cls"), "idx", "val")


def _vectors(coded: DataFrame) -> DataFrame:
    """Each distinct vector once, with its smallest id."""
    return coded.groupBy("cls").agg(F.min("id").alias("first"), F.first("idx").alias("idx"), F.first("val").alias("val"))


def _entries(rows: DataFrame, *keep: str) -> DataFrame:
    """One row (``keep``, t, w) per weight; without ``idx`` a vector's places are its terms."""
    return rows.select(*keep, "idx", F.posexplode("val").alias("at", "w")).select(*keep, F.coalesce(F.get("idx", "at"), "at").alias("t"), "w")


def _blocks(vectors: DataFrame) -> DataFrame:
    """``vectors`` (a checkpointed table) with ``block``: vectors that weigh the
    same or neighbouring terms most, so that blocks differ in their maxima."""
    size = max(BLOCK_ROWS, min(BLOCK_MOST, -(-vectors.count() // BLOCKS)))
    top = F.array_position(F.transform("val", F.abs), F.array_max(F.transform("val", F.abs))).cast("int")
    placed = vectors.withColumn("main", F.when(top > 0, F.coalesce(F.get("idx", top - 1), top - 1)).otherwise(-1))
    counts = placed.groupBy("main").agg(F.count(F.lit(1)).alias("n"))  # at most dim + 1 rows
    before = Window.orderBy("main").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    block = F.floor((F.col("start") + F.pmod(F.xxhash64("cls"), F.col("n"))) / size).cast("int")
    return placed.join(F.broadcast(counts), "main").select("cls", "first", "idx", "val", block.alias("block"))


def _parts(idx, val) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of all entries of vectors."""
    sizes = np.fromiter(map(len, val), np.int64, len(val))
    rows = np.repeat(np.arange(len(val)), sizes)
    if not len(rows):
        return rows, rows, np.zeros(0)
    terms = np.concatenate([np.arange(len(v)) if i is None else np.asarray(i, np.int64) for i, v in zip(idx, val)])
    return rows, terms, np.concatenate([np.asarray(v, np.float64) for v in val])


def _dense(idx, val, dim: int) -> np.ndarray:
    rows, terms, weights = _parts(idx, val)
    m = np.zeros((len(val), dim))
    m[rows, terms] = weights
    return m


def _bound(asks: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """No vector whose weights are between ``lo`` and ``hi`` scores higher."""
    return np.maximum(asks, 0) @ hi.T + np.minimum(asks, 0) @ lo.T


def _extremes(blocks: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's largest and smallest weight of each term, zero where some
    vector lacks it: two numbers per block and term, whatever its size."""
    ends = _entries(blocks, "block").groupBy("block", "t").agg(F.max("w").alias("hi"), F.min("w").alias("lo")).toPandas()
    n = (blocks.agg(F.max("block")).first()[0] or 0) + 1
    hi, lo = np.zeros((n, dim)), np.zeros((n, dim))
    at = ends["block"].to_numpy(np.int64), ends["t"].to_numpy(np.int64)
    hi[at], lo[at] = np.maximum(ends["hi"].to_numpy(np.float64), 0), np.minimum(ends["lo"].to_numpy(np.float64), 0)
    return hi, lo


def _blocks_to_ask(ends, dim: int, positive: bool):
    """Two columns: the SEEDS blocks with a query's highest bounds, and the
    others whose bound reaches its floor."""
    def bounds(idx, val):
        for at in range(0, len(val), TOGETHER):
            b = _bound(_dense(idx[at:at + TOGETHER], val[at:at + TOGETHER], dim), *ends.value)
            yield from np.where(b > -SLACK if positive else True, b, -np.inf)

    @F.pandas_udf("array<int>")
    def seeds(idx: pd.Series, val: pd.Series) -> pd.Series:
        return pd.Series([[int(j) for j in np.argsort(-b, kind="stable")[:SEEDS] if b[j] > -np.inf] for b in bounds(idx.tolist(), val.tolist())], dtype=object)

    @F.pandas_udf("array<int>")
    def rest(idx: pd.Series, val: pd.Series, first: pd.Series, floor: pd.Series) -> pd.Series:
        out = []
        for b, done, least in zip(bounds(idx.tolist(), val.tolist()), first, floor.to_numpy(np.float64)):
            go = np.isfinite(b) & ((b >= least - SLACK) | np.isnan(least))
            go[np.asarray(done, np.int64)] = False
            out.append(np.flatnonzero(go).tolist())
        return pd.Series(out, dtype=object)

    return seeds, rest


def _best_in_block(k: int, dim: int, positive: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        def by_main(part):
            main = [-1 if not len(v) else (j if i is None else i[j]) for i, v, j in zip(part["idx"], part["val"], [int(np.argmax(np.abs(v))) if len(v) else 0 for v in part["val"]])]
            return part.iloc[np.argsort(np.array(main, np.int64), kind="stable")]

        asks, docs = by_main(pdf[pdf["asks"]]), by_main(pdf[~pdf["asks"]].sort_values("first", kind="stable"))
        place = np.empty(len(docs), np.int64)  # ties go to the smaller first id
        place[np.argsort(docs["first"].to_numpy(), kind="stable")] = np.arange(len(docs))
        rows, terms, weights = _parts(docs["idx"].tolist(), docs["val"].tolist())
        cuts = list(range(0, len(docs), BLOCK_ROWS))
        hi, lo, small = np.zeros((len(cuts), dim)), np.zeros((len(cuts), dim)), []
        for c, at in enumerate(cuts):
            a, b = np.searchsorted(rows, (at, at + BLOCK_ROWS))
            cols, local = np.unique(terms[a:b], return_inverse=True)
            np.maximum.at(hi[c], terms[a:b], weights[a:b])
            np.minimum.at(lo[c], terms[a:b], weights[a:b])
            small.append((a, b, cols, local))
        out = []
        for q in range(0, len(asks), TOGETHER):
            some = asks.iloc[q:q + TOGETHER]
            m = _dense(some["idx"].tolist(), some["val"].tolist(), dim)
            floor = np.nan_to_num(some["floor"].to_numpy(np.float64), nan=-np.inf)
            score, which = np.full((len(m), k), -np.inf), np.full((len(m), k), -1)
            bounds, size = _bound(m, hi, lo), np.sqrt((m * m).sum(axis=1))
            for c in np.argsort(-bounds.mean(axis=0), kind="stable"):
                r = np.flatnonzero(bounds[:, c] >= floor - SLACK)
                if not len(r):
                    continue
                a, b, cols, local = small[c]
                d = np.zeros((min(BLOCK_ROWS, len(docs) - cuts[c]), len(cols)))
                d[rows[a:b] - cuts[c], local] = weights[a:b]
                # single precision on unit scale says who can reach the floor; those are scored in full
                mine, far = m[np.ix_(r, cols)], max(float(np.sqrt((d * d).sum(axis=1).max())), 1e-300)
                scale = np.maximum(size[r] * far, 1e-300)
                rough = (mine / np.maximum(size[r], 1e-300)[:, None]).astype(np.float32) @ (d / far).astype(np.float32).T
                slip = 1.2e-7 * (len(cols) + 4)
                least = (floor[r] - SLACK) / scale - slip
                fresh = np.flatnonzero(floor[r] == -np.inf)
                if len(fresh) and rough.shape[1] > k:
                    least[fresh] = np.partition(rough[fresh], -k, axis=1)[:, -k] - 2 * slip - SLACK / scale[fresh]
                x, y = np.nonzero(rough >= least.astype(np.float32)[:, None] - np.float32(1e-7))
                exact = np.round(np.concatenate([np.einsum("ij,ij->i", mine[x[j:j + 20_000]], d[y[j:j + 20_000]])
                                                 for j in range(0, max(len(x), 1), 20_000)]), 9)
                keep = exact > 0 if positive else exact > -np.inf
                x, y, exact = x[keep], y[keep], exact[keep]
                # what the queries had, and the new ones, best first
                who = np.r_[np.repeat(np.arange(len(r)), k), x]
                got, at = np.r_[score[r].ravel(), exact], np.r_[which[r].ravel(), y + cuts[c]]
                order = np.lexsort((place[at], -got, who))
                who, got, at = who[order], got[order], at[order]
                nth = np.arange(len(who)) - np.searchsorted(who, who)
                keep = nth < k
                score[r[who[keep]], nth[keep]], which[r[who[keep]], nth[keep]] = got[keep], at[keep]
                floor[r] = np.maximum(floor[r], score[r, k - 1])
            i, j = np.nonzero(score > -np.inf)
            out.append(pd.DataFrame({"ask": some["cls"].to_numpy()[i], "cls": docs["cls"].to_numpy()[which[i, j]],
                                     "first": docs["first"].to_numpy()[which[i, j]], "similarity": score[i, j]}))
        return pd.concat(out)
    return run


def topk_inner(queries: DataFrame, docs: DataFrame, dim: int, k: int, exclude_self: bool = False, positive: bool = True) -> DataFrame:
    """Exact top-k inner products of each query with the documents:
    id, other, similarity, rank (ties to the smaller id).  Null ids and vectors
    that are null or hold nulls or non-finite numbers take no part.

    Both sides are (id, idx array<int>, val array<double>), a null idx standing
    for all places in order; ``positive`` keeps similarities above zero only.
    Each distinct vector is compared once.  It is first scored in the SEEDS
    blocks with the highest bounds; its k-th score there is a floor, and it
    goes on only to blocks whose bound reaches it.  A task does the same once
    more inside its block, and lets at most k rows per query out."""
    from .components import reliable
    spark, same = docs.sparkSession, queries is docs
    held = reliable(_coded(docs.select("id", "idx", "val")))
    asked = held if same else reliable(_coded(queries.select("id", "idx", "val")))
    blocks = _blocks(reliable(_vectors(held)))
    parts = blocks if same else _blocks(reliable(_vectors(asked)))
    # a query's own id may be in as many classes as it has vectors
    own = (held.groupBy("id").agg(F.countDistinct("cls").alias("n")).agg(F.max("n")).first()[0] or 0) if exclude_self else 0
    most = k + own
    hi, lo = _extremes(blocks, dim)
    seeds_of, rest_of = _blocks_to_ask(spark.sparkContext.broadcast((hi, lo)), dim, positive)
    tasks = max(_tasks(docs), min(1024, len(hi) * ((parts.agg(F.max("block")).first()[0] or 0) + 1)))
    kind = dict(held.dtypes)["id"]

    def scored(asks: DataFrame) -> DataFrame:
        met = asks.select("block", "part").distinct()
        asks = asks.select("block", "part", F.lit(True).alias("asks"), "cls", F.lit("0").cast(kind).alias("first"), "idx", "val", "floor")
        docs = blocks.join(met, "block").select("block", "part", F.lit(False).alias("asks"), "cls", "first", "idx", "val", F.lit(None).cast("double").alias("floor"))
        return (asks.unionByName(docs).repartition(tasks, "block", "part").groupBy("block", "part")
                .applyInPandas(_best_in_block(most, dim, positive), f"ask binary, cls binary, first {kind}, similarity double"))

    best = [F.col("similarity").desc(), F.col("first").asc()]
    asks = parts.where(F.size("val") > 0).select("cls", F.col("block").alias("part"), "idx", "val")
    asks = reliable(asks.withColumn("seeds", seeds_of("idx", "val")))
    found = reliable(scored(asks.select("*", F.explode("seeds").alias("block"), F.lit(None).cast("double").alias("floor"))))
    if len(hi) > SEEDS:
        floor = rank_within(found, ["ask"], best, most).where(F.col("rank") == most).select(F.col("ask").alias("cls"), F.col("similarity").alias("floor"))
        rest = asks.join(floor, "cls", "left").withColumn("block", F.explode(rest_of("idx", "val", "seeds", "floor")))
        # read twice, for the queries and for the blocks that they meet
        found = found.unionByName(scored(reliable(rest.select("cls", "part", "idx", "val", "floor", "block"))))
    classes = rank_within(found, ["ask"], best, most).select("ask", "cls", "similarity")
    # the first ids of a class, with how often each occurs
    members = rank_within(held.groupBy("cls", "id").agg(F.count(F.lit(1)).alias("n")), ["cls"], [F.col("id").asc()], most, "_r").drop("_r")
    lists = rank_within(classes.join(members, "cls"), ["ask"], [F.col("similarity").desc(), F.col("id").asc()], most)
    lists = lists.groupBy(F.col("ask").alias("cls")).agg(F.sort_array(F.collect_list(F.struct("rank", F.col("id").alias("other"), "similarity", "n"))).alias("l"))
    near = F.filter("l", lambda x: x["other"] != F.col("id")) if exclude_self else F.col("l")
    out = asked.select("id", "cls").join(lists, "cls").select("id", F.explode(F.slice(near, 1, k)).alias("e"))
    out = out.select("id", "e.other", F.round("e.similarity", 9).alias("similarity"), F.explode(F.array_repeat(F.lit(0), F.least(F.col("e.n"), F.lit(k)).cast("int"))).alias("_n")).drop("_n")
    return rank_within(out, ["id"], [F.col("similarity").desc(), F.col("other").asc()], k)


def _tasks(df: DataFrame) -> int:
    """Tasks for block products: twice the cluster's cores."""
    return max(2, df.sparkSession.sparkContext.defaultParallelism * 2)


def sparse_rows(vec: DataFrame, vocab: DataFrame) -> DataFrame:
    """Long-form vectors -> (id, idx, val) rows with term indexes 0..V-1
    (vocabulary bounded by max_features, so the index table is broadcast)."""
    idx = vocab.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("tix"))
    j = vec.join(F.broadcast(idx), "term")
    return j.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("tix", "weight"))).alias("e")).select(
        "id", F.col("e.tix").alias("idx"), F.col("e.weight").alias("val"))


def content_similar(spark: SparkSession, items: DataFrame, k: int = 10, max_features: int = 1000,
                    of: DataFrame | None = None) -> DataFrame:
    """Cosine of each item's tf-idf vector to every other item, top k; given
    ``of`` (item_id), of those items only."""
    text = F.concat_ws(" ", "title", "description", "category",
                       F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "))
    docs = items.select("item_id", text.alias("text"))
    from .components import reliable
    counts = counted(spark, docs, "item_id", "text")
    vocab = fit_tfidf(spark, docs, "item_id", "text", max_features, counts)
    rows = sparse_rows(tfidf_vectors(spark, docs, "item_id", "text", vocab, counts), vocab)
    rows = reliable(rows)
    asks = rows if of is None else rows.join(of.select(F.col("item_id").alias("id")).distinct(), "id", "left_semi")
    out = topk_inner(asks, rows, max_features, k, exclude_self=True)
    return out.select(F.col("id").alias("item_id"), F.col("other").alias("sim_id"), "similarity", "rank")


def dense_cosine_topk(vectors: DataFrame, id_col: str, vec_col: str, dim: int, k: int = 5) -> DataFrame:
    """Top-k cosine neighbours on stored dense vectors.  Bounds prune as far
    as vectors cluster; nearly isotropic ones meet block by block."""
    v = vectors.select(F.col(id_col).alias("id"), F.transform(vec_col, lambda x: x.cast("double")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    rows = v.select("id", F.lit(None).cast("array<int>").alias("idx"),
                    F.transform("v", lambda x: F.try_divide(x, norm)).alias("val"))
    out = topk_inner(rows, rows, dim, k, exclude_self=True, positive=False)
    return out.select(F.col("id").alias(id_col), F.col("other").alias("neighbour"), "similarity", "rank")
