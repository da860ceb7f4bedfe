import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import types as T

from rivulet.llm import hash_index, ngram_lm, queries
from rivulet.llm.elias_fano import EliasFano, TrieLevel

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                        T.StructField("code", T.StringType()), T.StructField("v", T.StringType()), T.StructField("rank", T.StringType())])


def brute(x: dict, queries: list, k: int) -> dict:
    ids = np.array(sorted(x))
    m = np.array([x[i] for i in ids])
    out = {}
    for q in queries:
        s = m @ x[q]
        keep = ids != q
        order = np.lexsort((ids[keep], -s[keep]))[:k]
        out[q] = list(zip(ids[keep][order].tolist(), s[keep][order].tolist()))
    return out


def found(df) -> dict:
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "c", "v", "r") for i, v in rows], VECTORS)


def test_recall_on_a_whole_table(spark):
    got = found(queries.op8_multi_index_hashing(spark, SF_SMALL))
    rows = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()
    x = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in rows}
    expect = brute(x, [i for i in x if i % 20 == 0], 20)
    assert got.keys() == expect.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in expect[q]}) for q in expect)
    assert hits >= 0.9 * 20 * len(expect)
    for q, pairs in got.items():
        assert all(s == pytest.approx(float(x[i] @ x[q]), abs=1e-12) for i, s in pairs)
        assert pairs == sorted(pairs, key=lambda p: (-p[1], p[0]))


@pytest.mark.parametrize("norms", [False, True])
def test_clustered_vectors_in_several_blocks(spark, monkeypatch, norms):
    monkeypatch.setattr(hash_index, "SHARD_ROWS", 100)
    monkeypatch.setattr(hash_index, "QUERY_BLOCK", 20)
    monkeypatch.setattr(hash_index, "FIT_ROWS", 300)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    m = centres[rng.integers(0, 12, 900)] + 0.4 * rng.normal(size=(900, 16))
    if norms:
        m *= rng.uniform(0.3, 3, (900, 1))
    x = dict(enumerate(m))
    df = frame(spark, [(i, v.tolist()) for i, v in x.items()])
    got = found(hash_index.nearest(df, df.where("vec_id % 20 = 0"), 10))
    expect = brute(x, [i for i in x if i % 20 == 0], 10)
    assert got.keys() == expect.keys() and all(len(v) == 10 for v in got.values())
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in expect[q]}) for q in expect) >= 0.9 * 10 * len(expect)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = {0: [1.0, 0.0], 20: [1.0, 0.0], 21: [1.0, 0.0], 22: [0.0, 2.0], 40: [-1.0, -1.0]}
    bad = [(60, None), (61, [0.0, 0.0]), (62, [nan, 1.0]), (63, [inf, 1.0]), (64, [None, 1.0]), (65, []), (66, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = frame(spark, [*good.items(), *bad, (0, good[0])])
    got = found(hash_index.nearest(df, df.where("vec_id % 20 = 0"), 20))
    x = {i: np.array(v) for i, v in good.items()}
    assert got == brute(x, [0, 20, 40], 20)
    assert hash_index.nearest(df.limit(0), df, 20).count() == 0
    one = frame(spark, [(0, [1.0, 2.0])])
    assert hash_index.nearest(one, one, 20).count() == 0


def test_one_very_common_vector(spark):
    rng = np.random.default_rng(4)
    x = {i: (np.ones(8) if i % 3 else rng.normal(size=8)) for i in range(600)}
    df = frame(spark, [(i, v.tolist()) for i, v in x.items()])
    got = found(hash_index.nearest(df, df.where("vec_id % 20 = 0"), 5))
    expect = brute(x, [i for i in x if i % 20 == 0], 5)
    for q in expect:
        if q % 3:  # its nearest are its equals, smallest ids first
            assert [i for i, _ in got[q]] == [i for i, _ in expect[q]]


def test_probe_budgets_cover_the_radius():
    rng = np.random.default_rng(3)
    for radius in range(0, 65):
        r = hash_index.budgets(radius)
        for _ in range(20):
            far = np.zeros(64, np.uint64)
            far[rng.permutation(64)[:radius]] = 1
            code = np.array([int("".join(map(str, far.tolist())), 2)], np.uint64)
            assert any(np.bitwise_count(hash_index.substring(code, i))[0] <= r[i] for i in range(hash_index.SUBSTRINGS))


@pytest.mark.parametrize("n, universe", [(0, 10), (1, 1), (1, 1000), (50, 60), (1000, 1 << 20), (20_000, 1 << 40), (5000, 5000)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    v = np.unique(rng.integers(0, universe, n).astype(np.uint64))
    ef = EliasFano.build(v, universe)
    x = np.r_[rng.integers(0, universe, 2000).astype(np.uint64), v[:500]]
    at = np.searchsorted(v, x)
    assert (ef.successor(x) == at).all()
    hit = np.array([a < len(v) and v[a] == y for a, y in zip(at, x)])
    assert (ef.find(x) == np.where(hit, at, -1)).all()
    assert len(v) == 0 or (ef.at(np.arange(len(v))) == v).all()


def test_trie_level_from_a_mapped_file():
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 500, 20_000).astype(np.uint64) << np.uint64(32) | rng.integers(0, 3000, 20_000).astype(np.uint64))
    context, word = pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)
    codes = rng.integers(1, 256, len(pairs)).astype(np.uint8)
    level = TrieLevel.mapped(TrieLevel.build(context, word, codes).dump())
    assert (level.lookup(context, word) == codes).all()
    known = dict(zip(zip(context.tolist(), word.tolist()), codes.tolist()))
    a, b = rng.integers(0, 700, 5000).astype(np.uint64), rng.integers(0, 4000, 5000).astype(np.uint64)
    assert level.lookup(a, b).tolist() == [known.get(k, 0) for k in zip(a.tolist(), b.tolist())]
    empty = TrieLevel.build(context[:0], word[:0], codes[:0])
    assert TrieLevel.load(empty.dump()).lookup(a, b).sum() == 0


def test_squeeze_round_trip():
    for kind in (np.uint8, np.uint32, np.uint64):
        for n in (0, 1, 1000):
            a = np.sort(np.random.default_rng(n).integers(0, 255, n).astype(kind))
            assert (ngram_lm.expand(ngram_lm.squeeze(a), kind) == a).all() and (ngram_lm.expand(ngram_lm.squeeze(a, True), kind, True) == a).all()


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()) + [None]


def check_scores(rows, out):
    docs = [(i, words_of(t)) for i, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs]
    counts, pairs = Counter(), Counter()
    for (_, w), h in zip(docs, held):
        if not h:
            counts.update(w)
            pairs.update(zip([None, *w[:-1]], w))
    total, k = sum(counts.values()), ngram_lm.PRIOR
    expect = []
    for (i, w), h in zip(docs, held):
        p = [(counts[x] + 0.1) / (total + 0.1 * (len(counts) + 1)) for x in w]
        score = sum(math.log10(pairs[a, b] / (counts[a] + k) + k / (counts[a] + k) * q) for a, b, q in zip([None, *w[:-1]], w, p))
        expect.append((i or 0, h, len(w), sum(counts[x] > 0 for x in w), total, sum(map(math.log10, p)), score))
    got = [(r["doc_id"] or 0, *[r[c] for c in ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")]) for r in out]
    assert len(got) == len(expect)
    for a, b in zip(sorted(got), sorted(expect)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
        assert abs(a[6] - b[6]) <= ngram_lm.STEP / 2 * b[2] + 1e-6  # half a quantum per token at most
    return sum(r[6] for r in got if r[1]), sum(r[5] for r in got if r[1])


@pytest.mark.parametrize("shard, block", [(2_000_000, 2_000_000), (20_000, 5_000)])
def test_lm_scores_equal_the_plain_model(spark, monkeypatch, shard, block):
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", shard)
    monkeypatch.setattr(ngram_lm, "BLOCK_TOKENS", block)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    scores, model = ngram_lm.train_and_score(docs)
    score, base = check_scores([(r["doc_id"], r["text"]) for r in docs.collect()], scores.collect())
    assert score > base  # of held-out documents
    levels = {(r["shard"], r["level"]) for r in model.collect()}
    assert {lv for _, lv in levels} == {1, 2}


def test_lm_of_odd_rows(spark, odd, odd_rows, nothing):
    check_scores([(r[0], r[1]) for r in odd_rows], ngram_lm.train_and_score(odd)[0].collect())
    assert ngram_lm.train_and_score(nothing)[0].count() == 0
    alone = odd.where("doc_id = 9")  # held out or not, a table of one document
    check_scores([(9, "one two")], ngram_lm.train_and_score(alone)[0].collect())
