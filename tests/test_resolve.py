"""Similarity join and greedy dedup against brute force on corpus titles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from rivulet.functions.scalars import norm_title
from rivulet.operators import resolve as RS
from rivulet.sources import binding as B


def test_lcs_bit_parallel_matches_dp():
    import random
    rnd = random.Random(7)

    def dp(a, b):
        prev = [0] * (len(b) + 1)
        for ch in a:
            cur = [0]
            for j, bj in enumerate(b):
                cur.append(prev[j] + 1 if ch == bj else max(prev[j + 1], cur[j]))
            prev = cur
        return prev[-1]
    for _ in range(300):
        a = "".join(rnd.choice("abcde ") for _ in range(rnd.randint(0, 30)))
        b = "".join(rnd.choice("abcde ") for _ in range(rnd.randint(0, 30)))
        assert RS.lcs_len(a, b) == dp(a, b)


@pytest.fixture(scope="module")
def titles(spark):
    rows = (B.corpus(spark, SF_MID).select("doc_id", "source", norm_title(F.substring("title", 1, 80)).alias("t"))
            .orderBy("source", "doc_id").collect())
    return [(r.doc_id, r.t) for r in rows]


@pytest.mark.parametrize("t", [80.0, 88.0, 90.0])
def test_similar_keys_equals_brute_force(spark, titles, t):
    keys = sorted({" ".join(sorted(x.split())) for _, x in titles})
    brute = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1:] if RS.ratio(a, b) >= t}
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {(r.ka, r.kb) for r in RS.similar_keys(df, t).collect()}
    assert got == brute


@pytest.mark.parametrize("t", [80.0, 88.0, 90.0])
@pytest.mark.parametrize("block", [1024, 8])
def test_similar_keys_of_whole_lines(spark, monkeypatch, t, block):
    """Whole first lines, up to thousands of characters, in blocks of any size."""
    monkeypatch.setattr(RS, "BLOCK_KEYS", block)
    rows = B.corpus(spark, SF_SMALL).select(RS.token_sort(norm_title("title")).alias("k")).distinct().collect()
    keys = sorted(r.k for r in rows if r.k)
    assert max(map(len, keys)) > 1000
    brute = {}
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if 2 * min(len(a), len(b)) >= t / 100 * (len(a) + len(b)) and (r := RS.ratio(a, b)) >= t:
                brute[a, b] = r
    df = spark.createDataFrame([(k,) for k in [*keys, *keys[:5], "", None]], "k string")
    got = RS.similar_keys(df, t).collect()
    assert {(r.ka, r.kb): r.score for r in got} == pytest.approx(brute) and len(got) == len(brute) and brute
    some, rest = set(keys[::3]), set(keys[1::2])
    pairs = RS.similar_keys(df.where(F.col("k").isin(*some)), t, df.where(F.col("k").isin(*rest))).collect()
    assert {(r.ka, r.kb) for r in pairs} == {(a, b) for a, b in brute if (a in some and b in rest) or (b in some and a in rest)}


def test_signature_bounds_hold():
    import random

    import numpy as np
    rnd = random.Random(5)
    ends = np.cumsum((0, *RS.BUCKETS))
    for _ in range(2000):
        a, b = ("".join(rnd.choice("abcdé ") for _ in range(rnd.randint(1, 40))) for _ in range(2))
        if rnd.random() < 0.7:
            b = "".join(c for c in a if rnd.random() < 0.9) + "x"
        d = len(a) + len(b) - 2 * RS.lcs_len(a, b)
        x, y = (np.frombuffer(RS.signature(s), "<i2").astype(int) for s in (a, b))
        for q in range(3):
            assert np.abs(x[ends[q]:ends[q + 1]] - y[ends[q]:ends[q + 1]]).sum() <= (2 * q + 1) * d
        import pandas as pd
        assert RS.ratio_batch(pd.Series([a]), pd.Series([b]))[0] == pytest.approx(RS.ratio(a, b))


def test_dedup_equals_sequential_loop(spark, titles):
    kept, norms = [], []
    for doc_id, t in titles:
        if not any(RS.token_sort_ratio(t, k) >= 90 for k in norms):
            kept.append(doc_id)
            norms.append(t)
    items = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(titles)], "id long, title string, ord long")
    got = {r.id for r in RS.dedup_articles(spark, items, 90.0).filter("kept").collect()}
    assert got == set(kept)


def test_greedy_chain_keeps_first_and_third(spark):
    nodes = spark.createDataFrame([("A", 0, False), ("B", 1, False), ("C", 2, False)],
                                  "id string, ord long, pre_kept boolean")
    edges = spark.createDataFrame([("A", "B"), ("B", "C")], "l_id string, r_id string")
    got = {r.id for r in RS.greedy_keep(spark, nodes, edges).filter("kept").collect()}
    assert got == {"A", "C"}


def test_dedup_videos_keeps_first_list(spark):
    first = spark.createDataFrame([(1, "Space Show", 0), (2, "space show", 1)], "id long, title string, ord long")
    second = spark.createDataFrame([(3, "The Space Show", 0), (4, "Cooking Hour", 1), (5, "cooking hour!", 2)],
                                   "id long, title string, ord long")
    got = {r.id for r in RS.dedup_videos(spark, first, second, 90.0).filter("kept").collect()}
    assert got == {1, 2, 4}


def test_fuzzy_best_match_ties_to_first(spark):
    left = spark.createDataFrame([(1, "dark night")], "id long, key string")
    right = spark.createDataFrame([(10, "dark knight", 5), (11, "dark knight", 2), (12, "zzz", 0)],
                                  "id long, key string, ord long")
    r = RS.fuzzy_best_match(left, right, 88.0).collect()
    assert [(x.l_id, x.r_id) for x in r] == [(1, 11)]


def _items(spark, rows):
    return spark.createDataFrame(rows, "item_id string, title string, content_type string, category string, "
                                       "tags array<string>, description string, thumbnail_url string, "
                                       "publish_ts timestamp, duration_seconds int, rating double, "
                                       "view_count long")


def _inter(spark, rows):
    return spark.createDataFrame([(f"i{i}", u, it, "view", None, 10, r, None) for i, (u, it, r) in enumerate(rows)],
                                 "interaction_id string, user_id string, item_id string, interaction_type string, "
                                 "timestamp timestamp, dwell_seconds int, rating double, context string")


def test_resolve_movies(spark):
    import datetime as dt
    d = dt.datetime
    rich = _items(spark, [("tmdb_movie_155", "The Dark Knight", "movie", "Action", [], "", "", d(2008, 7, 1), None,
                           4.7, 1000),
                          ("tmdb_movie_27205", "Inception", "movie", "Sci-Fi", [], "", "", d(2010, 7, 1), None,
                           4.4, 500),
                          ("tmdb_movie_9", "Heat", "movie", "Crime", [], "", "", d(1995, 1, 1), None, 4.0, 10)])
    ml = _items(spark, [("ml_movie_1", "Dark Knight, The", "movie", "Action", [], "Year: 2008. Genres: Action.", "",
                         None, None, 3.0, 100),
                        ("ml_movie_2", "Inceptionn", "movie", "Sci-Fi", [], "Year: 2010. Genres: Sci-Fi.", "", None,
                         None, 3.0, 50),
                        ("ml_movie_3", "Heat", "movie", "Crime", [], "Year: 1980. Genres: Crime.", "", None, None,
                         3.0, 7),
                        ("ml_movie_4", "Unknown Film", "movie", "Drama", [], "Year: 2001. Genres: Drama.", "", None,
                         None, 3.0, 1)])
    inter = _inter(spark, [("u", "ml_movie_1", 4.0)] * 12 + [("u", "ml_movie_4", 2.0)])
    out = RS.resolve_movies(spark, rich, ml, inter)
    m = {(r.source_id, r.target_id, r.stage) for r in out["matches"].collect()}
    assert m == {("ml_movie_1", "tmdb_movie_155", "exact"), ("ml_movie_2", "tmdb_movie_27205", "fuzzy")}
    assert {(r.source_id, r.target_id) for r in out["year_rejected"].collect()} == {("ml_movie_3", "tmdb_movie_9")}
    items = {r.item_id: r for r in out["items"].collect()}
    assert set(items) == {"tmdb_movie_155", "tmdb_movie_27205", "tmdb_movie_9", "ml_movie_3", "ml_movie_4"}
    assert items["tmdb_movie_155"].view_count == 1100 and items["tmdb_movie_27205"].view_count == 550
    w = min(0.65, 0.1 + 12 / 5000)
    assert items["tmdb_movie_155"].rating == pytest.approx(round((1 - w) * 4.7 + w * 4.0, 2))
    assert {r.item_id for r in out["interactions"].collect()} == {"tmdb_movie_155", "ml_movie_4"}
    links = spark.createDataFrame([("4", "9")], "source_id string, tmdb_id string")
    out2 = RS.resolve_movies(spark, rich, ml, inter, links)
    assert ("ml_movie_4", "tmdb_movie_9", "bridge") in {(r.source_id, r.target_id, r.stage)
                                                       for r in out2["matches"].collect()}


def test_resolve_books_games_music(spark):
    ol = _items(spark, [("ol_W1", "Clara Callan", "article", "Fiction", [], "", "x", None, None, 0.0, 10)])
    bx = _items(spark, [("bx_0001", "Clara Callan", "article", "Books", [], "", "", None, None, 4.0, 5),
                        ("bx_0002", "Other Book", "article", "Books", [], "", "", None, None, 4.0, 5)])
    bint = _inter(spark, [("u", "bx_0001", 8.0)] * 10)
    b = RS.resolve_books(spark, ol, bx, bint)
    items = {r.item_id: r for r in b["items"].collect()}
    assert set(items) == {"ol_W1", "bx_0002"} and items["ol_W1"].view_count == 15
    assert items["bx_0002"].thumbnail_url == "https://covers.openlibrary.org/b/isbn/0002-M.jpg"
    w = min(0.60, 0.1 + 10 / 5000)
    assert items["ol_W1"].rating == pytest.approx(round((1 - w) * 3.0 + w * 4.0, 2))
    rawg = _items(spark, [("rawg_1", "Half-Life 2", "game", "Action", [], "short", "", None, None, 4.5, 100)])
    steam = _items(spark, [("steam_9", "Half Life 2", "game", "Action", [], "A long description " * 4, "", None, None,
                            4.0, 40), ("steam_8", "Portal", "game", "Puzzle", [], "p", "", None, None, 4.0, 1)])
    g = {r.item_id: r for r in RS.resolve_games(spark, rawg, steam)["items"].collect()}
    assert set(g) == {"rawg_1", "steam_8"} and g["rawg_1"].view_count == 140
    assert g["rawg_1"].description.startswith("A long description")
    sp = _items(spark, [("spotify_a", "Album One — Eminem", "music", "Pop", [], "", "", None, None, 4.0, 100),
                        ("spotify_b", "Album Two — Eminem", "music", "Pop", [], "", "", None, None, 4.0, 100)])
    lf = _items(spark, [("lastfm_1", "Song — Eminemm", "music", "Pop", [], "", "", None, None, 4.0, 7),
                        ("lastfm_2", "Song — Adele", "music", "Pop", [], "", "", None, None, 4.0, 3)])
    mu = {r.item_id: r.view_count for r in RS.resolve_music(spark, sp, lf)["items"].collect()}
    assert mu == {"spotify_a": 107, "spotify_b": 100, "lastfm_2": 3}


@pytest.mark.parametrize("walk", [200_000, 0])
def test_greedy_keep_of_long_chains(spark, walk):
    """A chain keeps every second node, by walking and by rounds of joins."""
    from pyspark.sql import functions as F
    from rivulet.operators.resolve import greedy_keep
    n = 3000 if walk else 24
    nodes = spark.range(n).select(F.col("id").cast("string").alias("id"), F.col("id").alias("ord"), F.lit(False).alias("pre_kept"))
    edges = spark.range(n - 1).select(F.col("id").cast("string").alias("l_id"), (F.col("id") + 1).cast("string").alias("r_id"))
    kept = {int(r["id"]) for r in greedy_keep(spark, nodes, edges, walk).collect() if r["kept"]}
    assert kept == set(range(0, n, 2))


def test_pairs_are_verified_as_arrays_where_they_meet(spark, monkeypatch):
    """Ratios of many pairs at once, of any width, and blocks that do not
    multiply with the keys; no table of unverified pairs is made."""
    import random
    rnd = random.Random(2)
    a = ["".join(rnd.choice("abcd é漢😀") for _ in range(n)) for n in (1, 5, 63, 64, 65, 128, 500, 2048, 2100) for _ in range(20)]
    b = ["".join(c for c in x if rnd.random() < rnd.choice((0.7, 0.9, 0.99))) + "z" for x in a]
    for t in (0.0, 88.0):
        for x, y, got in zip(a, b, RS.ratios_reaching(a, b, t)):
            assert got == RS.ratio(x, y) if RS.ratio(x, y) >= t else got < t
    monkeypatch.setattr(RS, "BLOCK_KEYS", 2)
    seen = []
    monkeypatch.setattr(RS, "_cut", lambda df, real=RS._cut: (seen.append(df.columns), real(df))[1])
    keys = spark.createDataFrame([(f"{k:03d} same words in a row",) for k in range(200)], "k string")
    assert RS.similar_keys(keys, 85.0).count() == sum(RS.ratio(f"{i:03d} same words in a row", f"{j:03d} same words in a row") >= 85 for i in range(200) for j in range(i))
    assert seen == [["k", "side"], ["ka", "kb", "score"]]


@pytest.mark.parametrize("together", [1, 256])
def test_ratios_across_words_of_the_state(monkeypatch, together):
    """Edits near and beyond the places that a match can reach, keys of one to
    many words of 63 places, letters outside the basic plane."""
    monkeypatch.setattr(RS, "TOGETHER", together)
    rng = np.random.default_rng(5)
    letters = np.array(list("ab cd\u00e9\U0001d11e"))
    for t in (60.0, 88.0, 90.0, 100.0):
        a, b = [], []
        for n in (1, 2, 62, 63, 64, 126, 127, 200, 700):
            for part in (0.0, 0.05, 0.1, 0.15, 0.4):
                x = rng.choice(letters, n)
                hit = rng.random(n) < part
                y = [z for c, h in zip(x, hit) for z in ([c] if not h else [] if rng.random() < 0.5 else [c, letters[rng.integers(7)]])] or ["a"]
                a.append("".join(x))
                b.append("".join(y))
                a.append("".join(np.roll(x, n // 8)))  # the best match is far from the same places
                b.append("".join(x))
        for x, y, got in zip(a, b, RS.ratios_reaching(a, b, t)):
            want = RS.ratio(x, y)
            assert got == want if want >= t else got < t


def test_characters_and_grams_drop_no_pair():
    rng = np.random.default_rng(6)
    keys = sorted({"".join(rng.choice(list("abcde fgh"), rng.integers(1, 90))) for _ in range(120)})
    keys += [k[:-1] + chr(0x4E00 + i) for i, k in enumerate(keys) if len(k) > 9]
    side = RS._Texts(keys)
    size = RS._coded(side)
    assert size > RS.BUCKETS[0]  # rare characters share buckets
    counts, flags = RS._counts(side, size, np.int16), np.full(len(keys), 3)
    for t in (50.0, 80.0, 90.0):
        got = {(min(side.keys[x], side.keys[y]), max(side.keys[x], side.keys[y])) for i, j in RS.near_counts(side, counts, side, counts, flags, flags, t, True) for x, y in zip(i, j)}
        assert {(min(x, y), max(x, y)) for n, x in enumerate(keys) for y in keys[:n] if RS.ratio(x, y) >= t} <= got


def test_a_key_is_sent_to_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(RS, "BLOCK_KEYS", 2)
    keys = spark.createDataFrame([(f"{i:03d} words of one length", 3) for i in range(300)], "k string, side int")
    assert RS.similar_pairs(keys, 90.0).rdd.getNumPartitions() <= 64
