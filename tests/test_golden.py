"""Golden rows of FIXTURES.md part D (our own arithmetic)."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from rivulet.functions import scalars as S
from rivulet.operators.experiments import ab_significance


SIG = [  # n1, c1, n2, c2, z, p, lift, status
    (3, 1, 2, 0, None, None, None, "insufficient"),
    (500, 50, 500, 125, 6.2419, 0.0, 150.0, "significant"),
    (100, 10, 100, 20, 1.9803, 0.04767, 100.0, "significant"),
    (200, 40, 200, 60, 2.3094, 0.020921, 50.0, "significant"),
    (100, 0, 100, 10, 3.2444, 0.001177, None, "significant"),
    (100, 30, 100, 30, 0.0, 1.0, 0.0, "not significant"),
    (10, 10, 10, 10, 0.0, 1.0, 0.0, "no variance"),
    (10, 30, 10, 25, None, None, None, "rate_above_one"),
]


def test_significance_golden(spark):
    df = spark.createDataFrame([r[:4] for r in SIG], "control_requests int, control_interactions int, "
                               "treatment_requests int, treatment_interactions int")
    out = {(r.control_requests, r.control_interactions, r.treatment_requests, r.treatment_interactions): r
           for r in ab_significance(df).collect()}
    for n1, c1, n2, c2, z, p, lift, status in SIG:
        r = out[(n1, c1, n2, c2)]
        assert r.status == status
        if z is None:
            assert r.z_score is None
        else:
            assert round(r.z_score, 4) == pytest.approx(z, abs=1e-4)
        if p is None:
            assert r.p_value is None
        else:
            assert round(r.p_value, 6) == pytest.approx(p, abs=2e-6)
        if lift is None:
            assert r.lift_pct is None
        else:
            assert round(r.lift_pct, 2) == pytest.approx(lift)


@pytest.mark.parametrize("rich,avg,n,w,expected", [
    (4.7, 4.15, 50000, 0.65, 4.34), (4.7, 4.15, 9, 0.65, 4.7), (4.0, 3.0, 10, 0.65, 3.90),
    (4.0, 3.0, 2750, 0.65, 3.35), (4.0, 3.0, 5000, 0.60, 3.40)])
def test_combined_rating_golden(spark, rich, avg, n, w, expected):
    df = spark.createDataFrame([(rich, avg, n)], "rich double, avg double, n long")
    got = df.select(S.combined_rating("rich", "avg", "n", w).alias("x")).first().x
    assert got == pytest.approx(expected)


def test_titles_golden(spark):
    df = spark.createDataFrame([("Dark Knight, The (2008)",), ("The Dark Knight (2008)",), ("Inception (2010)",)],
                               "t string")
    r = df.select(S.fix_trailing_article("t").alias("f"), S.norm_title("t").alias("n"),
                  S.title_year("t").alias("y")).collect()
    assert r[0].f == "The Dark Knight (2008)"
    assert r[1].n == "dark knight 2008"
    assert r[2].y == "2010"


def test_token_sort_ratio_golden():
    from rivulet.operators.resolve import token_sort_ratio
    assert token_sort_ratio("dark knight", "dark night") == pytest.approx(100 * 2 * 10 / 21)
    assert token_sort_ratio("inception", "conception") == pytest.approx(100 * 2 * 8 / 19)


def test_sha_mod_matches_python(spark):
    ids = [str(i) for i in range(300)] + ["user_x", "ünïcode"]
    df = spark.createDataFrame([(i,) for i in ids], "u string")
    got = {r.u: (r.a, r.b) for r in df.select("u", S.sha_mod("u", 100).alias("a"),
                                             S.sha_mod("u", 1000003).alias("b")).collect()}
    for i in ids:
        h = int(hashlib.sha256(i.encode()).hexdigest(), 16)
        assert got[i] == (h % 100, h % 1000003)


def test_normal_cdf_accuracy(spark):
    xs = [x / 10 for x in range(-40, 41)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", S.normal_cdf("x").alias("c")).collect():
        assert abs(r.c - 0.5 * (1 + math.erf(r.x / math.sqrt(2)))) < 1e-7


INTENTS = [
    ("show me trending videos", "category_filter", "show me trending", "video"),
    ("find educational courses for programming", "category_filter", "find educational", "course"),
    ("recommend action movies similar to marvel", "similar_to", "marvel", "video"),
    ("popular music from this year", "category_filter", "popular", "music"),
    ("best products for home office", "category_filter", "best", "product"),
    ("comedy podcasts", "category_filter", "comedy", "podcast"),
    ("movies about space", "category_filter", "movie", "video"),
    ("unlike jazz", "similar_to", "jazz", None),
    ("find me jazz", "recommendation_request", "jazz", None),
    ("how to play chess", "educational", "play chess", "game"),
    ("trending cooking", "trending", "cooking", None),
    ("quantum", "general", "quantum", None),
]


def test_intents_golden(spark):
    from rivulet.operators.intents import classify_intent
    df = spark.createDataFrame([(i, q) for i, (q, *_) in enumerate(INTENTS)], "query_id long, text string")
    got = {r.query_id: r for r in classify_intent(df).collect()}
    for i, (_, intent, target, hint) in enumerate(INTENTS):
        assert (got[i].intent, got[i].target, got[i].type_hint) == (intent, target, hint)


def test_features_golden(spark):
    """Profile and item of the reference's feature test; publish date = as_of."""
    from rivulet.operators.recommend import FEATURES, features
    as_of = F.lit("2024-06-01 00:00:00").cast("timestamp")
    prof = {
        "profile": spark.createDataFrame([("u1", 10, 45.0, 3.5, "US", "web", "25-34")],
                                         "user_id string, interaction_count long, avg_dwell_time double, "
                                         "avg_rating double, country string, device string, age_group string"),
        "categories": spark.createDataFrame([("u1", "Action", 5), ("u1", "Drama", 3)],
                                            "user_id string, category string, n long"),
        "types": spark.createDataFrame([("u1", "video", 7), ("u1", "article", 3)],
                                       "user_id string, content_type string, n long"),
        "tags": spark.createDataFrame([("u1", "action", 4), ("u1", "thriller", 3), ("u1", "drama", 2)],
                                      "user_id string, tag string, n long"),
    }
    items = spark.createDataFrame([("i1", "Test Movie", "video", "Action", ["action", "thriller"], 4.2, 1000,
                                    None)], "item_id string, title string, content_type string, category string, "
                                            "tags array<string>, rating double, view_count long, "
                                            "publish_ts timestamp")
    pairs = spark.createDataFrame([("u1", "i1", 30)], "user_id string, item_id string, dwell_seconds int")
    row = features(pairs, prof, items, as_of).first()
    vals = [row[c] for c in FEATURES]
    expected = [10, 45.0, 3.5, 4.2, 6.908754779, 0, 0.5, 30, 1.0, 2.1, 23.724575511, 0.7, 0.7,
                6.908754779, 2.397895273]
    assert vals[:15] == pytest.approx(expected, abs=1e-6)
    assert vals[15:23] == [1.0] + [0.0] * 7
    assert vals[23:28] == [0.0, 1.0, 0.0, 0.0, 0.0]
    assert vals[28:32] == [1.0, 0.0, 0.0, 0.0]
    year_old = items.withColumn("publish_ts", F.lit("2023-06-02 00:00:00").cast("timestamp"))
    fr = features(pairs, prof, year_old, as_of).first()["freshness"]
    assert fr == pytest.approx(1 / (1 + 365 * 24 / 720), abs=1e-6)


def test_norm_title_reads_whole_first_lines(spark, tmpdir_path):
    from rivulet.plans.registry import load_all
    head = "The " + "long title " * 20
    rows = [(1, head + "Night (1999)\nsecond (2001)"), (2, head + "Day (2004)"), (3, "A Short, one\nx"), (4, None), (5, "")]
    docs = [(i, t, "en", "s") for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmpdir_path}/documents.parquet")
    out = {r.doc_id: (r.norm_title, r.title_year) for r in load_all()["norm_title_whole"].build(spark, tmpdir_path).collect()}
    body = "long title " * 20
    assert out == {1: (body + "night 1999", "1999"), 2: (body + "day 2004", "2004"), 3: ("short one", ""), 4: (None, None), 5: ("", "")}
