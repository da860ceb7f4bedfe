"""Library functions without a query of their own."""

from pyspark.sql import functions as F

from rivulet.functions import scalars as S
from rivulet.operators import joins as J
from rivulet.operators import resolve as RS
from rivulet.operators import sets
from rivulet.operators.ranking import sort_results
from rivulet.operators.topk import rank_all


def test_bridge_join_needs_three_parts_and_a_number(spark):
    left = spark.createDataFrame([("1",), ("2",), ("3",)], "source_key string")
    links = spark.createDataFrame([("1", "tmdb_movie_7"), ("2", "tmdb_8"), ("3", "tmdb_movie_x")], "source_id string, target_id string")
    right = spark.createDataFrame([("tmdb_movie_7",), ("tmdb_8",), ("tmdb_movie_x",)], "item_id string")
    assert [(r.source_key, r.target_id) for r in J.bridge_join(left, links, right).collect()] == [("1", "tmdb_movie_7")]


def test_title_year_join_and_year_guard(spark):
    left = spark.createDataFrame([(1, "The Thing (1982)", None), (2, "The Thing", None), (3, "Alien", "1979")], "l int, title string, year string")
    right = spark.createDataFrame([(10, "Thing (1982)", None), (11, "thing", None), (12, "ALIEN", "1979"), (13, "Alien", "1986")], "r int, title string, year string")
    got = J.title_year_join(left.withColumn("title", F.regexp_replace("title", r" \\([0-9]+\\)", "")).withColumn("year", F.coalesce("year", F.when(F.col("l") == 1, "1982"))),
                            right.withColumn("title", F.regexp_replace("title", r" \\([0-9]+\\)", "")).withColumn("year", F.coalesce("year", F.when(F.col("r") == 10, "1982"))))
    assert sorted((r["l"], r["r"]) for r in got.select("l", "r").collect()) == [(1, 10), (3, 12)]
    years = spark.createDataFrame([("1990", "1991"), ("1990", "1992"), (None, "1990"), ("1990", None)], "a string, b string")
    assert [r[0] for r in years.select(J.year_guard(F.col("a"), F.col("b"))).collect()] == [True, False, True, True]


def test_artist_key_and_item_card(spark):
    rows = spark.createDataFrame([("Song — The Band",), ("The Band",), (None,)], "t string")
    keys = [r[0] for r in rows.select(S.artist_key("t")).collect()]
    assert keys[0] == keys[1] == "band" and not keys[2]


def test_sets_of_lists(spark):
    a, b = (spark.createDataFrame(r, "item_id string, title string") for r in ([("1", "a"), ("2", "b")], [("2", "other"), ("3", "c")]))
    assert {(r.item_id, r.title) for r in sets.assemble_catalogue([a, b]).select("item_id", "title").collect()} == {("1", "a"), ("2", "b"), ("3", "c")}
    assert sets.union_all([a, b]).count() == 4


def test_rank_of_a_whole_table(spark):
    df = spark.range(1000).repartition(7).select(F.col("id").cast("string").alias("item_id"), (F.col("id") % 10).cast("double").alias("rating"))
    want = [r.item_id for r in df.orderBy(F.col("rating").desc(), "item_id").collect()]
    got = {r["sort_rank"]: r.item_id for r in sort_results(df, "rating").collect()}
    assert [got[k + 1] for k in range(1000)] == want
    assert sort_results(df, "rating", k=5).orderBy("sort_rank").first().item_id == want[0]
    assert rank_all(df.where("item_id = 'none'"), ["item_id"]).count() == 0


def catalogue(spark, rows):
    return spark.createDataFrame([(i, t, "movie", "c", "d" * 60, "", r, v, k) for k, (i, t, r, v) in enumerate(rows)],
                                 "item_id string, title string, content_type string, category string, description string, thumbnail_url string, "
                                 "rating double, view_count long, ord long").withColumn("publish_ts", F.lit(None).cast("timestamp")).withColumn("tags", F.array(F.lit("t")))


def test_build_catalogue(spark):
    inter = lambda rows: spark.createDataFrame(rows, "user_id string, item_id string, interaction_type string, dwell_seconds int, rating double")
    src = {"tmdb_movies": catalogue(spark, [("tmdb_movie_1", "Dark Knight (2008)", 4.0, 5)]),
           "ml_items": catalogue(spark, [("ml_movie_1", "Dark Knight, The (2008)", 3.0, 2), ("ml_movie_2", "Quiet Lake (1999)", 3.0, 1)]),
           "ml_interactions": inter([("u", "ml_movie_1", "like", 1, 5.0), ("u", "ml_movie_2", "view", 1, 3.0)]),
           "openlibrary": catalogue(spark, [("ol_1", "Green Hills", 4.0, 1)]), "bx_items": catalogue(spark, [("bx_9", "The Green Hills", 4.0, 3)]),
           "bx_interactions": inter([("u", "bx_9", "like", 1, 8.0)]),
           "rawg": catalogue(spark, [("rawg_1", "Space Race", 4.0, 1)]), "steam": catalogue(spark, [("steam_1", "space race", 4.0, 1), ("steam_2", "Farm Days", 4.0, 1)]),
           "spotify": catalogue(spark, [("sp_1", "Album — Some Band", 4.0, 1)]), "lastfm": catalogue(spark, [("lf_1", "Track — Some Band", 4.0, 7)]),
           "newsdata": catalogue(spark, [("nd_1", "A big day in town", 4.0, 1)]), "newsapi": catalogue(spark, [("na_1", "A Big Day in Town!", 4.0, 1), ("na_2", "Other news", 4.0, 1)]),
           "tmdb_tv": catalogue(spark, [("tv_1", "Night Show", 4.0, 1)]), "youtube": catalogue(spark, [("yt_1", "night show", 4.0, 1), ("yt_2", "cooking", 4.0, 1)]),
           "food": catalogue(spark, [("f_1", "Bread", 4.0, 1)]), "amazon": catalogue(spark, [("a_1", "Lamp", 4.0, 1)])}
    out = RS.build_catalogue(spark, src)
    assert {r.item_id for r in out["items"].collect()} == {"tmdb_movie_1", "ml_movie_2", "ol_1", "rawg_1", "steam_2", "sp_1", "nd_1", "na_2", "tv_1", "yt_2", "f_1", "a_1"}
    assert {(r.user_id, r.item_id) for r in out["interactions"].collect()} == {("u", "tmdb_movie_1"), ("u", "ml_movie_2"), ("u", "ol_1")}
    summary = {(r.resolver, r.stage): r.n for r in out["summary"].collect()}
    assert summary[("movies", "exact")] == 1 and summary[("movies", "unmatched")] == 1 and summary[("movies", "combined")] == 1
    assert summary[("books", "combined")] == 1 and summary[("books", "unmatched")] == 0 and summary[("games", "unmatched")] == 1
    assert summary[("articles", "deduped")] == 1 and summary[("videos", "deduped")] == 1 and summary[("movies", "year_mismatch")] == 0
