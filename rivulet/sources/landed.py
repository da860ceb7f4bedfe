"""Landed-file sources -> canonical tables.

Files are read in parallel by Spark's CSV / JSON readers; every field rule is
a column expression.  Attributes the source lacks (ratings, view counts,
dwell, country, dates) are filled from a seeded hash of the row key instead
of a random generator, so a rerun (or a retried task) gives the same values.
Sampling is a seeded top-n by hash: repeatable and independent of
partitioning.  ``as_of`` replaces "now" for generated past dates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions.scalars import code_lookup, rating_to_interaction
from ..operators.topk import first_per_key, top_k

# FIXED VALUES — fill-in lists used by the loaders
COUNTRIES = ["US", "UK", "CA", "AU", "DE", "FR", "IN", "JP", "BR", "MX"]
DEVICES = ["web", "mobile", "tablet", "smart_tv"]
AGES_5 = ["18-24", "25-34", "35-44", "45-54", "55-64"]
STEAM_GENRES = ["Action", "Adventure", "RPG", "Strategy", "Simulation", "Puzzle", "Sports", "Indie"]
MUSIC_GENRES = ["Pop", "Rock", "Hip-Hop", "Electronic", "Jazz", "Classical", "Country", "R&B", "Indie", "Metal"]
AMAZON_CATEGORIES = ["Electronics", "Computers", "Phones", "Cameras", "Audio", "TV & Video",
                     "Car Electronics", "Wearables"]
TMDB_MOVIE_GENRE = {28: "Action", 12: "Adventure", 16: "Animation", 35: "Comedy", 80: "Crime",
                    99: "Documentary", 18: "Drama", 10751: "Family", 14: "Fantasy", 36: "History",
                    27: "Horror", 10402: "Music", 9648: "Mystery", 10749: "Romance", 878: "Sci-Fi",
                    53: "Thriller", 10752: "War", 37: "Western"}
TMDB_TV_GENRE = {10759: "Action", 16: "Animation", 35: "Comedy", 80: "Crime", 99: "Documentary",
                 18: "Drama", 10751: "Family", 9648: "Mystery", 10765: "Sci-Fi", 10766: "Soap", 37: "Western"}
YOUTUBE_CATEGORIES = {"1": "Film", "2": "Autos", "10": "Music", "15": "Pets", "17": "Sports", "19": "Travel",
                      "20": "Gaming", "22": "People", "23": "Comedy", "24": "Entertainment", "25": "News",
                      "26": "How-To", "27": "Education", "28": "Science", "29": "Nonprofits"}
TMDB_IMAGE_BASE = "https://image.tmdb.org/t/p/w500"
OPENLIBRARY_COVER = "https://covers.openlibrary.org/b/id/{}-M.jpg"


def _empty() -> F.Column:
    return F.array().cast("array<string>")


# ------------------------------------------------------------ seeded fills

def _u(key, seed: int, salt: str) -> F.Column:
    """Uniform [0, 1) from SHA-256 of (seed, salt, key)."""
    h = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), key.cast("string")), 256)
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(16 ** 13)


def seeded_fill(key, lo: float, hi: float, seed: int, salt: str, decimals: int | None = None) -> F.Column:
    """Value in [lo, hi] from the key: integers when ``decimals`` is None."""
    u = _u(key, seed, salt)
    if decimals is None:
        return (F.lit(lo) + F.floor(u * (hi - lo + 1))).cast("long")
    return F.round(F.lit(lo) + u * (hi - lo), decimals)


def seeded_pick(key, choices: list[str], seed: int, salt: str) -> F.Column:
    idx = F.floor(_u(key, seed, salt) * len(choices)).cast("int") + 1
    return F.element_at(F.array(*[F.lit(c) for c in choices]), idx)


def seeded_subset(key, choices: list[str], k_lo: int, k_hi: int, seed: int, salt: str) -> F.Column:
    """A seeded sample of k in [k_lo, k_hi] distinct choices."""
    arr = F.array(*[F.lit(c) for c in choices])
    order = F.transform(arr, lambda x: F.struct(
        F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), key.cast("string"), x), 256).alias("h"),
        x.alias("v")))
    k = seeded_fill(key, k_lo, k_hi, seed, salt + ":k").cast("int")
    return F.slice(F.transform(F.array_sort(order), lambda s: s["v"]), 1, k)


def seeded_sample(df: DataFrame, keys: list[str], n: int | None, seed: int) -> DataFrame:
    """At most n rows: the smallest seeded hashes of the key columns.  Counts
    by the hash's first four hex digits (65,536 numbers) tell which prefixes
    are in whole; only rows of the prefix at the cut are ranked."""
    if n is None:
        return df
    h = F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]), 256)
    hashed = df.withColumn("_h", h).withColumn("_p", F.substring("_h", 1, 4))
    left, cut = n, None
    for prefix, count in sorted(tuple(r) for r in hashed.groupBy("_p").count().collect()):
        if count > left:
            cut = prefix
            break
        left -= count
    if cut is None:
        return df
    whole = hashed.filter(F.col("_p") < cut)
    return whole.unionByName(top_k(hashed.filter(F.col("_p") == cut), [F.col("_h").asc()], left)).drop("_h", "_p")


def cut_text(c, n: int | None):
    """The first ``n`` characters, or all of it."""
    return c if n is None else F.substring(c, 1, n)


def past_date(key, seed: int, salt: str, as_of: str, max_days: int) -> F.Column:
    days = seeded_fill(key, 0, max_days, seed, salt)
    return (F.lit(as_of).cast("timestamp") - F.make_interval(days=days.cast("int")))


def dwell_for_type(itype: F.Column, key, seed: int) -> F.Column:
    return (F.when(itype == "like", seeded_fill(key, 300, 7200, seed, "dwell"))
            .when(itype == "view", seeded_fill(key, 60, 600, seed, "dwell"))
            .otherwise(seeded_fill(key, 5, 120, seed, "dwell"))).cast("int")


def _users_filled(ids: DataFrame, prefix: str, seed: int, ages: list[str] | None = None,
                  age_col: str | None = None) -> DataFrame:
    key = F.col("uid")
    age = F.col(age_col) if age_col else seeded_pick(key, ages or AGES_5, seed, "age")
    return ids.select(
        F.concat(F.lit(prefix), F.col("uid")).alias("user_id"),
        F.lit(None).cast("timestamp").alias("signup_ts"),
        seeded_pick(key, COUNTRIES, seed, "country").alias("country"),
        seeded_pick(key, DEVICES, seed, "device").alias("device"),
        age.alias("age_group"),
        seeded_subset(key, K.CONTENT_TYPES, 1, 4, seed, "prefs").alias("preferences"),
        F.lit(0).cast("long").alias("total_interactions"))


def _item(item_id, title, ctype, category, tags, description, thumb, rating, views, publish, duration=None):
    return [item_id.alias("item_id"), title.alias("title"), F.lit(ctype).alias("content_type"),
            category.alias("category"), tags.alias("tags"), description.alias("description"),
            thumb.alias("thumbnail_url"), publish.cast("timestamp").alias("publish_ts"),
            (duration if duration is not None else F.lit(None)).cast("int").alias("duration_seconds"),
            rating.cast("double").alias("rating"), views.cast("long").alias("view_count")]


def _interaction(iid, uid, item, itype, ts, dwell, rating, source: str):
    return [iid.alias("interaction_id"), uid.alias("user_id"), item.alias("item_id"),
            itype.alias("interaction_type"), ts.cast("timestamp").alias("timestamp"),
            dwell.cast("int").alias("dwell_seconds"), rating.cast("double").alias("rating"),
            F.lit('{"source": "%s"}' % source).alias("context")]


# ------------------------------------------------------------ MovieLens

def _movie_fields(df: DataFrame, title_col: str, genres_col: str) -> DataFrame:
    raw = F.col(title_col)
    year = F.regexp_extract(raw, r"\(([0-9]{4})\)\s*$", 1)
    return df.withColumn("year", F.when(year == "", "2000").otherwise(year)) \
             .withColumn("clean", F.trim(F.regexp_replace(raw, r"\s*\([0-9]{4}\)\s*$", ""))) \
             .withColumn("genres", F.split(F.col(genres_col), r"\|"))


def _movie_items(m: DataFrame, prefix: str, seed: int, views_hi: int) -> DataFrame:
    key = F.col("mid")
    cat = code_lookup(F.try_element_at("genres", F.lit(1)), K.GENRE_CATEGORY, "Drama")
    desc = F.concat(F.lit("Year: "), F.col("year"), F.lit(". Genres: "), F.array_join("genres", ", "), F.lit("."))
    pub = F.coalesce(F.make_timestamp(F.col("year").cast("int"), F.lit(6), F.lit(1), F.lit(0), F.lit(0), F.lit(0)),
                     F.make_timestamp(F.lit(2000), F.lit(6), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    return m.select(*_item(F.concat(F.lit(prefix), key), F.col("clean"), "movie", cat, F.col("genres"), desc,
                           F.lit(""), seeded_fill(key, 2.5, 5.0, seed, "rating", 1),
                           seeded_fill(key, 100, views_hi, seed, "views"), pub))


def ml1m_tables(spark: SparkSession, movies: str, ratings: str, users: str, max_ratings: int | None = None,
                seed: int = 42) -> dict[str, DataFrame]:
    """``::``-separated latin-1 files; short lines skipped; year from a
    trailing (dddd) (default 2000); first genre -> category."""
    def read(path, n):
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(n)])
        return (spark.read.schema(schema).option("sep", "::").option("encoding", "ISO-8859-1")
                .option("quote", "\u0000").option("mode", "PERMISSIVE").csv(path))
    mv = read(movies, 3).filter(F.col("c2").isNotNull()).select(F.trim("c0").alias("mid"), "c1", "c2")
    mv = _movie_fields(mv, "c1", "c2")
    items = _movie_items(mv, "ml_movie_", seed, 100_000)
    rt = read(ratings, 4).filter(F.col("c3").isNotNull()).select(
        F.trim("c0").alias("uid"), F.col("c1").alias("mid"), F.col("c2").cast("double").alias("score"),
        F.trim("c3").cast("long").alias("ts"))
    rt = seeded_sample(rt, ["uid", "mid", "ts"], max_ratings, seed)
    rt = rt.join(mv.select("mid"), "mid", "left_semi")
    itype = rating_to_interaction("score")
    key = F.concat_ws("_", "uid", "mid", "ts")
    inter = rt.select(*_interaction(F.concat(F.lit("ml_"), key), F.concat(F.lit("ml_user_"), F.col("uid")),
                                    F.concat(F.lit("ml_movie_"), F.col("mid")), itype,
                                    F.timestamp_seconds("ts"), dwell_for_type(itype, key, seed), F.col("score"),
                                    "movielens_1m"))
    us = read(users, 5).filter(F.col("c3").isNotNull()).select(
        F.trim("c0").alias("uid"), code_lookup(F.col("c2"), K.AGE_GROUP, "25-34").alias("age"))
    return {"items": items, "interactions": inter, "users": _users_filled(us, "ml_user_", seed, age_col="age")}


def ml25m_tables(spark: SparkSession, movies: str, ratings: str, links: str | None = None,
                 max_ratings: int | None = None, seed: int = 42) -> dict[str, DataFrame]:
    """CSV variant with a movieId -> tmdbId bridge; ratings only for known
    movies; users = distinct raters in the sample."""
    mv = spark.read.option("header", True).csv(movies).select(
        F.trim("movieId").alias("mid"), F.trim("title").alias("title"), "genres")
    mv = mv.filter((F.col("mid") != "") & (F.col("title") != "") & F.col("title").isNotNull())
    mv = _movie_fields(mv.withColumn("genres", F.coalesce("genres", F.lit(""))), "title", "genres")
    items = _movie_items(mv, "ml25_movie_", seed, 500_000)
    rt = spark.read.option("header", True).csv(ratings).select(
        F.trim("userId").alias("uid"), F.trim("movieId").alias("mid"),
        F.col("rating").try_cast("double").alias("score"), F.col("timestamp").try_cast("long").alias("ts"))
    rt = rt.filter(F.col("score").isNotNull() & F.col("ts").isNotNull() & (F.col("uid") != ""))
    rt = rt.join(mv.select("mid"), "mid", "left_semi")
    rt = seeded_sample(rt, ["uid", "mid", "ts"], max_ratings, seed)
    itype = rating_to_interaction("score")
    key = F.concat_ws("_", "uid", "mid", "ts")
    inter = rt.select(*_interaction(F.concat(F.lit("ml25_"), key), F.concat(F.lit("ml25_user_"), F.col("uid")),
                                    F.concat(F.lit("ml25_movie_"), F.col("mid")), itype,
                                    F.timestamp_seconds("ts"), dwell_for_type(itype, key, seed), F.col("score"),
                                    "movielens_25m"))
    users = _users_filled(rt.select("uid").distinct(), "ml25_user_", seed)
    out = {"items": items, "interactions": inter, "users": users}
    if links:
        lk = spark.read.option("header", True).csv(links).select(
            F.trim("movieId").alias("source_id"), F.trim("tmdbId").alias("tmdb_id"))
        out["links"] = lk.filter((F.col("source_id") != "") & (F.col("tmdb_id") != "") & F.col("tmdb_id").isNotNull())
    return out


# ------------------------------------------------------------ Book-Crossing

def bookcrossing_tables(spark: SparkSession, books: str, ratings: str, users: str,
                        max_ratings: int | None = None, seed: int = 42,
                        as_of: str = "2024-01-01") -> dict[str, DataFrame]:
    """``;``-separated latin-1 CSV; books need ISBN and title; ratings need a
    known ISBN and a score > 0 (a bad number counts as 0)."""
    def read(path):
        return (spark.read.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1")
                .option("quote", '"').option("escape", '"').csv(path))
    b = read(books).select(F.trim("ISBN").alias("isbn"), F.trim("Book-Title").alias("title"),
                           F.coalesce(F.trim("Book-Author"), F.lit("Unknown")).alias("author"),
                           F.coalesce(F.trim("Year-Of-Publication"), F.lit("2000")).alias("year"),
                           F.coalesce(F.trim("Image-URL-M"), F.lit("")).alias("img"))
    b = b.filter((F.col("isbn") != "") & F.col("isbn").isNotNull() & (F.col("title") != "") & F.col("title").isNotNull())
    b = first_per_key(b, ["isbn"], [F.col("title")])
    key = F.col("isbn")
    items = b.select(*_item(F.concat(F.lit("bx_"), key), F.col("title"), "article", F.lit("Books"),
                            F.array("author", F.lit("Books")),
                            F.concat(F.lit("By "), F.col("author"), F.lit(". Published: "), F.col("year"), F.lit(".")),
                            F.col("img"), seeded_fill(key, 3.0, 5.0, seed, "rating", 1),
                            seeded_fill(key, 50, 20_000, seed, "views"), past_date(key, seed, "pub", as_of, 365 * 5)))
    u = read(users).select(F.trim("User-ID").alias("uid")).filter((F.col("uid") != "") & F.col("uid").isNotNull())
    us = _users_filled(u.distinct(), "bx_user_", seed)
    r = read(ratings).select(F.trim("User-ID").alias("uid"), F.trim("ISBN").alias("isbn"),
                             F.coalesce(F.col("Book-Rating").try_cast("double"), F.lit(0.0)).alias("score"))
    r = r.filter((F.col("uid") != "") & (F.col("score") > 0)).join(b.select("isbn"), "isbn", "left_semi")
    r = seeded_sample(r, ["uid", "isbn"], max_ratings, seed)
    itype = rating_to_interaction("score")
    rk = F.concat_ws("_", "uid", "isbn")
    inter = r.select(*_interaction(F.concat(F.lit("bx_"), rk), F.concat(F.lit("bx_user_"), F.col("uid")),
                                   F.concat(F.lit("bx_"), F.col("isbn")), itype,
                                   past_date(rk, seed, "ts", as_of, 365 * 3), dwell_for_type(itype, rk, seed),
                                   F.col("score"), "book_crossings"))
    return {"items": items, "users": us, "interactions": inter}


# ------------------------------------------------------------ JSON helpers

def json_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of a JSON array, an object of objects, or JSON lines.

    JSON lines are read splittably; the two single-document forms are
    parsed with ``from_json`` and exploded."""
    first = spark.read.text(path).filter(F.trim("value") != "").limit(1).first()
    head = first[0].lstrip() if first else ""
    if head.startswith("["):
        return spark.read.schema(schema).option("multiLine", True).json(path)
    if head.startswith("{"):
        probe = spark.createDataFrame([(head,)], "v string").select(
            F.from_json("v", T.MapType(T.StringType(), T.StringType())).alias("m")).first()["m"]
        keys = set(probe or {})
        if keys & {f.name for f in schema.fields}:
            return spark.read.schema(schema).json(path)
        doc = spark.read.text(path, wholetext=True)
        m = doc.select(F.explode(F.from_json("value", T.MapType(T.StringType(), schema))).alias("k", "r"))
        return m.select("r.*")
    return spark.read.schema(schema).json(path)


def _genre_strings(col: str) -> F.Column:
    """Genres given as strings or as {description} objects."""
    arr = F.from_json(F.col(col), "array<string>")
    return F.filter(F.transform(F.coalesce(arr, _empty()), lambda x: F.when(
        F.trim(x).startswith("{"), F.coalesce(F.get_json_object(x, "$.description"), F.lit(""))).otherwise(x)),
        lambda x: x.isNotNull())


def steam_items(spark: SparkSession, path: str, seed: int = 42, as_of: str = "2024-01-01",
                max_items: int | None = None) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in
                           ("id", "name", "app_name", "genres", "price", "original_price", "short_description",
                            "desc", "header_image", "img_url")])
    g = json_records(spark, path, schema)
    name = F.trim(F.coalesce(F.when(F.col("name") != "", F.col("name")), F.col("app_name"), F.lit("")))
    g = g.withColumn("nm", name).filter(F.col("nm") != "").withColumn("gs", _genre_strings("genres"))
    key = F.coalesce(F.col("id"), F.col("nm"))
    cat = F.coalesce(F.try_element_at("gs", F.lit(1)), seeded_pick(key, STEAM_GENRES, seed, "genre"))
    tags = F.when(F.size("gs") > 0, F.slice("gs", 1, 5)).otherwise(F.array(cat))
    price = F.coalesce(F.col("price"), F.col("original_price"), F.lit(""))
    free = F.lower(price).contains("free") | (price.try_cast("double") == 0)
    desc = F.trim(F.concat(F.coalesce(F.when(F.col("short_description") != "", F.col("short_description")),
                                      F.col("desc"), F.lit("")), F.lit(" "),
                           F.when(free, F.lit("(Free to Play)")).otherwise(F.lit(""))))
    out = g.select(*_item(F.concat(F.lit("steam_"), key), F.col("nm"), "game", cat, tags, desc,
                          F.coalesce(F.col("header_image"), F.col("img_url"), F.lit("")),
                          seeded_fill(key, 3.0, 5.0, seed, "rating", 1), seeded_fill(key, 100, 500_000, seed, "views"),
                          past_date(key, seed, "pub", as_of, 365 * 5)))
    return out if max_items is None else seeded_sample(out, ["item_id"], max_items, seed)


def amazon_tables(spark: SparkSession, path: str, seed: int = 42, as_of: str = "2024-01-01",
                  max_ratings: int | None = None, max_title: int | None = None,
                  max_text: int | None = None) -> dict[str, DataFrame]:
    """JSON lines: first valid record per ASIN (by place in the files);
    category whitelist else Electronics; whole texts unless cut by
    ``max_title`` (usually 200) and ``max_text`` (400); rating <= 5; reviews of
    kept products become interactions."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in
                           ("asin", "title", "summary", "category", "overall", "reviewText", "description",
                            "imUrl", "image", "reviewerID")])
    r = spark.read.schema(schema).json(path)
    # place in the files, whatever the splits; ids come from the content
    r = r.select("*", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
                               F.monotonically_increasing_id().alias("n")).alias("_pos"),
                 F.substring(F.sha2(F.to_json(F.struct(*schema.names)), 256), 1, 16).alias("_hash"))
    r = r.withColumn("asin", F.trim(F.coalesce("asin", F.lit("")))).withColumn(
        "t", F.trim(F.coalesce("title", "summary", F.lit(""))))
    valid = r.filter((F.col("asin") != "") & (F.col("t") != ""))
    first = first_per_key(valid, ["asin"], ["_pos"])
    cats = F.from_json("category", "array<string>")
    cat = F.when(cats.isNotNull(), F.coalesce(F.try_element_at(cats, F.lit(-1)), F.lit("Electronics"))) \
           .otherwise(F.coalesce(F.when(F.col("category") != "", F.col("category")), F.lit("Electronics")))
    cat = F.when(cat.isin(*AMAZON_CATEGORIES), cat).otherwise(F.lit("Electronics"))
    score = F.when(F.col("overall").isNull(), 0.0).otherwise(F.coalesce(F.col("overall").try_cast("double"), F.lit(3.0)))
    key = F.col("asin")
    items = first.select(*_item(F.concat(F.lit("amz_"), key), cut_text(F.col("t"), max_title), "product", cat,
                                F.array(cat, F.lit("Electronics")),
                                cut_text(F.coalesce("reviewText", "description", F.lit("")), max_text),
                                F.coalesce("imUrl", "image", F.lit("")), F.round(F.least(score, F.lit(5.0)), 1),
                                seeded_fill(key, 50, 50_000, seed, "views"), past_date(key, seed, "pub", as_of, 365 * 5)))
    rv = r.filter((F.coalesce("reviewerID", F.lit("")) != "") & (F.col("asin") != "") &
                  F.col("overall").try_cast("double").isNotNull())
    rv = rv.join(first.select("asin"), "asin", "left_semi")
    rv = seeded_sample(rv.withColumn("score", F.col("overall").try_cast("double")), ["reviewerID", "asin", "_hash"],
                       max_ratings, seed)
    itype = rating_to_interaction("score")
    rv = rv.withColumn("_n", F.row_number().over(Window.partitionBy("_hash").orderBy("_pos")))  # reviews given twice
    rk = F.concat_ws("_", "reviewerID", "asin", "_hash", F.col("_n").cast("string"))
    inter = rv.select(*_interaction(F.concat(F.lit("amz_"), rk), F.concat(F.lit("amz_user_"), F.col("reviewerID")),
                                    F.concat(F.lit("amz_"), F.col("asin")), itype,
                                    past_date(rk, seed, "ts", as_of, 365 * 5), dwell_for_type(itype, rk, seed),
                                    F.col("score"), "amazon_reviews"))
    return {"items": items, "interactions": inter}


# ------------------------------------------------------------ API payloads

def _genre_names(ids_col: str, table: dict) -> F.Column:
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.transform(F.coalesce(F.col(ids_col), F.array().cast("array<bigint>")),
                       lambda g: F.coalesce(m[g], F.lit("Drama")))


def _tmdb(spark, path, prefix, ctype, title_field, table, seed, as_of):
    schema = T.StructType([T.StructField("results", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()), T.StructField(title_field, T.StringType()),
        T.StructField("genre_ids", T.ArrayType(T.LongType())), T.StructField("overview", T.StringType()),
        T.StructField("poster_path", T.StringType()), T.StructField("vote_average", T.DoubleType()),
        T.StructField("vote_count", T.LongType())])))])
    m = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("results").alias("m")).select("m.*")
    genres = _genre_names("genre_ids", table)
    key = F.col("id").cast("string")
    poster = F.coalesce(F.col("poster_path"), F.lit(""))
    return m.select(*_item(F.concat(F.lit(prefix), key), F.coalesce(F.col(title_field), F.lit("Unknown")), ctype,
                           F.coalesce(F.try_element_at(genres, F.lit(1)), F.lit("Drama")), genres,
                           F.coalesce(F.col("overview"), F.lit("")),
                           F.when(poster != "", F.concat(F.lit(TMDB_IMAGE_BASE), poster)).otherwise(F.lit("")),
                           F.round(F.coalesce(F.col("vote_average"), F.lit(0.0)) / 2, 1),
                           F.coalesce(F.col("vote_count"), F.lit(0)), past_date(key, seed, "pub", as_of, 365 * 3)))


def tmdb_movie_items(spark: SparkSession, path: str, seed: int = 42, as_of: str = "2024-01-01") -> DataFrame:
    return _tmdb(spark, path, "tmdb_movie_", "movie", "title", TMDB_MOVIE_GENRE, seed, as_of)


def tmdb_tv_items(spark: SparkSession, path: str, seed: int = 42, as_of: str = "2024-01-01") -> DataFrame:
    return _tmdb(spark, path, "tmdb_tv_", "video", "name", TMDB_TV_GENRE, seed, as_of)


def rawg_items(spark: SparkSession, path: str, seed: int = 42, as_of: str = "2024-01-01") -> DataFrame:
    named = T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))
    schema = T.StructType([T.StructField("results", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
        T.StructField("genres", named), T.StructField("tags", named),
        T.StructField("platforms", T.ArrayType(T.StructType([T.StructField("platform", T.StructType(
            [T.StructField("name", T.StringType())]))]))),
        T.StructField("released", T.StringType()), T.StructField("metacritic", T.LongType()),
        T.StructField("background_image", T.StringType()), T.StructField("rating", T.DoubleType()),
        T.StructField("ratings_count", T.LongType())])))])
    g = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("results").alias("g")).select("g.*")
    genres = F.transform(F.coalesce("genres", F.array().cast(named)), lambda x: x["name"])
    tags = F.transform(F.slice(F.coalesce("tags", F.array().cast(named)), 1, 5), lambda x: x["name"])
    plats = F.array_join(F.transform(F.slice(F.coalesce("platforms", F.array().cast(
        "array<struct<platform:struct<name:string>>>")), 1, 3), lambda p: p["platform"]["name"]), ", ")
    desc = F.concat(F.lit("Released: "), F.coalesce("released", F.lit("N/A")), F.lit(". Metacritic: "),
                    F.coalesce(F.col("metacritic").cast("string"), F.lit("N/A")), F.lit(". Platforms: "), plats)
    key = F.col("id").cast("string")
    return g.select(*_item(F.concat(F.lit("rawg_"), key), F.coalesce("name", F.lit("Unknown")), "game",
                           F.coalesce(F.try_element_at(genres, F.lit(1)), F.lit("Action")), F.concat(genres, tags), desc,
                           F.coalesce("background_image", F.lit("")), F.round(F.coalesce("rating", F.lit(0.0)), 1),
                           F.coalesce("ratings_count", F.lit(0)), past_date(key, seed, "pub", as_of, 365 * 3)))


def openlibrary_items(spark: SparkSession, path: str, seed: int = 42, as_of: str = "2024-01-01") -> DataFrame:
    """Records (subject, subject_order, works[]): first occurrence of a work
    key across subjects in subject order; first two authors."""
    schema = T.StructType([T.StructField("subject", T.StringType()), T.StructField("subject_order", T.LongType()),
                           T.StructField("works", T.ArrayType(T.StructType([
                               T.StructField("key", T.StringType()), T.StructField("title", T.StringType()),
                               T.StructField("cover_id", T.LongType()),
                               T.StructField("authors", T.ArrayType(T.StructType([
                                   T.StructField("name", T.StringType())])))])))])
    s = spark.read.schema(schema).json(path)
    w = s.select("subject", "subject_order", F.posexplode("works").alias("pos", "w")).select(
        "subject", "subject_order", "pos", "w.*").filter(F.coalesce("key", F.lit("")) != "")
    w = first_per_key(w, ["key"], ["subject_order", "pos"])
    authors = F.slice(F.transform(F.coalesce("authors", F.array().cast("array<struct<name:string>>")),
                                  lambda a: F.coalesce(a["name"], F.lit(""))), 1, 2)
    by = F.when(F.size(authors) > 0, F.array_join(authors, ", ")).otherwise(F.lit("Unknown Author"))
    cap = F.concat(F.upper(F.substring("subject", 1, 1)), F.lower(F.expr("substring(subject, 2)")))
    key = F.regexp_replace("key", "/works/", "")
    return w.select(*_item(F.concat(F.lit("ol_"), key), F.coalesce("title", F.lit("Unknown")), "article", cap,
                           F.concat(F.array("subject"), authors),
                           F.concat(F.lit("By "), by, F.lit(". Subject: "), cap, F.lit(".")),
                           F.when(F.col("cover_id").isNotNull(), F.format_string(OPENLIBRARY_COVER.replace("{}", "%d"),
                                                                                 F.col("cover_id"))).otherwise(F.lit("")),
                           seeded_fill(key, 3.0, 5.0, seed, "rating", 1), seeded_fill(key, 100, 50_000, seed, "views"),
                           past_date(key, seed, "pub", as_of, 365 * 3)))


def _capitalize(c: F.Column) -> F.Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def _article_id(prefix: str, *cols) -> F.Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *cols), 256), 1, 12))


def newsdata_items(spark: SparkSession, path: str, seed: int = 42, as_of: str = "2024-01-01") -> DataFrame:
    """Records (category, results[]): title required; description else content."""
    schema = T.StructType([T.StructField("category", T.StringType()), T.StructField("results", T.ArrayType(
        T.StructType([T.StructField(n, T.StringType()) for n in
                      ("title", "description", "content", "image_url", "source_name")])))])
    a = spark.read.schema(schema).json(path).select("category", F.posexplode("results").alias("pos", "a")) \
        .select("category", "pos", "a.*").filter(F.coalesce("title", F.lit("")) != "")
    key = F.concat_ws("|", "category", F.col("pos").cast("string"), "title")
    return a.select(*_item(_article_id("newsdata_", key), F.col("title"), "article", _capitalize(F.col("category")),
                           F.array("category", F.coalesce("source_name", F.lit("News"))),
                           F.coalesce(F.when(F.col("description") != "", F.col("description")),
                                      F.col("content"), F.lit("")),
                           F.coalesce("image_url", F.lit("")), seeded_fill(key, 3.0, 4.5, seed, "rating", 1),
                           seeded_fill(key, 500, 100_000, seed, "views"), past_date(key, seed, "pub", as_of, 30)))


def newsapi_items(spark: SparkSession, path: str, seed: int = 42, as_of: str = "2024-01-01",
                  max_title: int | None = None, max_text: int | None = None) -> DataFrame:
    """Records (category, articles[]): drops empty and '[Removed]' titles;
    whole texts unless cut (usually to 200 and 500 characters)."""
    schema = T.StructType([T.StructField("category", T.StringType()), T.StructField("articles", T.ArrayType(
        T.StructType([T.StructField("title", T.StringType()), T.StructField("description", T.StringType()),
                      T.StructField("content", T.StringType()), T.StructField("urlToImage", T.StringType()),
                      T.StructField("source", T.StructType([T.StructField("name", T.StringType())]))])))])
    a = spark.read.schema(schema).json(path).select("category", F.posexplode("articles").alias("pos", "a")) \
        .select("category", "pos", "a.*").withColumn("t", F.trim(F.coalesce("title", F.lit(""))))
    a = a.filter((F.col("t") != "") & (F.col("t") != "[Removed]"))
    key = F.concat_ws("|", "category", F.col("pos").cast("string"), "t")
    return a.select(*_item(_article_id("newsapi_", key), cut_text(F.col("t"), max_title), "article",
                           _capitalize(F.col("category")),
                           F.array("category", F.coalesce(F.col("source.name"), F.lit("News"))),
                           cut_text(F.coalesce(F.when(F.col("description") != "", F.col("description")),
                                               F.col("content"), F.lit("")), max_text),
                           F.coalesce("urlToImage", F.lit("")), seeded_fill(key, 3.0, 4.5, seed, "rating", 1),
                           seeded_fill(key, 500, 200_000, seed, "views"), past_date(key, seed, "pub", as_of, 7)))


def lastfm_items(spark: SparkSession, path: str, seed: int = 42, as_of: str = "2024-01-01") -> DataFrame:
    """Records (page, tracks{track[]}): title 'track — artist'; position % 5
    == 0 -> podcast, else music; views = listeners."""
    schema = T.StructType([T.StructField("page", T.LongType()), T.StructField("tracks", T.StructType([
        T.StructField("track", T.ArrayType(T.StructType([
            T.StructField("name", T.StringType()), T.StructField("listeners", T.StringType()),
            T.StructField("playcount", T.StringType()),
            T.StructField("artist", T.StructType([T.StructField("name", T.StringType())])),
            T.StructField("image", T.ArrayType(T.StructType([T.StructField("#text", T.StringType())])))])))]))])
    t = spark.read.schema(schema).json(path).select("page", F.posexplode("tracks.track").alias("i", "t")) \
        .select("page", "i", "t.*")
    artist = F.coalesce(F.col("artist.name"), F.lit("Unknown"))
    key = F.concat_ws("|", F.col("page").cast("string"), F.col("i").cast("string"), F.coalesce("name", F.lit("")))
    genre = seeded_pick(key, MUSIC_GENRES, seed, "genre")
    ctype = F.when(F.col("i") % 5 == 0, "podcast").otherwise("music")
    cols = _item(_article_id("lastfm_", key), F.concat(F.coalesce("name", F.lit("Unknown")), F.lit(" — "), artist),
                 "music", genre, F.array(artist, genre, F.lit("Music")),
                 F.concat(F.lit("Artist: "), artist, F.lit(". Listeners: "), F.coalesce("listeners", F.lit("N/A")),
                          F.lit(". Play count: "), F.coalesce("playcount", F.lit("N/A"))),
                 F.coalesce(F.try_element_at("image", F.lit(-1))["#text"], F.lit("")),
                 seeded_fill(key, 3.5, 5.0, seed, "rating", 1),
                 F.coalesce(F.col("listeners").try_cast("long"), F.lit(0)),
                 past_date(key, seed, "pub", as_of, 365 * 3), seeded_fill(key, 120, 360, seed, "duration"))
    cols[2] = ctype.alias("content_type")
    return t.select(*cols)


def spotify_items(spark: SparkSession, path: str, seed: int = 42, as_of: str = "2024-01-01") -> DataFrame:
    """Records (market, albums{items[]}): title 'album — artist';
    album_type capitalised in the tags."""
    schema = T.StructType([T.StructField("market", T.StringType()), T.StructField("albums", T.StructType([
        T.StructField("items", T.ArrayType(T.StructType([
            T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
            T.StructField("artists", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
            T.StructField("images", T.ArrayType(T.StructType([T.StructField("url", T.StringType())]))),
            T.StructField("album_type", T.StringType()), T.StructField("release_date", T.StringType()),
            T.StructField("total_tracks", T.LongType())])))]))])
    a = spark.read.schema(schema).json(path).select("market", F.explode("albums.items").alias("a")).select("market", "a.*")
    artist = F.coalesce(F.try_element_at("artists", F.lit(1))["name"], F.lit("Unknown"))
    key = F.coalesce("id", F.concat_ws("|", "market", "name"))
    genre = seeded_pick(key, MUSIC_GENRES, seed, "genre")
    return a.select(*_item(F.concat(F.lit("spotify_"), key), F.concat(F.coalesce("name", F.lit("Unknown")),
                                                                      F.lit(" — "), artist), "music", genre,
                           F.array(artist, genre, _capitalize(F.coalesce("album_type", F.lit("album")))),
                           F.concat(F.lit("Artist: "), artist, F.lit(". Released: "),
                                    F.coalesce("release_date", F.lit("N/A")), F.lit(". Tracks: "),
                                    F.coalesce(F.col("total_tracks").cast("string"), F.lit("?"))),
                           F.coalesce(F.try_element_at("images", F.lit(1))["url"], F.lit("")),
                           seeded_fill(key, 3.0, 5.0, seed, "rating", 1), seeded_fill(key, 1000, 5_000_000, seed, "views"),
                           past_date(key, seed, "pub", as_of, 365 * 3), seeded_fill(key, 180, 3600, seed, "duration")))


def youtube_items(spark: SparkSession, path: str, seed: int = 42, as_of: str = "2024-01-01",
                  max_title: int | None = None, max_text: int | None = None) -> DataFrame:
    """items[]: category id map (default Entertainment); best thumbnail
    high -> medium -> default; at most 10 tags; whole texts unless cut
    (usually to 200 and 500 characters)."""
    thumb = T.StructType([T.StructField("url", T.StringType())])
    schema = T.StructType([T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("snippet", T.StructType([
            T.StructField("title", T.StringType()), T.StructField("description", T.StringType()),
            T.StructField("categoryId", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())),
            T.StructField("thumbnails", T.StructType([T.StructField("high", thumb), T.StructField("medium", thumb),
                                                      T.StructField("default", thumb)]))])),
        T.StructField("statistics", T.StructType([T.StructField("viewCount", T.StringType())]))])))])
    v = spark.read.schema(schema).json(path).select(F.explode("items").alias("v")).select("v.*")
    cat = code_lookup(F.coalesce(F.col("snippet.categoryId"), F.lit("24")), YOUTUBE_CATEGORIES, "Entertainment")
    th = F.col("snippet.thumbnails")
    url = F.coalesce(F.coalesce(th["high"], th["medium"], th["default"])["url"], F.lit(""))
    key = F.coalesce("id", F.col("snippet.title"))
    return v.select(*_item(F.concat(F.lit("yt_"), key), cut_text(F.coalesce("snippet.title", F.lit("Unknown")), max_title),
                           "video", cat, F.slice(F.coalesce(F.col("snippet.tags"), F.array(cat)), 1, 10),
                           cut_text(F.coalesce("snippet.description", F.lit("")), max_text), url,
                           seeded_fill(key, 3.0, 5.0, seed, "rating", 1),
                           F.coalesce(F.col("statistics.viewCount").try_cast("long"), F.lit(0)),
                           past_date(key, seed, "pub", as_of, 365 * 3)))


def foodfacts_items(spark: SparkSession, path: str, seed: int = 42, as_of: str = "2024-01-01") -> DataFrame:
    """Records (category, products[]): name required; brand = first before a
    comma; category dashes -> title case."""
    schema = T.StructType([T.StructField("category", T.StringType()), T.StructField("products", T.ArrayType(
        T.StructType([T.StructField(n, T.StringType()) for n in
                      ("id", "product_name", "brands", "image_url", "nutriscore_grade")])))])
    p = spark.read.schema(schema).json(path).select("category", F.explode("products").alias("p")).select("category", "p.*")
    p = p.withColumn("nm", F.trim(F.coalesce("product_name", F.lit("")))).filter(F.col("nm") != "")
    brand = F.trim(F.split(F.coalesce("brands", F.lit("")), ",").getItem(0))
    nutri = F.upper(F.coalesce("nutriscore_grade", F.lit("")))
    key = F.coalesce("id", F.concat_ws("|", "category", "nm"))
    title = F.concat(F.col("nm"), F.when(brand != "", F.concat(F.lit(" — "), brand)).otherwise(F.lit("")))
    return p.select(*_item(F.concat(F.lit("off_"), key), title, "product",
                           F.initcap(F.regexp_replace("category", "-", " ")),
                           F.when(brand != "", F.array("category", brand)).otherwise(F.array("category", F.lit("Food"))),
                           F.concat(F.lit("Brand: "), F.when(brand != "", brand).otherwise(F.lit("N/A")),
                                    F.lit(". Category: "), F.col("category"), F.lit(". Nutriscore: "),
                                    F.when(nutri != "", nutri).otherwise(F.lit("N/A"))),
                           F.coalesce("image_url", F.lit("")), seeded_fill(key, 3.0, 5.0, seed, "rating", 1),
                           seeded_fill(key, 100, 50_000, seed, "views"), past_date(key, seed, "pub", as_of, 365 * 3)))
