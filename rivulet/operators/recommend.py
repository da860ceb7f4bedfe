"""Recommendation jobs, set-oriented: all users at once.

Profiles are kept in long form — (user, category, n), (user, type, n),
(user, tag, n).  Where they meet the feature rows, a user's counts are one row
of maps, no larger than the catalogue's categories, types and tags, so that
the many feature rows are sent to their users once.  Constant lists that every
user shares (the popular list) are bounded by a parameter and attached with a
scalar subquery instead of being joined to each user.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalars import confidence_weight, norm_title, training_label
from .components import dropped, released, reliable, written
from .topk import rank_within, top_k

FEATURES = (["interaction_count", "avg_dwell", "avg_rating", "item_rating", "log_views", "log_hours",
             "category_affinity", "dwell", "freshness", "category_rating_cross", "dwell_view_cross",
             "type_affinity", "tag_overlap", "engagement_velocity", "user_experience"]
            + [f"type_{t}" for t in K.CONTENT_TYPES]
            + [f"age_{a.replace('-', '_').replace('+', 'plus')}" for a in K.AGE_BUCKETS]
            + [f"device_{d}" for d in K.DEVICE_BUCKETS])


def _n():
    return F.count(F.lit(1))


# ------------------------------------------------------------ profiles

def user_profiles(inter: DataFrame, users: DataFrame, items: DataFrame) -> dict[str, DataFrame]:
    """Per user scalars with demographics (defaults when the user row is
    missing) plus long-form category / type / tag counts."""
    it = items.select("item_id", "category", "content_type", "tags")
    j = inter.select("user_id", "item_id", "dwell_seconds", "rating").join(it, "item_id", "left")
    # written, as all four tables are made from it
    j = written(j.select("user_id", "dwell_seconds", "rating", "category", "content_type", "tags"), "profiled")
    prof = j.groupBy("user_id").agg(
        _n().alias("interaction_count"),
        F.coalesce(F.avg(F.when(F.col("dwell_seconds") > 0, F.col("dwell_seconds"))), F.lit(0.0)).alias("avg_dwell_time"),
        F.coalesce(F.avg("rating"), F.lit(0.0)).alias("avg_rating"))
    u = users.select("user_id", "country", "device", "age_group")
    prof = prof.join(u, "user_id", "left").select(
        "user_id", "interaction_count", "avg_dwell_time", "avg_rating",
        F.coalesce("country", F.lit(K.DEFAULT_COUNTRY)).alias("country"),
        F.coalesce("device", F.lit(K.DEFAULT_DEVICE)).alias("device"),
        F.coalesce("age_group", F.lit(K.DEFAULT_AGE_GROUP)).alias("age_group"))
    cats = j.filter(F.col("category").isNotNull()).groupBy("user_id", "category").agg(_n().alias("n"))
    types = j.filter(F.col("content_type").isNotNull()).groupBy("user_id", "content_type").agg(_n().alias("n"))
    tags = (j.select("user_id", F.explode(F.coalesce("tags", F.array().cast("array<string>"))).alias("tag"))
            .groupBy("user_id", "tag").agg(_n().alias("n")))
    return {"profile": prof, "categories": cats, "types": types, "tags": tags}


def profiles_of(pairs: DataFrame, inter: DataFrame, users: DataFrame, items: DataFrame) -> dict[str, DataFrame]:
    """``user_profiles`` of the users in ``pairs`` (user_id) alone, from their
    whole history."""
    return user_profiles(inter.join(pairs.select("user_id").distinct(), "user_id", "left_semi"), users, items)


# ------------------------------------------------------------ features

def _maps(prof: dict[str, DataFrame]) -> DataFrame:
    """(user_id, cat_map, type_map, tag_map): a user's counts by key."""
    kinds = {"cat": ("categories", "category"), "type": ("types", "content_type"), "tag": ("tags", "tag")}
    rows = None
    for kind, (table, key) in kinds.items():
        part = prof[table].where(F.col(key).isNotNull()).select("user_id", F.lit(kind).alias("kind"), F.struct(F.col(key).alias("key"), F.col("n").cast("long").alias("n")).alias("e"))
        rows = part if rows is None else rows.unionByName(part)
    of = lambda kind: F.map_from_entries(F.collect_list(F.when(F.col("kind") == kind, F.col("e"))))
    return rows.where("user_id is not null").groupBy("user_id").agg(*[of(kind).alias(f"{kind}_map") for kind in kinds])


def features(pairs: DataFrame, prof: dict[str, DataFrame], items: DataFrame, as_of,
             keep: list[str] | None = None) -> DataFrame:
    """The 32 ranking features for (user_id, item_id, dwell_seconds) rows;
    ``keep`` columns of ``pairs`` are carried through."""
    keep = list(keep or [])
    # the tags of all rows of an item count, once per row
    every = items.where("item_id is not null").groupBy("item_id").agg(F.flatten(F.collect_list("tags")).alias("all_tags"))
    it = items.select("item_id", "category", "content_type", F.col("rating").alias("item_rating"),
                      "view_count", "publish_ts").join(every, "item_id")
    p = (pairs.select("user_id", "item_id", "dwell_seconds", *keep)
         .join(it, "item_id", "left")
         .join(prof["profile"], "user_id", "left")
         .join(_maps(prof), "user_id", "left"))
    # tag overlap: sum of the user's count for each item tag (tags may repeat)
    found = F.transform("all_tags", lambda t: F.coalesce(F.try_element_at("tag_map", t), F.lit(0)))
    p = (p.withColumn("cat_n", F.try_element_at("cat_map", F.col("category")))
          .withColumn("type_n", F.try_element_at("type_map", F.col("content_type")))
          .withColumn("tag_sum", F.aggregate(found, F.lit(0).cast("long"), lambda acc, x: acc + x)))

    ic = F.coalesce(F.col("interaction_count"), F.lit(0)).cast("double")
    denom = F.greatest(ic, F.lit(1.0))
    views = F.coalesce(F.col("view_count"), F.lit(0)).cast("double")
    pub = F.coalesce(F.col("publish_ts").cast("timestamp"), as_of.cast("timestamp"))
    hours = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(pub)) / F.lit(3.6e9)
    dwell = F.coalesce(F.col("dwell_seconds"), F.lit(0)).cast("double")
    rating = F.coalesce(F.col("item_rating"), F.lit(0.0))
    log_views = F.log1p(views)
    fresh = F.try_divide(F.lit(1.0), F.lit(1.0) + hours / F.lit(720.0))
    cat_aff = F.coalesce(F.col("cat_n"), F.lit(0)) / denom
    age = F.coalesce(F.col("age_group"), F.lit(K.DEFAULT_AGE_GROUP))
    dev = F.coalesce(F.col("device"), F.lit(K.DEFAULT_DEVICE))
    cols = [ic, F.coalesce(F.col("avg_dwell_time"), F.lit(0.0)), F.coalesce(F.col("avg_rating"), F.lit(0.0)),
            rating, log_views, F.log1p(F.greatest(hours, F.lit(0.0))), cat_aff, dwell, fresh,
            cat_aff * rating, F.log1p(dwell) * log_views,
            F.coalesce(F.col("type_n"), F.lit(0)) / denom,
            F.coalesce(F.col("tag_sum"), F.lit(0)) / denom,
            log_views * fresh, F.log1p(ic)]
    cols += [F.when(F.col("content_type") == t, 1.0).otherwise(0.0) for t in K.CONTENT_TYPES]
    cols += [F.when(age == a, 1.0).otherwise(0.0) for a in K.AGE_BUCKETS]
    cols += [F.when(dev == d, 1.0).otherwise(0.0) for d in K.DEVICE_BUCKETS]
    return p.select("user_id", "item_id", *keep,
                    *[c.cast("double").alias(n) for c, n in zip(cols, FEATURES)])


# ------------------------------------------------------------ training set

def training_set(spark: SparkSession, inter: DataFrame, users: DataFrame, items: DataFrame,
                 prof: dict[str, DataFrame] | None, as_of, seed: int = 42, max_pos: int = 10000,
                 max_neg: int = 5000) -> DataFrame:
    """Labelled feature rows: positives (view/like/purchase/bookmark with
    dwell > 10 on a known item, newest first, at most ``max_pos``) and
    min(positives, ``max_neg``) seeded random (user, item) negatives.
    Without ``prof`` the profiles of the rows' users alone are made."""
    seq = [c for c in ("seq_a", "seq_b", "seq_c", "seq_d") if c in inter.columns]
    pos = (inter.filter(F.col("interaction_type").isin(*K.POSITIVE_TYPES) & (F.col("dwell_seconds") > 10))
           .join(items.select("item_id"), "item_id", "left_semi"))
    pos = top_k(pos, [F.col("timestamp").desc()] + [F.col(c).asc() for c in seq] + [F.col("interaction_id").asc()],
                max_pos)
    pos = pos.select(F.concat(F.lit("p:"), F.col("interaction_id")).alias("pair_id"),
                     "user_id", "item_id", "dwell_seconds",
                     training_label("interaction_type", "dwell_seconds").alias("label"))
    pos = reliable(pos)  # at most max_pos rows, read twice
    n_neg = F.least(pos.select(_n()).scalar(), F.lit(max_neg))
    neg = random_pairs(spark, users, items, n_neg, max_neg, seed)
    pairs = reliable(pos.unionByName(neg))
    if prof is None:
        of = F.broadcast(pairs.select("user_id").distinct())  # at most max_pos + max_neg rows
        prof = user_profiles(inter.join(of, "user_id", "left_semi"), users, items)
    return features(pairs, prof, items, as_of, keep=["pair_id", "label"])


def random_pairs(spark: SparkSession, users: DataFrame, items: DataFrame, n, max_n: int, seed: int) -> DataFrame:
    """``n`` (<= max_n) repeatable pseudo-random (user, item) pairs: users and
    items are ordered by a seeded hash, the first ``max_n`` of each kept
    (bounded TakeOrdered), and pair i takes user i mod U, item (7i+3) mod I."""
    def ranked(df, col):
        h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(col)), 256)
        t = top_k(df.select(col).distinct().withColumn("_h", h), [F.col("_h").asc()], max_n)
        return t.withColumn("_r", F.row_number().over(Window.orderBy("_h")) - 1).drop("_h")
    u, it = ranked(users, "user_id"), ranked(items, "item_id")
    nu, ni = u.select(_n()).scalar(), it.select(_n()).scalar()
    idx = spark.range(max_n).filter(F.col("id") < n)
    idx = idx.select("id", (F.col("id") % nu).alias("ur"), ((F.col("id") * 7 + 3) % ni).alias("ir"))
    pairs = idx.join(u, idx.ur == u._r).drop("_r").join(it, idx.ir == it._r).drop("_r")
    return pairs.select(F.concat(F.lit("n:"), F.col("id").cast("string")).alias("pair_id"),
                        "user_id", "item_id", F.lit(0).alias("dwell_seconds"), F.lit(0.0).alias("label"))


# ------------------------------------------------------------ models

def ranker_pipeline(max_iter: int = 100, max_depth: int = 6, step: float = 0.1,
                    subsample: float = 0.8, col_sample: str = "0.8", seed: int = 42) -> Pipeline:
    """Assemble 32 features -> standardise (mean, std) -> boosted trees."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=FEATURES, outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        GBTRegressor(featuresCol="features", labelCol="label", predictionCol="ml_score",
                     maxIter=max_iter, maxDepth=max_depth, stepSize=step, subsamplingRate=subsample,
                     featureSubsetStrategy=col_sample, seed=seed),
    ])


def fit_ranker(train: DataFrame, **params) -> PipelineModel:
    return ranker_pipeline(**params).fit(train)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def dense_ids(values: DataFrame, col: str, name: str) -> DataFrame:
    """(col, name): distinct values of ``col`` numbered from 0 without gaps.
    Numbers are counted inside hash groups, which start where the counts of
    the groups before them end; no group holds more than its share."""
    groups = max(1, values.sparkSession.sparkContext.defaultParallelism * 4)
    own = values.select(F.col(col)).where(F.col(col).isNotNull()).distinct().withColumn("_g", F.pmod(F.xxhash64(col), F.lit(groups)))
    starts = own.groupBy("_g").agg(_n().alias("_c"))  # ``groups`` rows
    before = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("_g", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"))
    nth = F.row_number().over(Window.partitionBy("_g").orderBy(col)) - 1
    return own.withColumn("_n", nth).join(starts, "_g").select(col, (F.col("_s") + F.col("_n")).cast("int").alias(name))


class Factors:
    """Latent vectors by user and item id: (user_id, features) and (item_id,
    features), what kind of factorisation made them, and its singular values."""

    def __init__(self, users: DataFrame, items: DataFrame, rank: int, kind: str, values=None):
        self.users, self.items, self.rank, self.kind, self.values = users, items, rank, kind, values


def fit_factors(inter: DataFrame, rank: int = 64, seed: int = 42, max_iter: int = 10, reg: float = 0.1,
                kind: str = "svd") -> Factors | None:
    """Latent factors of the confidence matrix, rank min(64, min(users,
    items) - 1); None when there are fewer than 2 users or items.

    ``svd``: the truncated singular value decomposition, left and right
    vectors both scaled by the roots of the singular values; all tall matrices
    stay distributed.  ``als``: implicit-feedback alternating least squares."""
    with released(inter.sparkSession):
        data, uid, iid, dims = confidence_entries(inter)
        if not dims["u"] or not dims["i"]:
            return None
        k = min(rank, min(dims["u"], dims["i"]))
        if kind == "svd":
            return _svd(data, uid, iid, k, seed)
        als = ALS(rank=k, maxIter=max_iter, regParam=reg, implicitPrefs=True, alpha=1.0, userCol="u", itemCol="i",
                  ratingCol="confidence", seed=seed, coldStartStrategy="drop", nonnegative=False)
        model = als.fit(data)
    vec = lambda df, ids, key, n: ids.join(df.withColumnRenamed("id", n), n).select(
        key, F.col("features").cast("array<double>").alias("features"))
    return Factors(vec(model.userFactors, uid, "user_id", "u"), vec(model.itemFactors, iid, "item_id", "i"), k, "als")


def confidence_entries(inter: DataFrame):
    """The confidence matrix by numbers (u, i, confidence), the numbers of
    users and of items, and the largest of each; written tables."""
    from .aggregates import confidence_matrix
    conf = written(confidence_matrix(inter), "confidence")
    uid, iid = written(dense_ids(conf, "user_id", "u"), "user_ids"), written(dense_ids(conf, "item_id", "i"), "item_ids")
    data = written(conf.join(uid, "user_id").join(iid, "item_id").select("u", "i", F.col("confidence").cast("double").alias("confidence")), "entries")
    dropped(conf)
    return data, uid, iid, data.agg(F.max("u").alias("u"), F.max("i").alias("i")).first()


def _svd(data: DataFrame, uid: DataFrame, iid: DataFrame, k: int, seed: int) -> Factors:
    from .factorise import truncated_svd
    left, s, right = truncated_svd(data.select(F.col("u").alias("row"), F.col("i").alias("col"), F.col("confidence").alias("value")), k, seed, own=True)
    root = F.array(*[F.lit(float(x)) for x in np.sqrt(s)])

    def scaled(tall, ids, key, n):
        x = F.zip_with("x", root, lambda a, b: a * b)
        out = written(ids.join(tall.select(F.col("id").alias(n), x.alias("features")), n).select(key, "features"), "factors")
        dropped(tall)
        return out

    return Factors(scaled(left, uid, "user_id", "u"), scaled(right, iid, "item_id", "i"), len(s), "svd", s)


#: Item vectors and pairs that meet in one task.
ITEM_BLOCK, PAIR_BLOCK = 65_536, 1_000_000


def _block_dots(block):
    """Inner products of a block: rows that ask hold a user's vector and item
    ids, the others an item's.  Null where a vector is null or lengths differ."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def one(col):
        return pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)

    def dense(col, width):
        sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        m = np.zeros((len(sizes), width))
        starts = np.cumsum(sizes) - sizes
        m[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(starts, sizes)] = col.flatten().to_numpy(zero_copy_only=False)
        return m, np.where(col.is_valid().to_numpy(zero_copy_only=False), sizes, -1)

    asks, docs = block.filter(block["asks"]), block.filter(pc.invert(block["asks"]))
    width = max([0] + [pc.max(pc.list_value_length(one(t["vec"]))).as_py() or 0 for t in (asks, docs)])
    (mine, own), (theirs, other) = dense(one(asks["vec"]), width), dense(one(docs["vec"]), width)
    ids = one(docs["id"]).dictionary_encode()
    codes = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(codes, kind="stable")               # rows of an id, which may repeat
    ends = np.searchsorted(codes[order], np.arange(len(ids.dictionary) + 1))
    wanted = one(asks["items"])
    at = pc.fill_null(pc.index_in(wanted.flatten(), value_set=ids.dictionary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    who = np.repeat(np.arange(len(own)), pc.fill_null(pc.list_value_length(wanted), 0).to_numpy(zero_copy_only=False))
    place = np.flatnonzero(at >= 0)
    first, count = ends[at[place]], ends[at[place] + 1] - ends[at[place]]
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    place, row = np.repeat(place, count), order[np.repeat(first, count) + nth]
    who = who[place]
    raw = np.concatenate([np.zeros(0)] + [np.einsum("ij,ij->i", mine[who[i:i + 20_000]], theirs[row[i:i + 20_000]]) for i in range(0, len(row), 20_000)])
    cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(own)))]), pa.int32())
    unknown = (own[who] < 0) | (own[who] != other[row])
    return pa.table({"user_id": one(asks["id"]), "items": pa.ListArray.from_arrays(cuts, wanted.flatten().take(pa.array(place))),
                     "raw": pa.ListArray.from_arrays(cuts, pa.array(raw, pa.float64(), mask=unknown))})


def factor_scores(pairs: DataFrame, factors: Factors) -> DataFrame:
    """Dot product of user and item factors, min-max scaled per user over its
    candidates; unknown users or items give no row.  Vectors are sent to the
    blocks of users and items where they meet, not to every pair."""
    vec = lambda df: F.when(F.forall("features", lambda x: x.isNotNull()), F.col("features")).alias("vec")
    users, items = factors.users.where("user_id is not null"), factors.items.where("item_id is not null")
    n_items = items.count()
    across = max(1, -(-n_items // ITEM_BLOCK))
    lists = written(pairs.where("user_id is not null and item_id is not null")
                    .groupBy("user_id", F.pmod(F.xxhash64("item_id"), F.lit(across)).cast("int").alias("ib"))
                    .agg(F.collect_set("item_id").alias("items")), "asked")
    n_pairs = lists.agg(F.sum(F.size("items"))).first()[0] or 0
    down = max(1, -(-n_pairs // (across * PAIR_BLOCK)))
    asks = lists.join(users.select("user_id", vec(users)), "user_id").select(
        F.pmod(F.xxhash64("user_id"), F.lit(down)).cast("int").alias("ub"), "ib", F.lit(True).alias("asks"), F.col("user_id").alias("id"), "items", "vec")
    docs = items.select(F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("ub"), F.pmod(F.xxhash64("item_id"), F.lit(across)).cast("int").alias("ib"),
                        F.lit(False).alias("asks"), F.col("item_id").alias("id"), F.lit(None).cast("array<string>").alias("items"), vec(items))
    tasks = max(2, pairs.sparkSession.sparkContext.defaultParallelism * 2, min(1024, across * down))
    j = written(asks.unionByName(docs).repartition(tasks, "ub", "ib").groupBy("ub", "ib")
                .applyInArrow(_block_dots, "user_id string, items array<string>, raw array<double>"), "dots")
    # minima and maxima per list, then joined back: no window over a hot user
    ends = j.groupBy("user_id").agg(F.min(F.array_min("raw")).alias("lo"), F.max(F.array_max("raw")).alias("hi"))
    j = j.select("user_id", F.explode(F.arrays_zip("items", "raw")).alias("e")).select("user_id", F.col("e.items").alias("item_id"), F.col("e.raw").alias("raw"))
    lo, hi = F.col("lo"), F.col("hi")
    return j.join(ends, "user_id").select(
        "user_id", "item_id", F.when(hi > lo, (F.col("raw") - lo) / (hi - lo)).otherwise(F.lit(0.0)).alias("factor_score"))


# ------------------------------------------------------------ candidates

def _seen(inter: DataFrame, exclude: DataFrame | None) -> DataFrame:
    """Distinct (user_id, item_id) of the whole history and of ``exclude``."""
    seen = inter.select("user_id", "item_id")
    if exclude is not None:
        seen = seen.unionByName(exclude.select("user_id", "item_id"))
    return seen.distinct()


def popular_list(items: DataFrame, k: int, content_type: str | None = None) -> DataFrame:
    from .ranking import popular_items
    return popular_items(items, k, content_type)


def newest_items(inter: DataFrame, n: int) -> DataFrame:
    """(user_id, item_id, rank) of each user's ``n`` newest interactions."""
    newest = [F.col("timestamp").desc()] + [F.col(c).asc() for c in ("seq_a", "seq_b", "seq_c", "seq_d") if c in inter.columns]
    return rank_within(inter, ["user_id"], newest, n).select("user_id", "item_id", "rank")


def candidates(spark: SparkSession, users: DataFrame, inter: DataFrame, items: DataFrame,
               covis: DataFrame, similar: DataFrame | None, n: int = 500,
               content_type: str | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Per user: 20 strongest co-visited neighbours of each of the 10 newest
    items + the 100 most popular + 50 content-similar of each of the 3 newest
    items, minus everything the user has interacted with and what ``exclude``
    (user_id, item_id) lists; first ``n`` by id, topped up from the popular
    list."""
    # a user's pool is an array of at most 350 ids and the popular ones: ids
    # travel in their items' lists, and no (user, item) row is ever shuffled
    rec = newest_items(inter, 10)
    seen = _seen(inter, exclude)
    def ids(df, key, col):  # null ids are kept
        return df.groupBy(key).agg(F.transform(F.collect_list(F.struct(F.col(col).alias("id"))), lambda x: x["id"]).alias("near"))

    none = F.array().cast("array<string>")
    top_cov = rank_within(covis, ["item_a"], [F.col("weight").desc(), F.col("item_b").asc()], 20, "_r")
    # written one after the other, as each needs its shuffle files no longer
    with released(spark):
        near_cov = written(ids(top_cov, "item_a", "item_b"), "covisited")
    parts = rec.select("user_id", F.col("item_id").alias("item_a")).join(near_cov, "item_a").select("user_id", "near")
    if similar is not None:
        top_sim = rank_within(similar, ["item_id"], [F.col("similarity").desc(), F.col("sim_id").asc()], 50, "_r")
        parts = parts.unionByName(rec.filter(F.col("rank") <= 3).select("user_id", "item_id")
                                  .join(ids(top_sim, "item_id", "sim_id"), "item_id").select("user_id", "near"))
    own = users.select("user_id", none.alias("near"), F.lit(1).alias("row"))
    pools = parts.withColumn("row", F.lit(0)).unionByName(own).groupBy("user_id").agg(
        F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.sum("row").alias("rows"))
    with released(spark):
        pools = written(pools, "pools")
    # the popular list has at most max(n, 100) rows: attached as an array and broadcast
    top = reliable(popular_list(items, max(n, 100), content_type).select("item_id", F.col("rank").alias("pop_rank")))
    pop_ids = top.where("pop_rank <= 100").select(F.collect_list("item_id")).scalar()
    top_ids = top.where(F.col("pop_rank") <= n)
    pools = pools.select("user_id", "near", "rows", pop_ids.alias("pop")).select(
        "user_id", "rows", F.when(F.col("rows") > 0, F.array_union("near", "pop")).otherwise(F.col("near")).alias("pool"))
    # what the user has seen of the pool and of the popular list
    popular = F.broadcast(top_ids.select("item_id", F.lit(True).alias("popular")).distinct())
    met = (seen.join(popular, "item_id", "left").alias("s").join(pools.alias("p"), F.col("s.user_id") == F.col("p.user_id"))
           .where(F.col("popular").isNotNull() | F.array_contains("pool", F.col("item_id"))))
    known = met.groupBy("s.user_id").agg(F.collect_set("item_id").alias("known"))
    listed = pools.join(known, "user_id", "left").select(
        "user_id", "rows", F.coalesce("known", none).alias("known"),
        F.slice(F.sort_array(F.array_except("pool", F.coalesce("known", none))), 1, n).alias("list"))
    # top-up: the first (n - have) popular items that are neither listed nor
    # seen, in popularity order (fewer when some of those are excluded), for
    # each row of the user
    plist = top_ids.select(F.sort_array(F.collect_list(F.struct("pop_rank", "item_id")))).scalar()
    u = listed.select("user_id", "rows", "list", "known", F.when(F.col("user_id").isNull(), 0).otherwise(F.size("list")).alias("have"), plist.alias("plist"))
    taken = F.when(F.col("user_id").isNull(), none).otherwise(F.concat("known", "list"))
    u = u.select("user_id", "rows", "list", "have", "plist", taken.alias("taken"))
    avail = F.filter("plist", lambda x: (x["pop_rank"] <= F.lit(n) - F.col("have")) & x["item_id"].isNotNull()
                     & ~F.coalesce(F.array_contains("taken", x["item_id"]), F.lit(False)))
    at = lambda x, i: F.struct(x.alias("item_id"), i.cast("long").alias("cand_rank"))
    u = u.select("user_id", F.transform("list", lambda x, i: at(x, i + 1)).alias("list"), "rows",
                 F.transform(avail, lambda x, i: at(x["item_id"], F.col("have") + i + 1)).alias("extra"))
    rows = F.concat("list", F.flatten(F.array_repeat("extra", F.col("rows").cast("int"))))
    return u.select("user_id", F.explode(rows).alias("c")).select("user_id", "c.item_id", "c.cand_rank")


# ------------------------------------------------------------ ranking and blend

def rank_candidates(cands: DataFrame, prof, items: DataFrame, model: PipelineModel, as_of) -> DataFrame:
    """Features with dwell 0 -> scale -> predict."""
    pairs = cands.select("user_id", "item_id", F.lit(0).alias("dwell_seconds"))
    f = features(pairs, prof, items, as_of)
    return model.transform(f).select("user_id", "item_id", F.col("ml_score").cast("double"))


def blend_scores(ranked: DataFrame, items: DataFrame, factors: DataFrame | None,
                 weights=K.BLEND_WEIGHTS) -> DataFrame:
    """0.5 * model + 0.35 * factor (0 when missing) + 0.15 * views / max views
    in the user's list; without factors the model score is kept."""
    r = ranked.join(items.select("item_id", "title", "content_type", "view_count", *[c for c in ("_nt",) if c in items.columns]), "item_id")
    if factors is None:
        return r.withColumn("score", F.col("ml_score"))
    w = Window.partitionBy("user_id")
    r = r.join(factors, ["user_id", "item_id"], "left")
    pop = F.col("view_count") / F.greatest(F.max("view_count").over(w), F.lit(1)).cast("double")
    return r.withColumn("score", F.lit(weights[0]) * F.col("ml_score")
                        + F.lit(weights[1]) * F.coalesce("factor_score", F.lit(0.0)) + F.lit(weights[2]) * pop)


def dedup_top(scored: DataFrame, n: int, order) -> DataFrame:
    keyed = scored if "_nt" in scored.columns else scored.withColumn("_nt", norm_title("title"))
    first = rank_within(keyed, ["user_id", "_nt"], order, 1, "_r").drop("_r", "_nt")
    return rank_within(first, ["user_id"], order, n, "rec_rank")


def recommend(spark: SparkSession, users: DataFrame, inter: DataFrame, items: DataFrame, prof,
              model: PipelineModel, factors_model, covis: DataFrame, similar: DataFrame | None,
              as_of, n: int = 10, content_type: str | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """candidates -> rank -> type filter -> blend -> title dedup -> top n."""
    cands = candidates(spark, users, inter, items, covis, similar, 500, content_type, exclude)
    if content_type:
        cands = cands.join(items.filter(F.col("content_type") == content_type).select("item_id"), "item_id")
    with released(spark):
        cands = written(cands, "candidates")  # read by the ranker and for the factors
    ranked = rank_candidates(cands, prof, items, model, as_of)
    fs = factor_scores(cands, factors_model) if factors_model else None
    scored = blend_scores(ranked, items.withColumn("_nt", norm_title("title")), fs)
    return dedup_top(scored, n, [F.col("score").desc(), F.col("item_id").asc()]).withColumn(
        "algorithm", F.lit("xgboost_ml"))


def recommend_control(spark: SparkSession, users: DataFrame, inter: DataFrame, items: DataFrame,
                      n: int = 10, content_type: str | None = None, exclude: DataFrame | None = None,
                      exclude_seen: bool = True) -> DataFrame:
    """Popularity arm: the 3n most popular items minus ``exclude`` and, unless
    ``exclude_seen`` is off, the user's whole history; first item per
    normalised title, top n.  The popular list (3n rows) is attached to each
    user as an array from a scalar subquery."""
    pop = popular_list(items, 3 * n, content_type).select(
        "rank", "item_id", "title", norm_title("title").alias("nt"))
    plist = pop.select(F.sort_array(F.collect_list(F.struct("rank", "item_id", "title", "nt")))).scalar()
    seen = (_seen(inter if exclude_seen else inter.limit(0), exclude)
            .join(pop.select("item_id"), "item_id", "left_semi")
            .groupBy("user_id").agg(F.collect_set("item_id").alias("seen")))
    u = users.select("user_id").join(seen, "user_id", "left").withColumn(
        "seen", F.coalesce("seen", F.array().cast("array<string>")))
    # attach the shared list as a column first (subqueries may not sit
    # inside higher-order functions)
    u = u.select("user_id", "seen", plist.alias("plist"))
    avail = F.filter("plist", lambda x: ~F.array_contains(F.col("seen"), x["item_id"]))
    u = u.select("user_id", avail.alias("a"))
    dedup = F.filter("a", lambda x, i: ~F.exists(F.slice("a", 1, i), lambda y: y["nt"] == x["nt"]))
    out = u.select("user_id", F.posexplode(F.slice(dedup, 1, n)).alias("pos", "r"))
    return out.select("user_id", F.col("r.item_id").alias("item_id"), F.col("r.title").alias("title"),
                      (F.col("pos") + 1).cast("long").alias("rec_rank"), F.lit("popularity_based").alias("algorithm"))


def recommend_by_arm(spark: SparkSession, assignments: DataFrame, treatment_recs: DataFrame,
                     control_recs: DataFrame) -> DataFrame:
    """Treatment users get the model's list, control users the popular one."""
    t = treatment_recs.join(assignments.filter(F.col("bucket") == "treatment").select("user_id"), "user_id")
    c = control_recs.join(assignments.filter(F.col("bucket") == "control").select("user_id"), "user_id")
    cols = ["user_id", "item_id", "rec_rank", "algorithm"]
    return t.select(*cols).unionByName(c.select(*cols))


# ------------------------------------------------------------ pages

def item_page(items: DataFrame, similar: DataFrame) -> DataFrame:
    """Item with its 10 similar items as a sorted array of (rank, id)."""
    s = similar.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("rank", "sim_id"))).alias("similar"))
    return items.select("item_id", "title", "category", "content_type").join(s, "item_id", "left")


def profile_page(users: DataFrame, stats: DataFrame, recent: DataFrame) -> DataFrame:
    """User row + interaction stats + recent items (rank, item id) + total."""
    r = recent.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("rank", "item_id"))).alias("recent"))
    return users.join(stats, "user_id", "left").join(r, "user_id", "left")


def retrain(spark: SparkSession, inter: DataFrame, users: DataFrame, items: DataFrame, as_of,
            seed: int = 42, out_path: str | None = None, **ranker_params) -> dict:
    """One batch job rebuilding every artifact in order: item tf-idf vectors,
    user profiles, co-visitation edges, training set, ranker and latent
    factors.  All are written under one new version of the folder
    ``out_path``, which one commit then makes the current one: a run that
    fails on the way leaves the version before in use.  Returns what
    ``load_artifacts`` gives."""
    import os
    import uuid

    from ..session import checkpoint_dir
    from ..streaming.epochs import EpochStore
    from .search import item_text
    from .text import fit_tfidf, tfidf_vectors
    from .windows import covisitation_edges
    root = out_path or os.path.join(checkpoint_dir(spark), "models", f"artifacts-{uuid.uuid4().hex[:12]}")
    store = EpochStore(spark, root)
    version = (store.committed() or [-1])[-1] + 1
    docs = items.select("item_id", F.concat_ws(" ", item_text(items), F.col("category")).alias("text"))
    vocab = fit_tfidf(spark, docs, "item_id", "text", 1000)
    prof = user_profiles(inter, users, items)
    # written before it is used twice: the ranker learns from the rows that are kept
    train = training_set(spark, inter, users, items, None, as_of, seed)
    train_path = store.folder("training_set", version)
    train.write.mode("overwrite").parquet(train_path)
    model = fit_ranker(spark.read.schema(train.schema).parquet(train_path), **ranker_params)
    model_path = store.folder("ranker", version)
    save_model(model, model_path)
    factors = fit_factors(inter, seed=seed)
    tables = {"vectors": tfidf_vectors(spark, docs, "item_id", "text", vocab), **{f"profiles_{n}": t for n, t in prof.items()},
              "covisitation": covisitation_edges(inter)}
    if factors is not None:
        tables |= {"user_factors": factors.users, "item_factors": factors.items}
    note = {"ranker": model_path, "factors": None if factors is None else {"rank": factors.rank, "kind": factors.kind},
            "training_set": [train_path, train.schema.json()]}
    store.publish(version, tables, lambda: note)
    return load_artifacts(spark, root)


def load_artifacts(spark: SparkSession, root: str) -> dict:
    """The current version's artifacts, read through the newest commit."""
    import json

    from ..streaming.epochs import EpochStore
    from pyspark.sql import types as T
    store = EpochStore(spark, root)
    epochs = store.committed()
    if not epochs:
        raise FileNotFoundError(f"no version of the artifacts under {root}")
    commit = store.commit_of(epochs[-1])
    note, out = commit["note"], {n: store.read(n, epochs[-1:]) for n in commit["schemas"]}
    path, schema = note["training_set"]
    factors = None
    if note["factors"]:
        factors = Factors(out.pop("user_factors"), out.pop("item_factors"), note["factors"]["rank"], note["factors"]["kind"])
    prof = {n.removeprefix("profiles_"): out.pop(n) for n in list(out) if n.startswith("profiles_")}
    return out | {"profiles": prof, "training_set": spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(path), "model": load_model(note["ranker"]),
                  "model_path": note["ranker"], "factors": factors, "version": epochs[-1]}


def feature_importances(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """The ranker's feature importances as rows (feature, importance)."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(FEATURES, [float(x) for x in imp])), "feature string, importance double")
