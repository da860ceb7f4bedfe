"""Invariants of the model-based and random operators (no oracle possible)."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from rivulet.operators import recommend as RC
from rivulet.operators.experiments import bandit_posterior, thompson_assign
from rivulet.operators.windows import covisitation_edges
from rivulet.sources import binding as B


@pytest.fixture(scope="module")
def data(spark):
    inter = B.interactions(spark, SF_SMALL).cache()
    return {"inter": inter, "users": B.users(spark, SF_SMALL).cache(), "items": B.items(spark, SF_SMALL).cache(),
            "prof": RC.user_profiles(inter, B.users(spark, SF_SMALL), B.items(spark, SF_SMALL)),
            "as_of": B.as_of(inter)}


def test_candidates_bounded_and_unseen(spark, data):
    c = RC.candidates(spark, data["users"], data["inter"], data["items"], covisitation_edges(data["inter"]),
                      None, 50, exclude=data["users"].select("user_id", F.lit("7").alias("item_id")))
    assert c.where("item_id = '7'").count() == 0
    per_user = c.groupBy("user_id").count()
    assert per_user.agg(F.max("count")).first()[0] <= 50
    assert c.join(data["inter"].select("user_id", "item_id"), ["user_id", "item_id"], "left_semi").count() == 0
    assert c.groupBy("user_id", "item_id").count().filter("count > 1").count() == 0


def test_training_set_and_ranker(spark, data):
    train = RC.training_set(spark, data["inter"], data["users"], data["items"], data["prof"], data["as_of"], 42)
    labels = {r.label for r in train.select("label").distinct().collect()}
    assert labels <= {0.0, 0.7, 1.0} and 0.0 in labels
    n_pos = train.filter("label > 0").count()
    assert train.filter("label = 0").count() == min(n_pos, 5000)
    again = RC.training_set(spark, data["inter"], data["users"], data["items"], data["prof"], data["as_of"], 42)
    assert sorted(r.pair_id for r in again.select("pair_id").collect()) == \
        sorted(r.pair_id for r in train.select("pair_id").collect())
    model = RC.fit_ranker(train, max_iter=5, max_depth=3)
    path = spark.sparkContext.getCheckpointDir() + "/model-test"
    RC.save_model(model, path)
    loaded = RC.load_model(path)
    a = model.transform(train).select("pair_id", "ml_score").orderBy("pair_id").collect()
    b = loaded.transform(train).select("pair_id", "ml_score").orderBy("pair_id").collect()
    assert a == b


def test_recommend_control_invariants(spark, data):
    r = RC.recommend_control(spark, data["users"], data["inter"], data["items"], 10)
    assert r.groupBy("user_id").count().agg(F.max("count")).first()[0] <= 10
    assert r.join(data["inter"].select("user_id", "item_id"), ["user_id", "item_id"], "left_semi").count() == 0
    ranks = r.groupBy("user_id").agg(F.max("rec_rank").alias("m"), F.count(F.lit(1)).alias("n"))
    assert ranks.filter("m != n").count() == 0


@pytest.mark.parametrize("kind", ["als", "svd"])
def test_factors_and_scores(spark, data, kind):
    m = RC.fit_factors(data["inter"], rank=8, max_iter=3, kind=kind)
    s = RC.factor_scores(data["inter"].select("user_id", "item_id").distinct(), m)
    rng = s.agg(F.min("factor_score"), F.max("factor_score")).first()
    assert 0.0 <= rng[0] and rng[1] <= 1.0


def test_thompson_repeatable_and_shares(spark):
    post = spark.createDataFrame([("e", "a", 50.0, 50.0), ("e", "b", 90.0, 10.0)],
                                 "experiment_id string, arm string, alpha double, beta double")
    users = spark.range(2000).select(F.col("id").cast("string").alias("user_id"), F.lit("e").alias("experiment_id"))
    a = {r.user_id: r.arm for r in thompson_assign(users, post, 7).collect()}
    b = {r.user_id: r.arm for r in thompson_assign(users.repartition(3), post, 7).collect()}
    assert a == b
    share_b = sum(1 for v in a.values() if v == "b") / len(a)
    assert share_b > 0.95


def test_bandit_ignores_unknown_arm(spark):
    arms = spark.createDataFrame([("e", "a"), ("e", "b")], "experiment_id string, arm string")
    out = spark.createDataFrame([("e", "a", 1.0), ("e", "a", 0.0), ("e", "zzz", 1.0)],
                                "experiment_id string, arm string, reward double")
    got = {r.arm: (r.alpha, r.beta) for r in bandit_posterior(spark, out, arms).collect()}
    assert got == {"a": (2.0, 2.0), "b": (1.0, 1.0)}


def test_factors_of_text_ids_and_better_with_rank(spark):
    """Ids that are no numbers; the error of the decomposition falls with k."""
    rows = [(f"ml_user_{u}", f"ml_movie_{i}", "like" if (u * i) % 3 else "view", 30 + u * i % 50) for u in range(12) for i in range(9) if (u + i) % 2]
    inter = spark.createDataFrame(rows, "user_id string, item_id string, interaction_type string, dwell_seconds int")
    from rivulet.operators.aggregates import confidence_matrix
    want = {(r[0], r[1]): r[2] for r in confidence_matrix(inter).collect()}
    errors = []
    for k in (1, 3, 8):
        f = RC.fit_factors(inter, rank=k, kind="svd")
        u = {r[0]: r[1] for r in f.users.collect()}
        v = {r[0]: r[1] for r in f.items.collect()}
        assert set(u) == {x for x, _ in want} and set(v) == {x for _, x in want}
        errors.append(sum((want.get((a, b), 0) - sum(x * y for x, y in zip(u[a], v[b]))) ** 2 for a in u for b in v))
    assert errors[0] > errors[1] > errors[2]
    als = RC.fit_factors(inter, rank=4, max_iter=2)
    assert {r[0] for r in als.users.collect()} == set(u)


def test_history_beyond_500_events_is_excluded(spark, data):
    items = data["items"]
    ids = [r[0] for r in items.select("item_id").collect()]
    events = spark.createDataFrame([("u", ids[k % len(ids)] if k < 600 else "none", "view", 5, k) for k in range(600)],
                                   "user_id string, item_id string, interaction_type string, dwell_seconds int, k int")
    events = events.withColumn("timestamp", F.timestamp_seconds(F.lit(1.6e9) + F.col("k"))).withColumn("rating", F.lit(None).cast("double"))
    users = spark.createDataFrame([("u",)], "user_id string")
    assert RC.candidates(spark, users, events, items, covisitation_edges(events), None, 50).count() == max(0, min(50, len(ids) - 600))
    assert RC.recommend_control(spark, users, events, items, 10).join(events, "item_id", "left_semi").count() == 0


def test_popularity_ranking_keeps_all_and_falls_back(spark, data):
    from rivulet.operators.ranking import popularity_ranking
    users = spark.createDataFrame([("a",), ("b",)], "user_id string")
    cands = data["items"].limit(120).select(F.lit("a").alias("user_id"), "item_id")
    got = {r[0]: r[1] for r in popularity_ranking(data["items"], cands, users, 50).groupBy("user_id").count().collect()}
    assert got == {"a": 120, "b": 50}


def test_candidates_shuffle_lists_not_pairs(spark):
    """Null ids and repeated user rows keep their rows; a user's ids meet as
    lists, never as (user, item) rows that are made distinct."""
    users = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "user_id string")
    events = spark.createDataFrame([("a", "1", 1), ("b", "2", 1), ("c", "1", 1), (None, "3", 1)], "user_id string, item_id string, t long")
    events = events.withColumn("timestamp", F.timestamp_seconds("t"))
    items = spark.createDataFrame([(str(i), f"t{i}", 10 - i) for i in range(1, 5)], "item_id string, title string, view_count long").select(
        "*", F.lit("video").alias("content_type"), F.lit("c").alias("category"), F.lit("").alias("description"),
        F.lit("").alias("thumbnail_url"), F.lit(1.0).alias("rating"))
    covis = spark.createDataFrame([("1", "2", 3), ("1", None, 2), ("1", "9", 1)], "item_a string, item_b string, weight long")
    out = RC.candidates(spark, users, events, items, covis, None, 5)
    got = sorted(((r[0], r[1], r[2]) for r in out.collect()), key=str)
    a = [("a", None, 1), ("a", "2", 2), ("a", "3", 3), ("a", "4", 4), ("a", "9", 5)]
    b = [("b", "1", 1), ("b", "3", 2), ("b", "4", 3)]
    c = [("c", None, 1), ("c", "2", 2), ("c", "9", 3)]
    n = [(None, str(i), i) for i in range(1, 5)]
    assert got == sorted(a + b + c + n + n, key=str)
    assert "Aggregate [user_id#" in out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_training_set_profiles_its_own_users_only(spark, data):
    """Profiles of the rows' users alone give the rows of everybody's."""
    args = (spark, data["inter"], data["users"], data["items"])
    rows = lambda prof: sorted(map(str, RC.training_set(*args, prof, data["as_of"], 42, max_pos=40, max_neg=20).collect()))
    assert rows(None) == rows(data["prof"])


def test_features_meet_one_row_per_user(spark):
    """Repeated item rows count their tags once per row, null and unknown keys
    count nothing, and pairs are sent to their users once."""
    items = spark.createDataFrame([("1", "c", "video", ["x", "x", None]), ("1", "d", "video", ["y"]), ("2", None, "movie", None)],
                                  "item_id string, category string, content_type string, tags array<string>").select(
        "*", F.lit(1.0).alias("rating"), F.lit(3).cast("long").alias("view_count"), F.lit(None).cast("timestamp").alias("publish_ts"))
    inter = spark.createDataFrame([("a", "1", 20, 2.0), ("a", "2", 0, None), (None, "1", 5, 1.0)], "user_id string, item_id string, dwell_seconds int, rating double")
    users = spark.createDataFrame([("a", "DE", "web", "18-24")], "user_id string, country string, device string, age_group string")
    pairs = spark.createDataFrame([("a", "1", 1), ("a", "2", 1), ("a", "9", 1), ("b", "1", 1), (None, "1", 1)], "user_id string, item_id string, dwell_seconds int")
    f = RC.features(pairs, RC.profiles_of(pairs, inter, users, items), items, F.lit("2024-01-01").cast("timestamp"))
    got = sorted(((r["user_id"], r["item_id"], round(r["category_affinity"] * 3), round(r["type_affinity"] * 3), round(r["tag_overlap"] * 3)) for r in f.collect()), key=str)
    # a has three joined interactions: item 1 twice, as it has two rows
    assert got == sorted([("a", "1", 1, 2, 5), ("a", "1", 1, 2, 5), ("a", "2", 0, 1, 0), ("a", "9", 0, 0, 0), ("b", "1", 0, 0, 0), ("b", "1", 0, 0, 0),
                          (None, "1", 0, 0, 0), (None, "1", 0, 0, 0)], key=str)
    assert f._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") <= 5


def test_factor_scores_meet_in_blocks(spark, monkeypatch):
    """Repeated ids, vectors that are null, hold nulls or differ in length, and
    unknown ids, over several blocks; no pair carries a vector."""
    monkeypatch.setattr(RC, "ITEM_BLOCK", 2)
    monkeypatch.setattr(RC, "PAIR_BLOCK", 2)
    u = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None), ("c", [1.0]), ("d", [0.0, float("inf")])], "user_id string, features array<double>")
    i = spark.createDataFrame([(str(k), [float(k), 1.0]) for k in range(5)] + [("4", [9.0, 1.0]), ("n", [None, 1.0]), (None, [1.0, 1.0])], "item_id string, features array<double>")
    pairs = spark.createDataFrame([(x, y) for x in "abcdz" for y in ["0", "1", "2", "4", "4", "n", "q", None]], "user_id string, item_id string")
    got = sorted(((r[0], r[1], None if r[2] is None else round(r[2], 6)) for r in RC.factor_scores(pairs, RC.Factors(u, i, 2, "given")).collect()), key=str)
    want = [("a", "0", 0.0), ("a", "1", round(1 / 9, 6)), ("a", "2", round(2 / 9, 6)), ("a", "4", round(4 / 9, 6)), ("a", "4", 1.0), ("a", "n", None)]
    want += [(x, y, 0.0) for x in "bcd" for y in ["0", "1", "2", "4", "4", "n"]]
    assert got == sorted(want, key=str)


def test_candidates_are_drawn_from_written_pools(spark):
    """What ranks the neighbours is done before the lists are made, so that
    its shuffle files are not held beside theirs; null neighbours are kept."""
    import datetime as dt
    users = spark.createDataFrame([("u1",), ("u2",)], "user_id string")
    inter = spark.createDataFrame([("u1", "a", dt.datetime(2020, 1, 1))], "user_id string, item_id string, timestamp timestamp")
    items = spark.createDataFrame([(x, n) for n, x in enumerate("abcd")], "item_id string, view_count long").select(
        "*", F.col("item_id").alias("title"), F.lit("video").alias("content_type"), F.lit("c").alias("category"),
        F.lit("").alias("description"), F.lit("").alias("thumbnail_url"), F.lit(1.0).alias("rating"))
    covis = spark.createDataFrame([("a", "z", 3), ("a", None, 2), ("b", "y", 9)], "item_a string, item_b string, weight long")
    got = RC.candidates(spark, users, inter, items, covis, None, 10)
    assert "weight" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.user_id, r.item_id) for r in got.collect()} == {("u1", x) for x in ("b", "c", "d", "z", None)} | {("u2", x) for x in "abcd"}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
