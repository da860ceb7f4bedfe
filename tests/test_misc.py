"""Library functions without a registered query."""

import os

from rivulet.operators.sets import write_catalogue
from rivulet.operators.windows import suggestion_merge
from rivulet.sources import binding as B
from rivulet.sources.tables import read_table

from conftest import SF_SMALL


def test_suggestion_merge(spark):
    live = spark.createDataFrame([("u1", "rock", 1), ("u1", "jazz", 2)], "user_id string, text string, rank int")
    recent = spark.createDataFrame([("u1", "jazz", 1), ("u1", "pop", 2), ("u2", "folk", 1)],
                                   "user_id string, text string, rank int")
    defaults = spark.createDataFrame([(u, t, i + 1) for u in ("u1", "u2") for i, t in enumerate(["a", "b"])],
                                     "user_id string, text string, rank int")
    got = {}
    for r in suggestion_merge(live, recent, defaults, 3).collect():
        got.setdefault(r.user_id, []).append((r.rank, r.text))
    assert sorted(got["u1"]) == [(1, "rock"), (2, "jazz"), (3, "pop")]
    assert sorted(got["u2"]) == [(1, "folk"), (2, "a"), (3, "b")]


def test_write_and_read_catalogue(spark, tmpdir_path):
    items, users, inter = B.items(spark, SF_SMALL), B.users(spark, SF_SMALL), B.event_interactions(spark, SF_SMALL)
    out = os.path.join(tmpdir_path, "cat")
    write_catalogue(items, users, inter.drop("seq_a"), out)
    back = read_table(spark, f"{out}/items", "items")
    assert back.count() == items.count()
    assert {r.content_type for r in back.select("content_type").distinct().collect()} == \
        {r.content_type for r in items.select("content_type").distinct().collect()}
    assert read_table(spark, f"{out}/interactions", "interactions").count() == inter.count()


def test_stream_outputs_of_planted_events(spark, tmpdir_path):
    """Pairs of closed sessions only, and a z-test on rates below one."""
    from datetime import datetime, timedelta

    import pyarrow as pa
    import pyarrow.parquet as pq

    from rivulet.plans.registry import load_all
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(seconds=k), k, "view", 1.0, '{"k": 7}') for k in range(1000, 3000)]
    # every third viewer also clicks, half a day on, and views another item at once
    rows += [(10 * k, start + timedelta(hours=12, seconds=k), k, "click", 1.0, '{"k": 8}') for k in range(1000, 3000, 3)]
    rows += [(10 * k + 1, start + timedelta(hours=12, seconds=k + 60), k, "view", 1.0, '{"k": 9}') for k in range(1000, 3000, 3)]
    rows += [(50000, start + timedelta(days=2), 1, "view", 1.0, '{"k": 1}'), (50001, start + timedelta(days=2), 1, "view", 1.0, '{"k": 2}')]
    columns = dict(zip(("event_id", "ts", "user_id", "event_type", "value", "props"), zip(*rows)))
    pq.write_table(pa.table(columns), f"{tmpdir_path}/events.parquet")
    reg = load_all()
    sessions = {(r.item_a, r.item_b): r.weight for r in reg["stream_covisitation"].build(spark, tmpdir_path).collect()}
    assert sessions == {("8", "9"): 667, ("9", "8"): 667}
    r = reg["stream_experiment_significance"].build(spark, tmpdir_path).first()
    assert r.control_requests + r.treatment_requests == 2000 + 667 + 2 and r.control_interactions + r.treatment_interactions == 667
    p1, p2 = r.control_interactions / r.control_requests, r.treatment_interactions / r.treatment_requests
    pool = 667 / 2669
    z = (p2 - p1) / (pool * (1 - pool) * (1 / r.control_requests + 1 / r.treatment_requests)) ** 0.5
    assert abs(r.z_score - z) < 1e-5 and r.status in ("significant", "not significant") and r.p_value is not None


def test_system_stats_full_lists_types_and_categories(spark):
    from pyspark.sql import functions as F

    from rivulet.operators import aggregates as A
    items = spark.range(24).select(F.col("id").cast("string").alias("item_id"), F.concat(F.lit("t"), F.col("id") % 3).alias("content_type"),
                                   F.concat(F.lit("c"), F.col("id") % 12).alias("category"))
    inter = spark.range(40).select(F.lit("u").alias("user_id"), (F.col("id") % 25).cast("string").alias("item_id"),
                                   F.lit("2024-01-01").cast("timestamp").alias("timestamp"))
    r = A.system_stats_full(spark, spark.range(1), items, inter, inter.agg(F.max("timestamp")).scalar()).first()
    assert (r.item_types, r.item_type_counts) == (["t0", "t1", "t2"], [8, 8, 8])
    # items 0..14 twice, 15..24 once; item 24 is unknown
    n = {f"c{k}": sum(2 if i < 15 else 1 for i in (k, k + 12)) for k in range(12)} | {None: 1}
    expect = sorted(n.items(), key=lambda x: (-x[1], x[0] is None, x[0] or ""))[:10]
    assert list(zip(r.categories, r.category_counts)) == expect and r.top_category == expect[0][0]


def test_topk_inner_equals_brute_force(spark, monkeypatch):
    """Blocks of any size, negative weights, ties, wide ids, unlike id types."""
    import random

    from rivulet.operators import text as TX
    rnd = random.Random(11)

    def vectors(n, low, base):
        out = []
        for k in range(n):
            idx = sorted(rnd.sample(range(20), rnd.randint(1, 6)))
            out.append((base + k, idx, [float(rnd.randint(low, 4)) for _ in idx]))
        return out

    for low, positive, block in ((1, True, 8), (-3, False, 16), (1, True, 1024)):
        monkeypatch.setattr(TX, "BLOCK_ROWS", block)
        docs, asks = vectors(300, low, 1 << 60), vectors(40, low, (1 << 60) + 100)
        dot = lambda a, b: sum(x * dict(zip(*b[1:])).get(i, 0.0) for i, x in zip(*a[1:]))
        want = set()
        for a in asks:
            scores = sorted(((-dot(a, b), b[0]) for b in docs if set(a[1]) & set(b[1]) and b[0] != a[0]))
            want |= {(a[0], d, -s) for s, d in [x for x in scores if not positive or -x[0] > 0][:5]}
        kind = "id long, idx array<int>, val array<double>"
        got = TX.topk_inner(spark.createDataFrame(asks, kind), spark.createDataFrame(docs, kind), 20, 5, exclude_self=True, positive=positive).collect()
        if positive:
            assert {(r.id, r.other, r.similarity) for r in got} == want
        else:  # documents without a common term score zero there
            floor = {a[0]: sorted((s for q, _, s in want if q == a[0]), reverse=True) for a in asks}
            for a in asks:
                own = sorted((r.similarity for r in got if r.id == a[0]), reverse=True)
                assert all(s == f for s, f in zip(own, floor[a[0]]) if f > 0)
        named = TX.topk_inner(spark.createDataFrame([(f"q{a[0]}", *a[1:]) for a in asks], kind.replace("id long", "id string")),
                              spark.createDataFrame(docs, kind), 20, 5, positive=positive).count()
        assert named > 0


def test_topk_inner_keeps_rows_of_equal_vectors(spark):
    """Equal vectors are compared once; repeated ids and the own id stay right,
    and vectors without idx hold every place."""
    from rivulet.operators import text as TX
    docs = [(k, None, [1.0, 0.0] if k < 30 else [0.6, 0.8]) for k in range(40)] + [(7, None, [0.6, 0.8])] * 2 + [
        (50, None, None), (None, None, [1.0, 0.0]), (51, None, [None, 1.0]), (52, None, [float("nan"), 1.0])]
    df = spark.createDataFrame(docs, "id long, idx array<int>, val array<double>")
    got = {}
    for r in TX.topk_inner(df, df, 2, 4, exclude_self=True).collect():
        got.setdefault(r.id, []).append((r["rank"], r.other, r.similarity))
    assert sorted(got) == list(range(40))
    assert sorted(got[0]) == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0), (4, 4, 1.0)]
    assert sorted(got[35]) == [(1, 7, 1.0), (2, 7, 1.0), (3, 30, 1.0), (4, 31, 1.0)]
    assert [x[1:] for x in sorted(got[7])][:2] == [(0, 1.0), (0, 1.0)] or sorted(got[7])[0][1:] == (0, 1.0)


def test_vectors_are_sent_to_a_bounded_number_of_blocks(spark, monkeypatch):
    """More vectors make larger blocks, not more of them."""
    from pyspark.sql import functions as F

    from rivulet.operators import text as TX
    from rivulet.operators.components import reliable
    monkeypatch.setattr(TX, "BLOCK_ROWS", 4)
    rows = spark.range(4000).select("id", F.lit(None).cast("array<int>").alias("idx"), F.array(*[F.rand(k) for k in range(8)]).alias("val"))
    blocks = TX._blocks(reliable(TX._vectors(reliable(TX._coded(rows)))))
    assert blocks.count() == 4000 and blocks.select("block").distinct().count() <= TX.BLOCKS


def _odd_items(spark, n=60):
    import random
    rnd = random.Random(3)
    rows = [(str(k), rnd.choice("ab"), rnd.sample(["x", "y", "z", None], rnd.randint(0, 3)), rnd.choice([1.0, 2.0, None]), rnd.choice([5, 6, None])) for k in range(n)]
    rows += [rows[4], ("4", "c", ["w"], 1.0, 5), ("77", "c", None, 2.0, 6), (None, "a", ["x"], 9.0, 9)]
    return rows, spark.createDataFrame(rows, "item_id string, category string, tags array<string>, rating double, view_count long")


def test_similar_items_equals_brute_force_and_takes_some_only(spark):
    from rivulet.operators.joins import similar_items
    rows, items = _odd_items(spark)
    keys = lambda r: {"c" + r[1]} | {"t" + t for t in r[2] or () if t}
    place = lambda r: (r[3] is None, -(r[3] or 0), r[4] is None, -(r[4] or 0), r[0])
    want = {}
    for own in {r[0] for r in rows if r[0]}:
        mine = set().union(*(keys(r) for r in rows if r[0] == own))
        want[own] = [x[-1] for x in sorted({place(r) for r in rows if r[0] and r[0] != own and keys(r) & mine})[:5]]
    got = {}
    for r in sorted(similar_items(items, 5).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.item_id, []).append(r.sim_id)
    assert got == {k: v for k, v in want.items() if v}
    some = similar_items(items, 5, of=items.where("item_id in ('4', '9')").select("item_id")).collect()
    assert {r.item_id for r in some} == {"4", "9"} and len(some) == 10


def test_searches_look_at_each_text_once(spark, monkeypatch):
    """1,000 items of ten texts: ten texts are indexed, all items are found."""
    from pyspark.sql import functions as F

    from rivulet.operators import search as SE
    items = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("item_id"), F.concat(F.lit("alpha beta"), F.col("id") % 10).alias("title"),
                                     F.when(F.col("id") % 3 != 0, F.concat(F.lit("t"), F.col("id") % 3)).alias("content_type"), F.lit("cat").alias("category"), F.lit("").alias("description"),
                                     F.lit("").alias("thumbnail_url"), F.lit(1.0).alias("rating"), F.col("id").alias("view_count"), F.array(F.lit("tag")).alias("tags"))
    seen, plain = [], SE.inverted_index
    monkeypatch.setattr(SE, "inverted_index", lambda s, i, t=None: (seen.append(i.count()), plain(s, i, t))[1])
    q = spark.createDataFrame([(1, "beta7 nothing", None), (2, "alpha", "t2"), (3, "be", None), (4, "beta7", "t1")], "query_id long, text string, content_type string")
    got = {}
    for r in SE.text_search(spark, q, items, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.item_id))
    assert seen == [10]
    assert [i for _, i in sorted(got[1])] == ["0007", "0017", "0027", "0037", "0047"]
    assert [i for _, i in sorted(got[2])] == ["0002", "0005", "0008", "0011", "0014"]
    assert [i for _, i in sorted(got[4])] == ["0007", "0037", "0067", "0097", "0127"]
    hits = SE.literal_hits(spark, q, items)
    assert {r.query_id: r["count"] for r in hits.groupBy("query_id").count().collect()} == {2: 1000, 3: 1000, 4: 100}
    best = SE.literal_search(spark, q, items, 3).collect()
    assert sorted((r.query_id, r["rank"], r.item_id) for r in best if r.query_id == 4) == [(4, 1, "0997"), (4, 2, "0967"), (4, 3, "0937")]


def test_routes_read_their_queries_classified(spark):
    """The patterns run once, not wherever a route reads its queries, and the
    answers of all routes hold no joins of theirs any more."""
    from rivulet.plans import q_routes as Q
    from rivulet.plans.registry import load_all
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan(Q._classified(spark, SF_SMALL, "general"))
    assert "Join" not in plan(load_all()["answer_routed_queries"].build(spark, SF_SMALL))


def test_texts_are_split_into_words_once(spark, monkeypatch):
    """Vocabulary and vectors come from one table of counts."""
    from rivulet.operators import text as TX
    from rivulet.plans.registry import load_all
    times, plain = [], TX.term_counts
    monkeypatch.setattr(TX, "term_counts", lambda *a: (times.append(1), plain(*a))[1])
    assert load_all()["tfidf_vectors"].build(spark, SF_SMALL).count() > 0 and len(times) == 1
