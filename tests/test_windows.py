"""Chunked sessionization equals a single-window timeline scan."""

from pyspark.sql import functions as F

from conftest import SF_MID
from rivulet.operators import windows as W
from rivulet.sources import binding as B


def _rows(df):
    return sorted(tuple(r) for r in df.select("user_id", "item_id", "seq_a", "session_id", "pos").collect())


def test_sessionize_chunk_independent(spark):
    ev = B.event_interactions(spark, SF_MID)
    base = _rows(W.sessionize(ev, 3600, None, chunk_seconds=10 ** 9))
    for chunk in (600, 3600, 7200, 86400):
        assert _rows(W.sessionize(ev, 3600, None, chunk_seconds=chunk)) == base


def test_lookahead_pairs_count_matches_fixture(spark):
    """Every (user, order date) is one session at gap 1 h: 11,525 pairs."""
    sess = W.sessionize(B.interactions(spark, "/root/testdata/sf0.001"), 3600, None)
    assert W.lookahead_pairs(sess, 5).count() == 11525


def test_similar_items_leaders_exact(spark):
    """Per-key top-(k+1) pre-cut equals the full self-join ranking."""
    from rivulet.operators.joins import similar_items
    items = B.items(spark, "/root/testdata/sf0.001")
    fast = {(r.item_id, r.sim_id, r.rank) for r in similar_items(items, 5).collect()}
    rows = items.collect()
    keys = {r.item_id: {"cat:" + r.category} | {"tag:" + t for t in r.tags} for r in rows}
    info = {r.item_id: (r.rating, r.view_count) for r in rows}
    brute = set()
    for a in keys:
        sims = [b for b in keys if b != a and keys[a] & keys[b]]
        sims.sort(key=lambda b: (-info[b][0], -info[b][1], b))
        brute |= {(a, b, i + 1) for i, b in enumerate(sims[:5])}
    assert fast == brute


def test_lookahead_of_long_sessions_sends_rows_once(spark):
    """Equal to counting positions where a session spans several runs; no row
    is multiplied by ``ahead`` and the sessions are not made twice."""
    sizes = {("a", 1): 150, ("a", 2): 64, ("b", 1): 69, ("c", 1): 1}
    sess = spark.createDataFrame([(u, s, p, f"{u}{s}-{p}") for (u, s), n in sizes.items() for p in range(n)] + [(None, 1, 0, "x"), (None, 1, 1, "y")],
                                 "user_id string, session_id long, pos long, item_id string")
    pairs = W.lookahead_pairs(sess, 5)
    got = sorted(tuple(r) for r in pairs.collect())
    assert got == sorted((u, s, p, q, f"{u}{s}-{p}", f"{u}{s}-{q}") for (u, s), n in sizes.items() for p in range(n) for q in range(p + 1, min(p + 6, n)))
    plan = W.covisitation_edges(B.interactions(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "sequence(" not in plan
