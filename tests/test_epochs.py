"""Exactly-once sinks: replayed epochs, changed buckets, dirty users."""

import datetime as dt
import os
import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rivulet.streaming import jobs as SJ
from rivulet.streaming.epochs import EpochStore, KeyedTable


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def valid_events(spark, n, low=0):
    return spark.range(low, low + n).select(
        F.col("id").cast("string").alias("interaction_id"), F.concat(F.lit("u"), F.col("id") % 7).alias("user_id"),
        F.concat(F.lit("i"), F.col("id") % 5).alias("item_id"), F.lit("view").alias("type"),
        F.timestamp_seconds(F.col("id")).alias("ts"), F.lit(1).alias("dwell_seconds"), F.lit(None).cast("double").alias("rating"),
        F.lit("{}").alias("context"), (F.col("id") % 10 != 0).alias("valid"))


def lose(store, epoch):
    """As if the driver was lost before the epoch was committed."""
    files = store.files
    assert files.fs.delete(files.path(store._commit_file(epoch)), False)


@pytest.mark.parametrize("committed", [True, False])
def test_a_replayed_epoch_changes_nothing(spark, tmpdir_path, committed):
    root = os.path.join(tmpdir_path, "t")
    sinks = {"validated": (SJ.validated_sink(spark, f"{root}/v"), f"{root}/v/tables", ["events", "quarantine"]),
             "dirty": (SJ.dirty_sink(spark, f"{root}/d"), f"{root}/d", ["dirty"]),
             "lastn": (lambda b, e, s=SJ.last_n_sink(spark, f"{root}/l", 20): s(SJ.experiment_stream(b), e), f"{root}/l", ["rows"]),
             "trigger": (lambda b, e, s=SJ.trigger_sink(spark, f"{root}/r", 30): s(b.groupBy().agg(F.count("*").alias("total")), e), f"{root}/r", ["triggers", "totals"])}
    batches = {"trigger": [valid_events(spark, 50), valid_events(spark, 130)]}
    for name, (sink, where, tables) in sinks.items():
        first, second = batches.get(name, [valid_events(spark, 50), valid_events(spark, 80, 50)])
        store = EpochStore(spark, where)
        sink(first, 0)
        sink(second, 1)
        want = {t: rows(store.read(t)) for t in tables}
        if not committed:
            lose(store, 1)
            assert store.committed() == [0] and {t: rows(store.read(t)) for t in tables} != want
        sink(second, 1)
        assert store.committed() == [0, 1] and {t: rows(store.read(t)) for t in tables} == want, name
    assert [r["at_event"] for r in EpochStore(spark, f"{root}/r").read("triggers").orderBy("at_event").collect()] == [30, 60, 90, 120]
    assert EpochStore(spark, f"{root}/r").read_latest("totals").first()["progress_pct"] == pytest.approx(100 * 10 / 30)


def test_an_empty_quarantine_is_an_empty_table(spark, tmpdir_path):
    sink = SJ.validated_sink(spark, tmpdir_path)
    sink(valid_events(spark, 9, 1), 0)
    store = EpochStore(spark, f"{tmpdir_path}/tables")
    assert store.read("quarantine").count() == 0 and store.read("events").count() == 9
    with pytest.raises(FileNotFoundError):
        EpochStore(spark, f"{tmpdir_path}/none").read("events")


def test_a_batch_rewrites_its_buckets_only(spark, tmpdir_path):
    table = KeyedTable(spark, f"{tmpdir_path}/k", ["key"], 64)
    table.merge(spark.range(1000).select(F.col("id").alias("key"), F.lit(1).alias("n")), 0)
    batch = spark.range(10).select((F.col("id") * 97).alias("key"), F.lit(2).alias("n"))
    touched = table.merge(batch, 1)
    assert 0 < len(touched) <= 10
    assert {n for n in os.listdir(table.store.folder("rows", 1)) if n.startswith("_bucket")} == {f"_bucket={b}" for b in touched}
    want = [(k, 2 if k % 97 == 0 and k < 970 else 1) for k in range(1000)]
    assert rows(table.read()) == sorted(want, key=repr)
    assert table.merge(batch, 1) == [] and rows(table.read()) == sorted(want, key=repr)   # replayed after the commit
    lose(table.store, 1)
    assert table.merge(batch, 1) == touched and rows(table.read()) == sorted(want, key=repr)  # replayed before it
    everything = table.read().select("key")
    assert len(table.merge(table.read().limit(0), 2, replaced=everything)) == 64 and table.read().count() == 0


def test_dirty_users_are_refreshed_and_others_left_alone(spark, tmpdir_path):
    from conftest import SF_SMALL
    from rivulet.operators import recommend as RC
    from rivulet.sources import binding as B
    inter, items, users = B.interactions(spark, SF_SMALL), B.items(spark, SF_SMALL), B.users(spark, SF_SMALL)
    popular = items.select("item_id", "view_count")

    def newest(of):
        own = RC.newest_items(inter.join(of, "user_id", "left_semi"), 5)
        return own.join(popular, "item_id").select("user_id", "item_id", F.col("rank").cast("long").alias("rank"), "view_count")

    table = KeyedTable(spark, f"{tmpdir_path}/recs", ["user_id"], 32)
    SJ.refresh_users(table, users.select("user_id"), newest, 0)
    full = rows(table.read().select("user_id", "item_id", "rank"))
    assert full == rows(newest(users.select("user_id")).select("user_id", "item_id", "rank"))
    asked = []
    dirty = users.select("user_id").orderBy("user_id").limit(3)

    def changed(of):
        asked.extend(r["user_id"] for r in of.collect())
        return newest(of).withColumn("view_count", F.lit(-1).cast(popular.schema["view_count"].dataType))

    touched = SJ.refresh_users(table, dirty.union(dirty), changed, 1)
    mine = {r["user_id"] for r in dirty.collect()}
    assert sorted(asked) == sorted(mine) and len(touched) <= 3
    got = table.read().collect()
    assert rows(table.read().select("user_id", "item_id", "rank")) == full
    assert {r["user_id"] for r in got if r["view_count"] == -1} == mine & {r["user_id"] for r in got}


def test_pair_state_in_event_order():
    """Events out of order, in batches as the watermark moves, as in one go."""
    import random
    rnd = random.Random(2)
    gap = 100
    for _ in range(200):
        events = sorted([rnd.randint(0, 1500), k, f"i{rnd.randint(0, 5)}"] for k in range(rnd.randint(0, 25)))
        whole = SJ.PairState(None, gap, 3)
        whole.pending = [list(e) for e in events]
        want = whole.advance(10_000)
        text, got, rest, mark = None, [], list(events), 0
        while rest or mark < 10_000:
            mark += rnd.randint(1, 400)
            now = [e for e in rest if e[0] <= mark + 150]
            rest = [e for e in rest if e[0] > mark + 150]
            rnd.shuffle(now)
            own = SJ.PairState(text, gap, 3)
            own.pending += now
            got += own.advance(mark)
            assert own.wake_us() is None or own.wake_us() > mark
            text = own.text()
        assert got == want and SJ.PairState(text, gap, 3).wake_us() is None
    ends = [r for r in want if r[1] is not None]
    assert len({r[0] for r in ends}) == len(ends)


def test_activity_state_is_not_multiplied_by_windows(spark, tmp_path):
    """Batches with late events: an event counts in the windows that were open
    when its batch began.  The state has one row per bucket of users, not one
    per user and window, and the users are counted once per window."""
    day = dt.datetime(2024, 1, 1)
    at = lambda d, h, m=0: day + dt.timedelta(days=d, hours=h, minutes=m)
    files = [[("a", at(0, 10, 30)), ("a", at(0, 10, 40)), ("b", at(2, 5))], [("c", at(2, 1, 10)), ("a", at(4, 0, 20))],
             [("c", at(2, 1, 10)), ("d", at(2, 1, 20)), ("e", at(8, 0))]]
    source = tmp_path / "in"
    source.mkdir()
    for k, some in enumerate(files):
        pq.write_table(pa.table({"user_id": [r[0] for r in some], "ts": pa.array([r[1] for r in some], pa.timestamp("us", "UTC")), "valid": [True] * len(some)}), source / f"{k}.parquet")
        os.utime(source / f"{k}.parquet", (1_000_000 + k, 1_000_000 + k))
    ev = spark.readStream.schema("user_id string, ts timestamp, valid boolean").option("maxFilesPerTrigger", 1).parquet(str(source))
    base = str(tmp_path / "out")
    SJ.stream_activity(ev, base)
    got = EpochStore(spark, f"{base}/activity").read("activity").select(F.date_format("wt", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "active_users", "events")
    closed = [None, None, at(2, 4)]  # the last window's end that batches before had closed
    expected = {}
    for some, until in zip(files, closed):
        for user, ts in some:
            for k in range(24):
                end = ts.replace(minute=0) + dt.timedelta(hours=k + 1)
                if (until is None or end > until) and end <= at(7, 23):
                    expected.setdefault(end, []).append(user)
    assert rows(got) == sorted(((e - dt.timedelta(microseconds=1)).strftime("%Y-%m-%d %H:%M:%S.%f"), len(set(u)), len(u)) for e, u in expected.items())
    state = [spark.read.format("statestore").option("operatorId", k).load(f"{base}/_checkpoint").count() for k in os.listdir(f"{base}/_checkpoint/state")]
    assert sum(state) == 1  # of e; a row for each of 24 windows before


def test_activity_state_equals_counting_per_window():
    rng = random.Random(3)
    for _ in range(60):
        size, slide = rng.choice([(24, 1), (6, 2), (5, 2), (7, 3), (4, 4)])
        events = sorted((rng.randint(0, 150), rng.choice("abé")) for _ in range(rng.randint(1, 30)))
        held, users, counts, now, k = None, Counter(), Counter(), 0, 0
        while k < len(events) or now < 400:
            own, some = SJ.ActivityState(held, size, slide), events[k:k + rng.randint(0, 5)]
            if some:
                own.add(pd.Series([u for _, u in some]), np.array([t for t, _ in some]))
            k += len(some)
            for first, last, u, n in own.advance(now).itertuples(index=False):
                for end in range(first, last + 1, slide):
                    users[end] += u
                    counts[end] += n
            held = None if own.wake() is None else own.held()
            now = max(now, min(events[k][0] if k < len(events) else 1000, now + rng.randint(0, 9)))
        expected = {}
        for t, u in events:
            for start in range((t - size) // slide * slide, t + 1, slide):
                if start <= t < start + size:
                    expected.setdefault(start + size, []).append(u)
        assert {e: n for e, n in counts.items() if n} == {e: len(u) for e, u in expected.items()}
        assert {e: n for e, n in users.items() if n} == {e: len(set(u)) for e, u in expected.items()}
