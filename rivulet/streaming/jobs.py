"""Structured Streaming operators.

Every job takes a streaming DataFrame of canonical events, writes its result
as Parquet under ``base`` (a folder inside the shared checkpoint directory)
and keeps its own checkpoint there, so a restarted driver or lost executor
resumes from the last committed micro-batch.  Sinks are ``epochs`` tables: an
epoch is published once, however often it is replayed.  Nothing that grows is
collected to the driver: state lives in the state store and sinks are written
by executors.

``run`` drives a query with ``trigger(availableNow=True)``; production
deployments use a processing-time trigger with the same builders.
"""

from __future__ import annotations

import json
import math
import os
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import constants as K
from ..session import checkpoint_dir
from ..sources.binding import bucket_of
from ..sources.tables import raw
from .epochs import EpochStore, KeyedTable


def stream_base(spark: SparkSession, name: str) -> str:
    """A fresh folder for one stream run inside the shared checkpoint dir."""
    return os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:12]}")


def run(writer: DataStreamWriter, base: str, timeout_s: int | None = None) -> None:
    q = (writer.option("checkpointLocation", os.path.join(base, "_checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination(timeout_s)
    if q.exception():
        raise q.exception()


# ------------------------------------------------------------------ source

def raw_event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events table as a file stream (the folder, filtered to
    the events file)."""
    schema = raw(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def stream_events(raw_stream: DataFrame) -> DataFrame:
    """Parse, default and validate: canonical event columns plus ``valid``.
    ``ts`` is cast to ``timestamp`` (watermarks reject timestamp_ntz)."""
    itype = (F.when(F.col("event_type") == "signup", "bookmark")
             .when(F.col("event_type") == "error", "dislike")
             .otherwise(F.col("event_type")))
    ev = raw_stream.select(
        F.col("event_id").cast("string").alias("interaction_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.get_json_object("props", "$.k").alias("item_id"),
        itype.alias("type"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.coalesce(F.floor("value").cast("int"), F.lit(0)).alias("dwell_seconds"),
        F.lit(None).cast("double").alias("rating"),
        F.coalesce(F.col("props"), F.lit("{}")).alias("context"))
    valid = (F.col("type").isin(*K.INTERACTION_TYPES) & F.col("user_id").isNotNull()
             & F.col("item_id").isNotNull() & F.col("ts").isNotNull())
    return ev.withColumn("valid", valid)


def validated_sink(spark: SparkSession, base: str):
    store = EpochStore(spark, os.path.join(base, "tables"))

    def sink(batch: DataFrame, epoch: int) -> None:
        store.publish(epoch, {"events": batch.filter("valid").drop("valid"), "quarantine": batch.filter("NOT valid").drop("valid")})
    return sink


def write_validated(events: DataFrame, base: str) -> EpochStore:
    """Two tables from one stream, published together: valid rows in
    ``events``, the rest in ``quarantine``."""
    run(events.writeStream.foreachBatch(validated_sink(events.sparkSession, base)), base)
    return EpochStore(events.sparkSession, os.path.join(base, "tables"))


def stream_append(events: DataFrame, base: str, delay: str = "1 hour") -> None:
    """Append to the log with unique ids (duplicates inside the watermark
    delay are dropped by the state store)."""
    d = events.filter("valid").drop("valid").withWatermark("ts", delay).dropDuplicatesWithinWatermark(
        ["interaction_id"])
    run(d.writeStream.outputMode("append").format("parquet").option("path", os.path.join(base, "log")), base)


def version_sink(spark: SparkSession, root: str):
    """For complete mode over few groups: each epoch is the whole table."""
    store = EpochStore(spark, root)

    def sink(batch: DataFrame, epoch: int) -> None:
        store.publish(epoch, {"rows": batch})
    return sink


def latest_rows(spark: SparkSession, root: str) -> DataFrame:
    """The newest version that ``version_sink`` published."""
    return EpochStore(spark, root).read_latest("rows")


def counter_sink(table: KeyedTable):
    def sink(batch: DataFrame, epoch: int) -> None:
        table.merge(batch, epoch)
    return sink


def stream_counters(events: DataFrame, base: str, buckets: int = 64) -> tuple[KeyedTable, KeyedTable]:
    """+1 per user event; +1 item views only for ``view``: running counts in
    update mode, so that a batch hands over the keys it changed, and rewrites
    their buckets only.  Returns the tables of users and items."""
    spark, ev = events.sparkSession, events.filter("valid")
    per_user = ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    per_item = ev.filter(F.col("type") == "view").groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    users = KeyedTable(spark, os.path.join(base, "users"), ["user_id"], buckets)
    items = KeyedTable(spark, os.path.join(base, "items"), ["item_id"], buckets)
    run(per_user.writeStream.outputMode("update").foreachBatch(counter_sink(users)), os.path.join(base, "u"))
    run(per_item.writeStream.outputMode("update").foreachBatch(counter_sink(items)), os.path.join(base, "i"))
    return users, items


def stream_event_counts(events: DataFrame, base: str) -> None:
    c = events.filter("valid").groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    run(c.writeStream.outputMode("complete").foreachBatch(version_sink(events.sparkSession, os.path.join(base, "counts"))), base)


class ActivityState:
    """Events per user and cell (times that lie in the same windows) of a
    bucket of users, as long as a window that holds the cell is open, and the
    last window's end that spans were made for.  Times in microseconds;
    windows begin at multiples of ``slide``."""

    def __init__(self, held: tuple | None, size: int, slide: int):
        self.size, self.slide, self.cell = size, slide, math.gcd(size, slide)
        self.until, names, packed = held or (None, "[]", b"")
        self.names = json.loads(names)
        self.users, self.cells, self.counts = np.frombuffer(packed, np.int64).reshape(3, -1)

    def held(self) -> tuple:
        return self.until, json.dumps(self.names), np.stack([self.users, self.cells, self.counts]).tobytes()

    def add(self, users: pd.Series, times: np.ndarray) -> None:
        codes, names = pd.factorize(users)
        known = {name: k for k, name in enumerate(self.names)}
        places = np.array([known.setdefault(name, len(known)) for name in names], np.int64)
        self.names = list(known)
        both = pd.DataFrame({"u": np.r_[self.users, places[codes]], "c": np.r_[self.cells, times // self.cell * self.cell],
                             "n": np.r_[self.counts, np.ones(len(codes), np.int64)]})
        both = both.groupby(["u", "c"], sort=True)["n"].sum().reset_index()
        self.users, self.cells, self.counts = (both[c].to_numpy(np.int64) for c in ("u", "c", "n"))

    def _ends(self) -> tuple[np.ndarray, np.ndarray]:
        """The first and last end of the windows that hold each cell."""
        first = self.cells + self.cell
        return first + (self.size - first) % self.slide, self.cells + self.size - self.cells % self.slide

    def advance(self, now: int) -> pd.DataFrame:
        """Users and events to add to all windows from a first end to a last
        one, of those that ``now`` has passed; nothing to add to the newest of
        these, whether or not it has events, shows how far that was.  In a window a user counts by
        the newest cell there, up to where the user's next cell begins to."""
        closed = (now - self.size) // self.slide * self.slide + self.size
        first, last = self._ends()
        newest = last.copy()
        same = self.users[1:] == self.users[:-1]
        newest[:-1][same] = np.minimum(last[:-1], first[1:] - self.slide)[same]
        start = first if self.until is None else np.maximum(first, self.until + self.slide)
        spans = pd.concat([pd.DataFrame({"first_us": start, "last_us": np.minimum(newest, closed), "users": np.int64(1), "events": np.int64(0)}),
                           pd.DataFrame({"first_us": start, "last_us": np.minimum(last, closed), "users": np.int64(0), "events": self.counts})])
        spans = spans[spans["first_us"] <= spans["last_us"]]
        spans = pd.concat([spans, pd.DataFrame({"first_us": [closed], "last_us": [closed], "users": [0], "events": [0]})]).groupby(["first_us", "last_us"], as_index=False).sum()
        later = last > closed
        left, self.users = np.unique(self.users[later], return_inverse=True)
        self.names, self.cells, self.counts = [self.names[k] for k in left], self.cells[later], self.counts[later]
        self.until = closed if self.until is None else max(closed, self.until)
        return spans

    def wake(self) -> int | None:
        """When the watermark next closes a window with events."""
        if not len(self.cells):
            return None
        return max(int(self._ends()[0].min()), self.until + self.slide)


def activity_sink(spark: SparkSession, root: str, slide_us: int):
    """Adds up spans per window.  A window's spans come in the batch that
    closes it; later ones, of late events, are left out."""
    store = EpochStore(spark, root)

    def sink(batch: DataFrame, epoch: int) -> None:
        epochs = store.committed(below=epoch)
        until = store.commit_of(epochs[-1])["note"]["until"] if epochs else None
        spans = batch.groupBy("first_us", "last_us").agg(F.sum("users").alias("users"), F.sum("events").alias("events"))
        each = spans.select(F.explode(F.sequence("first_us", "last_us", F.lit(slide_us))).alias("end_us"), "users", "events")
        rows = each.groupBy("end_us").agg(F.sum("users").alias("active_users"), F.sum("events").alias("events"))
        seen = Observation()
        rows = rows.observe(seen, F.max("end_us").alias("until")).where("events > 0")
        if until is not None:
            rows = rows.where(F.col("end_us") > until)
        rows = rows.select(F.timestamp_micros(F.col("end_us") - 1).alias("wt"), "active_users", "events")

        def newest() -> dict:
            ends = [e for e in (until, seen.get["until"]) if e is not None]
            return {"until": max(ends, default=None)}
        store.publish(epoch, {"activity": rows}, newest)
    return sink


def stream_activity(events: DataFrame, base: str, size: str = "24 hours", slide: str = "1 hour",
                    delay: str = "1 hour", buckets: int = 1024) -> EpochStore:
    """Trailing activity per sliding window, exact: ``activity`` (wt,
    active_users, events), one row per window with events once it is closed.
    The state holds users' cells of the open windows, by buckets of users, not
    a row per user and window; spans of windows are added up per batch."""
    size_us, slide_us, delay_us = (pd.Timedelta(t) // pd.Timedelta("1us") for t in (size, slide, delay))

    def step(key: tuple, frames, state):
        now = state.getCurrentWatermarkMs() * 1000
        own = ActivityState(state.get if state.exists else None, size_us, slide_us)
        if not state.hasTimedOut:
            for pdf in frames:
                own.add(pdf["user_id"], pdf["ts_us"].to_numpy(np.int64))
        spans = own.advance(now)
        wake = own.wake()
        if wake is None:
            state.remove()
        else:
            state.update(own.held())
            state.setTimeoutTimestamp(-(-wake // 1000) - 1)  # timers fire once the watermark is beyond them
        yield spans

    # by when an event is of no use: late events still count in windows that are open
    ev = events.filter("valid").withColumn("gone", F.timestamp_micros(F.unix_micros("ts") + size_us)).withWatermark(
        "gone", f"{(size_us + delay_us) // 1000} milliseconds").select(
        "user_id", "gone", F.unix_micros("ts").alias("ts_us"), F.pmod(F.xxhash64("user_id"), F.lit(buckets)).alias("bucket"))
    rows = ev.groupBy("bucket").applyInPandasWithState(
        step, "first_us long, last_us long, users long, events long", "until long, names string, cells binary", "append", "EventTimeTimeout")
    root, spark = os.path.join(base, "activity"), events.sparkSession
    run(rows.writeStream.outputMode("append").foreachBatch(activity_sink(spark, root, slide_us)), base)
    return EpochStore(spark, root)


def stream_sessions(events: DataFrame, base: str, gap: str = "1 hour", types=None) -> None:
    """Session windows per user (gap ``gap``), emitted once closed."""
    ev = events.filter("valid")
    if types:
        ev = ev.filter(F.col("type").isin(*types))
    s = (ev.withWatermark("ts", gap).groupBy("user_id", F.session_window("ts", gap).alias("s"))
         .agg(F.count(F.lit(1)).alias("n_events")))
    out = s.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                   "n_events")
    run(out.writeStream.outputMode("append").format("parquet").option("path", os.path.join(base, "sessions")),
        base)


class PairState:
    """One user's open session: its newest items, and events that the
    watermark has not passed yet, as they may still arrive out of order."""

    def __init__(self, text: str | None, gap_us: int, ahead: int):
        held = json.loads(text) if text else {}
        self.gap, self.ahead = gap_us, ahead
        self.pending, self.recent = held.get("pending", []), held.get("recent", [])
        self.start, self.last = held.get("start"), held.get("last")

    def text(self) -> str:
        return json.dumps({"pending": self.pending, "recent": self.recent, "start": self.start, "last": self.last})

    def advance(self, until_us: int) -> list[tuple]:
        """Rows for what the watermark has passed: (start, end, item_a,
        item_b) of a pair with end None, or of a closed session, without items."""
        out, later = [], []
        for ts, seq, item in sorted(self.pending):
            if ts > until_us:
                later.append([ts, seq, item])
                continue
            if self.last is not None and ts - self.last > self.gap:
                out.append(self._close())
            if self.start is None:
                self.start = ts
            out += [(self.start, None, before, item) for before in self.recent]
            self.recent, self.last = [*self.recent, item][-self.ahead:], ts
        self.pending = later
        if self.last is not None and self.last + self.gap <= until_us:
            out.append(self._close())
        return out

    def _close(self) -> tuple:
        row = (self.start, self.last + self.gap, None, None)
        self.start = self.last = None
        self.recent = []
        return row

    def wake_us(self) -> int | None:
        """When the watermark next changes anything here."""
        times = [p[0] for p in self.pending] + ([] if self.last is None else [self.last + self.gap])
        return min(times, default=None)


def stream_pairs(events: DataFrame, base: str, gap_seconds: int = 3600, ahead: int = 5,
                 types=tuple(K.SESSION_TYPES)) -> EpochStore:
    """Co-visitation pairs out of the stream itself.  A user's state holds the
    last ``ahead`` items of the open session and the events of the watermark's
    delay; pairs are emitted in event order once the watermark passes them,
    and a row without items when an event-time timer closes the session.
    Events later than the watermark are dropped, here as in
    ``stream_sessions``."""
    gap_us = gap_seconds * 1_000_000

    def step(key: tuple, frames, state):
        now = state.getCurrentWatermarkMs() * 1000
        own = PairState(state.get[0] if state.exists else None, gap_us, ahead)
        if not state.hasTimedOut:
            for pdf in frames:
                own.pending += [[int(t), int(q), i] for t, q, i in zip(pdf["ts_us"], pdf["seq"], pdf["item_id"]) if t >= now]
        rows = own.advance(now)
        wake = own.wake_us()
        if wake is None:
            state.remove()
        else:
            state.update((own.text(),))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, wake // 1000))
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=["user_id", "start_us", "end_us", "item_a", "item_b"]).astype({"end_us": "Int64"})

    ev = events.filter("valid").filter(F.col("type").isin(*types)).withWatermark("ts", f"{gap_seconds} seconds").select(
        "user_id", "item_id", "ts", F.unix_micros("ts").alias("ts_us"), F.col("interaction_id").cast("long").alias("seq"))
    rows = ev.groupBy("user_id").applyInPandasWithState(
        step, "user_id string, start_us long, end_us long, item_a string, item_b string", "held string", "append", "EventTimeTimeout")
    root, spark = os.path.join(base, "tables"), events.sparkSession
    store = EpochStore(spark, root)

    def sink(batch: DataFrame, epoch: int) -> None:
        store.publish(epoch, {"rows": batch})
    run(rows.writeStream.outputMode("append").foreachBatch(sink), base)
    return EpochStore(spark, root)


def pair_edges(rows: DataFrame) -> DataFrame:
    """(item_a, item_b, weight), both ways, of the closed sessions among the
    rows that ``stream_pairs`` published."""
    closed = rows.where("end_us is not null").select("user_id", "start_us").distinct()
    pairs = rows.where("end_us is null").join(closed, ["user_id", "start_us"], "left_semi")
    both = pairs.select("item_a", "item_b").unionByName(pairs.select(F.col("item_b").alias("item_a"), F.col("item_a").alias("item_b")))
    return both.groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("weight"))


def session_covisitation(sessions: DataFrame, inter: DataFrame, gap_seconds: int = 3600,
                         types=tuple(K.SESSION_TYPES)) -> DataFrame:
    """Co-visitation edges of the closed sessions that ``stream_sessions``
    wrote.  A user's closed sessions precede the open ones, so their events
    are those before the end of the last: one equi-join per user."""
    from ..operators.windows import covisitation_edges
    ends = sessions.groupBy("user_id").agg(F.max("session_end").alias("_end"))
    closed = inter.join(ends, "user_id").where(F.col("timestamp").cast("timestamp") < F.col("_end")).drop("_end")
    return covisitation_edges(closed, gap_seconds, types=types)


def experiment_stream(events: DataFrame, experiment: str = K.DEFAULT_EXPERIMENT) -> DataFrame:
    """Events -> experiment events with the user's bucket attached."""
    ev = events.filter("valid").filter(F.col("type").isin("view", "click", "purchase"))
    return ev.select(
        "ts", "user_id", F.lit(experiment).alias("experiment_id"), bucket_of("user_id", experiment).alias("bucket"),
        F.when(F.col("type") == "view", "recommendation_request")
         .otherwise(F.concat(F.lit("interaction_"), F.col("type"))).alias("event_type"),
        F.col("interaction_id").cast("long").alias("event_id"))


def stream_experiment_metrics(events: DataFrame, base: str) -> None:
    """Running per-arm counts (exact) and approximate distinct users; the
    z-test is applied when the table is read."""
    ee = experiment_stream(events)
    ctl, trt = F.col("bucket") == "control", F.col("bucket") == "treatment"
    inter = F.col("event_type").startswith("interaction_")
    req = F.col("event_type") == "recommendation_request"
    m = ee.groupBy("experiment_id").agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(ctl).alias("control_events"), F.count_if(trt).alias("treatment_events"),
        F.approx_count_distinct(F.when(ctl, F.col("user_id"))).alias("control_users_approx"),
        F.approx_count_distinct(F.when(trt, F.col("user_id"))).alias("treatment_users_approx"),
        F.count_if(ctl & inter).alias("control_interactions"), F.count_if(trt & inter).alias("treatment_interactions"),
        F.count_if(ctl & req).alias("control_requests"), F.count_if(trt & req).alias("treatment_requests"))
    run(m.writeStream.outputMode("complete").foreachBatch(version_sink(events.sparkSession, os.path.join(base, "metrics"))), base)


def last_n_sink(spark: SparkSession, root: str, n: int):
    from ..operators.topk import rank_within
    store = EpochStore(spark, root)
    order = [F.col("ts").desc(), F.col("event_id").desc()]

    def sink(batch: DataFrame, epoch: int) -> None:
        cur = rank_within(batch, ["experiment_id"], order, n).drop("rank")
        before = store.read_latest("rows", below=epoch)
        if before is not None:
            cur = cur.unionByName(before)
        store.publish(epoch, {"rows": rank_within(cur, ["experiment_id"], order, n).drop("rank")})
    return sink


def stream_last_n(events: DataFrame, base: str, n: int = 1000) -> None:
    """Rolling newest ``n`` events per experiment: each batch's top n is
    merged with the top n of the epochs before it (both bounded by n per
    experiment) and published as a new version; no per-event state is kept."""
    sink = last_n_sink(events.sparkSession, os.path.join(base, "lastn"), n)
    run(experiment_stream(events).writeStream.foreachBatch(sink), base)


def latest_last_n(spark: SparkSession, base: str) -> DataFrame:
    return latest_rows(spark, os.path.join(base, "lastn"))


def stream_bandit(events: DataFrame, base: str) -> None:
    """Posterior counters per (experiment, arm): reward 1 for purchase, 0 for view."""
    ev = events.filter("valid").filter(F.col("type").isin("view", "purchase"))
    o = ev.select(F.lit(K.DEFAULT_EXPERIMENT).alias("experiment_id"), bucket_of("user_id").alias("arm"),
                  F.when(F.col("type") == "purchase", 1.0).otherwise(0.0).alias("reward"))
    c = o.groupBy("experiment_id", "arm").agg(
        F.sum(F.when(F.col("reward") > 0, F.col("reward")).otherwise(0.0)).alias("pos"),
        F.count_if(F.col("reward") <= 0).alias("neg"))
    run(c.writeStream.outputMode("complete").foreachBatch(version_sink(events.sparkSession, os.path.join(base, "bandit"))), base)


def trigger_sink(spark: SparkSession, root: str, every: int):
    store = EpochStore(spark, root)

    def sink(batch: DataFrame, epoch: int) -> None:
        before = store.read_latest("totals", below=epoch)
        prev = F.lit(0).cast("long") if before is None else before.select(F.max("total")).scalar()
        t = batch.select(F.col("total").cast("long").alias("total"), prev.alias("prev"))
        lo, hi = F.floor(F.col("prev") / every) + 1, F.floor(F.col("total") / every)
        ks = F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
        rows = t.select("total", F.explode(ks).alias("k")).select(F.lit(epoch).alias("epoch"), (F.col("k") * every).cast("long").alias("at_event"), "total")
        progress = (F.pmod("total", F.lit(every)) * 100.0 / every).alias("progress_pct")
        store.publish(epoch, {"triggers": rows, "totals": t.select("total", progress)})
    return sink


def stream_retrain_trigger(events: DataFrame, base: str, every: int = 100) -> EpochStore:
    """``triggers``: one row per crossed multiple of ``every`` events;
    ``totals``: events so far and percent of the way to the next one.  The
    running total is a global count (partial aggregation, no hot task); the
    sink compares it with the total of the epochs before."""
    total = events.filter("valid").agg(F.count(F.lit(1)).alias("total"))
    root = os.path.join(base, "tables")
    run(total.writeStream.outputMode("complete").foreachBatch(trigger_sink(events.sparkSession, root, every)), base)
    return EpochStore(events.sparkSession, root)


def dirty_sink(spark: SparkSession, root: str):
    store = EpochStore(spark, root)

    def sink(batch: DataFrame, epoch: int) -> None:
        store.publish(epoch, {"dirty": batch.filter("valid").select("user_id").distinct().withColumn("epoch", F.lit(epoch))})
    return sink


def stream_user_dirty(events: DataFrame, base: str) -> EpochStore:
    """``dirty``: users whose recommendations are stale, per epoch."""
    root = os.path.join(base, "tables")
    run(events.writeStream.foreachBatch(dirty_sink(events.sparkSession, root)), base)
    return EpochStore(events.sparkSession, root)


def refresh_users(table: KeyedTable, dirty: DataFrame, recompute, epoch: int) -> list[int]:
    """Recompute the rows of the users in ``dirty`` and put them in the place
    of their old ones in ``table`` (keyed by user_id).  ``recompute`` takes
    the distinct dirty users (user_id) and returns rows of those alone; other
    users' rows are not touched, and buckets without a dirty user not read."""
    users = dirty.select("user_id").distinct()
    return table.merge(recompute(users), epoch, replaced=users)
