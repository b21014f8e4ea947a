"""Structured Streaming jobs.

Each job is the batch operator's logic on a streaming DataFrame:

* Z1 features: event-time tumbling windows with a watermark, append mode
  (late rows behind the watermark are dropped, open windows are emitted once
  the watermark passes them);
* Z2 alerts, Z3 rate limit, Z5 snapshot diff: keyed state with
  ``transformWithState`` in the RocksDB store (list and value state per dedup
  key / target / connection of a host; rows of a key inside a micro-batch are
  processed in time order). State that can't matter any more is removed by an
  event-time timer;
* Z4 reversals: one key and one event-time timer per (target, action) that fires
  an ``unblock_ip`` request when the watermark passes ``reversal_at``;
* Z6 persistence: ``foreachBatch`` with the idempotent sinks, so a replayed
  micro-batch adds nothing twice.

All progress and state live in the query's ``checkpointLocation`` under the
shared checkpoint folder, so a restart resumes where it stopped.
"""

from __future__ import annotations

import datetime as dt
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import schemas as S
from ..functions.rates import allowed_rows
from ..operators import features as FE
from ..session import ensure_checkpoint_dir

MICROS = 1_000_000
PARTITION_BYTES = 64 << 20  # of Parquet rows for each partition of a query's state
UNREAD = object()
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def scratch(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:10]}")


def _folder_bytes(spark: SparkSession, path: str) -> int:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(folder).getLength()


class Replay:
    """A table played back as a file stream in event-time order.

    ``stream`` reads a landing folder. ``slices`` are the rows cut into equal time
    ranges (rows without a time come with the first). Landing one slice and
    letting the query run until everything available is processed, then the next,
    makes each slice one micro-batch, however many files it has. The query's
    state and watermark carry over in its checkpoint, as over any restart."""

    def __init__(self, df: DataFrame, path: str, ts: str = "ts", slices: int = 6):
        self.path = path
        spark = df.sparkSession
        df.limit(0).write.mode("append").parquet(path)
        self.stream = spark.readStream.schema(df.schema).parquet(path)
        # every slice reads the rows: what makes them runs once
        df.write.parquet(f"{path}-rows")
        self.bytes = _folder_bytes(spark, f"{path}-rows")
        rows = spark.read.schema(df.schema).parquet(f"{path}-rows")
        st = rows.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).first()
        if st["lo"] is None:
            self.slices = [rows]
            return
        edges = [st["lo"] + (st["hi"] - st["lo"]) / slices * i for i in range(1, slices)]
        at = F.coalesce(sum((F.col(ts) >= F.lit(e)).cast("int") for e in edges) if edges else F.lit(0), F.lit(0))
        self.slices = [rows.filter(at == i) for i in range(slices)]

    def through(self, start) -> None:
        """``start()`` starts the query (same checkpoint each time) with an
        available-now trigger."""
        for rows in self.slices:
            rows.write.mode("append").parquet(self.path)
            start().awaitTermination()


class _StatePartitions:
    """State-store partitions are fixed by ``spark.sql.shuffle.partitions`` when a
    query first starts. Each has a store to open and to commit in every batch, so
    there are only as many as cores, and more where ``size`` bytes of rows need them."""

    def __init__(self, spark: SparkSession, size: int = 0):
        self.spark, self.size = spark, size

    def __enter__(self):
        cores = self.spark.sparkContext.defaultParallelism
        most = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        conf = {"spark.sql.shuffle.partitions": str(max(1, min(most, max(cores, self.size // PARTITION_BYTES)))),
                "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
                "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
        self.old = {k: self.spark.conf.get(k, None) for k in conf}
        for k, v in conf.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *exc):
        for k, v in self.old.items():
            if v is None:
                self.spark.conf.unset(k)
            else:
                self.spark.conf.set(k, v)


def run_to_table(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append",
                 replay: Replay | None = None, ckpt: str | None = None) -> DataFrame:
    """Run a streaming query over everything available (slice by slice of
    ``replay``), into parquet; return it as a batch table. ``ckpt``: the query's
    checkpoint folder, by default a new one."""
    out, ckpt = scratch(spark, f"{name}-out"), ckpt or scratch(spark, f"{name}-ckpt")

    def start():
        return (stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", ckpt)
                .option("path", out).trigger(availableNow=True).start())

    with _StatePartitions(spark, getattr(replay, "bytes", 0)):
        if replay:
            replay.through(start)
        else:
            start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


# ---------------------------------------------------------------- Z1

def stream_features(telemetry: DataFrame, window_seconds: int, watermark: str) -> DataFrame:
    """F2 on a stream (event time, watermark, append mode)."""
    t = telemetry.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return FE.feature_vectors(t, window_seconds, streaming=True)


# ---------------------------------------------------------------- Z2

def _sorted(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(list(by), kind="mergesort")


class _Expiring(StatefulProcessor):
    """State that one event-time timer per key removes. ``_expire_at`` moves the
    timer; when the watermark passes it, all of the key's state goes. A timer
    rather than a TTL, as TTLs count the cluster's time: a replay or a backlog
    would keep or lose state by the speed at which it is read."""

    name = "timer"  # of the timer's state
    kept = ""  # fields that lie beside the timer's

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState(self.name, "at long, armed long" + self.kept)
        self.states = [self.timer]

    def _expire_at(self, micros: int, *kept, old: tuple | None = UNREAD) -> None:
        """``old``: the timer's state (None: there is none), if it was read before. A timer that is armed for
        an earlier time stays and is set anew when it fires: a key that is seen in
        each batch costs a read and a write."""
        at = -(-micros // 1000)
        old = self.timer.get() if old is UNREAD else old
        armed = old[1] if old else None
        if armed is None or at < armed:
            if armed is not None:
                self.handle.deleteTimer(armed)
            self.handle.registerTimer(at)
            armed = at
        if not old or (at, armed, *kept) != tuple(old):
            self.timer.update((at, armed, *kept))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        at, armed, *kept = self.timer.get()
        if at > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(at)
            self.timer.update((at, at, *kept))
        else:
            for state in self.states:
                state.clear()
        yield from ()

    def close(self) -> None:
        pass


def counted_matches(times: np.ndarray, window: np.ndarray, idle: int) -> np.ndarray:
    """For each of the sorted ``times``, how many lie in (t - window, t] up to it;
    a gap of ``idle`` restarts the count."""
    n = len(times)
    at = np.arange(n)
    fresh = np.ones(n, bool)
    fresh[1:] = np.diff(times) >= idle
    since = np.maximum.accumulate(np.where(fresh, at, 0))
    return at - np.maximum(since, np.searchsorted(times, times - window, side="right")) + 1


class AlertState(_Expiring):
    """E4 and E5 per dedup key: the match times inside the window and the last
    fired time."""

    def __init__(self, cooldown: int, idle: int):
        self.cooldown, self.idle = cooldown, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.times = handle.getListState("times", "t long")
        self.fired = handle.getValueState("fired", "t long")
        self.states += [self.times, self.fired]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _sorted(rows, "t_us", "id")
        new = pdf["t_us"].to_numpy(np.int64)
        old = np.array([r[0] for r in self.times.get()], np.int64) if self.times.exists() else new[:0]
        last = self.fired.get()[0] if self.fired.exists() else None
        windows = pdf["repeated_within_seconds"].to_numpy(np.int64) * MICROS
        times = np.concatenate((old, new))
        # old times count towards new ones; a rule without a window counts nothing
        width = np.concatenate((np.full(len(old), windows[0]), windows))
        counts = counted_matches(times, width, self.idle)[len(old):]
        enough = (counts >= pdf["min_occurrences"].to_numpy()) | (windows == 0)
        ok = np.zeros(len(new), bool)
        i = 0
        while i < len(new):  # once per fired row of a rule with a window
            if windows[i] == 0:
                ok[i] = True
            elif enough[i] and (last is None or new[i] - last >= self.cooldown):
                ok[i] = True
            if ok[i]:
                last = int(new[i])
            step = np.flatnonzero(enough[i + 1:])
            if not len(step):
                break
            i += 1 + int(step[0])
            if windows[i] > 0 and last is not None and new[i] - last < self.cooldown:
                i = max(i, int(np.searchsorted(new, last + self.cooldown, side="left")))
        kept = times[times > times[-1] - max(int(windows.max()), 0)]
        gap = np.flatnonzero(np.diff(kept) >= self.idle)
        kept = kept[gap[-1] + 1:] if len(gap) else kept
        if len(kept):
            self.times.put([(int(t),) for t in kept])
        else:
            self.times.clear()
        if last is not None:
            self.fired.update((last,))
        self._expire_at(int(times[-1]) + max(self.idle, self.cooldown))
        yield pd.DataFrame({"dedup_key": key[0], "policy_name": pdf["policy_name"].to_numpy(),
                            "id": pdf["id"].to_numpy(),
                            "repeat_count": pd.Series(counts).astype("Int64").mask(windows == 0), "fired": ok})


def stream_alerts(matches: DataFrame, cooldown: int = S.ALERT_COOLDOWN_SECONDS,
                  idle_ttl: int = S.DEDUP_IDLE_TTL_SECONDS) -> DataFrame:
    """E4 + E5 with state per dedup key. ``matches`` are E2/E3 rows with
    ``dedup_key``, ``t_us`` (epoch micros), ``id``, the rule columns and a
    watermark; a key's state goes once the watermark is ``idle_ttl`` past its
    last match."""
    return matches.groupBy("dedup_key").transformWithStateInPandas(
        AlertState(cooldown * MICROS, idle_ttl * MICROS),
        "dedup_key string, policy_name string, id long, repeat_count long, fired boolean", "Append", "EventTime")


# ---------------------------------------------------------------- Z3

class RateState(_Expiring):
    """R5 per target: the last ``budget`` allowed times. They lie beside the timer's,
    as most targets are asked for a few times only: a read and a write for each."""

    name = "allowed"
    kept = ", times array<bigint>"

    def __init__(self, budget: int, window: int):
        self.budget, self.window = budget, window

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        chunks = list(rows)
        t_us, request_id = (np.concatenate([pdf[c].to_numpy() for pdf in chunks]) for c in ("t_us", "request_id"))
        order = np.lexsort((request_id, t_us))
        old = self.timer.get()
        before = list(old[2]) if old else []
        ok, after = allowed_rows(t_us[order].astype(np.int64), before, self.budget, self.window)
        if after != before:
            self._expire_at(after[-1] + self.window, after, old=old)
        yield pd.DataFrame({"target": key[0], "request_id": request_id[order], "rate_ok": ok})


def stream_rate_limit(requests: DataFrame, budget: int = S.ACTIONS_PER_MINUTE,
                      window: int = S.RATE_WINDOW_SECONDS) -> DataFrame:
    """Z3: R5 with the last ``budget`` allowed times per target as state, which goes
    once the watermark is ``window`` past the last of them. ``requests`` carry a
    watermark on ``ts`` and ``t_us`` (epoch micros)."""
    return requests.select("target", "request_id", "t_us", "ts").groupBy("target").transformWithStateInPandas(
        RateState(budget, window * MICROS), "target string, request_id long, rate_ok boolean", "Append", "EventTime")


# ---------------------------------------------------------------- Z4

class ReversalTimer(StatefulProcessor):
    """One pending reversal: its due time, and the timer that fires it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at long")

    @staticmethod
    def _unblock(key, due: int) -> Row:
        return Row(action_id=key[1], target=key[0], action="unblock_ip", due_at=due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        for due in [int(r["due_us"]) for r in rows]:
            if due // 1000 <= now:
                yield self._unblock(key, due)
            elif not self.due.exists():
                self.due.update((due,))
                self.handle.registerTimer(-(-due // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = self.due.get()[0]
        self.due.clear()
        yield self._unblock(key, due)

    def close(self) -> None:
        pass


def stream_reversals(blocked: DataFrame) -> DataFrame:
    """A timer per (target, action), so that a target with many blocks is
    spread over tasks. ``blocked`` rows (action_id, target, ts, due_us) arrive with
    a watermark on ``ts``; when it passes a pending due time an ``unblock_ip``
    request is emitted. Timers live in the checkpointed state, so pending
    reversals survive a restart."""
    return blocked.groupBy("target", "action_id").transformWithState(
        ReversalTimer(), "action_id string, target string, action string, due_at long", "Append", "EventTime")


# ---------------------------------------------------------------- Z5

class LastSeen(_Expiring):
    """The snapshot in which a key was last seen, told to its next sighting."""

    def __init__(self, columns: list[str], forget: int):
        self.columns, self.forget = columns, forget

    kept = ", snap long"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        seen = sorted(rows, key=lambda r: (r["snap"] is None, r["snap"] or 0))
        old = self.timer.get()
        last = old[2] if old else None
        previous = None
        for r in seen:
            if previous is not None and r["snap"] != previous:
                last = previous
            previous = r["snap"]
            yield Row(**{c: r[c] for c in self.columns}, before=last)
        # a row's time is the worker's local one
        newest = max((r["ts"].astimezone(dt.timezone.utc) for r in seen if r["ts"]), default=EPOCH)
        self._expire_at((newest - EPOCH) // dt.timedelta(microseconds=1) + self.forget, previous, old=old)


def stream_snapshot_diff(conns: DataFrame, forget_seconds: int = 30 * 86400) -> DataFrame:
    """D1 with a key per connection of a host, so that one host is spread over
    tasks; a second, small state per host numbers its snapshots. Both are joined
    on (host, snapshot): a connection is new if it was last seen before the
    host's previous snapshot. ``conns`` carry a watermark on ``ts``, one time per
    snapshot. State of a key that isn't seen for ``forget_seconds`` goes; a host
    that is silent for longer starts anew."""
    forget = forget_seconds * MICROS
    keyed = "host string, conn_key string, snap long, ts timestamp, remote_ip string, local_port int"
    columns = [f.split()[0] for f in keyed.split(", ")]
    seen = conns.select(*columns).groupBy("host", "conn_key").transformWithState(
        LastSeen(columns, forget), keyed + ", before long", "Append", "EventTime", eventTimeColumnName="ts")
    snaps = (conns.select("host", "snap", "ts").dropDuplicatesWithinWatermark(["host", "snap"])
             .groupBy("host").transformWithState(
                 LastSeen(["host", "snap", "ts"], forget), "host string, snap long, ts timestamp, before long",
                 "Append", "EventTime", eventTimeColumnName="ts")
             .withColumnRenamed("before", "prev_snap"))
    fresh = F.col("before").isNull() | F.col("prev_snap").isNull() | (F.col("before") < F.col("prev_snap"))
    return (seen.join(snaps, ["host", "snap", "ts"]).filter(fresh & (F.col("remote_ip") != "0.0.0.0"))
            .select("host", "snap", "conn_key", "remote_ip", "local_port"))


# ---------------------------------------------------------------- Z6

def stream_persist(stream: DataFrame, writer, spark: SparkSession, name: str,
                   replay: Replay | None = None) -> str:
    """Each micro-batch goes through an idempotent writer (``foreachBatch``)."""
    ckpt = scratch(spark, f"{name}-ckpt")

    def start():
        return (stream.writeStream.foreachBatch(lambda df, _epoch: writer(df))
                .option("checkpointLocation", ckpt).trigger(availableNow=True).start())

    with _StatePartitions(spark, getattr(replay, "bytes", 0)):
        if replay:
            replay.through(start)
        else:
            start().awaitTermination()
    return name
