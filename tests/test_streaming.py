"""Streaming jobs on literal rows: timers fire when the watermark passes them."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from lookout.operators.folds import epoch_micros
from lookout.streaming import jobs as Z

T0 = dt.datetime(2024, 1, 1)


def marked(stream, late="10 minutes"):
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def state_keys(spark, ckpt, state):
    """The keys that hold ``state`` in the checkpoint's newest version."""
    rows = spark.read.format("statestore").option("path", ckpt).option("stateVarName", state).load()
    return sorted({tuple(r["key"]) for r in rows.collect()})


def test_reversal_timers_fire_after_watermark(spark):
    path = Z.scratch(spark, "t-rev")
    rows = [("act_1", "8.8.8.8", T0, T0 + dt.timedelta(minutes=30)),
            ("act_2", "9.9.9.9", T0 + dt.timedelta(minutes=5), T0 + dt.timedelta(hours=5)),
            ("act_4", "9.9.9.9", T0 + dt.timedelta(minutes=6), T0 + dt.timedelta(hours=6)),
            # later traffic moves the watermark past act_1's reversal time only
            ("act_3", "7.7.7.7", T0 + dt.timedelta(hours=2), T0 + dt.timedelta(hours=9))]
    df = spark.createDataFrame(rows, "action_id string, target string, ts timestamp_ntz, "
                                     "reversal_at timestamp_ntz")
    replay = Z.Replay(df, path, slices=2)
    s = replay.stream
    s = marked(s).withColumn("due_us", epoch_micros(F.col("reversal_at")))
    ckpt = Z.scratch(spark, "t-rev-ckpt")
    out = Z.run_to_table(Z.stream_reversals(s), spark, "t-rev", replay=replay, ckpt=ckpt).collect()
    assert [(r["action_id"], r["target"], r["action"]) for r in out] == [("act_1", "8.8.8.8", "unblock_ip")]
    # pending reversals have a key each, also those of one target
    assert state_keys(spark, ckpt, "due") == [("7.7.7.7", "act_3"), ("9.9.9.9", "act_2"), ("9.9.9.9", "act_4")]


def test_stream_features_drop_open_windows(spark):
    path = Z.scratch(spark, "t-feat")
    rows = [("h", T0 + dt.timedelta(minutes=m), "logs", "ssh_failure", None, None) for m in (1, 2, 70, 200)]
    df = spark.createDataFrame(rows, "host string, ts timestamp_ntz, stream string, type string, "
                                     "source_ip string, risk_reason string")
    replay = Z.Replay(df, path, slices=2)
    s = replay.stream
    out = Z.run_to_table(Z.stream_features(s, 3600, "30 minutes"), spark, "t-feat", replay=replay)
    got = sorted((r["ts"], r["log_auth_failures"]) for r in out.collect())
    # windows 00:00 and 01:00 close (watermark 03:20 - 0:30); 03:00 is still open
    assert [g[1] for g in got] == [2, 1]


def test_repeat_counts_expire_in_a_long_window_as_in_batch(spark):
    """A 600 s window: the count restarts after 300 s without a match."""
    from lookout.operators import policy as P
    from lookout.sources.config import load_rules, rules_frame
    rules = load_rules(rules=[{"name": "slow", "conditions": {
        "score_above": 0.5, "repeated_within_seconds": 600, "min_occurrences": 2}}])
    rows = [(i, T0 + dt.timedelta(seconds=x), "h", 0.9, "high", "brute_force", "7.7.7.7")
            for i, x in enumerate([0, 400, 800, 1200, 1250, 1600])]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, host string, score double, risk_level string, "
                                     "anomaly_type string, source_ip string")
    batch = {r["id"]: r["repeat_count"] for r in P.evaluate_policies(
        spark, df.withColumn("features", F.create_map(F.lit("f"), F.lit(1.0))), rules, "counted").collect()}
    replay = Z.Replay(df, Z.scratch(spark, "t-long"), slices=3)
    m = P.match_rules(marked(replay.stream, "10 seconds"), rules_frame(spark, P.active_rules(rules)))
    m = m.withColumn("dedup_key", P.dedup_key(F.col("policy_name"), F.col("anomaly_type"), F.col("source_ip"))) \
        .withColumn("t_us", epoch_micros(F.col("ts")))
    got = {r["id"]: r["repeat_count"] for r in Z.run_to_table(Z.stream_alerts(m), spark, "t-long", replay=replay).collect()}
    assert got == batch == {0: 1, 1: 1, 2: 1, 3: 1, 4: 2, 5: 1}


def test_replay_keeps_rows_without_a_time_and_slices_whole(spark):
    rows = [(i, None if i % 5 == 0 else T0 + dt.timedelta(minutes=i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz").repartition(7)
    replay = Z.Replay(df, Z.scratch(spark, "t-replay"), slices=4)
    batches = []
    Z.stream_persist(replay.stream, lambda b: batches.append([r["id"] for r in b.collect()]), spark, "t-replay", replay=replay)
    batches = [b for b in batches if b]
    assert len(batches) == 4 and sorted(i for b in batches for i in b) == list(range(60))
    assert all(i in batches[0] for i in range(0, 60, 5))


def test_replay_makes_its_rows_once(spark):
    """However many slices read them."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf
    df = spark.createDataFrame([(i, T0 + dt.timedelta(minutes=i)) for i in range(50)], "id long, ts timestamp_ntz")
    replay = Z.Replay(df.mapInPandas(counted, df.schema), Z.scratch(spark, "t-once"), slices=5)
    batches = []
    Z.stream_persist(replay.stream, lambda b: batches.append(b.count()), spark, "t-once", replay=replay)
    assert sum(batches) == 50 and made.value == 50


def test_state_partitions_follow_cores_and_bytes(spark):
    conf, cores = spark.conf, spark.sparkContext.defaultParallelism
    old = conf.get("spark.sql.shuffle.partitions")
    conf.set("spark.sql.shuffle.partitions", "200")
    try:
        for size, expected in ((0, cores), (100 * Z.PARTITION_BYTES, 100), (500 * Z.PARTITION_BYTES, 200)):
            with Z._StatePartitions(spark, size):
                assert int(conf.get("spark.sql.shuffle.partitions")) == expected
        assert conf.get("spark.sql.shuffle.partitions") == "200"
    finally:
        conf.set("spark.sql.shuffle.partitions", old)


def test_alert_state_equals_a_row_by_row_fold_and_goes_when_idle(spark):
    """Random matches of a few keys over several restarts; then only the key
    with a match in the last 300 s of event time still has state."""
    import random
    rng = random.Random(5)
    rows, t = [], 0
    for i in range(400):
        t += rng.choice((1, 1, 5, 20, 90, 310)) if i < 399 else 4000
        rows.append((i, T0 + dt.timedelta(seconds=t), f"k{rng.randrange(3)}" if i < 399 else "k9"))
    rule = {"k0": (60, 2), "k1": (600, 3), "k2": (0, 9), "k9": (60, 1)}
    rows = [(*r, "p", *rule[r[2]]) for r in rows]
    expected, times, last, newest = {}, {}, {}, {}
    for i, ts, k, _, w, least in rows:
        s = (ts - T0).total_seconds()
        if s - newest.get(k, s) >= 300:
            times[k], last[k] = [], None
        newest[k] = s
        times[k] = [x for x in times.get(k, []) if x > s - w] + [s]
        fires = not w or (len(times[k]) >= least and (last.get(k) is None or s - last[k] >= 60))
        if fires:
            last[k] = s
        expected[i] = (len(times[k]) if w else None, fires)
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, dedup_key string, policy_name string, "
                                     "repeated_within_seconds long, min_occurrences long")
    replay, ckpt = Z.Replay(df, Z.scratch(spark, "t-alert"), slices=4), Z.scratch(spark, "t-alert-ckpt")
    m = marked(replay.stream, "1 second").withColumn("t_us", epoch_micros(F.col("ts")))
    out = Z.run_to_table(Z.stream_alerts(m), spark, "t-alert", replay=replay, ckpt=ckpt)
    assert {r["id"]: (r["repeat_count"], r["fired"]) for r in out.collect()} == expected
    for state in ("times", "fired", "timer"):
        assert state_keys(spark, ckpt, state) == [("k9",)]


def test_rate_state_goes_after_its_window(spark):
    rows = [(i, T0 + dt.timedelta(seconds=i), "t") for i in range(100)] + [(100, T0 + dt.timedelta(seconds=900), "u")]
    df = spark.createDataFrame(rows, "request_id long, ts timestamp_ntz, target string")
    replay, ckpt = Z.Replay(df, Z.scratch(spark, "t-rate"), slices=3), Z.scratch(spark, "t-rate-ckpt")
    s = marked(replay.stream, "1 second").withColumn("t_us", epoch_micros(F.col("ts")))
    out = Z.run_to_table(Z.stream_rate_limit(s), spark, "t-rate", replay=replay, ckpt=ckpt)
    assert sorted(r["request_id"] for r in out.filter("rate_ok").collect()) == [0, 1, 2, 3, 4, 60, 61, 62, 63, 64, 100]
    assert state_keys(spark, ckpt, "allowed") == [("u",)]


def test_snapshot_diff_keeps_a_state_per_connection(spark):
    """Equal to the batch diff over snapshots with gaps; connections not seen for long go."""
    import random
    from lookout.operators import netflow as N
    rng, rows = random.Random(3), []
    for host in ("a", "b"):
        for snap in sorted(rng.sample(range(30), 12)):
            for port in rng.sample(range(8), 5):
                ip = "0.0.0.0" if port == 7 else "9.9.9.9"
                rows.append((host, snap, T0 + dt.timedelta(hours=snap), ip, 1, "1.1.1.1", port, "LISTEN"))
    rows.append(("c", 400, T0 + dt.timedelta(hours=400), "9.9.9.9", 1, "1.1.1.1", 0, "LISTEN"))
    df = N.connection_key(spark.createDataFrame(rows, (
        "host string, snap long, ts timestamp_ntz, remote_ip string, remote_port int, local_ip string, "
        "local_port int, state string")))
    batch = sorted((r["host"], r["snap"], r["conn_key"]) for r in N.new_connections(df).collect())
    replay, ckpt = Z.Replay(df, Z.scratch(spark, "t-snap"), slices=3), Z.scratch(spark, "t-snap-ckpt")
    out = Z.run_to_table(Z.stream_snapshot_diff(marked(replay.stream), 3 * 86400), spark, "t-snap", replay=replay, ckpt=ckpt)
    assert sorted((r["host"], r["snap"], r["conn_key"]) for r in out.collect()) == batch


class _Handle:
    """A processor's handle on one key that counts the calls to its state."""

    def __init__(self):
        self.value, self.calls, self.timers = None, [], []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def registerTimer(self, at):
        self.calls.append("registerTimer")
        self.timers.append(at)


def test_a_target_costs_one_read_one_write_and_one_timer():
    handle, state = _Handle(), Z.RateState(2, 60 * Z.MICROS)
    state.init(handle)
    rows = pd.DataFrame({"t_us": [t * Z.MICROS for t in (30, 10, 20, 75)], "request_id": range(4)})
    out = pd.concat(state.handleInputRows(("t",), iter([rows[:3], rows[3:]]), None))
    assert [tuple(r) for r in out.itertuples(index=False)] == [
        ("t", 1, True), ("t", 2, True), ("t", 0, False), ("t", 3, True)]
    assert handle.calls == ["get", "registerTimer", "update"] and handle.timers == [135000]
    # a refused request reads only
    again = pd.DataFrame({"t_us": [77 * Z.MICROS, 76 * Z.MICROS], "request_id": [5, 6]})
    del handle.calls[:]
    assert [pdf["rate_ok"].tolist() for pdf in state.handleInputRows(("t",), iter([again]), None)] == [[False, False]]
    assert handle.calls == ["get"]
