import datetime as dt
import os

from pyspark.sql import functions as F

from lookout import schemas as S
from lookout.sources import envelope as EN
from lookout.sources import files as FI
from lookout.sources import tcp_table as TCP


def test_parse_tcp_table(spark):
    lines = [("h", 0, "  sl  local_address rem_address   st tx_queue"),
             ("h", 1, "   0: 0100007F:0016 00000000:0000 0A 00000000:00000000 00:00000000 00000000"),
             ("h", 2, "   1: 0101A8C0:01BB 0F02000A:D431 01 0"),
             ("h", 3, "   2: ZZZZZZZZ:0050 0100007F:XYZ 99 0"),
             ("h", 4, "   3: 0100007F"),
             ("h", 5, "   4: 00000000000000000000000001000000:0016 00000000000000000000000000000000:0000 0A"),
             ("h", 6, "   5: 0100007F:FFFFFFFFFFFFFFFFF 00000000:0000 0A")]  # no such port: skipped
    df = spark.createDataFrame(lines, "host string, line_no int, value string").drop("line_no")
    got = [tuple(r) for r in TCP.parse_connection_snapshot(df).select(
        "local_ip", "local_port", "remote_ip", "remote_port", "state").collect()]
    assert got[0] == ("127.0.0.1", 22, "0.0.0.0", 0, "LISTEN")
    assert got[1] == ("192.168.1.1", 443, "10.0.2.15", 54321, "ESTABLISHED")
    assert got[2] == ("0.0.0.0", 80, "127.0.0.1", 0, "UNKNOWN")
    assert got[3][0] == "00000000000000000000000001000000" and len(got) == 4


def test_tcp_round_trip(spark):
    rows = [("h", 1, "203.0.113.9", 40001, "192.0.2.1", 8080, "TIME_WAIT")]
    c = spark.createDataFrame(rows, "host string, snap long, remote_ip string, remote_port int, "
                                    "local_ip string, local_port int, state string")
    back = TCP.parse_connection_snapshot(TCP.render_tcp_table(c)).select(*c.columns).collect()
    assert [tuple(r) for r in back] == rows


def test_read_log_files(spark, tmp_path):
    (tmp_path / "nginx").mkdir()
    (tmp_path / "auth.log").write_text("a\n\n  b  \n")
    (tmp_path / "nginx" / "access.log").write_bytes(b"x\xff\n")
    (tmp_path / "postgresql").mkdir()
    (tmp_path / "postgresql" / "postgresql-16-main.log").write_text("pg\n")
    df = FI.read_log_files(spark, str(tmp_path))
    got = sorted((r["source"], r["line"]) for r in df.collect())
    assert got[0] == ("access.log", "x�") and ("auth.log", "b") in got
    assert ("postgresql-16-main.log", "pg") in got and len(got) == 4


def test_envelope_and_dead_letters(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), '{"k": 5}'), (2, dt.datetime(2024, 1, 1), "{bad")],
                               "id long, ts timestamp_ntz, data string")
    dec = {r["id"]: r["k"] for r in EN.decode_envelope(df, S.ENVELOPE_DATA).collect()}
    assert dec == {1: 5, 2: None}
    good, dead = EN.split_dead_letters(df, "ml")
    assert [r["id"] for r in good.collect()] == [1]
    d = dead.collect()[0]
    assert (d["source"], d["msg_id"], d["reason"], d["data"]) == ("ml", "2", "json_decode_error", "{bad")


def test_processing_dead_letters(spark):
    df = spark.createDataFrame([(7, dt.datetime(2024, 1, 1), "x" * 300)], "id long, ts timestamp_ntz, err string")
    d = EN.processing_dead_letters(df, "actions", "err").collect()[0]
    assert (d["source"], d["msg_id"], len(d["reason"])) == ("actions", "7", 200)


def test_drop_expired_partitions(spark, tmp_path):
    from lookout.operators.retention import drop_expired_partitions
    rows = [(i, dt.date(2024, 1, 1) + dt.timedelta(days=i)) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, date date")
    path = str(tmp_path / "logs")
    df.write.partitionBy("date").parquet(path)
    dropped = drop_expired_partitions(spark, path, 5, "2024-01-08 12:00:00")
    assert dropped == ["2024-01-01", "2024-01-02"]
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(2, 10))


def test_decode_flat_entries(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([('{"a": 1}', "hello", "5", None)], "x string, y string, z string, w string")
    d = EN.decode_flat(df, ["x", "y", "z", "w"])
    r = d.select(F.variant_get("x", "$.a", "int").alias("a"), F.variant_get("y", "$", "string").alias("y"),
                 F.variant_get("z", "$", "int").alias("z"), F.col("w").isNull().alias("w_null")).first()
    assert (r["a"], r["y"], r["z"], r["w_null"]) == (1, "hello", 5, True)


def _day_table(spark, path):
    from lookout.sources.sinks import append_once
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"k{i}", t0 + dt.timedelta(hours=5 * i)) for i in range(60)] + [("none", None), ("stamped", dt.datetime(2024, 1, 9))]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz").withColumn("timed", F.col("key") != "stamped")
    append_once(df, path, "key", timed="timed")
    return dict(rows)


def _left(spark, path):
    return {r["key"] for r in spark.read.parquet(path).collect()}


def test_retention_of_a_day_table(spark, tmp_path):
    from lookout.operators.retention import enforce_retention
    path = str(tmp_path / "t")
    rows = _day_table(spark, path)
    cut = dt.datetime(2024, 1, 5, 7)
    kept = {k for k, t in rows.items() if t is not None and t >= cut}
    assert enforce_retention(spark, path, 30, "2024-02-04 07:00:00") == len(rows) - len(kept)
    assert _left(spark, path) == kept
    assert enforce_retention(spark, path, 30, "2024-02-04 07:00:00") == 0 and _left(spark, path) == kept
    assert enforce_retention(spark, path, 30, "2024-02-05 07:00:00") == 5
    assert enforce_retention(spark, str(tmp_path / "absent"), 30, "2024-02-05 07:00:00") == 0


def test_retention_goes_on_where_a_run_broke_off(spark, tmp_path):
    """The old day is deleted, the new one not yet in its place."""
    import shutil
    from lookout.operators.retention import enforce_retention
    path, cut = tmp_path / "t", dt.datetime(2024, 1, 5, 7)
    rows = _day_table(spark, str(path))
    enforce_retention(spark, str(path), 30, "2024-02-04 07:00:00")
    name = cut.strftime("%Y%m%dT%H%M%S%f")
    (path / "_retention" / name).unlink()
    shutil.move(path / "day=2024-01-05", path / "_retention" / f"{name}-2024-01-05")
    enforce_retention(spark, str(path), 30, "2024-02-04 07:00:00")
    assert _left(spark, str(path)) == {k for k, t in rows.items() if t is not None and t >= cut}


def test_logs_without_a_time_are_added_once_whenever_they_are_replayed(spark, tmp_path):
    from lookout.sources.sinks import append_logs
    path = str(tmp_path / "logs")
    logs = spark.createDataFrame([(1, None, "a"), (2, "not a time", "b"), (3, "2024-01-03T10:00:00Z", "c")],
                                 "id long, timestamp string, message string")
    for c in ("source", "level", "type", "source_ip", "user"):
        logs = logs.withColumn(c, F.lit(None).cast("string"))
    append_logs(logs, path, "2024-01-30 23:59:00")
    append_logs(logs, path, "2024-02-02 08:00:00")
    got = spark.read.parquet(path)
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 3] and "timed" not in got.columns


def test_handler_errors_are_kept_row_by_row(spark):
    df = spark.createDataFrame([(1, "4"), (2, "0"), (3, None), (4, "x")], "id long, n string") \
        .withColumn("ts", F.lit(dt.datetime(2024, 1, 1)))
    done, failed = EN.handled(df, lambda n: 8 // int(n), [F.col("n")], "long")
    assert [(r["id"], r["value"]) for r in done.collect()] == [(1, 2)]
    errors = {r["msg_id"]: r["reason"] for r in EN.processing_dead_letters(failed, "actions").collect()}
    assert set(errors) == {"2", "3", "4"} and errors["2"].startswith("ZeroDivisionError")


def test_tail_goes_on_after_a_rotation(spark, tmp_path):
    """The query stops, a log is rotated (its lines go on in a new segment, the old
    one is deleted), the query restarts from its checkpoint: each line once."""
    from lookout.streaming import jobs as Z
    folder = tmp_path / "a.log"
    folder.mkdir()
    (folder / "1").write_text("one\ntwo\n")

    class Rotation:
        def through(self, start):
            start().awaitTermination()
            (folder / "1").unlink()
            (folder / "2").write_text("three\n\n four \n")
            (tmp_path / "b.log").mkdir()
            (tmp_path / "b.log" / "1").write_text("five\n")
            start().awaitTermination()
            start().awaitTermination()  # nothing new

    tail = FI.stream_log_files(spark, str(tmp_path), source_from_parent=True)
    out = Z.run_to_table(tail, spark, "t-tail", replay=Rotation())
    got = sorted((r["source"], r["line"]) for r in out.collect())
    assert got == [("a.log", "four"), ("a.log", "one"), ("a.log", "three"), ("a.log", "two"), ("b.log", "five")]
