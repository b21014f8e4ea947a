import datetime as dt

from pyspark.sql import functions as F

from lookout.operators import response as R
from lookout.operators import routing as W

T0 = dt.datetime(2024, 1, 1)


def test_ip_protected_boundaries(spark):
    cases = {"10.0.0.0": True, "9.255.255.255": False, "172.31.255.255": True, "172.32.0.0": False,
             "192.168.1.1": True, "127.0.0.1": True, "8.8.8.8": False, "::1": True, "2001:db8::1": False,
             "not-an-ip": True, "": True, "256.1.1.1": True, "01.2.3.4": True}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["p"] for r in df.select("t", R.ip_protected(F.col("t")).alias("p")).collect()}
    assert got == cases


def test_validation_reasons(spark):
    df = spark.createDataFrame([("REBOOT", "x"), ("block_ip", "10.1.1.1"), ("kill_process", "SSHD"),
                                ("kill_process", "worker"), ("block_ip", "8.8.8.8")],
                               "action string, target string")
    got = [(r["allowed"], r["reason"]) for r in R.validate(df).collect()]
    assert got == [(False, "Action 'REBOOT' is permanently forbidden"),
                   (False, "IP 10.1.1.1 is protected and cannot be blocked"),
                   (False, "Process 'SSHD' is protected and cannot be killed"),
                   (True, "Action allowed"), (True, "Action allowed")]


def test_dispositions(spark):
    reqs = [(1, T0, "block_ip", "8.8.8.8", "policy", "a1", None),
            (2, T0 + dt.timedelta(seconds=1), "block_ip", "8.8.8.8", "policy", "a2", None),
            (3, T0 + dt.timedelta(seconds=2), "kill_process", "120", "manual", "a3", None),
            (4, T0 + dt.timedelta(seconds=3), "kill_process", "999", "manual", "a4", None),
            (5, T0 + dt.timedelta(seconds=4), "kill_process", "abc", "manual", "a5", None),
            (6, T0 + dt.timedelta(seconds=5), "kill_process", "7", "manual", "a6", None),
            (7, T0 + dt.timedelta(seconds=6), "resize", "x", "manual", "a7", None)]
    df = spark.createDataFrame(reqs, "request_id long, ts timestamp_ntz, action string, target string, "
                                     "triggered_by string, alert_id string, duration_minutes long")
    procs = spark.createDataFrame([(120, "nginx"), (7, "systemd")], "pid int, name string")
    got = {r["request_id"]: (r["status"], r["message"]) for r in R.dispositions(df, procs).collect()}
    assert got[1] == ("blocked", "Blocked IP 8.8.8.8")
    assert got[2] == ("already_blocked", "IP 8.8.8.8 is already blocked")
    assert got[3] == ("terminated", "Process 120 (nginx) terminated")
    assert got[4] == ("not_found", "Process 999 not found")
    assert got[5] == ("failed", "Invalid PID: abc")
    assert got[6] == ("rejected", "Process 'systemd' (PID 7) is protected")
    assert got[7] == ("unknown_action", "Unknown action: resize")


def test_rate_limit_five_per_minute(spark):
    reqs = [(i, T0 + dt.timedelta(seconds=i), "alert_only", "t", "policy", f"a{i}", None) for i in range(8)]
    reqs.append((8, T0 + dt.timedelta(seconds=61), "alert_only", "t", "policy", "a8", None))
    df = spark.createDataFrame(reqs, "request_id long, ts timestamp_ntz, action string, target string, "
                                     "triggered_by string, alert_id string, duration_minutes long")
    got = {r["request_id"]: r["rate_ok"] for r in R.rate_limited(df).collect()}
    assert [got[i] for i in range(9)] == [True] * 5 + [False] * 3 + [True]


def test_event_type_boundaries(spark):
    df = spark.createDataFrame([("critical", 0.1, "alert_only"), ("high", 0.9, "alert_only"),
                                ("high", 0.5, "block_ip"), ("high", 0.8, "alert_only"),
                                ("low", 0.7999, "alert_only")], "severity string, score double, action string")
    got = [r[0] for r in df.select(W.event_type(F.col("severity"), F.col("score"), F.col("action"))).collect()]
    assert got == ["critical_alert", "critical_alert", "action_taken", "attack_detected", "anomaly_detected"]


def test_hmac_rfc4231(spark):
    df = spark.createDataFrame([("what do ya want for nothing?",)], "payload string")
    got = W.sign_payloads(df, "Jefe").first()["signature"]
    assert got == "sha256=5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"
    assert W.sign_payloads(df, "").first()["signature"] == ""
    assert W.verify_signatures(W.sign_payloads(df, "Jefe"), "Jefe").first()["valid"]
    assert not W.verify_signatures(W.sign_payloads(df, "Jefe"), "").first()["valid"]


def test_delivery_outcomes(spark):
    rows = [(1, 1, "s", 500, None, T0), (1, 2, "s", 200, None, T0), (1, 3, "s", 500, None, T0),
            (2, 1, "s", None, "timeout", T0), (2, 2, "s", 503, None, T0)]
    df = spark.createDataFrame(rows, "delivery_id long, attempt int, webhook_name string, "
                                     "http_status int, error string, ts timestamp_ntz")
    got = {r["delivery_id"]: (r["status"], r["attempts"], r["last_error"])
           for r in W.delivery_outcomes(df).collect()}
    assert got == {1: ("delivered", 2, None), 2: ("failed", 2, "HTTP 503")}


def test_webhook_url_check(spark):
    urls = ["https://hooks.example.com/x", "ftp://a.b/c", "http:///nohost", "http://10.2.3.4:80/x",
            "http://169.254.169.254/latest", "http://[fd00::1]:8080/", "http://8.8.8.8/h"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [r["reason"] for r in W.webhook_url_check(df).collect()]
    assert got == [None, "invalid_scheme", "no_hostname", "blocked_address", "blocked_address",
                   "blocked_address", None]


def test_undeliverable_without_url(spark):
    df = spark.createDataFrame([("a1", "hook", ""), ("a2", "hook2", "https://x.example/h")],
                               "alert_id string, webhook_name string, webhook_url string")
    got = [tuple(r) for r in W.undeliverable(df).collect()]
    assert got == [("a1", "hook", "error", 0, "No URL configured")]


def test_ip_to_interface_of_both_families(spark):
    import ipaddress
    import random
    from lookout.operators import hostmetrics as H
    rng = random.Random(2)
    routes = [("h", "10.0.0.0", 8, "a", 5), ("h", "10.1.0.0", 15, "b", 2), ("h", "10.1.2.0", 25, "c", 1), ("h", "0.0.0.0", 0, "d", 0),
              ("h", "127.0.0.0", 8, "lo", 0), ("h", "2001:db8::", 33, "e", 3), ("h", "2001:db8:8000::", 35, "f", 4),
              ("h", "::1", 128, "lo", 0), ("g", "10.0.0.0", 9, "x", 1)]
    ips = ["10.1.2.3", "10.1.2.200", "10.200.0.1", "127.0.0.1", "::1", "8.8.8.8", "2001:DB8::7", "2001:db8:9fff::1",
           "2001:db8:a000::", "not an address", "::ffff:10.1.2.3"]
    ips += [f"10.{rng.randrange(4)}.{rng.randrange(4)}.{rng.randrange(256)}" for _ in range(60)]
    rows = [(h, ip) for h in ("h", "g") for ip in sorted(set(ips))]
    expected = {}
    for h, ip in rows:
        try:
            address = ipaddress.ip_address(ip)
        except ValueError:
            continue
        found = [(order, name) for host, net, bits, name, order in routes if host == h and bits and name != "lo"
                 and address in ipaddress.ip_network(f"{net}/{bits}", strict=False)]
        if found:
            expected[h, ip] = min(found)[1]
    got = H.ip_to_interface(spark.createDataFrame(rows, "host string, ip string"), spark.createDataFrame(
        routes, "host string, network string, mask_bits int, interface string, route_order int"))
    assert {(r["host"], r["ip"]): r["interface"] for r in got.collect()} == expected


def test_address_expressions_are_evaluated_once(spark):
    """An expression written into another several times is evaluated as often."""
    from pyspark.sql import functions as F
    from lookout.operators.response import ip_protected
    urls = ["http://[fd00::1]:8080/", "http://[::ffff:10.0.0.1]/", "http://[1:2:3]/", "http://0x7f000001/", "http://127.1/",
            "http://1.2.3.4.5/", "http://[::1%eth0]/", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    out = W.webhook_url_check(df)
    assert out.columns == ["url", "scheme", "host", "valid", "reason"]
    assert [r["reason"] for r in out.collect()] == ["blocked_address", None, None, "blocked_address", "blocked_address",
                                                    None, "blocked_address", None]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(url") == 2 and plan.count("split(") <= 20
    mapped = df.select(ip_protected(F.col("url")).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert mapped.count("split(") <= 20


def test_dispositions_make_the_requests_once(spark):
    """Also with a process table: rows with and without a pid come from one pass."""
    from lookout.operators import response as R
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf
    rows = [(1, T0, "kill_process", "7"), (2, T0, "kill_process", "8"), (3, T0, "kill_process", "x"),
            (4, T0, "alert_only", "9.9.9.9"), (5, T0, "alert_only", None)]
    df = spark.createDataFrame([(*r, "manual", "a", None) for r in rows], (
        "request_id long, ts timestamp_ntz, action string, target string, triggered_by string, alert_id string, "
        "duration_minutes long"))
    plain = R.dispositions(df, spark.createDataFrame([(7, "worker"), (None, "none")], "pid int, name string"))
    assert {r["request_id"]: r["status"] for r in plain.collect()} == {
        1: "terminated", 2: "not_found", 3: "failed", 4: "alert_only"}
    R.dispositions(df.mapInPandas(counted, df.schema), spark.createDataFrame([(7, "worker")], "pid int, name string"))
    assert made.value <= 3 * len(rows)  # the rate limit's two passes and the join
