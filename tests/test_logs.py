from pyspark.sql import functions as F

from lookout.operators import logs as L

LINES = [
    ("auth.log", "sshd[1]: Failed password for invalid user bob from 1.2.3.4 port 22 ssh2",
     "ssh_failure", "warning", "bob", "1.2.3.4"),
    ("auth.log", "sshd[1]: Failed password for root from 5.6.7.8 port 2222 ssh2",
     "ssh_failure", "warning", "root", "5.6.7.8"),
    ("auth.log", "sshd[1]: Accepted password for amy from 9.9.9.9 port 50000",
     "ssh_success", "info", "amy", "9.9.9.9"),
    ("auth.log", "sudo:    carl : TTY=pts/0 ; COMMAND=/bin/ls", "sudo_attempt", "info", "carl", None),
    ("syslog", "systemd[1]: Stopped nginx.service", "service_restart", "info", None, None),
    ("auth.log", "x pam_unix(sshd:auth): authentication failure; logname=", "auth_failure", "warning", None, None),
    ("auth.log", "x pam_unix(cron:session): session closed for user root", "pam_session", "info", None, None),
    ("kern.log", "kernel: Out of memory: Kill process 42 (java)", "oom_kill", "critical", None, None),
    ("access.log", '10.1.1.1 - - "GET / HTTP/1.1" 502 12', "http_5xx", "error", None, "10.1.1.1"),
    ("access.log", '10.1.1.2 - - "GET / HTTP/1.1" 404 12', "http_4xx", "warning", None, "10.1.1.2"),
    ("access.log", '10.1.1.3 - - "GET / HTTP/1.1" 200 12', "http_request", "info", None, "10.1.1.3"),
    ("access.log", "10.1.1.4 malformed line without status", "unknown", "info", None, "10.1.1.4"),
    ("nginx/access.log", "no ip here but an error", "error_keyword", "warning", None, None),
    ("syslog", "connection REFUSED by peer", "error_keyword", "warning", None, None),
    ("syslog", "all good", "unknown", "info", None, None),
]


def test_classify_every_outcome(spark):
    df = spark.createDataFrame([(i, s, line) for i, (s, line, *_) in enumerate(LINES)],
                               "id int, source string, line string")
    got = {r["id"]: r for r in L.classify_logs(df).collect()}
    for i, (_, _, typ, lvl, user, ip) in enumerate(LINES):
        assert got[i]["type"] == typ, (i, got[i])
        assert got[i]["level"] == lvl, (i, got[i])
        assert got[i]["user"] == user, (i, got[i])
        assert got[i]["source_ip"] == ip, (i, got[i])


def test_blank_lines_dropped_and_basename(spark):
    df = spark.createDataFrame([(1, "/var/log/nginx/access.log", '1.1.1.1 "x" 500 1'), (2, "a", "   ")],
                               "id int, source string, line string")
    rows = L.classify_logs(df).collect()
    assert len(rows) == 1 and rows[0]["source"] == "access.log" and rows[0]["type"] == "http_5xx"


def test_mask_url_secrets(spark):
    df = spark.createDataFrame([("redis://user:s3cret@host:6379/0",), ("http://host/x",)], "u string")
    got = [r[0] for r in df.select(L.mask_url_secrets(F.col("u"))).collect()]
    assert got == ["redis://user:*****@host:6379/0", "http://host/x"]


def test_log_search_regex_and_substring(spark):
    df = spark.createDataFrame([("Failed login",), ("ok",), ("FAIL",)], "message string")
    assert L.log_search(df, "/fail/").count() == 2
    assert L.log_search(df, "LOGIN").count() == 1
    assert L.log_search(df, "/fa(il/").count() == 0  # invalid regex -> substring 'fa(il'


def test_keyset_paging_and_sources(spark):
    import datetime as dt
    from lookout.operators import reads as Q
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), ["auth.log", "syslog", ""][i % 3],
             "warning" if i % 2 else "info", f"m{i}", "unknown" if i % 4 else "ssh_failure", None, None)
            for i in range(30)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, source string, level string, message string, "
                                     "type string, user string, source_ip string")
    p1 = Q.query_logs(df, level="warning", limit=5)
    ids = [r["id"] for r in p1.collect()]
    assert ids == [29, 27, 25, 23, 21]
    cur = Q.next_cursor(p1, 5)
    assert cur == 21
    assert [r["id"] for r in Q.query_logs(df, level="warning", after=cur, limit=5).collect()] == [19, 17, 15, 13, 11]
    assert Q.next_cursor(Q.query_logs(df, level="warning", after=3, limit=5), 5) is None
    assert [r["source"] for r in Q.log_sources(df, newest=2).collect()] == ["syslog"]
    assert [r["source"] for r in Q.log_sources(df, newest=3).collect()] == ["auth.log", "syslog"]
