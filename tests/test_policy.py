import datetime as dt

from pyspark.sql import functions as F

from lookout import schemas as S
from lookout.operators import features as FE
from lookout.operators import logs as L
from lookout.operators import netflow as N
from lookout.operators import policy as P
from lookout.sources.config import load_rules

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def test_brute_force_scenario(spark):
    """100 ssh failures from 5 IPs in one window -> brute_force."""
    rows = [(i, T0 + dt.timedelta(seconds=i % 5), "h", "auth.log",
             f"sshd[9]: Failed password for root from 198.51.100.{i % 5 + 1} port {4000 + i} ssh2")
            for i in range(100)]
    raw = spark.createDataFrame(rows, "id long, ts timestamp_ntz, host string, source string, line string")
    vec = FE.feature_vectors(FE.union_telemetry(L.classify_logs(raw)), 5)
    r = P.classify_anomaly(vec).collect()
    assert len(r) == 1 and r[0]["log_auth_failures"] == 100 and r[0]["anomaly_type"] == "brute_force"


def test_port_scan_scenario(spark):
    """100 connections to ports 1-100 from one IP -> one candidate with 100 ports."""
    rows = [("h", 1, "198.51.100.7", 40000, "192.0.2.1", p, "ESTABLISHED") for p in range(1, 101)]
    conns = spark.createDataFrame(rows, "host string, snap long, remote_ip string, remote_port int, "
                                        "local_ip string, local_port int, state string")
    new = N.new_connections(conns).withColumn("ts", F.lit(T0))
    sc = N.port_scan_candidates(new, "30 seconds").collect()
    assert len(sc) == 1 and sc[0]["ports"] == 100


def _scores(spark, rows):
    return spark.createDataFrame(
        [(i, T0 + dt.timedelta(seconds=s), "h", sc, "critical", at, ip, {"a": 1.0})
         for i, (s, sc, at, ip) in enumerate(rows)],
        "id long, ts timestamp_ntz, host string, score double, risk_level string, "
        "anomaly_type string, source_ip string, features map<string,double>")


def test_threshold_boundaries(spark):
    rules = load_rules(rules=[{"name": "r", "conditions": {"score_above": 0.75}}])
    s = _scores(spark, [(0, 0.75, "x", "1.1.1.1"), (1, 0.7499, "x", "1.1.1.1")])
    got = P.evaluate_policies(spark, s, rules).collect()
    assert [r["score_id"] for r in got] == [0]


def test_type_filter(spark):
    rules = load_rules(rules=[{"name": "r", "conditions": {"score_above": 0.1, "anomaly_type": "port_scan"}}])
    s = _scores(spark, [(0, 0.9, "port_scan", ""), (1, 0.9, "brute_force", ""), (2, 0.9, "", "")])
    got = sorted(r["score_id"] for r in P.evaluate_policies(spark, s, rules).collect())
    assert got == [0, 2]


def test_repeat_count_and_cooldown(spark):
    """w=60 s, 3 needed, cooldown 60 s from the last fired alert."""
    rules = load_rules(rules=[{"name": "bf", "conditions": {
        "score_above": 0.8, "repeated_within_seconds": 60, "min_occurrences": 3}}])
    secs = [0, 10, 20, 30, 79, 80, 85, 200, 205, 210]
    s = _scores(spark, [(x, 0.9, "brute_force", "9.9.9.9") for x in secs])
    counted = {r["id"]: r["repeat_count"] for r in
               P.evaluate_policies(spark, s, rules, "counted").collect()}
    assert [counted[i] for i in range(len(secs))] == [1, 2, 3, 4, 3, 3, 4, 1, 2, 3]
    fired = sorted(r["score_id"] for r in P.evaluate_policies(spark, s, rules).collect())
    # 20 fires (3 in window); 30, 79 within 60 s of 20; 80 is exactly 60 s later -> fires
    assert fired == [2, 5, 9]


def test_alert_message_and_top_features(spark):
    rules = load_rules(rules=[{"name": "p", "severity": "high", "action": "block_ip",
                               "conditions": {"score_above": 0.5}}])
    s = spark.createDataFrame(
        [(1, T0, "h", 0.876, "critical", "brute_force", "8.8.8.8",
          {"b": 2.0, "a": 2.0, "c": 0.0, "d": 5.0, "e": 1.0, "f": 3.0, "g": 4.0})],
        "id long, ts timestamp_ntz, host string, score double, risk_level string, "
        "anomaly_type string, source_ip string, features map<string,double>")
    a = P.evaluate_policies(spark, s, rules).collect()[0]
    assert a["message"] == ("[HIGH] Policy 'p' triggered (score: 0.88) — Brute force attack detected "
                            "from 8.8.8.8 → Action: block_ip")
    assert a["top_features"] == "d,g,f,a,b"
    assert a["alert_id"].startswith("alert_") and len(a["alert_id"]) == 6 + 64


def test_dedup_key_matches_python(spark):
    import hashlib
    df = spark.createDataFrame([("r", None, "1.2.3.4")], "r string, t string, ip string")
    got = df.select(P.dedup_key(F.col("r"), F.col("t"), F.col("ip"))).first()[0]
    assert got == hashlib.sha256(b"r::1.2.3.4").hexdigest()[:16]


def test_default_rules_when_missing(tmp_path):
    rules = load_rules(str(tmp_path / "missing.yml"))
    assert [r["name"] for r in rules] == ["high_score_alert", "critical_score_alert"]
    assert len(load_rules(rules=list(S.EXAMPLE_RULES) + ["junk"])) == 6


def test_repeat_count_expires_after_idle(spark):
    """A 600 s window, but the key's occurrences expire after 300 s without a match."""
    rules = load_rules(rules=[{"name": "slow", "conditions": {
        "score_above": 0.5, "repeated_within_seconds": 600, "min_occurrences": 1}}])
    s = _scores(spark, [(x, 0.9, "brute_force", "7.7.7.7") for x in [0, 100, 450, 500, 799]])
    counted = {r["id"]: r["repeat_count"] for r in
               P.evaluate_policies(spark, s, rules, "counted").collect()}
    assert [counted[i] for i in range(5)] == [1, 2, 1, 2, 3]
