"""Registered queries: response decisions and alert routing (R, W)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.ip import cidr_bounds
from ..operators import response as R
from ..operators import routing as W
from ..session import read_table
from ..sources.config import load_webhooks, webhooks_frame
from . import views as V
from .q_detect import _ALERT_SQL, _policy
from .registry import register
from .sqlviews import REQUESTS, with_views

AS_OF = "2024-01-30 23:59:00"
SECRET = "a key for these queries only"


# ---------------------------------------------------------------- inputs

def pid_names(spark: SparkSession, sf: str) -> DataFrame:
    p = V.processes(spark, sf)
    return p.groupBy("pid").agg(F.max_by("name", F.struct("snap", "ts")).alias("name"))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return V.requests(spark, sf)


def dispositions(spark: SparkSession, sf: str) -> DataFrame:
    return R.dispositions(requests(spark, sf), pid_names(spark, sf))


def actions(spark: SparkSession, sf: str) -> DataFrame:
    return R.action_records(dispositions(spark, sf))


def test_webhooks() -> list[dict]:
    hooks, _ = load_webhooks(hooks=[dict(h, enabled=True) for h in S.EXAMPLE_WEBHOOKS])
    return hooks


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    return _policy(spark, sf, "alerts")


def routed(spark: SparkSession, sf: str) -> DataFrame:
    return W.route_alerts(alerts(spark, sf), webhooks_frame(spark, test_webhooks()))


# ---------------------------------------------------------------- SQL pieces

_IPV4 = r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"
# any spelling of an IPv6 address, by where its :: stands; and any spelling of ::1
_H, _Q = "[0-9a-f]{1,4}", "[0-9]{1,3}(\\.[0-9]{1,3}){3}"
_IPV6 = "^(" + "|".join(
    [f"({_H}:){{7}}{_H}", f"({_H}:){{6}}{_Q}", "::"]
    + [f"({_H}:){{{n}}}(:{_H}){{1,{7 - n}}}" for n in range(1, 7)] + [f"({_H}:){{1,7}}:", f":(:{_H}){{1,7}}"]
    + [f"({_H}:){{{n}}}:({_H}:){{0,{5 - n}}}{_Q}" for n in range(1, 6)] + [f"::({_H}:){{0,5}}{_Q}"]) + ")$"
_ONE = "^((0{1,4}:){7}0{0,3}1|((0{1,4}:){1,6}|:):(0{1,4}:){0,6}0{0,3}1|((0{1,4}:){1,5}|:):(0{1,4}:){0,4}0\\.0\\.0\\.1|(0{1,4}:){6}0\\.0\\.0\\.1)$"


def _ipnum(x: str) -> str:
    return " + ".join(f"CAST(string_split({x}, '.')[{i + 1}] AS BIGINT) * {256 ** (3 - i)}"
                      for i in range(4))


def _v4_in(x: str, cidrs) -> str:
    terms = []
    for c in cidrs:
        b = cidr_bounds(c)
        if b:
            terms.append(f"({_ipnum(x)}) BETWEEN {b[0]} AND {b[1]}")
    return "(" + " OR ".join(terms) + ")"


PROTECTED_SQL = f"""CASE
  WHEN regexp_matches(coalesce(target, ''), '{_IPV4}') THEN {_v4_in('target', S.PROTECTED_IP_RANGES)}
  WHEN regexp_matches(lower(coalesce(target, '')), '{_IPV6}') THEN regexp_matches(lower(target), '{_ONE}')
  ELSE true END"""

#: Spellings of addresses, good and bad, that no event has: the k-th event is
#: given the k-th of them as its address.
_SPELLINGS = ("::1", "::0001", "0:0:0:0:0:0:0:1", "0::0:1", "::0.0.0.1", "2001:db8::7", "2001:DB8:0:0:0:0:0:7", "1:2:3", ":::",
              "12:34", "1::2::3", "fe80::1", "fd00::12", "fc00:1::", "febf::1", "::ffff:10.0.0.1", "::ffff:203.0.113.9",
              "1:2:3:4:5:6:7:8:9", "12345::1", "203.0.113.300", "010.0.0.1", "2130706433", "0x7f000001", "127.1", "0177.0.0.1",
              "3405803785", "203.0.28937", "1.2.3.4.5", "g::1", "::", "1:2:3:4:5:6:7::")


def odd_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """(id, address): one of ``_SPELLINGS`` for each event."""
    some = F.array(*[F.lit(x) for x in _SPELLINGS])
    return V.base(spark, sf).select(F.col("event_id").alias("id"), F.element_at(
        some, (F.col("event_id") % len(_SPELLINGS) + 1).cast("int")).alias("address"))


_ODD_SQL = f"""odd AS (SELECT event_id AS id, [{", ".join(f"'{x}'" for x in _SPELLINGS)}][event_id % {len(_SPELLINGS)} + 1] AS address FROM base)"""

DISP_SQL = f"""
names AS (SELECT pid, arg_max(name, (snap, ts)) AS name FROM processes GROUP BY pid),
req AS (SELECT r.*, epoch_us(r.ts) AS t, {PROTECTED_SQL} AS protected,
          lower(action) IN ({", ".join(f"'{a}'" for a in S.FORBIDDEN_ACTIONS)}) AS forbidden,
          coalesce(lower(target) IN ({", ".join(f"'{p}'" for p in S.PROTECTED_PROCESSES)}), false) AS prot_target,
          CASE WHEN action = 'kill_process' THEN TRY_CAST(trim(target) AS BIGINT) END AS pid
        FROM requests r),
rr AS (SELECT target, request_id, t, row_number() OVER (PARTITION BY target ORDER BY t, request_id) AS rn FROM req),
rl AS (
  SELECT target, rn, request_id, t, [t] AS hist, true AS ok FROM rr WHERE rn = 1
  UNION ALL
  SELECT rr.target, rr.rn, rr.request_id, rr.t,
    CASE WHEN len(list_filter(rl.hist, lambda x: x > rr.t - 60000000)) < 5
         THEN list_append(list_filter(rl.hist, lambda x: x > rr.t - 60000000), rr.t)
         ELSE list_filter(rl.hist, lambda x: x > rr.t - 60000000) END,
    len(list_filter(rl.hist, lambda x: x > rr.t - 60000000)) < 5
  FROM rl JOIN rr ON rr.target = rl.target AND rr.rn = rl.rn + 1),
val AS (
  SELECT q.*, rl.ok AS rate_ok,
    CASE WHEN q.forbidden THEN printf('Action ''%s'' is permanently forbidden', q.action)
         WHEN q.action = 'block_ip' AND q.protected THEN printf('IP %s is protected and cannot be blocked', coalesce(q.target, ''))
         WHEN q.action = 'kill_process' AND q.prot_target THEN printf('Process ''%s'' is protected and cannot be killed', coalesce(q.target, ''))
    END AS bad_reason,
    q.t + coalesce(q.duration_minutes, 60) * 60 * 1000000 AS until,
    n.name AS pname
  FROM req q JOIN rl ON rl.request_id = q.request_id LEFT JOIN names n ON n.pid = q.pid),
bsr AS (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY t, request_id) AS brn FROM val
  WHERE rate_ok AND bad_reason IS NULL AND ((action = 'block_ip' AND NOT protected) OR action = 'unblock_ip')),
bf AS (
  SELECT target, brn, request_id, t,
    CASE WHEN action = 'block_ip' THEN until END AS cur,
    CASE WHEN action = 'block_ip' THEN 'blocked' ELSE 'not_blocked' END AS outcome
  FROM bsr WHERE brn = 1
  UNION ALL
  SELECT b.target, b.brn, b.request_id, b.t,
    CASE WHEN b.action = 'block_ip' THEN CASE WHEN bf.cur IS NOT NULL AND b.t < bf.cur THEN bf.cur ELSE b.until END END,
    CASE WHEN b.action = 'block_ip' THEN CASE WHEN bf.cur IS NOT NULL AND b.t < bf.cur THEN 'already_blocked' ELSE 'blocked' END
         ELSE CASE WHEN bf.cur IS NOT NULL AND b.t < bf.cur THEN 'unblocked' ELSE 'not_blocked' END END
  FROM bf JOIN bsr b ON b.target = bf.target AND b.brn = bf.brn + 1),
disp AS (
  SELECT v.*, bf.outcome, bf.cur AS blocked_until,
    CASE WHEN NOT v.rate_ok THEN 'rate_limited'
         WHEN v.bad_reason IS NOT NULL THEN 'rejected'
         WHEN v.action = 'block_ip' AND v.protected THEN 'rejected'
         WHEN v.action = 'block_ip' THEN bf.outcome
         WHEN v.action = 'unblock_ip' THEN 'unblocked'
         WHEN v.action = 'kill_process' AND v.pid IS NULL THEN 'failed'
         WHEN v.action = 'kill_process' AND lower(coalesce(v.pname, 'unknown')) IN ({", ".join(f"'{p}'" for p in S.PROTECTED_PROCESSES)}) THEN 'rejected'
         WHEN v.action = 'kill_process' AND v.pid <= 1 THEN 'rejected'
         WHEN v.action = 'kill_process' AND v.pname IS NULL THEN 'not_found'
         WHEN v.action = 'kill_process' THEN 'terminated'
         WHEN v.action = 'alert_only' THEN 'alert_only'
         ELSE 'unknown_action' END AS status,
    CASE WHEN NOT v.rate_ok THEN printf('Rate limit exceeded for %s (5/min)', coalesce(v.target, ''))
         WHEN v.bad_reason IS NOT NULL THEN v.bad_reason
         WHEN v.action = 'block_ip' AND v.protected THEN printf('IP %s is protected (whitelist)', v.target)
         WHEN v.action = 'block_ip' AND bf.outcome = 'already_blocked' THEN printf('IP %s is already blocked', v.target)
         WHEN v.action = 'block_ip' THEN printf('Blocked IP %s', v.target)
         WHEN v.action = 'unblock_ip' THEN printf('Unblocked IP %s', v.target)
         WHEN v.action = 'kill_process' AND v.pid IS NULL THEN printf('Invalid PID: %s', coalesce(v.target, ''))
         WHEN v.action = 'kill_process' AND lower(coalesce(v.pname, 'unknown')) IN ({", ".join(f"'{p}'" for p in S.PROTECTED_PROCESSES)})
           THEN printf('Process ''%s'' (PID %d) is protected', coalesce(v.pname, 'unknown'), v.pid)
         WHEN v.action = 'kill_process' AND v.pid <= 1 THEN printf('PID %d is protected (init/systemd)', v.pid)
         WHEN v.action = 'kill_process' AND v.pname IS NULL THEN printf('Process %d not found', v.pid)
         WHEN v.action = 'kill_process' THEN printf('Process %d (%s) terminated', v.pid, v.pname)
         WHEN v.action = 'alert_only' THEN 'Alert logged, no action taken'
         ELSE printf('Unknown action: %s', v.action) END AS message
  FROM val v LEFT JOIN bf ON bf.request_id = v.request_id),
acts AS (
  SELECT 'act_' || CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) || '_' || CAST(request_id AS VARCHAR) AS action_id,
    *, action = 'block_ip' AS reversible,
    CASE WHEN status = 'blocked' THEN coalesce(duration_minutes, 60) END AS block_minutes
  FROM disp),
revs AS (
  SELECT action_id, target, block_minutes AS duration_minutes, ts,
         ts + block_minutes * INTERVAL 1 MINUTE AS reversal_at
  FROM acts WHERE status = 'blocked' AND coalesce(action_id, '') <> '' AND coalesce(target, '') <> ''
    AND action = 'block_ip' AND block_minutes > 0)"""

_R_SQL = with_views("requests", "processes", extra=DISP_SQL, recursive=True)


# ---------------------------------------------------------------- R

@register("r1_action_requests", _ALERT_SQL.rstrip() + """,
auto AS (SELECT alert_id AS request_id, ts, action, source_ip AS target, 'policy' AS triggered_by, alert_id,
                policy_name, severity, NULL AS reason, NULL::BIGINT AS duration_minutes
         FROM alerts WHERE action <> 'alert_only'),
""" + REQUESTS.strip() + """
SELECT * FROM auto
UNION ALL
SELECT CAST(request_id AS VARCHAR), ts, action, target, triggered_by, alert_id, NULL, NULL,
  'asked for by u' || request_id % 7, duration_minutes FROM requests WHERE triggered_by = 'manual'""")
def r1_action_requests(spark, sf):
    manual = requests(spark, sf).filter(F.col("triggered_by") == "manual") \
        .withColumn("reason", F.concat(F.lit("asked for by u"), (F.col("request_id") % 7).cast("string"))) \
        .withColumn("request_id", F.col("request_id").cast("string"))
    return R.action_requests(alerts(spark, sf), manual)


@register("r2_ip_protected", with_views("requests", "base") + f""",
{_ODD_SQL},
targets AS (SELECT CAST(request_id AS VARCHAR) AS request_id, target FROM requests
            UNION ALL SELECT 'odd_' || CAST(id AS VARCHAR), address FROM odd)
SELECT request_id, target, {PROTECTED_SQL} AS protected FROM targets""")
def r2_ip_protected(spark, sf):
    odd = odd_addresses(spark, sf).select(F.concat(F.lit("odd_"), F.col("id").cast("string")).alias("request_id"),
                                          F.col("address").alias("target"))
    targets = requests(spark, sf).select(F.col("request_id").cast("string"), "target").unionByName(odd)
    return targets.select("request_id", "target", R.ip_protected(F.col("target")).alias("protected"))


@register("r3_action_validation", _R_SQL + """
SELECT request_id, bad_reason IS NULL AS allowed, coalesce(bad_reason, 'Action allowed') AS reason FROM val""")
def r3_action_validation(spark, sf):
    return R.validate(requests(spark, sf)).select("request_id", "allowed", "reason")


@register("r5_rate_limit_actions", _R_SQL + "SELECT request_id, rate_ok FROM val")
def r5_rate_limit_actions(spark, sf):
    return R.rate_limited(requests(spark, sf)).select("request_id", "rate_ok")


@register("r6_action_disposition", _R_SQL + "SELECT request_id, status, message FROM disp")
def r6_action_disposition(spark, sf):
    return dispositions(spark, sf).select("request_id", "status", "message")


@register("r7_action_records", _R_SQL + """
SELECT action_id, action, target, triggered_by, alert_id, status, reversible FROM acts""")
def r7_action_records(spark, sf):
    return actions(spark, sf).select("action_id", "action", "target", "triggered_by", "alert_id",
                                     "status", "reversible")


@register("r8_schedule_reversals", _R_SQL + """
SELECT action_id, target, duration_minutes, reversal_at FROM revs""")
def r8_schedule_reversals(spark, sf):
    return R.schedule_reversals(actions(spark, sf)).select(
        "action_id", "target", F.col("duration_minutes").cast("long").alias("duration_minutes"),
        "reversal_at")


@register("r9_due_reversals", _R_SQL + f"""
SELECT action_id, target, reversal_at,
  CASE WHEN reversal_at <= TIMESTAMP '{AS_OF}' THEN 'unblock_ip' ELSE 'pending' END AS state,
  CASE WHEN reversal_at > TIMESTAMP '{AS_OF}' THEN
    CAST(floor(epoch(reversal_at)) AS BIGINT) - CAST(floor(epoch(TIMESTAMP '{AS_OF}')) AS BIGINT) END AS remaining_seconds
FROM revs WHERE coalesce(target, '') <> ''""")
def r9_due_reversals(spark, sf):
    return R.due_reversals(R.schedule_reversals(actions(spark, sf)), AS_OF)


@register("r10_block_state", _R_SQL + f"""
SELECT target, make_timestamp(blocked_until) AS blocked_until FROM (
  SELECT target, arg_max(action, (ts, request_id)) AS action, arg_max(blocked_until, (ts, request_id)) AS blocked_until
  FROM disp WHERE ts <= TIMESTAMP '{AS_OF}' AND action IN ('block_ip', 'unblock_ip')
    AND status IN ('blocked', 'already_blocked', 'unblocked')
  GROUP BY target)
WHERE action = 'block_ip' AND blocked_until > epoch_us(TIMESTAMP '{AS_OF}')""")
def r10_block_state(spark, sf):
    return R.blocked_at(dispositions(spark, sf), AS_OF)


# ---------------------------------------------------------------- W

_EVENT_SQL = ("CASE WHEN severity = 'critical' OR score >= 0.9 THEN 'critical_alert' "
              "WHEN action <> 'alert_only' THEN 'action_taken' "
              "WHEN score >= 0.8 THEN 'attack_detected' ELSE 'anomaly_detected' END")

_HOOKS_SQL = "hooks(webhook_name, events) AS (VALUES " + ", ".join(
    "('{}', [{}])".format(h["name"], ", ".join(f"'{e}'" for e in h["events"]))
    for h in S.EXAMPLE_WEBHOOKS) + ")"

_ROUTE_SQL = _ALERT_SQL.rstrip() + f""",
{_HOOKS_SQL},
notified AS (SELECT *, {_EVENT_SQL} AS event_type FROM alerts
             WHERE lower(coalesce(CAST(notify AS VARCHAR), 'true')) NOT IN ('false', '0', 'no')),
routed AS (SELECT n.*, h.webhook_name FROM notified n JOIN hooks h
           ON list_contains(h.events, n.event_type) OR len(h.events) = 0)
"""


@register("w1_event_type", _ALERT_SQL + f"SELECT alert_id, {_EVENT_SQL} AS event_type FROM alerts")
def w1_event_type(spark, sf):
    a = alerts(spark, sf)
    return a.select("alert_id", W.event_type(F.col("severity"), F.col("score"), F.col("action"))
                    .alias("event_type"))


@register("w2_notify_filter", _ROUTE_SQL + "SELECT alert_id FROM notified")
def w2_notify_filter(spark, sf):
    return W.notify_filter(alerts(spark, sf)).select("alert_id")


@register("w3_route_alerts", _ROUTE_SQL + "SELECT alert_id, webhook_name, event_type FROM routed")
def w3_route_alerts(spark, sf):
    return routed(spark, sf).select("alert_id", "webhook_name", "event_type")


_COLORS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.SEVERITY_COLORS.items())
_EMOJI = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.SEVERITY_EMOJI.items())


@register("w4_alert_payload", _ROUTE_SQL + f"""
SELECT alert_id, webhook_name,
  (CASE severity {_EMOJI} ELSE '{S.DEFAULT_EMOJI}' END) || ' *[' || upper(severity) || ']* Lookout Alert on server'
    || chr(10) || 'Score: ' || printf('%.2f', round(score, 2)) || ' | Policy: ' || policy_name || chr(10) || message AS text,
  CASE severity {_COLORS} ELSE {S.DEFAULT_COLOR} END AS color
FROM routed""")
def w4_alert_payload(spark, sf):
    p = W.alert_payload(routed(spark, sf))
    body = F.from_json("payload", "text string, embeds array<struct<color:int>>")
    return p.select("alert_id", "webhook_name", body["text"].alias("text"),
                    body["embeds"][0]["color"].alias("color"))


_SIGNING = ", ".join(f"'{h['name']}'" for h in S.EXAMPLE_WEBHOOKS if h.get("sign_payloads"))


def _hmac_pads(secret: str) -> tuple[str, str]:
    """HMAC (RFC 2104) key pads for SHA-256 (64-byte block), as hex."""
    key = secret.encode("utf-8").ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5c for b in key).hex()


_IPAD, _OPAD = _hmac_pads(SECRET)

RISK_SQL_SCORE = ("CASE WHEN score >= 0.8 THEN 'critical' WHEN score >= 0.6 THEN 'suspicious' "
                  "WHEN score >= 0.4 THEN 'elevated' ELSE 'normal' END")

# the payload body written out in the field order and compact layout of JSON
_PAYLOAD_SQL = f"""'{{"event_type":' || to_json(event_type)
  || ',"alert_id":' || to_json(alert_id)
  || ',"timestamp":' || to_json(CAST(ts AS VARCHAR))
  || ',"severity":' || to_json(severity)
  || ',"score":' || CAST(CAST(score AS DOUBLE) AS VARCHAR)
  || ',"risk_level":' || to_json({RISK_SQL_SCORE})
  || ',"policy_name":' || to_json(policy_name)
  || ',"anomaly_type":' || to_json(anomaly_type)
  || ',"source_ip":' || to_json(source_ip)
  || ',"action":' || to_json(action)
  || ',"message":' || to_json(message)
  || ',"host":""'
  || ',"text":' || to_json((CASE severity {_EMOJI} ELSE '{S.DEFAULT_EMOJI}' END) || ' *[' || upper(severity)
       || ']* Lookout Alert on server' || chr(10) || 'Score: ' || printf('%.2f', round(score, 2))
       || ' | Policy: ' || policy_name || chr(10) || message)
  || ',"embeds":[{{"title":' || to_json((CASE severity {_EMOJI} ELSE '{S.DEFAULT_EMOJI}' END) || ' Lookout Alert')
  || ',"description":' || to_json(message)
  || ',"color":' || CAST(CASE severity {_COLORS} ELSE {S.DEFAULT_COLOR} END AS VARCHAR)
  || ',"fields":[{{"name":"Severity","value":' || to_json(upper(severity)) || ',"inline":true}}'
  || ',{{"name":"Score","value":' || to_json(printf('%.2f', round(score, 2))) || ',"inline":true}}'
  || ',{{"name":"Policy","value":' || to_json(policy_name) || ',"inline":true}}'
  || ',{{"name":"Host","value":"N/A","inline":true}}]'
  || ',"timestamp":' || to_json(CAST(ts AS VARCHAR)) || '}}]}}'"""


@register("w5_sign_payloads", _ROUTE_SQL + f"""
SELECT alert_id, webhook_name,
  'sha256=' || sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode({_PAYLOAD_SQL})))) AS signature
FROM routed WHERE webhook_name IN ({_SIGNING})""")
def w5_sign_payloads(spark, sf):
    """HMAC-SHA256 of every routed payload for webhooks that sign."""
    p = W.alert_payload(routed(spark, sf)).filter("sign_payloads")
    return W.sign_payloads(p, SECRET).select("alert_id", "webhook_name", "signature")


@register("w6_verify_signatures", _ROUTE_SQL + f"""
SELECT alert_id, webhook_name, true AS valid FROM routed WHERE webhook_name IN ({_SIGNING})""")
def w6_verify_signatures(spark, sf):
    """Signatures recomputed and compared (all must verify)."""
    p = W.sign_payloads(W.alert_payload(routed(spark, sf)).filter("sign_payloads"), SECRET)
    return W.verify_signatures(p, SECRET).select("alert_id", "webhook_name", "valid")


# the url of a webhook is configuration; one has none
_HOOK_URLS = {"slack": "https://hooks.example.com/slack", "discord": "https://hooks.example.com/discord",
              "siem": "https://siem.example.com/in", "mail": ""}
_OUT_SQL = with_views("attempts", extra="""
urls(webhook_name, url) AS (VALUES ('slack', 'https://hooks.example.com/slack'), ('discord', 'https://hooks.example.com/discord'),
                                   ('siem', 'https://siem.example.com/in'), ('mail', '')),
sent AS (
  SELECT delivery_id, webhook_name,
    CASE WHEN min(attempt) FILTER (WHERE http_status BETWEEN 200 AND 299) IS NOT NULL THEN 'delivered' ELSE 'failed' END AS status,
    CAST(coalesce(min(attempt) FILTER (WHERE http_status BETWEEN 200 AND 299), max(attempt)) AS INTEGER) AS attempts,
    CASE WHEN min(attempt) FILTER (WHERE http_status BETWEEN 200 AND 299) IS NULL THEN
      arg_max(CASE WHEN http_status IS NOT NULL THEN 'HTTP ' || CAST(http_status AS VARCHAR)
                   ELSE coalesce(error, 'Request timed out') END, attempt) END AS last_error,
    max(ts) AS ts, '{"delivery":' || delivery_id || '}' AS payload
  FROM attempts WHERE attempt <= 5 GROUP BY delivery_id, webhook_name),
outcomes AS (
  SELECT delivery_id, webhook_name, url, payload, ts,
    CASE WHEN url = '' THEN 'error' ELSE status END AS status,
    CASE WHEN url = '' THEN 0 ELSE attempts END AS attempts,
    CASE WHEN url = '' THEN 'No URL configured' ELSE last_error END AS last_error
  FROM sent JOIN urls USING (webhook_name))""")


def outcomes(spark, sf):
    a = V.attempts(spark, sf).withColumn("payload", F.to_json(F.struct(F.col("delivery_id").alias("delivery"))))
    urls = spark.createDataFrame(list(_HOOK_URLS.items()), "webhook_name string, url string")
    return W.delivery_outcomes(a, urls)


@register("w7_delivery_outcomes", _OUT_SQL + "SELECT delivery_id, webhook_name, url, status, attempts, last_error FROM outcomes")
def w7_delivery_outcomes(spark, sf):
    return outcomes(spark, sf).select("delivery_id", "webhook_name", "url", "status", "attempts", "last_error")


@register("w8_delivery_dead_letters", _OUT_SQL + """
SELECT delivery_id, webhook_name, url, payload, last_error AS error, attempts,
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS failed_at FROM (
  SELECT * FROM outcomes WHERE status = 'failed' ORDER BY ts DESC, delivery_id DESC LIMIT 1000)
ORDER BY ts DESC, delivery_id DESC LIMIT 50""")
def w8_delivery_dead_letters(spark, sf):
    return W.delivery_dead_letters(outcomes(spark, sf))


@register("w9_delivery_stats", _OUT_SQL + """
SELECT webhook_name, status, CAST(count(*) AS BIGINT) AS n FROM outcomes GROUP BY webhook_name, status""")
def w9_delivery_stats(spark, sf):
    return W.delivery_stats(outcomes(spark, sf))


def _urls(spark, sf):
    pages = read_table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("src"), "url")
    ips = V.base(spark, sf).select(F.concat(F.lit("ip_"), F.col("event_id").cast("string")).alias("src"),
                                   F.concat(F.when(F.col("k") % 3 == 0, "ftp").otherwise("http"),
                                            F.lit("://"), F.col("ip"), F.lit(":9000/hook")).alias("url"))
    address = F.col("address")
    odd = odd_addresses(spark, sf).select(
        F.concat(F.lit("odd_"), F.col("id").cast("string")).alias("src"),
        F.concat(F.lit("http://"), F.when(address.contains(":"), F.concat(F.lit("["), address, F.lit("]"))).otherwise(address),
                 F.lit("/hook")).alias("url"))
    return pages.unionByName(ips).unionByName(odd)


# addresses of the spellings that a resolver takes as loopback or private
_ODD_BLOCKED = ("2130706433", "0x7f000001", "127.1", "0177.0.0.1")


@register("w10_webhook_url_check", with_views("base") + rf""",
{_ODD_SQL}
, urls AS (
  SELECT CAST(page_id AS VARCHAR) AS src, url FROM pages
  UNION ALL
  SELECT 'ip_' || CAST(event_id AS VARCHAR), CASE WHEN k % 3 = 0 THEN 'ftp' ELSE 'http' END || '://' || ip || ':9000/hook' FROM base
  UNION ALL
  SELECT 'odd_' || CAST(id AS VARCHAR), 'http://' || CASE WHEN contains(address, ':') THEN '[' || address || ']' ELSE address END || '/hook' FROM odd),
parsed AS (
  SELECT src, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
    lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?(\[[^\]]*\]|[^:/?#]*)', 1), '^\[|\]$', '', 'g')) AS host
  FROM urls)
SELECT src, valid, reason FROM (
  SELECT src, CASE WHEN scheme NOT IN ('http', 'https') THEN 'invalid_scheme'
      WHEN host = '' THEN 'no_hostname'
      WHEN regexp_matches(host, '{_IPV4}') AND {_v4_in('host', S.BLOCKED_WEBHOOK_NETWORKS)} THEN 'blocked_address'
      WHEN host IN ({", ".join(f"'{x}'" for x in _ODD_BLOCKED)}) THEN 'blocked_address'
      WHEN regexp_matches(host, '{_IPV6}') AND (regexp_matches(host, '{_ONE}')
           OR regexp_matches(host, '^f[cd][0-9a-f]{{2}}:') OR regexp_matches(host, '^fe[89ab][0-9a-f]:')) THEN 'blocked_address'
      END AS reason, reason IS NULL AS valid FROM parsed)""")
def w10_webhook_url_check(spark, sf):
    return W.webhook_url_check(_urls(spark, sf)).select("src", "valid", "reason")
