"""The telemetry views of FIXTURES.md part B as DuckDB SQL (for oracles).

These are written from the view definitions, independently of the Spark
code in ``views.py``; each oracle query starts with ``WITH`` + the views it
needs. Dialect notes: DuckDB casts double -> int by rounding, so ``floor``
first; BIGINT sums are HUGEINT, so cast back.
"""

from __future__ import annotations

BASE = """
base AS (
  SELECT event_id, ts, user_id, event_type, value, props,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CAST(floor(epoch(ts)) AS BIGINT) AS es,
         'h' || CAST(user_id % 4 AS VARCHAR) AS host,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 = 0
              THEN '10.0.0.' || CAST(user_id % 5 + 1 AS VARCHAR)
              ELSE '203.0.113.' || CAST(user_id % 20 + 1 AS VARCHAR) END AS ip
  FROM events)"""

RAW_LOGS = """
raw_logs AS (
  SELECT event_id AS id, ts, host,
    CASE WHEN event_type IN ('error', 'signup') THEN 'auth.log'
         WHEN event_type = 'purchase' THEN 'syslog'
         WHEN event_type = 'click' THEN 'access.log'
         WHEN event_type = 'view' THEN 'kern.log' ELSE 'unknown' END AS source,
    CASE
      WHEN event_type = 'error' AND k % 2 = 0 THEN 'sshd[7]: Failed password for '
           || CASE WHEN k % 4 = 0 THEN 'invalid user ' ELSE '' END
           || 'u' || CAST(user_id AS VARCHAR) || ' from ' || ip || ' port ' || CAST(k + 1024 AS VARCHAR) || ' ssh2'
      WHEN event_type = 'error' THEN 'login: pam_unix(login:auth): authentication failure; uid=0'
      WHEN event_type = 'signup' AND k % 3 = 0 THEN 'sshd[7]: Accepted publickey for u'
           || CAST(user_id AS VARCHAR) || ' from ' || ip || ' port ' || CAST(k + 1024 AS VARCHAR)
      WHEN event_type = 'signup' AND k % 3 = 1 THEN 'sudo:    u' || CAST(user_id AS VARCHAR)
           || ' : TTY=pts/0 ; COMMAND=/bin/ls'
      WHEN event_type = 'signup' THEN 'sshd[7]: pam_unix(sshd:session): session opened for user u1'
      WHEN event_type = 'purchase' AND k % 2 = 0 THEN 'systemd[1]: Started unit-' || CAST(k AS VARCHAR) || '.service'
      WHEN event_type = 'purchase' AND k % 4 = 1 THEN 'disk: I/O ERROR on sda'
      WHEN event_type = 'purchase' THEN 'cron: tick'
      WHEN event_type = 'click' THEN ip || ' - - "GET /p/' || CAST(k AS VARCHAR) || ' HTTP/1.1" '
           || CASE WHEN k % 10 = 0 THEN '503' WHEN k % 7 = 0 THEN '404' ELSE '200' END || ' 512'
      WHEN event_type = 'view' AND k % 20 = 0 THEN 'kernel: Out of memory: Killed process 77 (java)'
      ELSE 'usb: device connected' END AS line
  FROM base)"""

# Log classification written as SQL regexes (DuckDB RE2 syntax).
CLASSIFIED = r"""
classified AS (
  SELECT id, ts, host, source, trim(line) AS message,
    CASE
      WHEN regexp_matches(trim(line), 'Failed password for (?:invalid user )?(\S+) from (\S+) port (\d+)') THEN 'ssh_failure'
      WHEN regexp_matches(trim(line), 'Accepted (?:password|publickey) for (\S+) from (\S+) port (\d+)') THEN 'ssh_success'
      WHEN regexp_matches(trim(line), 'sudo:\s+(\S+)\s+:') THEN 'sudo_attempt'
      WHEN regexp_matches(trim(line), 'systemd\[\d+\]:\s+(Started|Stopped|Restarting)\s+(.+)') THEN 'service_restart'
      WHEN regexp_matches(trim(line), 'pam_unix\(.+\):\s+authentication failure') THEN 'auth_failure'
      WHEN regexp_matches(trim(line), 'pam_unix\(.+\):\s+session (?:opened|closed)') THEN 'pam_session'
      WHEN regexp_matches(trim(line), 'Out of memory: Kill(?:ed)? process (\d+)') THEN 'oom_kill'
      WHEN source = 'access.log' AND regexp_matches(trim(line), '\d+\.\d+\.\d+\.\d+') THEN
        CASE WHEN regexp_extract(trim(line), '" (\d{3}) ', 1) = '' THEN 'unknown'
             WHEN CAST(regexp_extract(trim(line), '" (\d{3}) ', 1) AS INTEGER) >= 500 THEN 'http_5xx'
             WHEN CAST(regexp_extract(trim(line), '" (\d{3}) ', 1) AS INTEGER) >= 400 THEN 'http_4xx'
             ELSE 'http_request' END
      WHEN contains(lower(line), 'error') OR contains(lower(line), 'fail')
           OR contains(lower(line), 'denied') OR contains(lower(line), 'refused') THEN 'error_keyword'
      ELSE 'unknown' END AS type
  FROM raw_logs WHERE length(trim(line)) > 0)"""

LOGS = r"""
logs AS (
  SELECT *,
    CASE WHEN type IN ('ssh_failure', 'auth_failure', 'http_4xx', 'error_keyword') THEN 'warning'
         WHEN type = 'http_5xx' THEN 'error' WHEN type = 'oom_kill' THEN 'critical'
         ELSE 'info' END AS level,
    nullif(CASE
      WHEN type = 'ssh_failure' THEN regexp_extract(message, 'Failed password for (?:invalid user )?(\S+) from (\S+) port (\d+)', 1)
      WHEN type = 'ssh_success' THEN regexp_extract(message, 'Accepted (?:password|publickey) for (\S+) from (\S+) port (\d+)', 1)
      WHEN type = 'sudo_attempt' THEN regexp_extract(message, 'sudo:\s+(\S+)\s+:', 1) END, '') AS "user",
    nullif(CASE
      WHEN type = 'ssh_failure' THEN regexp_extract(message, 'Failed password for (?:invalid user )?(\S+) from (\S+) port (\d+)', 2)
      WHEN type = 'ssh_success' THEN regexp_extract(message, 'Accepted (?:password|publickey) for (\S+) from (\S+) port (\d+)', 2)
      WHEN type IN ('http_5xx', 'http_4xx', 'http_request', 'unknown') AND source = 'access.log'
        THEN regexp_extract(message, '(\d+\.\d+\.\d+\.\d+)', 1) END, '') AS source_ip
  FROM classified)"""

CONNECTIONS = """
connections AS (
  SELECT DISTINCT host, CAST(es // 21600 AS BIGINT) AS snap, ip AS remote_ip,
    CAST(40000 + k % 3 AS INTEGER) AS remote_port, '192.0.2.1' AS local_ip,
    CAST(CASE k % 12 WHEN 0 THEN 22 WHEN 1 THEN 80 WHEN 2 THEN 443 WHEN 3 THEN 8080
         WHEN 4 THEN 3306 WHEN 5 THEN 5432 WHEN 6 THEN 6379 ELSE 9000 + k % 12 END AS INTEGER) AS local_port,
    CASE WHEN k % 5 = 0 THEN 'LISTEN' WHEN k % 5 = 4 THEN 'TIME_WAIT' ELSE 'ESTABLISHED' END AS state
  FROM base)"""

PROCESSES = """
proc_rows AS (
  SELECT host, ts, event_id, CAST(es // 86400 AS BIGINT) AS snap,
    CAST(100 + user_id % 60 AS INTEGER) AS pid,
    ['bash', 'python3', 'nginx', 'curl', 'java', 'sshd'][k % 6 + 1] AS name,
    ['bash', 'python3', 'nginx', 'curl', 'java', 'sshd'][k % 6 + 1] || ' --job ' || CAST(k AS VARCHAR) AS cmdline,
    least(100.0, value) AS cpu_percent, value * 4 AS memory_mb,
    CAST(k % 10 AS INTEGER) AS connections, 'running' AS status,
    CAST(1 + user_id % 5 AS INTEGER) AS ppid,
    ['nginx', 'mysqld', 'postgres', 'systemd', 'httpd'][user_id % 5 + 1] AS parent_name
  FROM base),
processes AS (
  SELECT host, snap, pid, name, cmdline, cpu_percent, memory_mb, connections, status, ppid, parent_name, ts
  FROM (SELECT *, row_number() OVER (PARTITION BY host, snap, pid ORDER BY ts DESC, event_id DESC) AS rn
        FROM proc_rows) WHERE rn = 1)"""

SCORES = """
scores_raw AS (
  SELECT event_id AS id, ts, host, round(least(1.0, value / 150.0), 4) AS score,
    ['brute_force', 'port_scan', 'ssh_failure', 'process_spike', 'unknown'][k % 5 + 1] AS anomaly_type,
    ip AS source_ip, k
  FROM base)"""

REQUESTS = """
requests AS (
  SELECT event_id AS request_id, ts,
    ['block_ip', 'kill_process', 'alert_only', 'unblock_ip', 'Reboot', 'resize', 'block_ip', 'block_ip'][k % 8 + 1] AS action,
    CASE WHEN k % 8 = 1 AND k % 3 = 0 THEN CAST(user_id AS VARCHAR)
         WHEN k % 8 = 1 AND k % 3 = 1 THEN 'SSHD'
         WHEN k % 8 = 1 THEN 'worker'
         WHEN k % 16 = 6 THEN '' ELSE ip END AS target,
    CASE WHEN k % 4 = 3 THEN 'manual' ELSE 'policy' END AS triggered_by,
    'alert_' || CAST(event_id AS VARCHAR) AS alert_id,
    CASE WHEN k % 4 = 3 THEN CAST((k % 3 + 1) * 30 AS BIGINT) END AS duration_minutes
  FROM base)"""

ATTEMPTS = """
attempts AS (
  SELECT CAST(event_id // 5 AS BIGINT) AS delivery_id, CAST(event_id % 5 + 1 AS INTEGER) AS attempt,
    ['slack', 'discord', 'siem', 'mail'][CAST(event_id // 5 AS BIGINT) % 4 + 1] AS webhook_name,
    CASE WHEN k % 4 = 0 THEN 200 WHEN k % 4 = 3 THEN NULL ELSE 500 + k % 4 END AS http_status,
    CASE WHEN k % 4 = 3 THEN 'timeout' END AS error, ts
  FROM base)"""

ENVELOPE = """
envelope AS (
  SELECT event_id AS id, ts, CASE WHEN k % 17 = 0 THEN '{bad' ELSE props END AS data FROM base)"""

HEARTBEATS = """
heartbeats AS (
  SELECT CASE event_type WHEN 'click' THEN 'collectors' WHEN 'view' THEN 'ml'
              WHEN 'purchase' THEN 'policy_engine' WHEN 'signup' THEN 'action_engine'
              WHEN 'error' THEN 'webhook_service' END AS service, ts FROM base)"""

_ORDER = [("base", BASE), ("raw_logs", RAW_LOGS), ("classified", CLASSIFIED), ("logs", LOGS),
          ("connections", CONNECTIONS), ("processes", PROCESSES), ("scores_raw", SCORES),
          ("requests", REQUESTS), ("attempts", ATTEMPTS), ("envelope", ENVELOPE),
          ("heartbeats", HEARTBEATS)]
_DEPS = {"raw_logs": ["base"], "classified": ["raw_logs"], "logs": ["classified"],
         "connections": ["base"], "processes": ["base"], "scores_raw": ["base"],
         "requests": ["base"], "attempts": ["base"], "envelope": ["base"], "heartbeats": ["base"]}


def with_views(*names: str, extra: str = "", recursive: bool = False) -> str:
    """``WITH`` clause holding the named views (and their dependencies)."""
    need: set[str] = set()

    def add(n):
        if n in need:
            return
        need.add(n)
        for d in _DEPS.get(n, []):
            add(d)
    for n in names:
        add(n)
    parts = [sql.strip() for n, sql in _ORDER if n in need]
    if extra.strip():
        parts.append(extra.strip())
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"
