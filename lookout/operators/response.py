"""Response decisions.

Validation is column expressions (the protected lists are a handful of
literals); the pid lookup is an equi-join against the newest process
snapshot per (host, pid); the rate limit and the block state are greedy
folds per target (``folds``), hashed by target so attackers spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.ip import in_ipv4_ranges, in_ipv6_ranges, ipv4_to_long, ipv6_hex, is_ipv4, once
from .folds import block_state, epoch_micros, rate_limit

MICROS = 1_000_000


def action_requests(alerts: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """One request per alert whose action is not alert_only, with the policy and
    its severity; manual ones, with their reason and duration, union in."""
    auto = alerts.filter(F.col("action") != "alert_only").select(
        F.col("alert_id").alias("request_id"), "ts", "action",
        F.coalesce(F.col("source_ip"), F.lit("")).alias("target"),
        F.lit("policy").alias("triggered_by"), "alert_id", "policy_name", "severity",
        F.lit(None).cast("string").alias("reason"), F.lit(None).cast("long").alias("duration_minutes"))
    if manual is None:
        return auto
    return auto.unionByName(manual.select(*[c for c in auto.columns if c in manual.columns]), allowMissingColumns=True)


def ip_protected(target: Column, config_ips=S.CONFIG_PROTECTED_IPS) -> Column:
    """R2: in a protected range or equal to a configured IP, in any spelling;
    unparsable -> protected."""
    single = [f"{ip}/128" if ":" in ip else f"{ip}/32" for ip in config_ips]
    networks = (*S.PROTECTED_IP_RANGES, *single)
    return F.when(is_ipv4(target), once(ipv4_to_long(target), lambda four: in_ipv4_ranges(four, networks))) \
        .otherwise(once(ipv6_hex(target), lambda six: six.isNull() | in_ipv6_ranges(six, networks)))


def _forbidden(action: Column) -> Column:
    return F.lower(action).isin(*S.FORBIDDEN_ACTIONS)


def _protected_process(name: Column) -> Column:
    return F.coalesce(F.lower(name).isin(*S.PROTECTED_PROCESSES), F.lit(False))


def validate(df: DataFrame, action: str = "action", target: str = "target",
             protected: Column | None = None) -> DataFrame:
    """(allowed, reason). ``protected``: R2 of the targets, where it is known."""
    a, t = F.col(action), F.coalesce(F.col(target), F.lit(""))
    protected = ip_protected(t) if protected is None else protected
    reason = (
        F.when(_forbidden(a), F.format_string("Action '%s' is permanently forbidden", a))
        .when((a == "block_ip") & protected,
              F.format_string("IP %s is protected and cannot be blocked", t))
        .when((a == "kill_process") & _protected_process(t),
              F.format_string("Process '%s' is protected and cannot be killed", t))
    )
    return df.withColumn("allowed", reason.isNull()) \
        .withColumn("reason", F.coalesce(reason, F.lit("Action allowed")))


def rate_limited(requests: DataFrame, budget: int = S.ACTIONS_PER_MINUTE,
                 window: int = S.RATE_WINDOW_SECONDS, tie: str = "request_id") -> DataFrame:
    """Adds ``rate_ok``: fewer than ``budget`` allowed requests of the target in (t - w, t]."""
    d = requests.withColumn("__t", epoch_micros(F.col("ts")))
    ok = rate_limit(d.select("target", "__t", tie), ["target"], "__t", tie, budget,
                    window * MICROS)
    return d.join(ok.select("target", tie, F.col("allowed").alias("rate_ok")), ["target", tie]) \
        .drop("__t")


def dispositions(requests: DataFrame, processes: DataFrame | None = None, enabled: bool = True,
                 default_minutes: int = S.DEFAULT_BLOCK_MINUTES, tie: str = "request_id",
                 as_of: str | None = None) -> DataFrame:
    """R5 + R3 + R6 + R10: status and message for each request.

    ``processes`` is the newest process snapshot ``(pid, name)`` used to
    resolve kill targets."""
    if not enabled:
        return requests.withColumn("status", F.lit("disabled")).withColumn(
            "message", F.lit("Actions are disabled in configuration"))
    a, t = F.col("action"), F.coalesce(F.col("target"), F.lit(""))
    protected = F.col("__protected")
    d = rate_limited(requests, tie=tie).withColumn("__protected", (a == "block_ip") & ip_protected(t))
    d = validate(d, protected=protected)
    pid = F.trim(t).try_cast("long")
    d = d.withColumn("__pid", F.when(a == "kill_process", pid))
    if processes is not None:
        # Only kill requests carry a pid. The rows with none are dealt by their tie, so
        # that they do not all hash into one partition, and what makes them runs once.
        names = processes.select(F.col("pid").cast("long").alias("__pid"), F.col("name").alias("__pname")) \
            .filter("__pid IS NOT NULL").dropDuplicates(["__pid"])
        names = names.select(F.lit(False).alias("__none"), F.col("__pid").alias("__key"), "__pname")
        d = d.withColumn("__none", F.col("__pid").isNull()) \
            .withColumn("__key", F.coalesce("__pid", F.xxhash64(tie))) \
            .join(names, ["__none", "__key"], "left").drop("__none", "__key")
    else:
        d = d.withColumn("__pname", F.lit(None).cast("string"))
    dur = F.coalesce(F.col("duration_minutes"), F.lit(default_minutes))
    d = d.withColumn("__t", epoch_micros(F.col("ts"))).withColumn(
        "__until", F.col("__t") + dur * 60 * MICROS).checkpoint(eager=True)
    # block state over the requests that reach dispatch
    reach = F.col("rate_ok") & F.col("allowed")
    bs_in = d.filter(reach & (((a == "block_ip") & ~protected) | (a == "unblock_ip")))
    # exact reset gap: no block outlives the longest requested duration
    longest = bs_in.agg(F.max(F.col("__until") - F.col("__t"))).first()[0] or 1
    bs = block_state(bs_in.select("target", "__t", tie, "action", "__until"), ["target"], "__t",
                     tie, "action", "__until", max_duration=int(longest))
    d = d.join(bs.select("target", tie, "outcome", "blocked_until"), ["target", tie], "left")
    pname = F.coalesce(F.col("__pname"), F.lit("unknown"))
    status = (
        F.when(~F.col("rate_ok"), "rate_limited")
        .when(~F.col("allowed"), "rejected")
        .when((a == "block_ip") & protected, "rejected")
        .when(a == "block_ip", F.col("outcome"))
        .when(a == "unblock_ip", F.lit("unblocked"))
        .when((a == "kill_process") & F.col("__pid").isNull(), "failed")
        .when((a == "kill_process") & _protected_process(pname), "rejected")
        .when((a == "kill_process") & (F.col("__pid") <= 1), "rejected")
        .when((a == "kill_process") & F.col("__pname").isNull(), "not_found")
        .when(a == "kill_process", "terminated")
        .when(a == "alert_only", "alert_only")
        .otherwise("unknown_action")
    )
    message = (
        F.when(~F.col("rate_ok"), F.format_string("Rate limit exceeded for %s (%d/min)", t,
                                                  F.lit(S.ACTIONS_PER_MINUTE)))
        .when(~F.col("allowed"), F.col("reason"))
        .when((a == "block_ip") & protected,
              F.format_string("IP %s is protected (whitelist)", t))
        .when((a == "block_ip") & (F.col("outcome") == "already_blocked"),
              F.format_string("IP %s is already blocked", t))
        .when(a == "block_ip", F.format_string("Blocked IP %s", t))
        .when(a == "unblock_ip", F.format_string("Unblocked IP %s", t))
        .when((a == "kill_process") & F.col("__pid").isNull(), F.format_string("Invalid PID: %s", t))
        .when((a == "kill_process") & _protected_process(pname),
              F.format_string("Process '%s' (PID %d) is protected", pname, F.col("__pid")))
        .when((a == "kill_process") & (F.col("__pid") <= 1),
              F.format_string("PID %d is protected (init/systemd)", F.col("__pid")))
        .when((a == "kill_process") & F.col("__pname").isNull(),
              F.format_string("Process %d not found", F.col("__pid")))
        .when(a == "kill_process", F.format_string("Process %d (%s) terminated", F.col("__pid"),
                                                   pname))
        .when(a == "alert_only", F.lit("Alert logged, no action taken"))
        .otherwise(F.format_string("Unknown action: %s", a))
    )
    return d.withColumn("status", status).withColumn("message", message) \
        .withColumn("block_minutes", F.when(F.col("status") == "blocked", dur)) \
        .drop("__pid", "__pname", "__t", "__until", "__protected", "outcome")


def action_records(disp: DataFrame, tie: str = "request_id") -> DataFrame:
    """R7."""
    return disp.select(
        F.concat(F.lit("act_"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"),
                 F.lit("_"), F.col(tie).cast("string")).alias("action_id"),
        "action", "target", "triggered_by", "alert_id", "status", "message",
        (F.col("action") == "block_ip").alias("reversible"), "ts", "block_minutes")


def schedule_reversals(actions: DataFrame) -> DataFrame:
    """Blocked actions get ``reversal_at = ts + duration``; invalid requests dropped."""
    ok = (F.col("status") == "blocked") & (F.coalesce(F.col("action_id"), F.lit("")) != "") \
        & (F.coalesce(F.col("target"), F.lit("")) != "") & (F.col("action") == "block_ip") \
        & (F.col("block_minutes") > 0)
    return actions.filter(ok).select(
        "action_id", "target", F.col("block_minutes").alias("duration_minutes"), "ts",
        (F.col("ts") + F.make_dt_interval(mins=F.col("block_minutes").cast("int"))).alias("reversal_at"))


def due_reversals(reversals: DataFrame, as_of: str) -> DataFrame:
    """At ``as_of``: due ones become unblock_ip requests, the rest stay pending."""
    now = F.lit(as_of).cast("timestamp_ntz")
    r = reversals.filter(F.coalesce(F.col("target"), F.lit("")) != "")
    due = r.reversal_at <= now
    remaining = F.unix_seconds(F.col("reversal_at").cast("timestamp")) - \
        F.unix_seconds(now.cast("timestamp"))
    return r.select("action_id", "target", "reversal_at",
                    F.when(due, "unblock_ip").otherwise("pending").alias("state"),
                    F.when(~due, remaining).alias("remaining_seconds"))


def blocked_at(disp: DataFrame, as_of: str) -> DataFrame:
    """R10 result: targets blocked at ``as_of`` (last block state before it)."""
    now = F.lit(as_of).cast("timestamp_ntz")
    d = disp.filter((F.col("ts") <= now) & F.col("action").isin("block_ip", "unblock_ip")
                    & F.col("status").isin("blocked", "already_blocked", "unblocked"))
    last = d.groupBy("target").agg(F.max_by(F.struct("status", "blocked_until", "action"),
                                            F.struct("ts", "request_id")).alias("l"))
    until = F.col("l.blocked_until")
    return last.filter((F.col("l.action") == "block_ip") & (until > F.unix_micros(
        now.cast("timestamp")))).select(
        "target", F.timestamp_micros(until).cast("timestamp_ntz").alias("blocked_until"))
