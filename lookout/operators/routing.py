"""Alert routing and webhook deliveries.

Alerts x enabled webhooks is a broadcast nested-loop join against the
(small, configuration-sized) webhook table. HMAC signing has no built-in,
so it is an Arrow-batched pandas UDF; everything else is column work.
"""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.ip import host_ipv4_to_long, in_ipv4_ranges, in_ipv6_ranges, ipv6_hex, once


def event_type(severity: Column, score: Column, action: Column) -> Column:
    """W1."""
    return (F.when((severity == "critical") | (score >= 0.9), "critical_alert")
            .when(action != "alert_only", "action_taken")
            .when(score >= 0.8, "attack_detected")
            .otherwise("anomaly_detected"))


def notify_filter(alerts: DataFrame, col: str = "notify") -> DataFrame:
    """Drop alerts whose notify flag reads false / 0 / no (any case); missing -> notify."""
    v = F.lower(F.coalesce(F.col(col).cast("string"), F.lit("true")))
    return alerts.filter(~v.isin("false", "0", "no"))


def route_alerts(alerts: DataFrame, webhooks: DataFrame) -> DataFrame:
    """(alert, webhook) pairs for enabled webhooks subscribed to the event type
    (an empty subscription list takes every type)."""
    a = notify_filter(alerts).withColumn(
        "event_type", event_type(F.col("severity"), F.col("score"), F.col("action")))
    w = webhooks.filter("enabled").select(
        F.col("name").alias("webhook_name"), F.col("url").alias("webhook_url"),
        F.col("events").alias("webhook_events"), "sign_payloads")
    cond = F.array_contains(F.col("webhook_events"), F.col("event_type")) | (
        F.size(F.col("webhook_events")) <= 0)
    return a.join(F.broadcast(w), cond, "inner")


def _color(severity: Column) -> Column:
    m = F.create_map(*[x for k, v in S.SEVERITY_COLORS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[severity], F.lit(S.DEFAULT_COLOR))


def _emoji(severity: Column) -> Column:
    m = F.create_map(*[x for k, v in S.SEVERITY_EMOJI.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[severity], F.lit(S.DEFAULT_EMOJI))


def alert_payload(routed: DataFrame, host_name: str = "", brand: str = "Lookout") -> DataFrame:
    """The JSON body (flat fields, a text line and an embeds array)."""
    sev = F.coalesce(F.col("severity"), F.lit("medium"))
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    score2 = F.format_string("%.2f", F.round(score, 2))
    host = F.lit(host_name)
    text = F.concat(
        _emoji(sev), F.lit(" *["), F.upper(sev), F.lit(f"]* {brand} Alert on "),
        F.lit(host_name or "server"), F.lit("\nScore: "), score2, F.lit(" | Policy: "),
        F.coalesce(F.col("policy_name"), F.lit("N/A")), F.lit("\n"),
        F.coalesce(F.col("message"), F.lit("")))
    fields = F.array(
        F.struct(F.lit("Severity").alias("name"), F.upper(sev).alias("value"), F.lit(True).alias("inline")),
        F.struct(F.lit("Score").alias("name"), score2.alias("value"), F.lit(True).alias("inline")),
        F.struct(F.lit("Policy").alias("name"), F.coalesce(F.col("policy_name"), F.lit("N/A")).alias("value"),
                 F.lit(True).alias("inline")),
        F.struct(F.lit("Host").alias("name"), F.lit(host_name or "N/A").alias("value"),
                 F.lit(True).alias("inline")),
    )
    embed = F.struct(
        F.concat(_emoji(sev), F.lit(f" {brand} Alert")).alias("title"),
        F.coalesce(F.col("message"), F.lit("Security alert triggered")).alias("description"),
        _color(sev).alias("color"), fields.alias("fields"),
        F.col("ts").cast("string").alias("timestamp"))
    body = F.struct(
        F.col("event_type"), F.col("alert_id"), F.col("ts").cast("string").alias("timestamp"),
        sev.alias("severity"), score.alias("score"), F.col("risk_level"), F.col("policy_name"),
        F.col("anomaly_type"), F.col("source_ip"), F.col("action"), F.col("message"),
        host.alias("host"), text.alias("text"), F.array(embed).alias("embeds"))
    return routed.withColumn("payload", F.to_json(body))


def _hmac_hex(secret: str):
    key = secret.encode("utf-8")

    @F.pandas_udf(T.StringType())
    def sign(body: pd.Series) -> pd.Series:
        if not key:
            return pd.Series([""] * len(body), index=body.index)
        return body.map(lambda b: None if b is None else
                        "sha256=" + hmac.new(key, b.encode("utf-8"), hashlib.sha256).hexdigest())
    return sign


def sign_payloads(df: DataFrame, secret: str, body: str = "payload", out: str = "signature") -> DataFrame:
    """``sha256=<hex HMAC-SHA256(secret, body)>``; an empty secret gives ''."""
    return df.withColumn(out, _hmac_hex(secret)(F.col(body)))


def verify_signatures(df: DataFrame, secret: str, body: str = "payload", sig: str = "signature",
                      out: str = "valid") -> DataFrame:
    """Recompute and compare; no secret -> false."""
    if not secret:
        return df.withColumn(out, F.lit(False))
    return df.withColumn(out, _hmac_hex(secret)(F.col(body)) == F.col(sig))


def delivery_outcomes(attempts: DataFrame, urls: DataFrame | None = None,
                      max_attempts: int = S.MAX_DELIVERY_ATTEMPTS) -> DataFrame:
    """Per delivery, the first 2xx attempt (delivered) or the last error (failed).
    With ``urls`` (webhook_name, url; configuration-sized), a delivery to a webhook
    without a URL is an ``error`` with 0 attempts: nothing is sent.

    A grouped partial aggregate (min / max_by / count), so a busy webhook
    combines map-side. A ``payload`` column, one per delivery, is kept."""
    a = attempts.filter(F.col("attempt") <= max_attempts)
    ok = (F.col("http_status") >= 200) & (F.col("http_status") < 300)
    err = F.when(F.col("http_status").isNotNull(), F.format_string("HTTP %d", F.col("http_status"))) \
        .otherwise(F.coalesce(F.col("error"), F.lit("Request timed out")))
    kept = [F.max("payload").alias("payload")] if "payload" in a.columns else []
    g = a.groupBy("delivery_id", "webhook_name").agg(
        F.min(F.when(ok, F.col("attempt"))).alias("first_ok"),
        F.max("attempt").alias("last_attempt"),
        F.max_by(err, F.col("attempt")).alias("last_error"),
        F.max("ts").alias("ts"), *kept)
    d = g.select(
        "delivery_id", "webhook_name",
        F.when(F.col("first_ok").isNotNull(), "delivered").otherwise("failed").alias("status"),
        F.coalesce(F.col("first_ok"), F.col("last_attempt")).cast("int").alias("attempts"),
        F.when(F.col("first_ok").isNull(), F.col("last_error")).alias("last_error"), "ts",
        *(["payload"] if kept else []))
    if urls is None:
        return d
    d = d.join(F.broadcast(urls.select("webhook_name", "url")), "webhook_name", "left")
    none = F.coalesce(F.trim(F.col("url")), F.lit("")) == ""
    return d.withColumns({"status": F.when(none, "error").otherwise(F.col("status")),
                          "attempts": F.when(none, 0).otherwise(F.col("attempts")),
                          "last_error": F.when(none, "No URL configured").otherwise(F.col("last_error"))})


def undeliverable(routed: DataFrame) -> DataFrame:
    """W7, the no-URL case: a routed webhook without a URL is an ``error`` with
    0 attempts (nothing is sent)."""
    bad = F.coalesce(F.trim(F.col("webhook_url")), F.lit("")) == ""
    return routed.filter(bad).select(
        "alert_id", "webhook_name", F.lit("error").alias("status"),
        F.lit(0).alias("attempts"), F.lit("No URL configured").alias("last_error"))


def delivery_dead_letters(outcomes: DataFrame, keep: int = S.DEAD_LETTER_KEEP,
                          page: int = S.DEAD_LETTER_PAGE) -> DataFrame:
    """Failed deliveries, newest first: the first ``page`` of the newest ``keep``,
    as entries (webhook, url, payload, error, attempts, time of failure)."""
    failed = outcomes.filter(F.col("status") == "failed")
    newest = failed.orderBy(F.col("ts").desc(), F.col("delivery_id").desc()).limit(keep)
    first = newest.orderBy(F.col("ts").desc(), F.col("delivery_id").desc()).limit(page)
    return first.select("delivery_id", "webhook_name", "url", "payload", F.col("last_error").alias("error"), "attempts",
                        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("failed_at"))


def delivery_stats(outcomes: DataFrame) -> DataFrame:
    """Count per webhook and status."""
    return outcomes.groupBy("webhook_name", "status").agg(F.count(F.lit(1)).alias("n"))


URL_SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.-]*)://"
URL_HOST_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?(\[[^\]]*\]|[^:/?#]*)"


def webhook_url_check(df: DataFrame, url: str = "url") -> DataFrame:
    """Scheme http/https, a host, and a literal-IP host, in any spelling that
    resolvers take, outside the blocked networks (host names are not resolved here)."""
    u = F.col(url)
    scheme = F.lower(F.regexp_extract(u, URL_SCHEME_RE, 1))
    host = F.lower(F.regexp_replace(F.regexp_extract(u, URL_HOST_RE, 1), r"^\[|\]$", ""))

    def blocked(h):
        return once(host_ipv4_to_long(h), lambda four: F.when(
            four.isNotNull(), in_ipv4_ranges(four, S.BLOCKED_WEBHOOK_NETWORKS))
            .otherwise(in_ipv6_ranges(ipv6_hex(h), S.BLOCKED_WEBHOOK_NETWORKS)))

    def reason(scheme, host):
        return (F.when(~scheme.isin("http", "https"), F.lit("invalid_scheme"))
                .when(host == "", F.lit("no_hostname"))
                .when(blocked(host), F.lit("blocked_address")))
    # each is a column before it is used, so that its expression is evaluated once
    return df.withColumns({"scheme": scheme, "host": host}) \
        .withColumn("reason", reason(F.col("scheme"), F.col("host"))) \
        .withColumn("valid", F.col("reason").isNull()) \
        .select(*[c for c in df.columns if c not in ("scheme", "host", "valid", "reason")],
                "scheme", "host", "valid", "reason")
