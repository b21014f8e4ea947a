"""Read queries: paging, top-k, summaries, feeds (Q1-Q18).

Paging is keyset paging (filter on the cursor, order, limit), planned as
TakeOrderedAndProject after the filters have been pushed to the scan. Per
group tails use the two-phase top-k of ``functions.ordered``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.ordered import ordered_parts, prefix_sums, top_k_per_group
from .folds import epoch_micros, period_starts


def _page(df: DataFrame, order_cols: str | tuple[str, ...], after, limit: int, lo: int, hi: int) -> DataFrame:
    """The next rows in descending order of ``order_cols`` (together unique),
    after the row with the values ``after``."""
    limit = max(lo, min(hi, int(limit)))
    cols = (order_cols,) if isinstance(order_cols, str) else tuple(order_cols)
    if after is not None:
        values = after if isinstance(after, tuple) else (after,)
        later, same = F.lit(False), F.lit(True)
        for c, v in zip(cols, values):
            v = F.lit(v).cast(df.schema[c].dataType)
            later, same = later | (same & (F.col(c) < v)), same & (F.col(c) == v)
        df = df.filter(F.col(cols[0]) <= F.lit(values[0]).cast(df.schema[cols[0]].dataType)).filter(later)
    return df.orderBy(*[F.col(c).desc() for c in cols]).limit(limit)


def query_logs(logs: DataFrame, level: str | None = None, source: str | None = None,
               after=None, limit: int = 100) -> DataFrame:
    """Q1: newest first; level equality, source substring, exclusive id cursor."""
    d = logs
    if level:
        d = d.filter(F.col("level") == level)
    if source:
        d = d.filter(F.col("source").contains(source))
    d = d.select("id", "ts", "source", "level", "message",
                 F.when(F.col("type") != "unknown", F.col("type")).alias("parsed_type"),
                 F.when(F.col("type") != "unknown", F.col("user")).alias("parsed_user"),
                 F.when(F.col("type") != "unknown", F.col("source_ip")).alias("parsed_source_ip"))
    return _page(d, "id", after, limit, 1, 1000)


def next_cursor(page: DataFrame, limit: int, id_col: str | tuple[str, ...] = "id"):
    """Cursor of the last row of a full page, else None (a bounded page, so
    collecting is fine)."""
    cols = (id_col,) if isinstance(id_col, str) else id_col
    rows = page.select(*cols).collect()
    if len(rows) < limit:
        return None
    return tuple(rows[-1]) if len(cols) > 1 else rows[-1][0]


def all_pages(rows: DataFrame, limit: int, cursor: tuple[str, ...]) -> DataFrame:
    """Every row with the ``page`` (from 0) that walking all cursors, newest first,
    would find it on, and ``next_cursor``, which that page gives (JSON; null if
    the page isn't full).

    One pass: rows are range-sorted by the cursor and numbered by running counts
    over the partitions; no page is fetched by itself."""
    parts = ordered_parts(rows.withColumn("__all", F.lit(0)), ["__all"], list(cursor))
    total = parts.agg(F.count(F.lit(1)).alias("__total")).withColumn("__all", F.lit(0))
    paged = prefix_sums(parts, ["__all"], list(cursor), {"__upto": F.lit(1).cast("long")}).join(F.broadcast(total), "__all").withColumn(
        "page", F.floor((F.col("__total") - F.col("__upto")) / limit))
    in_page = Window.partitionBy("page")
    last = F.when(F.count(F.lit(1)).over(in_page) == limit, F.to_json(F.min(F.struct(*cursor)).over(in_page)))
    return paged.withColumn("next_cursor", last).select(*rows.columns, "page", "next_cursor")


ALERT_CURSOR = ("score_id", "alert_id")
ACTION_CURSOR = ("ts", "action_id")


def query_alerts(alerts: DataFrame, severity: str | None = None, since=None, after=None,
                 limit: int = 50, order_col: str | tuple[str, ...] = ALERT_CURSOR) -> DataFrame:
    """Q2: filters first, then the page; ``total`` is the all-time alert count
    (one aggregate row, joined on a constant key). A score may raise several
    alerts, so the cursor is (score_id, alert_id)."""
    d = alerts
    if severity:
        d = d.filter(F.col("severity") == severity)
    if since is not None:
        d = d.filter(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    page = _page(d, order_col, after, limit, 1, 500)
    total = alerts.agg(F.count(F.lit(1)).alias("total")).withColumn("__one", F.lit(1))
    return page.withColumn("__one", F.lit(1)).join(F.broadcast(total), "__one").drop("__one")


def query_actions(actions: DataFrame, triggered_by: str | None = None, action_id: str | None = None,
                  since=None, after=None, limit: int = 50,
                  order_col: str | tuple[str, ...] = ACTION_CURSOR) -> DataFrame:
    """Q3; several actions may share a time, so the cursor is (ts, action_id)."""
    d = actions
    if triggered_by:
        d = d.filter(F.col("triggered_by") == triggered_by)
    if action_id:
        d = d.filter(F.col("action_id") == action_id)
    if since is not None:
        d = d.filter(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    return _page(d, order_col, after, limit, 1, 500)


def query_scores(scores: DataFrame, after=None, limit: int = 50, order_col: str = "id") -> DataFrame:
    """Q4."""
    return _page(scores, order_col, after, limit, 1, 500)


def log_sources(logs: DataFrame, newest: int = 2000) -> DataFrame:
    """Q5: distinct non-empty sources among the newest ``newest`` entries, sorted."""
    recent = logs.orderBy(F.col("id").desc()).limit(newest)
    return recent.filter(F.coalesce(F.col("source"), F.lit("")) != "") \
        .select("source").distinct().orderBy("source")


def top_processes(procs: DataFrame, sort_by: str = "cpu_percent", limit: int = 50,
                  flagged_only: bool = False) -> DataFrame:
    """Q6: optional flagged-only filter, sort desc, limit; ``total`` is the count before the limit."""
    d = procs.filter("risk_flag") if flagged_only else procs
    total = d.agg(F.count(F.lit(1)).alias("total")).withColumn("__one", F.lit(1))
    top = d.orderBy(F.col(sort_by).desc(), F.col("host"), F.col("snap"), F.col("pid")).limit(limit)
    # ``total`` is one aggregate row: a broadcast equi-join on a constant key
    return top.withColumn("__one", F.lit(1)).join(F.broadcast(total), "__one").drop("__one")


def port_summary(conns: DataFrame) -> DataFrame:
    """Q7: LISTEN/ESTABLISHED only; per (host, snapshot, local port)."""
    d = conns.filter(F.col("state").isin("LISTEN", "ESTABLISHED"))
    ip = F.when(~F.col("remote_ip").isin("0.0.0.0", "00000000"), F.col("remote_ip"))
    hints = F.create_map(*[x for p, h in S.PORT_HINTS.items() for x in (F.lit(p), F.lit(h))])
    g = d.groupBy("host", "snap", "local_port").agg(
        F.count(F.lit(1)).alias("connections"), F.count_distinct(ip).alias("unique_ips"))
    risk = F.col("unique_ips") > S.PORT_ELEVATED_IPS
    return g.select("host", "snap", F.col("local_port").alias("port"), "connections", "unique_ips",
                    F.when(risk, "elevated").otherwise("normal").alias("state"),
                    risk.alias("risk_flag"),
                    F.coalesce(hints[F.col("local_port")], F.lit("")).alias("service_hint"))


def recent_alerts(alerts: DataFrame, n: int = 100) -> DataFrame:
    """Q8: newest ``n`` alerts (id breaks ties)."""
    return alerts.orderBy(F.col("ts").desc(), F.col("alert_id").desc()).limit(n)


def action_lifecycle(actions: DataFrame, reversals: DataFrame, as_of: str, n: int = 100) -> DataFrame:
    """Q9: newest ``n`` actions with their reversal columns; ``reversed`` if the
    reversal was due by ``as_of``."""
    r = reversals.select("action_id", "reversal_at")
    due = F.coalesce(F.col("reversal_at") <= F.lit(as_of).cast("timestamp_ntz"), F.lit(False))
    a = actions.join(r, "action_id", "left").withColumn("reversed", due)
    return a.orderBy(F.col("ts").desc(), F.col("action_id").desc()).limit(n)


def filter_alerts(alerts: DataFrame, severity: str | None = None, last_seconds: int | None = None,
                  text: str | None = None, as_of: str | None = None) -> DataFrame:
    """Q10."""
    d = alerts
    if severity:
        d = d.filter(F.col("severity") == severity)
    if last_seconds is not None and as_of is not None:
        d = d.filter(F.col("ts") >= F.lit(as_of).cast("timestamp_ntz")
                     - F.make_dt_interval(secs=F.lit(int(last_seconds))))
    if text:
        hay = F.lower(F.concat_ws(" ", "anomaly_type", "message", "source_ip", "policy_name"))
        d = d.filter(hay.contains(text.lower()))
    return d


def alert_severity_buckets(alerts: DataFrame) -> DataFrame:
    """Q11."""
    s = F.col("severity")
    return alerts.agg(
        F.count_if(s == "critical").alias("critical"),
        F.count_if(s.isin("high", "warning")).alias("high"),
        F.count_if(~s.isin("critical", "high", "warning") | s.isNull()).alias("medium"),
        F.count(F.lit(1)).alias("total"),
    ).withColumn("badge", F.col("critical") + F.col("high"))


def live_feed(parts: dict[str, DataFrame], topics=None) -> DataFrame:
    """Q12: union of (type, id, ts, data JSON) projections, filtered by topic."""
    out = None
    for name, df in parts.items():
        if topics is not None and name not in topics:
            continue
        cols = [c for c in df.columns if c not in ("id",)]
        p = df.select(F.lit(name).alias("type"), F.col("id").cast("string").alias("id"), "ts",
                      F.to_json(F.struct(*cols)).alias("data"))
        out = p if out is None else out.unionByName(p)
    return out


def replay(scores: DataFrame, alerts: DataFrame, logs: DataFrame, n_alerts: int = 10,
           n_logs: int = 20) -> DataFrame:
    """Q13: latest score + last alerts + last logs, oldest first."""
    s = scores.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(1) \
        .select(F.lit("score").alias("type"), F.col("id").cast("string").alias("id"), "ts")
    a = alerts.orderBy(F.col("ts").desc(), F.col("alert_id").desc()).limit(n_alerts) \
        .select(F.lit("alert").alias("type"), F.col("alert_id").alias("id"), "ts")
    lg = logs.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(n_logs) \
        .select(F.lit("log").alias("type"), F.col("id").cast("string").alias("id"), "ts")
    return s.unionByName(a).unionByName(lg).orderBy("ts", "type", "id")


def anomaly_notifications(scores: DataFrame, threshold: float = 0.6, interval_seconds: int = 30,
                          keys=("host",), tie: str = "id") -> DataFrame:
    """Q14: scores above ``threshold``, at most one per ``interval`` per key (greedy)."""
    keys = list(keys)
    a = scores.filter(F.col("score") > threshold).withColumn("__t", epoch_micros(F.col("ts")))
    p = period_starts(a, keys, "__t", tie, interval_seconds * 1_000_000).filter("opens")
    return a.join(p.select(*keys, tie), keys + [tie], "left_semi").drop("__t")


def series_tail(df: DataFrame, keys, n: int = 60, ts: str = "ts", tie: str = "id") -> DataFrame:
    """Q15: the last ``n`` points per key."""
    bucket = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / 86400)
    return top_k_per_group(df, keys, [F.col(ts).desc(), F.col(tie).desc()], n, bucket)


def event_rate(df: DataFrame, ts: str = "ts", seconds: int = 1) -> DataFrame:
    """Q16: messages per interval."""
    g = df.groupBy(F.window(ts, f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("second"),
                    F.round(F.col("n") / F.lit(seconds)).cast("long").alias("rate"))


def service_liveness(heartbeats: DataFrame, as_of: str, ttls: dict[str, int] = S.SERVICE_TTLS) -> DataFrame:
    """Q17: a service is active when its newest heartbeat is younger than its TTL."""
    spark = heartbeats.sparkSession
    exp = spark.createDataFrame(list(ttls.items()), "service string, ttl_seconds int")
    last = heartbeats.groupBy("service").agg(F.max("ts").alias("last_seen"))
    now = F.lit(as_of).cast("timestamp_ntz")
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last_seen").cast("timestamp"))
    # the expected-service list is configuration-sized: it is the broadcast side
    j = last.join(F.broadcast(exp), "service", "right")
    return j.select("service", "ttl_seconds", "last_seen",
                    F.coalesce(age < F.col("ttl_seconds"), F.lit(False)).alias("active"))


def liveness_overview(liveness: DataFrame) -> DataFrame:
    """Q17: services up, of how many, and the overall status."""
    return liveness.agg(F.count_if("active").alias("services_up"),
                        F.count(F.lit(1)).alias("services_total")) \
        .withColumn("status", F.when(F.col("services_up") == F.col("services_total"), "healthy")
                    .otherwise("degraded"))


def metric_bands(df: DataFrame, keys=("host", "ts")) -> DataFrame:
    """One row per (keys, metric) with a success / warning / danger band
    (strictly above the thresholds); risk score is danger above 0.7, and the
    risk level is danger for critical or high."""
    keys = list(keys)
    rows = []
    for metric, col in (("cpu", "cpu_percent"), ("memory", "memory_percent"),
                        ("disk", "disk_percent"), ("load1", "load_1m")):
        warn, danger = S.METRIC_BANDS[metric]
        v = F.col(col).cast("double")
        band = F.when(v > danger, "danger").when(v > warn, "warning").otherwise("success")
        rows.append(F.struct(F.lit(col).alias("metric"), v.alias("value"), band.alias("status")))
    risk = F.coalesce(F.col("risk_score").cast("double"), F.lit(0.0))
    rows.append(F.struct(F.lit("risk_score").alias("metric"), risk.alias("value"),
                         F.when(risk > S.RISK_BAND_DANGER, "danger").otherwise("success").alias("status")))
    lvl = F.coalesce(F.col("risk_level"), F.lit("normal"))
    rows.append(F.struct(F.lit("risk_level").alias("metric"), F.lit(None).cast("double").alias("value"),
                         F.when(lvl.isin("critical", "high"), "danger").otherwise("success").alias("status")))
    return df.select(*keys, F.explode(F.array(*rows)).alias("m")).select(*keys, "m.*")
