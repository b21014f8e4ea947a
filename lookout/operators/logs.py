"""Log line parsing (P1-P4) and text filters.

All of it is column expressions: the parse is one narrow projection that
stays inside whole-stage codegen, no Python.
"""

from __future__ import annotations

import re

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S


def _nz(c: Column) -> Column:
    return F.when(c == "", F.lit(None)).otherwise(c)


def log_type(line: Column, source: Column) -> Column:
    """First matching rule wins; access.log lines are typed by status."""
    status = F.regexp_extract(line, S.ACCESS_STATUS_RE, 1)
    is_access = (source == S.ACCESS_LOG_NAME) & line.rlike(S.DOTTED_QUAD_RE)
    lower = F.lower(line)
    keyword = None
    for kw in S.ERROR_KEYWORDS:
        keyword = lower.contains(kw) if keyword is None else (keyword | lower.contains(kw))
    status_i = F.when(status != "", status.cast("int"))
    return (
        F.when(line.rlike(S.SSH_FAILURE_RE), "ssh_failure")
        .when(line.rlike(S.SSH_SUCCESS_RE), "ssh_success")
        .when(line.rlike(S.SUDO_RE), "sudo_attempt")
        .when(line.rlike(S.SERVICE_RESTART_RE), "service_restart")
        .when(line.rlike(S.PAM_RE), F.when(
            F.regexp_extract(line, S.PAM_RE, 1).contains("failure"), "auth_failure"
        ).otherwise("pam_session"))
        .when(line.rlike(S.KERNEL_OOM_RE), "oom_kill")
        .when(is_access, F.when(status_i >= 500, "http_5xx").when(status_i >= 400, "http_4xx")
              .when(status_i.isNotNull(), "http_request").otherwise("unknown"))
        .when(keyword, "error_keyword")
        .otherwise("unknown")
    )


def log_level(type_col: Column) -> Column:
    """P2."""
    return (
        F.when(type_col.isin("ssh_failure", "auth_failure", "http_4xx", "error_keyword"), "warning")
        .when(type_col == "http_5xx", "error")
        .when(type_col == "oom_kill", "critical")
        .otherwise("info")
    )


def log_user(line: Column, type_col: Column) -> Column:
    """User of ssh and sudo lines."""
    return (
        F.when(type_col == "ssh_failure", F.regexp_extract(line, S.SSH_FAILURE_RE, 1))
        .when(type_col == "ssh_success", F.regexp_extract(line, S.SSH_SUCCESS_RE, 1))
        .when(type_col == "sudo_attempt", F.regexp_extract(line, S.SUDO_RE, 1))
    )


def log_source_ip(line: Column, source: Column, type_col: Column) -> Column:
    """Source ip of ssh lines; first dotted quad of access-log lines."""
    is_access = (source == S.ACCESS_LOG_NAME) & line.rlike(S.DOTTED_QUAD_RE)
    return (
        F.when(type_col == "ssh_failure", F.regexp_extract(line, S.SSH_FAILURE_RE, 2))
        .when(type_col == "ssh_success", F.regexp_extract(line, S.SSH_SUCCESS_RE, 2))
        .when(type_col.isin("sudo_attempt", "service_restart", "auth_failure", "pam_session",
                            "oom_kill"), F.lit(None))
        .when(is_access, F.regexp_extract(line, S.DOTTED_QUAD_RE, 1))
    )


def classify_logs(raw: DataFrame, line: str = "line", source: str = "source") -> DataFrame:
    """P1-P4 over raw lines: adds message, type, level, user, source_ip.

    ``source`` is reduced to its basename first, as log files are named by it.
    """
    src = F.regexp_extract(F.col(source), r"([^/]*)$", 1)
    d = raw.withColumn(source, src).withColumn("message", F.trim(F.col(line))) \
        .filter(F.length("message") > 0)
    typ = log_type(F.col("message"), F.col(source))
    d = d.withColumn("type", typ)
    return d.withColumn("level", log_level(F.col("type"))) \
        .withColumn("user", _nz(log_user(F.col("message"), F.col("type")))) \
        .withColumn("source_ip", _nz(log_source_ip(F.col("message"), F.col(source), F.col("type"))))


def parse_access_status(line: Column) -> Column:
    """P4 helper: HTTP status of an access-log line, NULL when absent."""
    s = F.regexp_extract(line, S.ACCESS_STATUS_RE, 1)
    return F.when(s != "", s.cast("int"))


# P11 -------------------------------------------------------------------------

URL_PASSWORD_RE = r"(://[^:/@]*:)[^@]*@"


def mask_url_secrets(c: Column) -> Column:
    """``scheme://user:PASS@host`` -> ``scheme://user:*****@host``."""
    return F.regexp_replace(c, URL_PASSWORD_RE, "$1*****@")


# P14 -------------------------------------------------------------------------

def log_search(df: DataFrame, query: str, col: str = "message") -> DataFrame:
    """``/re/flags`` is a regex (flag i by default), anything else a
    case-insensitive substring; an invalid regex is looked for as it is written."""
    parts = re.fullmatch(r"/(.+)/([gimsuy]*)", query, re.DOTALL)
    if parts:
        pattern, flags = parts[1], parts[2] or "i"
        inline = "".join(f for f in "ims" if f in flags)
        if inline:
            pattern = f"(?{inline}){pattern}"
        try:  # the engine that will run the pattern decides whether it is one
            df.sparkSession._jvm.java.util.regex.Pattern.compile(pattern)
            return df.filter(F.col(col).rlike(pattern))
        except IllegalArgumentException:
            pass
    return df.filter(F.lower(F.col(col)).contains(query.lower()))
