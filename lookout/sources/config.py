"""Rules and webhook configuration.

Configuration files are small by nature (tens of entries); they are read on
the driver and turned into tiny DataFrames that are always broadcast.
"""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .. import schemas as S


def _load_file(path: str) -> dict:
    with open(path, encoding="utf-8") as fh:
        text = fh.read()
    try:
        import yaml  # optional
        return yaml.safe_load(text) or {}
    except ImportError:
        return json.loads(text or "{}")


def normalize_rule(raw: dict[str, Any]) -> dict[str, Any]:
    """Per-field defaults of a policy rule; raises on a malformed entry."""
    if not isinstance(raw, dict):
        raise ValueError("rule must be a mapping")
    cond = raw.get("conditions", {}) or {}
    if not isinstance(cond, dict):
        raise ValueError("conditions must be a mapping")
    at = cond.get("anomaly_type")
    return {
        "name": str(raw.get("name", "unnamed")),
        "enabled": bool(raw.get("enabled", True)),
        "score_above": float(cond.get("score_above", 0.0)),
        "anomaly_type": None if at in (None, "") else str(at),
        "repeated_within_seconds": int(cond.get("repeated_within_seconds", 0)),
        "min_occurrences": int(cond.get("min_occurrences", 1)),
        "action": str(raw.get("action", "alert_only")),
        "severity": str(raw.get("severity", "medium")),
        "notify": bool(raw.get("notify", False)),
    }


def load_rules(path: str | None = None, rules: list[dict] | None = None) -> list[dict]:
    """Rules from a YAML/JSON file or a list; bad entries are skipped; a
    missing file gives the two fall-back rules."""
    if rules is None:
        if path is None or not os.path.exists(path):
            rules = list(S.DEFAULT_RULES)
        else:
            rules = (_load_file(path) or {}).get("policies", []) or []
    out = []
    for r in rules:
        try:
            out.append(normalize_rule(r))
        except (ValueError, TypeError):
            continue
    return out


def active_rules(rules: list[dict]) -> list[dict]:
    return [r for r in rules if r["enabled"]]


def rules_frame(spark: SparkSession, rules: list[dict]) -> DataFrame:
    rows = [tuple(r[f.name] for f in S.RULE.fields) for r in rules]
    return spark.createDataFrame(rows, S.RULE)


class RuleSource:
    """Re-read the rules file when it changes (used inside ``foreachBatch``)."""

    def __init__(self, path: str | None):
        self.path, self._mtime, self._rules = path, None, None

    def current(self) -> list[dict]:
        mtime = os.path.getmtime(self.path) if self.path and os.path.exists(self.path) else -1
        if self._rules is None or mtime != self._mtime:
            self._rules, self._mtime = load_rules(self.path), mtime
        return self._rules


def normalize_webhook(raw: dict[str, Any]) -> dict[str, Any]:
    return {
        "name": str(raw.get("name", "unnamed")),
        "url": str(raw.get("url", "")),
        "events": [str(e) for e in (raw.get("events") or [])],
        "enabled": bool(raw.get("enabled", False)),
        "sign_payloads": bool(raw.get("sign_payloads", False)),
        "headers": {str(k): str(v) for k, v in (raw.get("headers") or {}).items()},
    }


def load_webhooks(path: str | None = None, hooks: list[dict] | None = None) -> tuple[list[dict], str]:
    """(webhooks, secret); enabled defaults to false."""
    secret = ""
    if hooks is None:
        data = _load_file(path) if path and os.path.exists(path) else {}
        hooks = data.get("webhooks", []) or []
        secret = str(data.get("webhook_secret", "") or "")
    return [normalize_webhook(h) for h in hooks if isinstance(h, dict)], secret


def webhooks_frame(spark: SparkSession, hooks: list[dict]) -> DataFrame:
    rows = [tuple(h[f.name] for f in S.WEBHOOK.fields) for h in hooks]
    return spark.createDataFrame(rows, S.WEBHOOK)
