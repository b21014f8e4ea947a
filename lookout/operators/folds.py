"""Greedy folds: rows whose outcome depends on earlier *outcomes*.

Cooldown (E5), one-per-interval notifications (Q14), the fixed 24 h
anomaly period (M12), the per-target rate limit (R5) and the block state
(R10) cannot be written as window functions.

They run as the exact three-pass bucketed folds of ``functions.periods``,
``functions.rates`` and ``functions.blocks``: buckets of a key are folded in
parallel for every possible entry, a scan over the small per-bucket summaries
fixes each bucket's true entry, and the buckets are folded again in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import block_state as _parallel_blocks
from ..functions.periods import period_starts as _parallel_periods
from ..functions.rates import rate_limit as _parallel_rates


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def period_starts(df: DataFrame, keys: list[str], t: str, tie: str, period: int,
                  levels: tuple[int, ...] = (64, 64)) -> DataFrame:
    """Greedy periods per key: a row opens a period when ``t >= start + period``
    (the first row opens the first). Returns ``(keys, tie, period_start, opens)``.

    ``t`` is a long (e.g. epoch micros), ``period`` in the same unit. Runs on the
    tree of buckets of ``functions.periods`` (``levels``: periods per bucket,
    buckets per group, ...), so even a key with continuous traffic is spread
    over tasks."""
    return _parallel_periods(df, list(keys), t, tie, int(period), levels)


def rate_limit(df: DataFrame, keys: list[str], t: str, tie: str, budget: int, window: int) -> DataFrame:
    """Allow a row when fewer than ``budget`` *allowed* rows of its key lie in
    ``(t - window, t]``; refused rows do not count. Returns ``(keys, tie, allowed)``.

    Runs as the three-pass bucketed fold of ``functions.rates``, so a key that is
    never idle is spread over tasks too."""
    return _parallel_rates(df, list(keys), t, tie, int(budget), int(window))


def block_state(df: DataFrame, keys: list[str], t: str, tie: str, action: str,
                until: str, max_duration: int, bucket: Column | None = None) -> DataFrame:
    """Per target in time order, ``block`` while blocked -> already_blocked,
    else blocked until ``until``; ``unblock`` ends a block (``unblocked``) or is a
    no-op (``not_blocked``). Returns ``(keys, tie, outcome, blocked_until)``.

    Runs as the three-pass bucketed fold of ``functions.blocks`` (buckets of
    64 x ``max_duration``), so a target with continuous requests is spread
    over tasks as well (``bucket`` is accepted for signature compatibility)."""
    return _parallel_blocks(df, list(keys), t, tie, action, until, int(max_duration))
