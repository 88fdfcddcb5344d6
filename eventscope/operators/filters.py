"""Filters and predicates.

Relative windows are anchored at ``as_of``: an explicit timestamp (a literal, so the
predicate reaches the Parquet scan as a pushed filter) or, by default, the latest
event time of the frame, planned as an uncorrelated scalar subquery whose max is
combined map-side before a one-row exchange.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventscope.functions.timefn import duration_us, interval_of, ntz_lit


def latest_ts(df: DataFrame, ts: str = "ts") -> Column:
    """Scalar subquery: the latest event time of ``df`` (NULL when none)."""
    return df.select(F.max(ts)).scalar()


def latest_ts_value(df: DataFrame, ts: str = "ts"):
    """The latest event time as a Python value (one single-row aggregate job), or None.

    Use it when the window predicate should reach the scan as a literal.
    """
    return df.select(F.max(ts)).first()[0]


def _anchor(df: DataFrame, as_of, ts: str) -> Column:
    if as_of is None:
        return latest_ts(df, ts)
    if isinstance(as_of, Column):
        return as_of
    return ntz_lit(as_of)


def window_predicate(df: DataFrame, window: str | None, as_of=None, ts: str = "ts") -> Column | None:
    """Predicate of F1, or None when the window does not filter ('All', unknown text)."""
    us = duration_us(window)
    if us is None:
        return None
    if as_of is not None and not isinstance(as_of, Column) and hasattr(as_of, "year"):
        # a known anchor: a plain literal comparison, pushed down to the scan
        if as_of.tzinfo is not None:
            as_of = as_of.astimezone(_dt.timezone.utc).replace(tzinfo=None)
        return F.col(ts) > ntz_lit(as_of - _dt.timedelta(microseconds=us))
    anchor = _anchor(df, as_of, ts)
    # No valid time at all → anchor is NULL → no filter; otherwise NULL ts is dropped.
    return F.coalesce(F.col(ts) > anchor - interval_of(us), anchor.isNull())


def time_window(df: DataFrame, window: str | None, as_of=None, ts: str = "ts") -> DataFrame:
    """keep ``ts > as_of - window`` (strict).

    'All', an unknown suffix, or a frame without valid times leaves the frame as it is.
    """
    p = window_predicate(df, window, as_of, ts)
    return df if p is None else df.where(p)


def event_types(df: DataFrame, selected: list[str] | None) -> DataFrame:
    """keep the selected event types.  ``None`` keeps all; ``[]`` keeps none.

    ``isin`` on a partition column becomes a PartitionFilter (directory pruning).
    """
    if selected is None:
        return df
    if len(selected) == 0:
        return df.where(F.lit(False))
    return df.where(F.col("event_type").isin(list(selected)))


def recent(df: DataFrame, seconds: int = 60, as_of=None, ts: str = "ts") -> DataFrame:
    """the last ``seconds`` before ``as_of`` (strict), same anchoring as F1."""
    return time_window(df, f"{int(seconds)}s", as_of, ts)


def valid_categories(df: DataFrame, col: str = "category") -> DataFrame:
    """drop NULL and empty categories."""
    return df.where(F.col(col).isNotNull() & (F.col(col) != F.lit("")))


def top_k_keys(df: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` most frequent non-NULL keys (count desc, key asc); at most ``k`` rows."""
    return (df.where(F.col(key).isNotNull()).groupBy(key).count()
              .orderBy(F.col("count").desc(), F.col(key).asc()).limit(k).select(key))


def in_top_k(df: DataFrame, key: str, k: int = 5) -> DataFrame:
    """rows whose key is among the top ``k`` keys.

    The top-k frame has at most ``k`` rows, so broadcasting it is safe at any scale;
    the semi join then runs without shuffling ``df``.
    """
    return df.join(F.broadcast(top_k_keys(df, key, k)), key, "left_semi")


def valid_records(df: DataFrame, corrupt_col: str = "_corrupt_record") -> DataFrame:
    """rows that parsed (malformed ones are routed by ``malformed_records``)."""
    if corrupt_col in df.columns:
        return df.where(F.col(corrupt_col).isNull()).drop(corrupt_col)
    return df


def malformed_records(df: DataFrame, corrupt_col: str = "_corrupt_record") -> DataFrame:
    """Rows that did not parse, raw text in ``corrupt_col``.

    All columns are kept: Spark refuses a raw JSON scan that reads only the corrupt
    record column.
    """
    if corrupt_col in df.columns:
        return df.where(F.col(corrupt_col).isNotNull())
    return df.where(F.lit(False))


def with_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """drop rows without an event time (before any series)."""
    return df.where(F.col(ts).isNotNull())


def dashboard_filters(df: DataFrame, window: str | None = "All", selected: list[str] | None = None,
                      recent_only: bool = False, as_of=None) -> DataFrame:
    """The dashboard's filter chain: window → event types → optional last 60 s.

    Both relative filters share one anchor ("now"): ``as_of`` or the latest event
    time of the unfiltered frame.
    """
    anchor = as_of if as_of is not None and not isinstance(as_of, Column) else _anchor(df, as_of, "ts")
    out = event_types(time_window(df, window, anchor), selected)
    return recent(out, 60, anchor) if recent_only else out
