"""Time helpers: duration strings, timestamp coercion (N5/N5b), bucket alignment.

All event times are ``timestamp_ntz`` holding UTC wall-clock time; the session time
zone is pinned to UTC, so casts between ``timestamp`` and ``timestamp_ntz`` are exact.
"""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNITS_US = {"ms": 1_000, "s": 1_000_000, "min": 60_000_000, "h": 3_600_000_000,
             "d": 86_400_000_000}
_DURATION = re.compile(r"^\s*(\d+)\s*(ms|s|min|h|d)\s*$")
# Largest epoch second that still is a valid timestamp (9999-12-31).
_MAX_EPOCH_S = 253_402_300_799.0


def duration_us(text: str | None) -> int | None:
    """``'5s'`` → 5_000_000.  ``'All'``, ``None`` or an unknown suffix → ``None``."""
    if text is None:
        return None
    m = _DURATION.match(str(text))
    if not m:
        return None
    return int(m.group(1)) * _UNITS_US[m.group(2)]


def interval_of(us: int) -> Column:
    """A day-time interval literal of ``us`` microseconds."""
    return F.make_dt_interval(secs=F.lit(us / 1_000_000).cast("decimal(18,6)"))


def epoch_to_ts(seconds: Column, precision: str = "micro") -> Column:
    """Epoch seconds (any numeric) → ``timestamp_ntz``; NaN, ±inf, out of range → NULL.

    ``precision='second'`` truncates to whole seconds (variant N5b).
    """
    x = seconds.cast("double")
    ok = ~F.isnan(x) & (F.abs(x) <= F.lit(_MAX_EPOCH_S))
    if precision == "second":
        t = F.timestamp_seconds(F.floor(x))
    else:
        t = F.timestamp_micros(F.round(x * F.lit(1e6)).cast("long"))
    return F.when(ok, t).cast("timestamp_ntz")


def text_to_ts(text: Column) -> Column:
    """ISO-8601 text (with or without zone, 'T' or blank separator) → ``timestamp_ntz``.

    Text with an offset or ``Z`` is converted to UTC; text without one is read as UTC.
    Unparseable text → NULL (never an error, ANSI mode notwithstanding).
    """
    return F.try_to_timestamp(F.trim(text)).cast("timestamp_ntz")


def coerce_ts(col: Column, dtype: T.DataType, precision: str = "micro") -> Column:
    """Numeric → epoch seconds; text → parsed; timestamps kept; other → NULL."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        t = col.cast("timestamp_ntz")
        return F.date_trunc("second", t).cast("timestamp_ntz") if precision == "second" else t
    if isinstance(dtype, T.NumericType):
        return epoch_to_ts(col, precision)
    if isinstance(dtype, T.StringType):
        t = text_to_ts(col)
        return F.date_trunc("second", t).cast("timestamp_ntz") if precision == "second" else t
    if isinstance(dtype, T.DateType):
        return col.cast("timestamp_ntz")
    return F.lit(None).cast("timestamp_ntz")


def ntz_lit(value) -> Column:
    """A ``timestamp_ntz`` literal holding exactly the wall-clock of ``value``.

    Built from text: ``F.lit(datetime)`` would read a naive datetime in the Python
    process's local zone and shift it whenever that zone is not UTC.
    """
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        value = value.astimezone(_dt.timezone.utc).replace(tzinfo=None)
    text = value.isoformat(sep=" ") if hasattr(value, "isoformat") else str(value)
    return F.lit(text).cast("timestamp_ntz")


def ts_micros(ts: Column) -> Column:
    """``timestamp_ntz`` → epoch microseconds (bigint)."""
    return F.unix_micros(ts.cast("timestamp"))


def micros_to_ts(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def ts_to_epoch(ts: Column) -> Column:
    """``timestamp_ntz`` → epoch seconds as double (the stored form of the ingest)."""
    return ts_micros(ts) / F.lit(1e6)


def bucket_micros(ts: Column, bucket_us: int) -> Column:
    """Start of the epoch-aligned bucket holding ``ts``, as epoch microseconds.

    Exact integer arithmetic (``x - pmod(x, b)``), so it also floors before 1970.
    Buckets that divide a day coincide with midnight-anchored resampling.
    """
    x = ts_micros(ts)
    return x - F.pmod(x, F.lit(bucket_us))


def bucket_start(ts: Column, bucket_us: int) -> Column:
    return micros_to_ts(bucket_micros(ts, bucket_us))
