"""Date rules (H8-H13). Every operator takes an explicit as-of; none reads the clock."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

PT_ZONE = "America/Los_Angeles"
MAX_BACKFILL_MONTHS = 16


def _d(x) -> dt.date:
    if isinstance(x, dt.datetime):
        return x.date()
    if isinstance(x, dt.date):
        return x
    return dt.date.fromisoformat(str(x))


def _shift_months_clamped(d: dt.date, n: int) -> dt.date:
    m0 = d.month - 1 + n
    y, m = d.year + m0 // 12, m0 % 12 + 1
    nxt = dt.date(y + (m // 12), m % 12 + 1, 1)
    last = (nxt - dt.timedelta(days=1)).day
    return dt.date(y, m, min(d.day, last))


def compare_window(start, end, mode: str | None = "previous", compare_start=None, compare_end=None,
                   match_weekdays: bool = False):
    """H8: the comparison window as (start, end) dates, or None.

    previous   → same length immediately before; yoy → 365 (or 364 with match_weekdays) days back;
    prev_month → both ends one calendar month back, clamped to month end; custom → given dates."""
    mode = mode or "previous"
    s, e = _d(start), _d(end)
    if mode == "none":
        return None
    if mode == "custom":
        return (_d(compare_start), _d(compare_end)) if compare_start and compare_end else None
    if mode == "yoy":
        k = 364 if match_weekdays else 365
        return s - dt.timedelta(days=k), e - dt.timedelta(days=k)
    if mode == "prev_month":
        return _shift_months_clamped(s, -1), _shift_months_clamped(e, -1)
    days = (e - s).days
    prev_end = s - dt.timedelta(days=1)
    return prev_end - dt.timedelta(days=days), prev_end


def movers_window(start, end, mode=None, compare_start=None, compare_end=None, match_weekdays=False):
    """H9: like H8 but always has a baseline: none, or an incomplete custom, → previous."""
    m = "previous" if (not mode or mode == "none") else mode
    w = compare_window(start, end, m, compare_start, compare_end, match_weekdays)
    return w or compare_window(start, end, "previous")


def pacific_day(ts) -> Column:
    """Instant → Pacific calendar date."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.to_date(F.from_utc_timestamp(c, PT_ZONE))


def subtract_months_overflow(d, months) -> Column:
    """Month subtraction that overflows into the next month like a JS Date
    (Mar 31 − 1 month = Mar 3)."""
    c = F.col(d) if isinstance(d, str) else d
    n = months if isinstance(months, Column) else F.lit(months)
    return F.date_add(F.add_months(F.trunc(c, "month"), -n), F.dayofmonth(c) - 1)


def collection_window(today, offset_days, backfill_months):
    """(oldest, newest) columns: newest = today − offset; oldest = today − months (overflowing),
    clamped to 16 months back and to newest."""
    t = F.col(today) if isinstance(today, str) else today
    off = offset_days if isinstance(offset_days, Column) else F.lit(offset_days)
    newest = F.date_sub(t, off)
    api_oldest = subtract_months_overflow(t, MAX_BACKFILL_MONTHS)
    oldest = subtract_months_overflow(t, backfill_months)
    oldest = F.when(oldest < api_oldest, api_oldest).otherwise(oldest)
    oldest = F.when(oldest > newest, newest).otherwise(oldest)
    return oldest, newest


def days_in_range(start, end) -> Column:
    """Inclusive array of days; empty when reversed."""
    s = F.col(start) if isinstance(start, str) else start
    e = F.col(end) if isinstance(end, str) else end
    return F.when(s <= e, F.sequence(s, e)).otherwise(F.array().cast("array<date>"))


def valid_iso_date(c) -> Column:
    """Strict YYYY-MM-DD that is a real calendar day."""
    x = F.col(c) if isinstance(c, str) else c
    parsed = F.try_to_date(x, "yyyy-MM-dd")
    return (x.rlike(r"^\d{4}-\d{2}-\d{2}$") & parsed.isNotNull()
            & (F.date_format(parsed, "yyyy-MM-dd") == x))


def compare_window_cols(start, end, mode: str = "previous", match_weekdays: bool = False):
    """H8 over date columns (every row its own window): (compare_start, compare_end)."""
    s = F.col(start) if isinstance(start, str) else start
    e = F.col(end) if isinstance(end, str) else end
    if mode == "none":
        return F.lit(None).cast("date"), F.lit(None).cast("date")
    if mode == "yoy":
        k = 364 if match_weekdays else 365
        return F.date_sub(s, k), F.date_sub(e, k)
    if mode == "prev_month":
        return F.add_months(s, -1), F.add_months(e, -1)
    days = F.datediff(e, s)
    prev_end = F.date_sub(s, 1)
    return F.date_sub(prev_end, days), prev_end


def movers_window_cols(start, end, mode: str | None = None, match_weekdays: bool = False, custom_complete: bool = False):
    """H9 over date columns: like H8, but 'none' (and a custom window without both dates)
    falls back to 'previous'."""
    m = "previous" if (not mode or mode == "none" or (mode == "custom" and not custom_complete)) else mode
    if m == "custom":
        raise ValueError("a complete custom window is given as literal dates, not computed")
    return compare_window_cols(start, end, m, match_weekdays)
