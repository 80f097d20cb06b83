"""Report filters compiled to one Spark Column.

``to_column`` AND-s every clause, so Catalyst pushes the date range into partition pruning and the
rest into the Parquet scan.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from clickstack.functions import dates

# Question words of the "people also ask" preset.
PAA_PATTERN = r"^(who|what|when|where|why|how|is|are|can|could|does|do|did|will|would|should|which)\b"


@dataclasses.dataclass(frozen=True)
class Filters:
    start: dt.date | str
    end: dt.date | str
    search_type: str = "web"
    final_only: bool = False
    device: tuple[str, ...] = ()
    country: tuple[str, ...] = ()
    query: str | None = None
    page: str | None = None
    position_min: float | None = None
    position_max: float | None = None
    brand_exclude: tuple[str, ...] = ()
    brand_terms: tuple[str, ...] = ()
    segment: str | None = None
    compare_mode: str | None = None
    compare_start: str | None = None
    compare_end: str | None = None
    match_weekdays: bool = False
    presets: tuple[str, ...] = ()

    def replace(self, **kw) -> Filters:
        return dataclasses.replace(self, **kw)

    def compare(self):
        """H8 window for this filter set, or None."""
        return dates.compare_window(self.start, self.end, self.compare_mode, self.compare_start,
                                    self.compare_end, self.match_weekdays)

    def movers(self):
        """H9 window (always present)."""
        return dates.movers_window(self.start, self.end, self.compare_mode, self.compare_start,
                                   self.compare_end, self.match_weekdays)

    def shifted(self, window) -> Filters:
        return self.replace(start=window[0], end=window[1])


def without_segment(f: Filters) -> Filters:
    """Page reports drop the brand segment."""
    return f.replace(segment=None)


def without_position(f: Filters) -> Filters:
    return f.replace(position_min=None, position_max=None)


def split_terms(s: str | None) -> list[str]:
    return [t.strip() for t in (s or "").split(",") if t.strip()]


def _any(cols: Sequence[Column]) -> Column:
    return functools.reduce(operator.or_, cols)


def _contains_any(col: str, terms: Sequence[str]) -> Column:
    return _any([F.lower(F.col(col)).like(f"%{t.lower()}%") for t in terms])


def brand_match(terms: Sequence[str]) -> Column | None:
    """Query contains any brand term (case-insensitive); None without terms."""
    t = [s.strip() for s in terms if s and s.strip()]
    return _contains_any("query", t) if t else None


def _date(x):
    return x if isinstance(x, dt.date) else dt.date.fromisoformat(str(x))


def date_range(start, end, prune_months: bool = True) -> Column:
    """B2: inclusive day range, plus the same range on the ``data_month`` partition column so the
    scan prunes whole partitions."""
    s, e = _date(start), _date(end)
    c = F.col("data_date").between(F.lit(s), F.lit(e))
    if prune_months:
        c = c & F.col("data_month").between(F.lit(s.replace(day=1)), F.lit(e.replace(day=1)))
    return c


def to_column(f: Filters, require_query: bool = False, require_page: bool = False,
              with_dates: bool = True) -> Column:
    """AND of all clauses of ``f``."""
    c = [F.col("search_type") == F.lit(f.search_type or "web")]
    if with_dates:
        c.append(date_range(f.start, f.end))
    if f.final_only:
        c.append(F.col("data_state") == "final")
    if f.device:
        c.append(F.col("device").isin(list(f.device)))
    if f.country:
        c.append(F.col("country").isin(list(f.country)))
    if f.position_min is not None:
        c.append(F.col("position") >= F.lit(float(f.position_min)))
    if f.position_max is not None:
        c.append(F.col("position") <= F.lit(float(f.position_max)))
    q_terms = split_terms(f.query)
    if q_terms:
        c.append(_contains_any("query", q_terms))
    p_terms = split_terms(f.page)
    if p_terms:
        c.append(_contains_any("page", p_terms))
    for t in f.brand_exclude:
        c.append(~F.lower(F.col("query")).like(f"%{t.lower()}%"))
    bm = brand_match(f.brand_terms)
    if f.segment and bm is not None:
        c.append(bm if f.segment == "brand" else (F.col("query").isNotNull() & ~bm))
    for p in f.presets:
        if p == "paa":
            c.append(F.lower(F.col("query")).rlike(PAA_PATTERN))
        elif p == "longtail":
            c.append(F.size(F.split(F.trim(F.col("query")), " ")) >= 4)
    if require_query:
        c.append(F.col("query").isNotNull())
    if require_page:
        c.append(F.col("page").isNotNull())
    return functools.reduce(operator.and_, c)


def rule_match(rules: Sequence[dict]) -> Column | None:
    """OR of match rules on page/query; blank values ignored. regex is a partial match on the
    lower-cased column (the pattern is not lower-cased); other ops compare lower-cased text."""
    parts = []
    for r in rules:
        v = (r.get("value") or "").strip()
        if not v:
            continue
        col = F.lower(F.col("page" if r.get("dimension") == "page" else "query"))
        op = r.get("op")
        if op == "regex":
            parts.append(col.rlike(v))
        elif op == "equals":
            parts.append(col == F.lit(v.lower()))
        elif op == "starts_with":
            parts.append(col.like(f"{v.lower()}%"))
        else:
            parts.append(col.like(f"%{v.lower()}%"))
    return _any(parts) if parts else None


def rule_match_column(dimension: Column, op: Column, value: Column, page: Column, query: Column) -> Column:
    """B15 for rules held as data (one rule per row): evaluates against either column."""
    v = F.trim(value)
    target = F.lower(F.when(dimension == "page", page).otherwise(query))
    lv = F.lower(v)
    return (F.length(v) > 0) & (
        F.when(op == "regex", F.regexp_like(target, v))
        .when(op == "equals", target == lv)
        .when(op == "starts_with", F.startswith(target, lv))
        .otherwise(F.contains(target, lv)))
