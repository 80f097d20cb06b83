"""Status and classification columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Message patterns of retryable API failures and of dead tokens.
RETRYABLE_MESSAGE = r"(?i)quotaExceeded|rateLimitExceeded|userRateLimitExceeded|backendError|try again"
RETRYABLE_REASON = r"(?i)quota|rateLimit|backendError|internalError"
REVOKED_MESSAGE = r"(?i)invalid_grant|token has been expired or revoked|revoked|account.*deleted"
TASK_MAX_ATTEMPTS = 8
PROBE_LOOKBACK_DAYS = 14
# Dimensions each search type supports.
TYPE_DIMENSIONS = {
    "web": ["query", "page", "country", "device"],
    "image": ["query", "page", "country", "device"],
    "video": ["query", "page", "country", "device"],
    "news": ["query", "page", "country", "device"],
    "discover": ["page", "country"],
    "googleNews": ["page", "country"],
}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def valid_combo(search_type, aggregation) -> Column:
    """Discover / googleNews have no byProperty (hence no totals)."""
    st, ag = _c(search_type), _c(aggregation)
    no_bp = st.isin("discover", "googleNews")
    return ~(no_bp & ag.isin("byProperty", "totals"))


def dims_for(aggregation, search_type) -> Column:
    """Requested dimensions: the aggregation's wanted list ∩ what the type supports;
    totals none; null for an invalid combination."""
    ag, st = _c(aggregation), _c(search_type)
    wanted = F.when(ag == "byPage", F.array(*[F.lit(x) for x in ["query", "page", "country", "device"]])) \
        .otherwise(F.array(*[F.lit(x) for x in ["query", "country", "device"]]))
    supported = F.lit(None).cast("array<string>")
    for t, dims in TYPE_DIMENSIONS.items():
        supported = F.when(st == t, F.array(*[F.lit(d) for d in dims])).otherwise(supported)
    kept = F.filter(wanted, lambda d: F.array_contains(supported, d))
    return (F.when(ag == "totals", F.array().cast("array<string>"))
            .when(~valid_combo(st, ag), F.lit(None).cast("array<string>"))
            .otherwise(kept))


def day_final(data_date, first_incomplete_date, today=None) -> Column:
    """Final when there is no boundary or the day precedes it. With ``today`` given, a day
    older than the probe look-back is final without a boundary (it is never probed)."""
    d, fi = _c(data_date), _c(first_incomplete_date)
    final = fi.isNull() | (d < fi)
    if today is not None:
        recent = d >= F.date_sub(_c(today), PROBE_LOOKBACK_DAYS)
        final = ~recent | final
    return final


def collect_status(is_final, row_count) -> Column:
    """rows>0 → with_data (final) / fresh; no rows → no_data (final) / fresh."""
    f, n = _c(is_final), _c(row_count)
    return (F.when(~f, F.lit("collected_fresh"))
            .when(F.coalesce(n, F.lit(0)) > 0, F.lit("collected_with_data"))
            .otherwise(F.lit("collected_no_data")))


def retryable_error(message, status_code=None, reason=None) -> Column:
    """429 / 5xx, a retryable reason, or a retryable message."""
    msg = F.coalesce(_c(message), F.lit(""))
    out = msg.rlike(RETRYABLE_MESSAGE)
    if status_code is not None:
        s = _c(status_code)
        out = out | (s == 429) | s.between(500, 599)
    if reason is not None:
        out = out | F.coalesce(_c(reason), F.lit("")).rlike(RETRYABLE_REASON)
    return out


def token_error_class(message) -> Column:
    """Revoked when the message says so, else broken."""
    return F.when(F.coalesce(_c(message), F.lit("")).rlike(REVOKED_MESSAGE), F.lit("revoked")).otherwise(F.lit("broken"))


def dead_letter(message, attempt) -> Column:
    """Terminal 'error' when not retryable or the attempt reached the limit, else 'queued'."""
    last = ~retryable_error(message) | (_c(attempt) >= TASK_MAX_ATTEMPTS)
    return F.when(last, F.lit("error")).otherwise(F.lit("queued"))


def pct_delta(cur, prev, metric: str = "clicks") -> Column:
    """Label of the change chip: null without values; prev 0 → 'new' (clicks and
    impressions with cur > 0) else null; |pct| < 0.05 → 'flat'; else 'up'/'down' with position
    inverted into 'good'/'bad' by the caller via ``pct_value``."""
    c, p = _c(cur), _c(prev)
    pct = (c - p) / F.abs(p) * 100
    new_ok = metric in ("clicks", "impressions")
    return (F.when(c.isNull() | p.isNull(), F.lit(None).cast("string"))
            .when(p == 0, F.when((c > 0) & F.lit(new_ok), F.lit("new")).otherwise(F.lit(None).cast("string")))
            .when(F.abs(pct) < 0.05, F.lit("flat"))
            .when(pct > 0, F.lit("good" if metric != "position" else "bad"))
            .otherwise(F.lit("bad" if metric != "position" else "good")))


def pct_value(cur, prev) -> Column:
    """H21 numeric part: (cur − prev) / |prev| × 100, null when prev is 0 or missing."""
    c, p = _c(cur), _c(prev)
    return F.when(p.isNull() | (p == 0) | c.isNull(), F.lit(None).cast("double")).otherwise((c - p) / F.abs(p) * 100)
