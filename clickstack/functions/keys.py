"""Identity and naming columns: row hash, property keys, task ids (H1-H7)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The search-type names used by the bulk export (upper case) and the API.
SEARCH_TYPE_NAMES = {
    "WEB": "web",
    "IMAGE": "image",
    "VIDEO": "video",
    "NEWS": "news",
    "DISCOVER": "discover",
    "GOOGLE_NEWS": "googleNews",
}

IDENTITY = ["property", "data_date", "search_type", "aggregation", "query", "page", "country",
            "device", "search_appearance", "is_anonymized"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bool_text(c) -> Column:
    """'true' / 'false' like String(bool); null stays null."""
    c = _c(c)
    return F.when(c, F.lit("true")).when(~c, F.lit("false"))


def row_hash(prefix: str = "") -> Column:
    """H1: sha256 hex of the identity tuple joined by '|'; null text becomes ''."""
    p = lambda n: F.col(prefix + n)
    parts = [
        p("property"),
        F.date_format(p("data_date"), "yyyy-MM-dd"),
        p("search_type"),
        p("aggregation"),
        F.coalesce(p("query"), F.lit("")),
        F.coalesce(p("page"), F.lit("")),
        F.coalesce(p("country"), F.lit("")),
        F.coalesce(p("device"), F.lit("")),
        F.coalesce(p("search_appearance"), F.lit("")),
        bool_text(p("is_anonymized")),
    ]
    return F.sha2(F.concat_ws("|", *parts), 256)


def row_hash_native(site_url, data_date, search_type, aggregation: str, query, page, country,
                    device, anonymized) -> Column:
    """H2: the same tuple built in the export adapter. A null flag is skipped by concat_ws,
    so the tuple gets one element shorter (kept on purpose)."""
    parts = [
        _c(site_url),
        F.date_format(_c(data_date), "yyyy-MM-dd"),
        norm_search_type(search_type),
        F.lit(aggregation),
        F.coalesce(_c(query), F.lit("")),
        F.coalesce(_c(page), F.lit("")) if page is not None else F.lit(""),
        F.coalesce(_c(country), F.lit("")),
        F.coalesce(_c(device), F.lit("")),
        F.lit(""),
        bool_text(anonymized),
    ]
    return F.sha2(F.concat_ws("|", *parts), 256)


def property_key(url) -> Column:
    """H3: lower-case, scheme or 'sc-domain:' stripped, non-alphanumeric runs to '_', trimmed,
    prefixed by kind, cut at 1024 characters."""
    u = _c(url)
    is_domain = u.startswith("sc-domain:")
    raw = F.when(is_domain, F.substring(u, 11, 1 << 20)).otherwise(
        F.regexp_replace(u, r"(?i)^https?://", ""))
    body = F.regexp_replace(F.regexp_replace(F.lower(raw), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    prefix = F.when(is_domain, F.lit("domain")).otherwise(F.lit("urlp"))
    return F.substring(F.concat(prefix, F.lit("_"), body), 1, 1024)


def property_key_disambiguated(url) -> Column:
    """H4: base key + '_' + first 8 hex of sha256(url)."""
    u = _c(url)
    return F.substring(F.concat(property_key(u), F.lit("_"), F.substring(F.sha2(u, 256), 1, 8)), 1, 1024)


def property_type(url) -> Column:
    """H5: 'sc-domain:' → domain, else url_prefix."""
    return F.when(_c(url).startswith("sc-domain:"), F.lit("domain")).otherwise(F.lit("url_prefix"))


def norm_search_type(st) -> Column:
    """H6: export search type → API name; anything else lower-cased."""
    u = F.upper(_c(st))
    expr = None
    for k, v in SEARCH_TYPE_NAMES.items():
        expr = F.when(u == k, F.lit(v)) if expr is None else expr.when(u == k, F.lit(v))
    return expr.otherwise(F.lower(_c(st)))


def task_id(property_id, search_type, aggregation, data_date) -> Column:
    """H7: property__type__aggregation__yyyymmdd."""
    return F.concat_ws("__", _c(property_id), _c(search_type), _c(aggregation),
                       F.date_format(_c(data_date), "yyyyMMdd"))
