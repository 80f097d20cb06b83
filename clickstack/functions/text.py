"""Text helpers for grouping and naming (H23-H26), all built-in Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Common English and generic web words never used as topic head terms.
STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "for", "of", "to", "in", "on", "at", "by", "with", "from",
    "is", "are", "was", "were", "be", "been", "as", "it", "its", "this", "that", "these", "those",
    "i", "you", "my", "your", "we", "our", "do", "does", "did", "can", "how", "what", "when", "where",
    "why", "which", "who", "near", "me", "vs", "best", "top", "new", "get", "buy", "cheap", "free",
]

# Fixed value: the rule pattern that matches a site root.
HOMEPAGE_PATTERN = "^https?://[^/]+/?$"

_URL = r"(?i)^https?://[^/]+(/.*)?$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def url_path(page) -> Column:
    """Path of a page URL (host-agnostic): '/' for a bare host; a path without a leading slash
    gets one."""
    p = _c(page)
    from_url = F.regexp_extract(p, _URL, 1)
    return (F.when(p.rlike(_URL), F.when(from_url == "", F.lit("/")).otherwise(from_url))
            .when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)))


def first_segment(page) -> Column:
    """First non-empty path segment, '' for the site root."""
    return F.regexp_extract(url_path(page), r"^/*([^/]*)", 1)


def tokenize(query, brand_terms: Sequence[str] = ()) -> Column:
    """Lower-case [a-z0-9]+ runs of length ≥ 3 that are not stopwords, brand terms or
    all digits (duplicates kept)."""
    brand = sorted({t.lower().strip() for t in brand_terms if t and t.strip()})
    toks = F.regexp_extract_all(F.lower(_c(query)), F.lit("[a-z0-9]+"), 0)
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    excluded = F.array(*[F.lit(w) for w in brand]) if brand else F.array().cast("array<string>")
    return F.filter(toks, lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t)
                    & ~F.array_contains(excluded, t) & ~t.rlike(r"^\d+$"))


def client_name(url) -> Column:
    """H25: 'sc-domain:', the scheme, trailing slashes and a leading 'www.' removed, in that order."""
    u = F.regexp_replace(_c(url), r"^sc-domain:", "")
    u = F.regexp_replace(u, r"^https?://", "")
    u = F.regexp_replace(u, r"/+$", "")
    return F.regexp_replace(u, r"^www\.", "")


def title_case(s) -> Column:
    """H26: '-'/'_' runs become spaces, words capitalised (rest of each word unchanged)."""
    words = F.filter(F.split(F.regexp_replace(_c(s), "[-_]+", " "), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " ")
