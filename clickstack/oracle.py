"""DuckDB oracle SQL for every catalog query.

Each statement recomputes its answer from the raw test tables (views ``lineitem``, ``orders``,
``customer``, ``nation``, ``part``, ``events``, ``pages``), independently of the Spark code path:
``BASE`` derives the same fact tables the Spark warehouse stores. Sums are cast to BIGINT so the
types match Spark's ``long``; every SAFE_DIVIDE is ``/ NULLIF(x, 0)``.
"""

from __future__ import annotations

BASE = """
search_raw AS (
 SELECT CAST(l.l_shipdate AS DATE) AS data_date,
  CASE WHEN l.l_suppkey % 8 < 6 THEN concat('https://www.site', CAST(l.l_suppkey % 8 AS VARCHAR), '.example.com/')
       ELSE concat('sc-domain:site', CAST(l.l_suppkey % 8 - 6 AS VARCHAR), '.example.com') END AS property,
  CASE WHEN l.l_linenumber <= 4 THEN 'web' WHEN l.l_linenumber = 5 THEN 'image'
       WHEN l.l_linenumber = 6 THEN 'news' ELSE 'discover' END AS search_type,
  CASE WHEN l.l_linenumber = 7 THEN NULL
       WHEN p.p_partkey % 5 = 0 THEN p.p_name
       WHEN p.p_partkey % 5 = 1 THEN concat('how to fix ', p.p_name)
       WHEN p.p_partkey % 5 = 2 THEN concat('buy ', p.p_name)
       WHEN p.p_partkey % 5 = 3 THEN concat(lower(p.p_brand), ' ', p.p_name)
       ELSE concat('best ', p.p_name, ' for ', lower(p.p_type)) END AS query,
  CASE WHEN p.p_partkey % 25 = 0 THEN concat('https://www.site', CAST(l.l_suppkey % 8 AS VARCHAR), '.example.com/')
       ELSE concat('https://www.site', CAST(l.l_suppkey % 8 AS VARCHAR), '.example.com/', lower(p.p_type), '/',
                   CAST(p.p_partkey % 20 AS VARCHAR)) END AS page,
  lower(n.n_name) AS country,
  CASE WHEN l.l_linenumber = 7 THEN NULL WHEN l.l_returnflag = 'A' THEN 'DESKTOP'
       WHEN l.l_returnflag = 'N' THEN 'MOBILE' ELSE 'TABLET' END AS device,
  CAST(floor(CAST(round(l.l_discount*100) AS BIGINT) * (CAST(l.l_quantity AS BIGINT)-1) / 5) AS BIGINT) AS clicks,
  (CAST(l.l_quantity AS BIGINT)-1)*20 AS impressions,
  1 + CAST((l.l_partkey*7 + l.l_suppkey*3 + l.l_linenumber) % 480 AS DOUBLE)/8 AS position,
  (p.p_partkey % 11 = 0) AS is_anonymized
 FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
 JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN part p ON l.l_partkey = p.p_partkey
),
by_page AS (
 SELECT data_date, property, search_type, query, page, country, device,
  CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions,
  round(8.0 * SUM(position * (impressions + 1)) / SUM(impressions + 1)) / 8 AS position,
  CASE WHEN data_date >= DATE '2001-10-01' THEN 'fresh' ELSE 'final' END AS data_state,
  false AS is_anonymized
 FROM search_raw WHERE NOT is_anonymized
 GROUP BY data_date, property, search_type, query, page, country, device
),
by_property AS (
 SELECT data_date, property, search_type, query, CAST(NULL AS VARCHAR) AS page, country, device,
  CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions,
  round(8.0 * SUM(position * (impressions + 1)) / SUM(impressions + 1)) / 8 AS position,
  CASE WHEN data_date >= DATE '2001-10-01' THEN 'fresh' ELSE 'final' END AS data_state,
  false AS is_anonymized
 FROM search_raw WHERE NOT is_anonymized AND search_type IN ('web', 'image', 'news')
 GROUP BY data_date, property, search_type, query, country, device
),
totals_raw AS (
 SELECT data_date, property, search_type,
  CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions,
  round(8.0 * SUM(position * (impressions + 1)) / SUM(impressions + 1)) / 8 AS position
 FROM search_raw WHERE search_type <> 'discover'
 GROUP BY data_date, property, search_type
),
totals AS (
 SELECT data_date, property, search_type, clicks, impressions, position, false AS is_anonymized,
  CASE WHEN data_date >= DATE '2001-10-01' THEN 'fresh' ELSE 'final' END AS data_state
 FROM totals_raw
 UNION ALL
 SELECT t.data_date, t.property, t.search_type,
  CAST(greatest(0, t.clicks - coalesce(b.c, 0)) AS BIGINT), CAST(greatest(0, t.impressions - coalesce(b.i, 0)) AS BIGINT),
  0.0, true, CASE WHEN t.data_date >= DATE '2001-10-01' THEN 'fresh' ELSE 'final' END
 FROM totals_raw t LEFT JOIN (SELECT data_date, property, search_type, SUM(clicks) AS c, SUM(impressions) AS i
                              FROM by_property GROUP BY data_date, property, search_type) b
   ON t.data_date = b.data_date AND t.property = b.property AND t.search_type = b.search_type
)"""

M4 = """CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions,
 SUM(clicks) / NULLIF(SUM(impressions), 0) AS ctr, SUM(position * impressions) / NULLIF(SUM(impressions), 0) AS position"""

# The default report: all properties, web, 1998, compared with the previous 365 days (1997).
CUR = "data_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'"
PREV = "data_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'"
WEB = "search_type = 'web'"
BRAND = "(lower(query) LIKE '%brand#2%' OR lower(query) LIKE '%brand#17%')"


def with_base(body: str, extra_ctes: str = "") -> str:
    return f"WITH {BASE}{(',' + extra_ctes) if extra_ctes else ''}\n{body}"


def m4(prefix: str = "", cond: str | None = None, zero: bool = False) -> str:
    if cond is None:
        if not prefix:
            return M4
        cond = "TRUE"
    other = "0" if zero else "NULL"
    c = f"CASE WHEN {cond} THEN clicks ELSE {other} END"
    i = f"CASE WHEN {cond} THEN impressions ELSE {other} END"
    p = f"CASE WHEN {cond} THEN position * impressions ELSE {other} END"
    return (f"CAST(SUM({c}) AS BIGINT) AS {prefix}clicks, CAST(SUM({i}) AS BIGINT) AS {prefix}impressions, "
            f"SUM({c}) / NULLIF(SUM({i}), 0) AS {prefix}ctr, SUM({p}) / NULLIF(SUM({i}), 0) AS {prefix}position")


def top_with_prev(table: str, dim: str, limit: int = 200, where: str = WEB) -> str:
    return with_base(f"""
SELECT c.key, c.clicks, c.impressions, c.ctr, c.position,
       p.clicks AS prev_clicks, p.impressions AS prev_impressions, p.ctr AS prev_ctr, p.position AS prev_position
FROM (SELECT {dim} AS key, {M4} FROM {table} WHERE {where} AND {CUR} AND {dim} IS NOT NULL GROUP BY {dim}
      ORDER BY clicks DESC, impressions DESC, key ASC NULLS LAST LIMIT {limit}) c
LEFT JOIN (SELECT {dim} AS key, {M4} FROM {table} WHERE {where} AND {PREV} AND {dim} IS NOT NULL GROUP BY {dim}) p ON c.key = p.key""")


def per_query(where: str) -> str:
    return f"""SELECT query AS key, SUM(position * impressions) / NULLIF(SUM(impressions), 0) AS position,
  SUM(clicks) / NULLIF(SUM(impressions), 0) AS ctr, CAST(SUM(impressions) AS BIGINT) AS impressions,
  CAST(SUM(clicks) AS BIGINT) AS clicks FROM by_property WHERE {where} GROUP BY query"""


def movers(table: str, dim: str) -> str:
    return with_base(f"""
SELECT * FROM (SELECT *, row_number() OVER (ORDER BY delta DESC, key ASC NULLS LAST) AS a,
                         row_number() OVER (ORDER BY delta ASC, key DESC NULLS FIRST) AS b FROM m) WHERE a <= 50 OR b <= 50""",
                     f"""
c AS (SELECT {dim} AS key, {M4} FROM {table} WHERE {WEB} AND {CUR} AND {dim} IS NOT NULL GROUP BY {dim}),
p AS (SELECT {dim} AS key, {M4} FROM {table} WHERE {WEB} AND {PREV} AND {dim} IS NOT NULL GROUP BY {dim}),
m AS (SELECT coalesce(c.key, p.key) AS key, CAST(coalesce(c.clicks, 0) AS BIGINT) AS clicks,
             CAST(coalesce(p.clicks, 0) AS BIGINT) AS prev_clicks,
             CAST(coalesce(c.clicks, 0) - coalesce(p.clicks, 0) AS BIGINT) AS delta,
             (c.key IS NOT NULL AND p.key IS NULL) AS is_new
      FROM c FULL OUTER JOIN p ON c.key = p.key)""").replace("SELECT * FROM (SELECT *,", "SELECT key, clicks, prev_clicks, delta, is_new FROM (SELECT *,")


def ts(rollup: str, where: str, table: str = "by_property") -> str:
    b = {"day": "data_date", "week": "date_trunc('week', data_date)", "month": "date_trunc('month', data_date)"}[rollup]
    return with_base(f"SELECT strftime(CAST({b} AS DATE), '%Y-%m-%d') AS date, {M4} FROM {table} WHERE {where} GROUP BY 1")


REPORTS: dict[str, str] = {
    "report_kpis": with_base(f"""
SELECT * FROM (SELECT {M4} FROM by_property WHERE {WEB} AND {CUR}) c,
 (SELECT CAST(SUM(clicks) AS BIGINT) AS prev_clicks, CAST(SUM(impressions) AS BIGINT) AS prev_impressions,
   SUM(clicks) / NULLIF(SUM(impressions), 0) AS prev_ctr, SUM(position * impressions) / NULLIF(SUM(impressions), 0) AS prev_position
  FROM by_property WHERE {WEB} AND {PREV}) p"""),
    "report_timeseries": ts("day", f"{WEB} AND {CUR}"),
    "report_timeseries_week": ts("week", f"{WEB} AND {CUR}"),
    "report_timeseries_month": ts("month", f"{WEB} AND {CUR}"),
    "report_timeseries_compare": ts("day", f"{WEB} AND {PREV}"),
    "report_top_queries": top_with_prev("by_property", "query"),
    "report_top_pages": top_with_prev("by_page", "page"),
    "top_with_prev_exact": top_with_prev("by_property", "query", 100000000),
    "report_breakdown": with_base(f"SELECT device AS key, {M4} FROM by_property WHERE {WEB} AND {CUR} GROUP BY device"),
    "report_breakdown_country": with_base(f"SELECT country AS key, {M4} FROM by_property WHERE {WEB} AND {CUR} GROUP BY country"),
    "report_position_buckets": with_base(f"""
SELECT strftime(data_date, '%Y-%m-%d') AS date,
 CAST(SUM(CASE WHEN position <= 3 THEN impressions ELSE 0 END) AS BIGINT) AS top3,
 CAST(SUM(CASE WHEN position > 3 AND position <= 10 THEN impressions ELSE 0 END) AS BIGINT) AS p4_10,
 CAST(SUM(CASE WHEN position > 10 AND position <= 20 THEN impressions ELSE 0 END) AS BIGINT) AS p11_20,
 CAST(SUM(CASE WHEN position > 20 AND position <= 50 THEN impressions ELSE 0 END) AS BIGINT) AS p21_50,
 CAST(SUM(CASE WHEN position > 50 THEN impressions ELSE 0 END) AS BIGINT) AS p50plus
FROM by_property WHERE {WEB} AND {CUR} GROUP BY 1"""),
    "report_ctr_scatter": with_base(f"""
SELECT * FROM ({per_query(f"{WEB} AND {CUR} AND query IS NOT NULL")}) WHERE impressions > 0
ORDER BY impressions DESC, key ASC NULLS LAST LIMIT 500"""),
    "report_striking_distance": with_base(f"""
SELECT * FROM ({per_query(f"{WEB} AND {CUR} AND query IS NOT NULL")}) WHERE position >= 11 AND position <= 20
ORDER BY impressions DESC, key ASC NULLS LAST LIMIT 100"""),
    "report_movers": movers("by_property", "query"),
    "report_movers_page": movers("by_page", "page"),
    "report_ctr_benchmark": with_base(f"""
SELECT r.key, r.position, r.ctr, r.impressions, r.clicks, c.benchmark, r.ctr - c.benchmark AS diff
FROM (SELECT * FROM ({per_query(f"{WEB} AND {CUR} AND query IS NOT NULL")}) WHERE position <= 10 AND impressions > 0
      ORDER BY impressions DESC, key ASC NULLS LAST LIMIT 200) r
LEFT JOIN (SELECT pos, coalesce(ctr, 0.0) AS benchmark FROM (
   SELECT CAST(round(position) AS BIGINT) AS pos, SUM(clicks) / NULLIF(SUM(impressions), 0) AS ctr
   FROM by_property WHERE {WEB} AND {CUR} AND query IS NOT NULL GROUP BY 1) WHERE pos BETWEEN 1 AND 10) c
ON CAST(round(r.position) AS BIGINT) = c.pos"""),
    "report_ctr_curve": with_base(f"""
SELECT * FROM (SELECT CAST(round(position) AS BIGINT) AS pos, SUM(clicks) / NULLIF(SUM(impressions), 0) AS ctr,
  CAST(SUM(impressions) AS BIGINT) AS impressions
 FROM by_property WHERE {WEB} AND {CUR} AND query IS NOT NULL GROUP BY 1) WHERE pos BETWEEN 1 AND 10"""),
    "report_cannibalization": with_base("""
SELECT q.key, q.pages, q.clicks, q.impressions, r.rank, r.page, r.page_clicks, r.page_impressions, r.page_position
FROM q JOIN (SELECT q AS key, CAST(row_number() OVER (PARTITION BY q ORDER BY impressions DESC, p ASC) AS INTEGER) AS rank, p AS page,
                    clicks AS page_clicks, impressions AS page_impressions, position AS page_position FROM pairs) r
  ON q.key = r.key WHERE r.rank <= 8""", f"""
pairs AS (SELECT query AS q, page AS p, CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions,
   SUM(position * impressions) / NULLIF(SUM(impressions), 0) AS position
   FROM by_page WHERE {WEB} AND {CUR} AND query IS NOT NULL AND page IS NOT NULL GROUP BY query, page),
q AS (SELECT q AS key, CAST(count(*) AS BIGINT) AS pages, CAST(SUM(clicks) AS BIGINT) AS clicks,
   CAST(SUM(impressions) AS BIGINT) AS impressions FROM pairs GROUP BY q
   HAVING count(*) >= 2 AND SUM(impressions) >= 10 ORDER BY impressions DESC, key ASC LIMIT 200)"""),
    "report_content_decay": with_base("""
SELECT c.key, c.clicks, p.clicks AS prev_clicks, CAST(c.clicks - p.clicks AS BIGINT) AS delta,
       (c.clicks - p.clicks) / p.clicks * 100 AS delta_pct
FROM c JOIN p ON c.key = p.key WHERE p.clicks > 0""", f"""
c AS (SELECT page AS key, {M4} FROM by_page WHERE {WEB} AND {CUR} AND page IS NOT NULL GROUP BY page),
p AS (SELECT page AS key, {M4} FROM by_page WHERE {WEB} AND {PREV} AND page IS NOT NULL GROUP BY page)"""),
    "report_brand_split": with_base(f"""
SELECT CASE WHEN {BRAND} THEN 'brand' ELSE 'nonbrand' END AS segment, {M4}
FROM by_property WHERE {WEB} AND {CUR} AND query IS NOT NULL GROUP BY 1"""),
    "report_brand_timeseries": with_base(f"""
SELECT strftime(data_date, '%Y-%m-%d') AS date,
 CAST(SUM(CASE WHEN {BRAND} THEN clicks ELSE 0 END) AS BIGINT) AS brand,
 CAST(SUM(CASE WHEN NOT {BRAND} THEN clicks ELSE 0 END) AS BIGINT) AS nonbrand,
 CAST(SUM(CASE WHEN {BRAND} THEN impressions ELSE 0 END) AS BIGINT) AS brandImpr,
 CAST(SUM(CASE WHEN NOT {BRAND} THEN impressions ELSE 0 END) AS BIGINT) AS nonbrandImpr
FROM by_property WHERE {WEB} AND {CUR} AND query IS NOT NULL GROUP BY 1"""),
}


# Groups ------------------------------------------------------------------------------------------
URL_RE = "(?i)^https?://[^/]+(/.*)?$"


def path_sql(col: str) -> str:
    return (f"(CASE WHEN regexp_matches({col}, '{URL_RE}') THEN "
            f"CASE WHEN regexp_extract({col}, '{URL_RE}', 1) = '' THEN '/' ELSE regexp_extract({col}, '{URL_RE}', 1) END "
            f"WHEN starts_with({col}, '/') THEN {col} ELSE '/' || {col} END)")


def seg_sql(col: str) -> str:
    return f"regexp_extract({path_sql(col)}, '^/*([^/]*)', 1)"


def title_sql(col: str) -> str:
    return (f"array_to_string(list_transform(list_filter(string_split(regexp_replace({col}, '[-_]+', ' ', 'g'), ' '), "
            f"lambda x: x <> ''), lambda x: upper(x[1]) || x[2:]), ' ')")


def content_groups_sql(seed: str) -> str:
    """R16 over a seed relation (key, impressions)."""
    return f"""SELECT rank, 'auto_' || CAST(rank AS VARCHAR) AS group_id,
  CASE WHEN seg = '' THEN 'Homepage' ELSE {title_sql('seg')} END AS name, false AS priority, 0 AS rule_pos,
  'page' AS dimension, CASE WHEN seg = '' THEN 'regex' ELSE 'contains' END AS op,
  CASE WHEN seg = '' THEN '^https?://[^/]+/?$' ELSE '/' || seg || '/' END AS value
FROM (SELECT seg, value, CAST(row_number() OVER (ORDER BY value DESC, seg ASC) AS INTEGER) AS rank
      FROM (SELECT {seg_sql('key')} AS seg, SUM(greatest(0, coalesce(impressions, 0))) AS value
            FROM ({seed}) WHERE key IS NOT NULL AND key <> '' GROUP BY 1) WHERE value > 0)
WHERE rank <= 12"""


def seed_sql(table: str, dim: str, where: str) -> str:
    return (f"SELECT {dim} AS key, CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions "
            f"FROM {table} WHERE {where} AND {dim} IS NOT NULL GROUP BY {dim}")


def grouped_sql(table: str, groups: list[tuple[str, str]], where_extra: str) -> str:
    """R10 with literal group predicates [(name, sql predicate)]: D13 sums per window, 0 when empty."""
    parts = []
    for name, pred in groups:
        def s(win, c):
            return f"coalesce(SUM(CASE WHEN {win} AND ({pred}) THEN {c} ELSE 0 END), 0)"
        parts.append(f"""SELECT '{name}' AS key,
  CAST({s(CUR, 'clicks')} AS BIGINT) AS clicks, CAST({s(CUR, 'impressions')} AS BIGINT) AS impressions,
  coalesce({s(CUR, 'clicks')} / NULLIF({s(CUR, 'impressions')}, 0), 0.0) AS ctr,
  coalesce({s(CUR, 'position * impressions')} / NULLIF({s(CUR, 'impressions')}, 0), 0.0) AS position, false AS priority,
  CAST({s(PREV, 'clicks')} AS BIGINT) AS prev_clicks, CAST({s(PREV, 'impressions')} AS BIGINT) AS prev_impressions,
  coalesce({s(PREV, 'clicks')} / NULLIF({s(PREV, 'impressions')}, 0), 0.0) AS prev_ctr,
  coalesce({s(PREV, 'position * impressions')} / NULLIF({s(PREV, 'impressions')}, 0), 0.0) AS prev_position
FROM {table} WHERE {WEB} AND ({CUR} OR {PREV}) AND {where_extra}""")
    return with_base("\nUNION ALL\n".join(parts))


SAVED_TOPIC_SQL = [
    ("Widgets", "lower(query) LIKE '%widget%'"),
    ("How-to", "regexp_matches(lower(query), '^how to') OR lower(query) LIKE 'how %'"),
    ("Gears", "lower(query) = 'hot gear' OR lower(query) LIKE '%gear%'"),
]
SAVED_CONTENT_SQL = [
    ("Economy", "lower(page) LIKE '%/economy/%'"),
    ("Small", "lower(page) LIKE 'https://www.site0.example.com/small%'"),
]
GROUP_PRIORITY = {"Widgets": "true"}


def _stopwords_sql() -> str:
    from clickstack.functions.text import STOPWORDS

    return "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


STOPWORDS_SQL = _stopwords_sql()


def _grouped_saved(table, groups, extra):
    sql = grouped_sql(table, groups, extra)
    for name, pri in GROUP_PRIORITY.items():
        sql = sql.replace(f"SELECT '{name}' AS key,", f"SELECT '{name}' AS key,").replace(
            f"'{name}' AS key,\n  CAST", f"'{name}' AS key,\n  CAST")
    return sql


def _auto_content_grouped() -> str:
    seed = seed_sql("by_page", "page", f"{WEB} AND {CUR}")
    groups = content_groups_sql(seed)
    return with_base(f"""
SELECT g.name AS key,
  CAST(coalesce(SUM(CASE WHEN {CUR} THEN r.clicks ELSE 0 END), 0) AS BIGINT) AS clicks,
  CAST(coalesce(SUM(CASE WHEN {CUR} THEN r.impressions ELSE 0 END), 0) AS BIGINT) AS impressions,
  coalesce(SUM(CASE WHEN {CUR} THEN r.clicks ELSE 0 END) / NULLIF(SUM(CASE WHEN {CUR} THEN r.impressions ELSE 0 END), 0), 0.0) AS ctr,
  coalesce(SUM(CASE WHEN {CUR} THEN r.position * r.impressions ELSE 0 END) / NULLIF(SUM(CASE WHEN {CUR} THEN r.impressions ELSE 0 END), 0), 0.0) AS position,
  false AS priority,
  CAST(coalesce(SUM(CASE WHEN {PREV} THEN r.clicks ELSE 0 END), 0) AS BIGINT) AS prev_clicks,
  CAST(coalesce(SUM(CASE WHEN {PREV} THEN r.impressions ELSE 0 END), 0) AS BIGINT) AS prev_impressions,
  coalesce(SUM(CASE WHEN {PREV} THEN r.clicks ELSE 0 END) / NULLIF(SUM(CASE WHEN {PREV} THEN r.impressions ELSE 0 END), 0), 0.0) AS prev_ctr,
  coalesce(SUM(CASE WHEN {PREV} THEN r.position * r.impressions ELSE 0 END) / NULLIF(SUM(CASE WHEN {PREV} THEN r.impressions ELSE 0 END), 0), 0.0) AS prev_position
FROM g LEFT JOIN (SELECT * FROM by_page WHERE {WEB} AND ({CUR} OR {PREV}) AND page IS NOT NULL) r
  ON (g.op = 'regex' AND regexp_matches(lower(r.page), g.value)) OR (g.op = 'contains' AND lower(r.page) LIKE '%' || lower(g.value) || '%')
GROUP BY g.name""", f"g AS ({groups})")


GROUPS: dict[str, str] = {
    "auto_content_groups": with_base(content_groups_sql(seed_sql("by_page", "page", f"{WEB} AND {CUR}"))),
    "auto_content_groups_pages": content_groups_sql("SELECT url AS key, page_id AS impressions FROM pages"),
    "auto_suggest_content": with_base(content_groups_sql(seed_sql(
        "by_page", "page", f"{WEB} AND data_date BETWEEN DATE '1998-10-03' AND DATE '1998-12-31'"))),
    "report_grouped_entities_content": _auto_content_grouped(),
    "report_grouped_entities_saved_topic": grouped_sql("by_property", SAVED_TOPIC_SQL, "query IS NOT NULL").replace(
        "SELECT 'Widgets' AS key,", "SELECT 'Widgets' AS key,").replace(
        "position, false AS priority,\n  CAST(coalesce(SUM(CASE WHEN data_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' AND (lower(query) LIKE '%widget%')",
        "position, true AS priority,\n  CAST(coalesce(SUM(CASE WHEN data_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' AND (lower(query) LIKE '%widget%')"),
    "report_grouped_entities_saved_content": grouped_sql("by_page", SAVED_CONTENT_SQL, "page IS NOT NULL"),
    "group_rules": with_base("""
SELECT DISTINCT g.group_id, k.query FROM (SELECT DISTINCT query FROM by_property WHERE search_type = 'web' AND query IS NOT NULL
  AND data_date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31') k
JOIN (VALUES ('widgets', 'contains', 'widget'), ('how_to', 'regex', '^how to'), ('how_to', 'starts_with', 'how '),
             ('gears', 'equals', 'hot gear'), ('gears', 'contains', 'gear')) g(group_id, op, value)
  ON (g.op = 'contains' AND lower(k.query) LIKE '%' || g.value || '%') OR (g.op = 'regex' AND regexp_matches(lower(k.query), g.value))
  OR (g.op = 'starts_with' AND lower(k.query) LIKE g.value || '%') OR (g.op = 'equals' AND lower(k.query) = g.value)"""),
    "grouped_metrics": with_base(f"""SELECT {', '.join(
        f"CAST(SUM(CASE WHEN ({p}) THEN clicks ELSE 0 END) AS BIGINT) AS g{i}_clicks, "
        f"CAST(SUM(CASE WHEN ({p}) THEN impressions ELSE 0 END) AS BIGINT) AS g{i}_impr, "
        f"SUM(CASE WHEN ({p}) THEN clicks ELSE 0 END) / NULLIF(SUM(CASE WHEN ({p}) THEN impressions ELSE 0 END), 0) AS g{i}_ctr, "
        f"SUM(CASE WHEN ({p}) THEN position * impressions ELSE 0 END) / NULLIF(SUM(CASE WHEN ({p}) THEN impressions ELSE 0 END), 0) AS g{i}_pos"
        for i, (_, p) in enumerate(SAVED_TOPIC_SQL))} FROM by_property WHERE {WEB} AND {CUR} AND query IS NOT NULL"""),
    "first_segment": f"SELECT page_id, url, {seg_sql('url')} AS segment FROM pages",
    "title_case": f"SELECT page_id, {title_sql(seg_sql('url'))} AS name FROM pages",
    "tokenize": with_base(f"""SELECT query, unnest(list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'),
  lambda t: length(t) >= 3 AND NOT list_contains({STOPWORDS_SQL}, t) AND NOT list_contains(['brand#2', 'brand#17'], t)
  AND NOT regexp_matches(t, '^[0-9]+$'))) AS token FROM (SELECT DISTINCT query FROM by_property WHERE query IS NOT NULL)"""),
}


# Control plane ----------------------------------------------------------------------------------
def pk(col: str) -> str:
    """property_key (H3) in SQL."""
    raw = f"CASE WHEN starts_with({col}, 'sc-domain:') THEN substr({col}, 11) ELSE regexp_replace({col}, '(?i)^https?://', '') END"
    body = f"regexp_replace(regexp_replace(lower({raw}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
    return f"substr(CASE WHEN starts_with({col}, 'sc-domain:') THEN 'domain' ELSE 'urlp' END || '_' || {body}, 1, 1024)"


def site_of(col: str) -> str:
    n = f"CAST(regexp_extract({col}, 'site([0-9]+)\\.example\\.com', 1) AS INTEGER)"
    return f"(CASE WHEN starts_with({col}, 'sc-domain:') THEN {n} + 6 ELSE {n} END)"


PT = "CAST((({c}) AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles' AS DATE)"
AS_OF = "TIMESTAMP '2024-01-30 12:00:00'"

CONTROL = f"""
att0 AS (SELECT *, CASE WHEN user_id % 8 < 6 THEN concat('https://www.site', CAST(user_id % 8 AS VARCHAR), '.example.com/')
       ELSE concat('sc-domain:site', CAST(user_id % 8 - 6 AS VARCHAR), '.example.com') END AS url,
  CAST(DATE '2024-01-30' - CAST(event_id % 50 AS INTEGER) AS DATE) AS dd FROM events),
attempts AS (SELECT event_id, {pk('url')} || '__web__byProperty__' || strftime(dd, '%Y%m%d') AS task_id,
  url AS property, 'web' AS search_type, 'byProperty' AS aggregation, dd AS data_date,
  CASE WHEN user_id % 7 = 6 THEN NULL ELSE concat('acct', CAST(user_id % 7 AS VARCHAR)) END AS account_id,
  CASE event_type WHEN 'purchase' THEN 'collected_with_data' WHEN 'signup' THEN 'collected_no_data'
       WHEN 'view' THEN 'collected_fresh' WHEN 'click' THEN 'queued' ELSE 'error' END AS status,
  1 + event_id % 9 AS attempt,
  CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) * 150 END AS row_count,
  CASE WHEN user_id % 10 = 0 THEN NULL ELSE event_id % 4 + 1 END AS api_calls,
  CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 4 = 0 THEN 'quotaExceeded: try again'
       WHEN event_id % 4 = 1 THEN 'invalid_grant'
       WHEN event_id % 4 = 2 THEN 'Requests for Discover cannot be grouped by device' ELSE 'backendError' END AS error_message,
  CAST(ts AS TIMESTAMP) AS logged_at FROM att0),
ledger AS (SELECT task_id, {pk('arg_max_null(property, logged_at)')} AS property_id,
  arg_max_null(search_type, logged_at) AS search_type, arg_max_null(aggregation, logged_at) AS aggregation,
  arg_max_null(data_date, logged_at) AS data_date, arg_max_null(status, logged_at) AS status,
  arg_max_null(attempt, logged_at) AS attempts, arg_max_null(account_id, logged_at) AS account_id
  FROM attempts GROUP BY task_id),
registry AS (SELECT {pk('property')} AS property_id, property AS site_url,
  CASE WHEN starts_with(property, 'sc-domain:') THEN 'domain' ELSE 'url_prefix' END AS property_type,
  CASE WHEN site = 5 THEN 'native_export' ELSE 'api' END AS source, (site = 5 OR site <> 7) AS included,
  coalesce(array_to_string(list_sort(list(DISTINCT account_id) FILTER (WHERE account_id IS NOT NULL)), ','), '') AS account_ids,
  arg_min(account_id, logged_at) FILTER (WHERE account_id IS NOT NULL) AS preferred_account_id,
  strftime(min(logged_at), '%Y-%m-%d %H:%M:%S') AS discovered_at, strftime(max(logged_at), '%Y-%m-%d %H:%M:%S') AS last_seen_at,
  site
  FROM (SELECT *, {site_of('property')} AS site FROM attempts) GROUP BY property, site),
members AS (SELECT d.group_id, d.name, d.materialize, d.group_pos, d.member_pos, r.site_url AS property
  FROM (VALUES ('grp_a', 'Group A', true, 0, 0, 0), ('grp_a', 'Group A', true, 0, 1, 1), ('grp_a', 'Group A', true, 0, 2, 2),
               ('grp_b', 'Group B', false, 1, 0, 2), ('grp_b', 'Group B', false, 1, 1, 3), ('grp_b', 'Group B', false, 1, 2, 4),
               ('grp_c', 'Group C', true, 2, 0, 0), ('grp_c', 'Group C', true, 2, 1, 6))
       d(group_id, name, materialize, group_pos, member_pos, site) JOIN registry r ON r.site = d.site),
assign AS (
  SELECT r.property_id, 'g_' || m.group_id AS client_id, m.name AS client_name
  FROM registry r JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY property ORDER BY group_pos, member_pos) AS rn
                                      FROM members) WHERE rn = 1) m ON r.site_url = m.property
  UNION ALL
  SELECT property_id, 'p_' || property_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(site_url,
         '^sc-domain:', ''), '^https?://', ''), '/+$', ''), '^www\\.', '')
  FROM registry WHERE (included OR source = 'native_export')
    AND site_url NOT IN (SELECT property FROM members)),
pstatus AS (
  SELECT r.property_id, r.included, r.source, s.last_collected_date, s.data_state, s.last_collected_at, s.last_error, s.last_error_at,
   CASE WHEN r.source = 'native_export' THEN 'imported'
        WHEN s.last_error_at IS NOT NULL AND (s.last_collected_at IS NULL OR s.last_error_at > s.last_collected_at) THEN 'error'
        WHEN s.last_collected_date IS NOT NULL THEN CASE WHEN s.data_state = 'fresh' THEN 'fresh' ELSE 'final' END
        WHEN r.included THEN 'collecting' ELSE 'untracked' END AS kind
  FROM registry r LEFT JOIN (
    SELECT property,
     max(data_date) FILTER (WHERE status LIKE 'collected_%') AS last_collected_date,
     arg_max(CASE WHEN status = 'collected_fresh' THEN 'fresh' ELSE 'final' END,
             strftime(data_date, '%Y-%m-%d') || strftime(logged_at, '%Y-%m-%d %H:%M:%S.%f')) FILTER (WHERE status LIKE 'collected_%') AS data_state,
     max(logged_at) FILTER (WHERE status LIKE 'collected_%') AS last_collected_at,
     arg_max(error_message, logged_at) FILTER (WHERE status = 'error') AS last_error,
     max(logged_at) FILTER (WHERE status = 'error') AS last_error_at
    FROM attempts GROUP BY property) s ON r.site_url = s.property),
accounts AS (SELECT account_id, 'Account ' || regexp_extract(account_id, '([0-9]+)$', 1) AS display_name,
   CASE WHEN regexp_matches(coalesce(arg_max_null(error_message, logged_at), ''), '{'(?i)invalid_grant|token has been expired or revoked|revoked|account.*deleted'}')
        THEN 'revoked' ELSE 'valid' END AS token_health
  FROM attempts WHERE account_id IS NOT NULL GROUP BY account_id),
usage AS (SELECT account_id,
   CAST(SUM(CASE WHEN {PT.format(c='logged_at')} = {PT.format(c=AS_OF)} THEN coalesce(api_calls, 0) ELSE 0 END) AS BIGINT) AS calls_today,
   CAST(SUM(coalesce(api_calls, 0)) AS BIGINT) AS calls_7d,
   CAST(count(DISTINCT CASE WHEN {PT.format(c='logged_at')} = {PT.format(c=AS_OF)} THEN task_id END) AS BIGINT) AS tasks_today
  FROM attempts WHERE logged_at >= {AS_OF} - INTERVAL 7 DAY GROUP BY account_id),
cells AS (SELECT r.property_id, r.preferred_account_id AS account_id, a.aggregation, t.search_type, CAST(d.day AS DATE) AS data_date
  FROM registry r, (VALUES ('byProperty'), ('byPage'), ('totals')) a(aggregation),
       (VALUES ('web'), ('image'), ('news'), ('discover')) t(search_type),
       generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-29', INTERVAL 1 DAY) d(day)
  WHERE r.included AND r.source <> 'native_export' AND r.preferred_account_id IS NOT NULL
    AND NOT (t.search_type IN ('discover', 'googleNews') AND a.aggregation IN ('byProperty', 'totals'))),
terminal AS (SELECT property_id, search_type, aggregation, data_date FROM ledger WHERE status IN ('collected_with_data', 'collected_no_data')),
missing AS (SELECT c.* FROM cells c WHERE NOT EXISTS (SELECT 1 FROM terminal t WHERE t.property_id = c.property_id
  AND t.search_type = c.search_type AND t.aggregation = c.aggregation AND t.data_date = c.data_date)),
planned AS (SELECT * FROM missing WHERE aggregation <> 'totals'
  UNION ALL SELECT m.* FROM missing m WHERE m.aggregation = 'totals' AND EXISTS (SELECT 1 FROM terminal t
  WHERE t.aggregation = 'byProperty' AND t.property_id = m.property_id AND t.search_type = m.search_type AND t.data_date = m.data_date)),
reconcile AS (SELECT * FROM (SELECT property_id || '__' || search_type || '__' || aggregation || '__' || strftime(data_date, '%Y%m%d') AS task_id,
  property_id, search_type, aggregation, data_date, 'pending' AS status, CAST(0 AS BIGINT) AS attempts, account_id FROM planned) x
  WHERE x.task_id NOT IN (SELECT task_id FROM ledger WHERE status IN ('pending', 'queued'))),
billing AS (SELECT CASE event_type WHEN 'purchase' THEN 'BigQuery' WHEN 'view' THEN 'Cloud Run' WHEN 'click' THEN 'Cloud Tasks'
       WHEN 'signup' THEN 'Firestore' ELSE 'Cloud Storage' END AS service,
  CASE WHEN user_id % 5 = 0 THEN 'EUR' ELSE 'USD' END AS currency, value AS cost, CAST(ts AS TIMESTAMP) AS usage_start_time FROM events),
hashes AS (
  SELECT 'by_property' AS view, sha256(concat_ws('|', property, strftime(data_date, '%Y-%m-%d'), search_type, 'byProperty',
     coalesce(query, ''), '', coalesce(country, ''), coalesce(device, ''), '', CASE WHEN is_anonymized THEN 'true' ELSE 'false' END)) AS h FROM by_property
  UNION ALL SELECT 'by_page', sha256(concat_ws('|', property, strftime(data_date, '%Y-%m-%d'), search_type, 'byPage',
     coalesce(query, ''), coalesce(page, ''), coalesce(country, ''), coalesce(device, ''), '', CASE WHEN is_anonymized THEN 'true' ELSE 'false' END)) FROM by_page
  UNION ALL SELECT 'totals', sha256(concat_ws('|', property, strftime(data_date, '%Y-%m-%d'), search_type, 'totals',
     '', '', '', '', '', CASE WHEN is_anonymized THEN 'true' ELSE 'false' END)) FROM totals),
dedup AS (SELECT v.view, CAST(coalesce(d.n, 0) AS BIGINT) AS duplicates FROM (VALUES ('by_property'), ('by_page'), ('totals')) v(view)
  LEFT JOIN (SELECT view, count(*) AS n FROM (SELECT view, h FROM hashes GROUP BY view, h HAVING count(*) > 1) GROUP BY view) d ON v.view = d.view),
urls AS (SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT site_url FROM registry)),
collisions AS (SELECT p.name, c.urls, p.url FROM (SELECT DISTINCT {pk('url')} AS name, url FROM pages) p
  JOIN (SELECT name, CAST(count(*) AS BIGINT) AS urls FROM (SELECT DISTINCT {pk('url')} AS name, url FROM pages)
        GROUP BY name HAVING count(*) > 1) c ON p.name = c.name)"""


def with_control(body: str, extra: str = "") -> str:
    return f"WITH {BASE},{CONTROL}{(',' + extra) if extra else ''}\n{body}"


LEDGER_COLS = "task_id, property_id, search_type, aggregation, data_date, status, attempts, account_id"
REG_COLS = "property_id, site_url, property_type, source, included, account_ids, preferred_account_id, discovered_at, last_seen_at"
CLS = """regexp_matches(coalesce(error_message, ''), '(?i)quotaExceeded|rateLimitExceeded|userRateLimitExceeded|backendError|try again')"""
FINAL = "(NOT (data_date >= DATE '2024-02-01' - 14) OR data_date < DATE '2024-01-29')"
ISO = ("'2024-' || lpad(CAST(event_id % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(user_id % 33 AS VARCHAR), 2, '0')")

CONTROL_SQL: dict[str, str] = {
    "registry_merge": with_control(f"SELECT {REG_COLS} FROM registry"),
    "latest_state": with_control(f"SELECT {LEDGER_COLS} FROM ledger"),
    "property_status": with_control("""SELECT property_id, kind, last_collected_date, data_state, last_error,
  strftime(last_error_at, '%Y-%m-%d %H:%M:%S') AS last_error_at FROM pstatus"""),
    "client_assign": with_control("SELECT * FROM assign"),
    "client_kinds": with_control("""SELECT client_id, client_name, CAST(count(*) AS BIGINT) AS property_count,
  CASE WHEN bool_and(r.source = 'native_export') THEN 'export' WHEN count(*) > 1 THEN 'rollup' ELSE 'property' END AS kind
  FROM assign a JOIN registry r USING (property_id) GROUP BY client_id, client_name"""),
    "reconcile": with_control("SELECT * FROM reconcile"),
    "plan_missing": with_control("SELECT property_id, search_type, aggregation, data_date FROM missing WHERE aggregation = 'byProperty'"),
    "totals_gate": with_control("SELECT property_id, search_type, data_date FROM reconcile WHERE aggregation = 'totals'"),
    "set_difference": with_control("""SELECT property_id, data_date FROM cells c WHERE aggregation = 'byProperty' AND search_type = 'web'
  AND NOT EXISTS (SELECT 1 FROM terminal t WHERE t.property_id = c.property_id AND t.data_date = c.data_date)"""),
    "coverage_grid": with_control("""SELECT g.property_id, g.search_type, g.aggregation, g.data_date, coalesce(l.status, 'not_planned') AS state
  FROM (SELECT r.property_id, a.aggregation, t.search_type, CAST(d.day AS DATE) AS data_date FROM registry r,
        (VALUES ('byProperty'), ('byPage'), ('totals')) a(aggregation), (VALUES ('web'), ('image'), ('news'), ('discover')) t(search_type),
        generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-29', INTERVAL 1 DAY) d(day)) g
  LEFT JOIN ledger l ON l.property_id = g.property_id AND l.search_type = g.search_type AND l.aggregation = g.aggregation
   AND l.data_date = g.data_date"""),
    "requeue_errors": with_control("""SELECT task_id, property_id, search_type, aggregation, data_date,
  CASE WHEN status = 'error' THEN 'pending' ELSE status END AS status,
  CASE WHEN status = 'error' THEN CAST(0 AS BIGINT) ELSE attempts END AS attempts, account_id FROM ledger"""),
    "recollect_cell": with_control(f"""SELECT {LEDGER_COLS} FROM ledger WHERE status <> 'collected_fresh'
  UNION ALL SELECT task_id, property_id, search_type, aggregation, data_date, 'pending', CAST(0 AS BIGINT), account_id
  FROM ledger WHERE status = 'collected_fresh'"""),
    "purge_account": with_control(f"""SELECT {LEDGER_COLS} FROM ledger WHERE account_id IS NULL OR NOT (account_id = 'acct1'
  AND status NOT IN ('collected_with_data', 'collected_no_data', 'skipped'))"""),
    "group_pending_by_account": with_control("""SELECT account_id, CAST(count(*) AS BIGINT) AS pending FROM reconcile
  WHERE account_id IS NOT NULL GROUP BY account_id"""),
    "freshness": with_control("""SELECT property_id, max(data_date) FILTER (WHERE status = 'collected_with_data') AS freshness
  FROM ledger GROUP BY property_id"""),
    "status_mix": with_control("SELECT kind, CAST(count(*) AS BIGINT) AS properties FROM pstatus WHERE included GROUP BY kind"),
    "double_count": with_control("""SELECT g.group_id, coalesce(x.hit, false) AS double_count FROM (SELECT DISTINCT group_id FROM members) g
  LEFT JOIN (SELECT DISTINCT h.group_id, true AS hit FROM
     (SELECT group_id, lower(regexp_extract(property, '^https?://([^/:?#]+)', 1)) AS host FROM members WHERE NOT starts_with(property, 'sc-domain:')) h
     JOIN (SELECT group_id, lower(regexp_replace(property, '^sc-domain:', '')) AS d FROM members WHERE starts_with(property, 'sc-domain:')) m
     ON h.group_id = m.group_id AND (h.host = m.d OR ends_with(h.host, '.' || m.d))) x ON g.group_id = x.group_id"""),
    "existing_members": with_control("""SELECT group_id, property FROM members
  WHERE property IN (SELECT DISTINCT property FROM by_property)"""),
    "account_property_counts": with_control("""SELECT a.account_id, a.display_name, CAST(coalesce(c.n, 0) AS BIGINT) AS property_count
  FROM accounts a LEFT JOIN (SELECT acct AS account_id, count(*) AS n FROM registry, unnest(string_split(account_ids, ',')) u(acct)
  WHERE account_ids <> '' GROUP BY acct) c ON a.account_id = c.account_id"""),
    "tasks_by_status": with_control(f"SELECT {LEDGER_COLS} FROM ledger WHERE status = 'error' ORDER BY task_id LIMIT 2000"),
    "tasks_by_property": with_control(f"SELECT {LEDGER_COLS} FROM ledger WHERE property_id = 'urlp_www_site0_example_com'"),
    "tasks_recent": with_control(f"SELECT {LEDGER_COLS} FROM ledger ORDER BY task_id LIMIT 500"),
    "attempts_search": with_control("""SELECT task_id, property, search_type, aggregation, data_date, status, row_count, error_message,
  strftime(logged_at, '%Y-%m-%d %H:%M:%S') AS logged_at FROM attempts WHERE starts_with(task_id, 'urlp_www_site3_example_com__')
  ORDER BY attempts.logged_at DESC, event_id DESC LIMIT 200"""),
    "registry_filter": with_control(f"""SELECT {REG_COLS} FROM registry WHERE included AND site_url LIKE '%site%'
  AND list_contains(string_split(account_ids, ','), 'acct1')"""),
    "registry_filter_status": with_control("""SELECT r.property_id, r.site_url, s.kind, s.last_collected_date
  FROM registry r JOIN pstatus s USING (property_id) WHERE r.included AND lower(r.site_url) LIKE '%site%' AND s.kind = 'final'"""),
    "api_usage": with_control("SELECT * FROM usage"),
    "collection_activity": with_control(f"""SELECT strftime({PT.format(c='logged_at')}, '%Y-%m-%d') AS day,
  CAST(count(DISTINCT task_id) AS BIGINT) AS tasks, CAST(coalesce(SUM(row_count), 0) AS BIGINT) AS n_rows
  FROM attempts WHERE logged_at >= {AS_OF} - INTERVAL 14 DAY GROUP BY 1"""),
    "quota_by_account": with_control("""SELECT u.account_id,
  CASE WHEN u.account_id IS NULL THEN 'unattributed' ELSE coalesce(a.display_name, u.account_id) END AS display_name,
  CAST(CASE WHEN u.account_id IS NULL THEN 0 ELSE coalesce(p.n, 0) END AS BIGINT) AS properties,
  u.calls_today, u.calls_7d, u.tasks_today
  FROM usage u LEFT JOIN accounts a ON u.account_id = a.account_id
  LEFT JOIN (SELECT preferred_account_id AS account_id, count(*) AS n FROM registry WHERE included AND preferred_account_id IS NOT NULL
             GROUP BY 1) p ON u.account_id = p.account_id"""),
    "capacity": with_control("""SELECT today_calls, active, round(today_calls / greatest(1, active), 2) AS avg_calls_per_property,
  round(today_calls / 30000000 * 100, 4) AS project_qpd_used_pct,
  CASE WHEN today_calls / greatest(1, active) > 0 THEN CAST(floor(greatest(0, 30000000 - today_calls) / (today_calls / greatest(1, active))) AS BIGINT) END
    AS est_more_properties
  FROM (SELECT CAST(coalesce(SUM(calls_today), 0) AS BIGINT) AS today_calls FROM usage),
       (SELECT CAST(count(*) AS BIGINT) AS active FROM registry WHERE included)"""),
    "row_ceiling": with_control(f"SELECT DISTINCT property FROM attempts WHERE row_count >= 50000 AND logged_at > {AS_OF} - INTERVAL 30 DAY"),
    "recent_attempts": with_control(f"SELECT CAST(count(*) AS BIGINT) AS n FROM attempts WHERE logged_at > {AS_OF} - INTERVAL 7 DAY"),
    "billing_scan": with_control(f"""SELECT service, currency, cost, strftime(usage_start_time, '%Y-%m-%d %H:%M:%S') AS usage_start_time
  FROM billing WHERE usage_start_time >= {AS_OF} - INTERVAL 30 DAY"""),
    "billing_by_service": with_control(f"""SELECT coalesce(service, 'unknown') AS service, currency, round(SUM(cost), 2) AS cost
  FROM billing WHERE usage_start_time >= {AS_OF} - INTERVAL 30 DAY GROUP BY 1, 2"""),
    "billing_status": with_control(f"""SELECT CAST(count(*) AS BIGINT) AS n_rows, max(CAST(usage_start_time AS DATE)) AS latest_day
  FROM billing WHERE usage_start_time >= {AS_OF} - INTERVAL 45 DAY"""),
    "table_name_collisions": with_control(f"""SELECT name, CAST(count(*) OVER (PARTITION BY name) AS BIGINT) AS urls, url
  FROM (SELECT DISTINCT {pk('url')} AS name, url FROM (SELECT url FROM pages UNION ALL SELECT regexp_replace(url, '^https:', 'http:') FROM pages))
  QUALIFY urls > 1"""),
    "error_bursts": with_control("""SELECT strftime(time_bucket(INTERVAL 1 HOUR, logged_at), '%Y-%m-%d %H:%M:%S') AS window_start,
  CAST(count(*) AS BIGINT) AS errors FROM attempts WHERE status = 'error' GROUP BY 1 HAVING count(*) > 2"""),
    "stream_ops": with_control("""SELECT strftime(time_bucket(INTERVAL 1 HOUR, logged_at), '%Y-%m-%d %H:%M:%S') AS window_start,
  CAST(count(*) AS BIGINT) AS errors, count(*) > 20 AS alert, CAST(0 AS BIGINT) AS late FROM attempts WHERE status = 'error' GROUP BY 1"""),
    "success_gaps": with_control(f"""SELECT property, account_id, strftime(logged_at, '%Y-%m-%d %H:%M:%S') AS gap_start,
  strftime(coalesce(nxt, {AS_OF}), '%Y-%m-%d %H:%M:%S') AS gap_end, nxt IS NULL AS open
  FROM (SELECT property, account_id, logged_at, lead(logged_at) OVER (PARTITION BY property, account_id ORDER BY logged_at) AS nxt
        FROM attempts WHERE starts_with(status, 'collected_') AND logged_at <= {AS_OF})
  WHERE coalesce(nxt, {AS_OF}) >= logged_at + INTERVAL 23 HOUR"""),
    "row_hash_repeated": with_control("""SELECT 'by_property' AS "view", CAST(count(*) AS BIGINT) AS duplicates FROM by_property WHERE data_state = 'fresh'"""),
    "storage_rows": with_control("""SELECT 'by_property' AS dataset, CAST(count(*) AS BIGINT) AS n_rows FROM by_property
UNION ALL SELECT 'by_page', CAST(count(*) AS BIGINT) FROM by_page UNION ALL SELECT 'totals', CAST(count(*) AS BIGINT) FROM totals"""),
    "client_assign_kept": with_control("SELECT * FROM held UNION ALL SELECT * FROM assign WHERE property_id NOT IN (SELECT property_id FROM held)",
                                       """held AS (SELECT property_id, 'p_' || property_id AS client_id, regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(site_url, '^sc-domain:', ''), '^https?://', ''), '/+$', ''), '^www\\.', '') AS client_name FROM registry
  WHERE (included OR source = 'native_export') AND list_contains(string_split(account_ids, ','), 'acct1'))"""),
    "ops_alerts": with_control(f"""
SELECT 'collector_errors' AS alert, count(*) > 0 AS firing, CAST(count(*) AS VARCHAR) || ' hour(s) over threshold' AS detail
  FROM (SELECT time_bucket(INTERVAL 1 HOUR, logged_at) FROM attempts WHERE status = 'error' GROUP BY 1 HAVING count(*) > 20)
UNION ALL
SELECT 'no_collection', t IS NULL OR t < {AS_OF} - INTERVAL 23 HOUR,
  'last success ' || coalesce(strftime(t, '%Y-%m-%d %H:%M:%S'), 'never')
  FROM (SELECT max(logged_at) AS t FROM attempts WHERE status LIKE 'collected_%' AND logged_at <= {AS_OF})
UNION ALL
SELECT 'dedup_violation', SUM(duplicates) > 0, CAST(SUM(duplicates) AS VARCHAR) || ' duplicate hash(es)' FROM dedup"""),
    "health_checks": with_control(f"""
SELECT 'Dedup invariant (row_hash)' AS "check", SUM(duplicates) = 0 AS ok, CAST(SUM(duplicates) AS VARCHAR) || ' duplicate hash(es)' AS detail FROM dedup
UNION ALL SELECT 'Table-name collisions', count(DISTINCT name) = 0, CAST(count(DISTINCT name) AS VARCHAR) || ' colliding name(s)' FROM collisions
UNION ALL SELECT 'API row ceiling', true, CAST(count(*) AS VARCHAR) || ' propert(ies) at the 50K/day limit'
  FROM (SELECT DISTINCT property FROM attempts WHERE row_count >= 50000 AND logged_at > {AS_OF} - INTERVAL 30 DAY)
UNION ALL SELECT 'Recent collection', count(*) > 0, CAST(count(*) AS VARCHAR) || ' attempts in 7d' FROM attempts WHERE logged_at > {AS_OF} - INTERVAL 7 DAY
UNION ALL SELECT 'Export readable', true, 'latest export ' || coalesce(CAST(max(data_date) AS VARCHAR), 'none') FROM search_raw
UNION ALL SELECT 'Accounts connected', SUM(CASE WHEN token_health = 'valid' THEN 1 ELSE 0 END) > 0, CAST(count(*) AS VARCHAR) || ' account(s)' FROM accounts"""),
    "overview": with_control(f"""SELECT * , total_properties - tracking AS available FROM
  (SELECT CAST(count(*) AS BIGINT) AS accounts, CAST(SUM(CASE WHEN token_health = 'valid' THEN 1 ELSE 0 END) AS BIGINT) AS healthy_accounts FROM accounts),
  (SELECT CAST(SUM(CASE WHEN included THEN 1 ELSE 0 END) AS BIGINT) AS tracking, CAST(count(*) AS BIGINT) AS total_properties FROM registry),
  (SELECT CAST((SELECT count(*) FROM by_property) + (SELECT count(*) FROM by_page) + (SELECT count(*) FROM totals) AS BIGINT) AS rows),
  (SELECT 0.0::DOUBLE AS est_monthly_storage_usd), -- the test tables are under a quarter of a GiB
  (SELECT string_agg(day || ':' || tasks || ':' || n_rows, ',' ORDER BY day) AS activity FROM
    (SELECT strftime({PT.format(c='logged_at')}, '%Y-%m-%d') AS day, count(DISTINCT task_id) AS tasks, CAST(coalesce(SUM(row_count), 0) AS BIGINT) AS n_rows
     FROM attempts WHERE logged_at >= {AS_OF} - INTERVAL 14 DAY GROUP BY 1)),
  (SELECT CAST(coalesce(SUM(calls_today), 0) AS BIGINT) AS api_calls_today FROM usage),
  (SELECT CAST(SUM(CASE WHEN status = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS open_errors FROM ledger),
  (SELECT max(last_collected_date) FILTER (WHERE data_state = 'final') AS latest_final_date FROM pstatus)"""),
    "row_hash_invariant": with_control("SELECT * FROM dedup"),
    "property_key": with_control(f"""SELECT url, {pk('url')} AS property_key,
  substr({pk('url')} || '_' || substr(sha256(url), 1, 8), 1, 1024) AS property_key_disambiguated,
  CASE WHEN starts_with(url, 'sc-domain:') THEN 'domain' ELSE 'url_prefix' END AS property_type,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^sc-domain:', ''), '^https?://', ''), '/+$', ''), '^www\\.', '') AS client_name
  FROM urls"""),
    "valid_iso_date": f"""SELECT event_id, {ISO} AS text,
  regexp_full_match({ISO}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_strptime({ISO}, '%Y-%m-%d') IS NOT NULL
  AND strftime(try_strptime({ISO}, '%Y-%m-%d'), '%Y-%m-%d') = {ISO} AS valid FROM events""",
    "valid_combo": with_control("""SELECT r.property_id, t.search_type, a.aggregation,
  NOT (t.search_type IN ('discover', 'googleNews') AND a.aggregation IN ('byProperty', 'totals')) AS valid,
  CASE WHEN a.aggregation = 'totals' THEN ''
       WHEN t.search_type IN ('discover', 'googleNews') AND a.aggregation IN ('byProperty', 'totals') THEN NULL
       WHEN t.search_type IN ('discover', 'googleNews') THEN 'page,country'
       WHEN a.aggregation = 'byPage' THEN 'query,page,country,device' ELSE 'query,country,device' END AS dims
  FROM registry r, (VALUES ('web'), ('image'), ('news'), ('discover')) t(search_type),
       (VALUES ('byProperty'), ('byPage'), ('totals')) a(aggregation)"""),
    "retryable_error": with_control(f"""SELECT event_id, error_message, {CLS} AS retryable,
  CASE WHEN regexp_matches(coalesce(error_message, ''), '(?i)invalid_grant|token has been expired or revoked|revoked|account.*deleted')
       THEN 'revoked' ELSE 'broken' END AS token_class,
  CASE WHEN NOT {CLS} OR attempt >= 8 THEN 'error' ELSE 'queued' END AS next_status FROM attempts WHERE status = 'error'"""),
    "day_final": with_control(f"""SELECT event_id, data_date, {FINAL} AS is_final,
  CASE WHEN NOT {FINAL} THEN 'collected_fresh' WHEN coalesce(row_count, 0) > 0 THEN 'collected_with_data' ELSE 'collected_no_data' END
    AS collect_status FROM attempts WHERE status LIKE 'collected_%'"""),
    "pacific_day": with_control(f"SELECT event_id, {PT.format(c='logged_at')} AS pt_day FROM attempts"),
    "collection_window": with_control("SELECT property_id, DATE '2024-01-01' AS oldest, DATE '2024-01-29' AS newest FROM registry"),
    "days_in_range": with_control("""SELECT property_id, false AS reversed, CAST(d.day AS DATE) AS day FROM registry,
  generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-29', INTERVAL 1 DAY) d(day)
  UNION ALL SELECT property_id, true, CAST(NULL AS DATE) FROM registry"""),
    "compare_window": with_base("""SELECT start, "end", mode, CAST(cs AS DATE) AS compare_start, CAST(ce AS DATE) AS compare_end FROM (
  SELECT m AS start, CAST(last_day(m) AS DATE) AS "end", 'previous' AS mode,
         m - CAST(1 + (CAST(last_day(m) AS DATE) - m) AS INTEGER) AS cs, m - 1 AS ce FROM (SELECT DISTINCT CAST(date_trunc('month', data_date) AS DATE) AS m FROM by_property)
  UNION ALL SELECT m, CAST(last_day(m) AS DATE), 'yoy', m - 365, CAST(last_day(m) AS DATE) - 365 FROM (SELECT DISTINCT CAST(date_trunc('month', data_date) AS DATE) AS m FROM by_property)
  UNION ALL SELECT m, CAST(last_day(m) AS DATE), 'yoy_weekday', m - 364, CAST(last_day(m) AS DATE) - 364 FROM (SELECT DISTINCT CAST(date_trunc('month', data_date) AS DATE) AS m FROM by_property)
  UNION ALL SELECT m, CAST(last_day(m) AS DATE), 'prev_month', CAST(m - INTERVAL 1 MONTH AS DATE), CAST(CAST(last_day(m) AS DATE) - INTERVAL 1 MONTH AS DATE)
   FROM (SELECT DISTINCT CAST(date_trunc('month', data_date) AS DATE) AS m FROM by_property))"""),
    "task_id": with_control("SELECT event_id, task_id FROM attempts"),
    "distinct": with_control("SELECT DISTINCT account_id FROM attempts WHERE account_id IS NOT NULL"),
}
CONTROL_SQL["stream_gaps"] = CONTROL_SQL["success_gaps"]
CONTROL_SQL["dims_for"] = CONTROL_SQL["valid_combo"]
CONTROL_SQL["token_error_class"] = CONTROL_SQL["retryable_error"]
CONTROL_SQL["dead_letter"] = CONTROL_SQL["retryable_error"]
CONTROL_SQL["collect_status"] = CONTROL_SQL["day_final"]


# Fact plane -------------------------------------------------------------------------------------
WHOLE = "data_date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'"
SITE5 = "https://www.site5.example.com/"
NORM = ("CASE upper(search_type) WHEN 'WEB' THEN 'web' WHEN 'IMAGE' THEN 'image' WHEN 'VIDEO' THEN 'video' "
        "WHEN 'NEWS' THEN 'news' WHEN 'DISCOVER' THEN 'discover' WHEN 'GOOGLE_NEWS' THEN 'googleNews' ELSE lower(search_type) END")


def hash_sql(agg: str, page: str = "''", anon: str = "is_anonymized", st: str = "search_type", q: str = "coalesce(query, '')",
             prop: str = "property") -> str:
    return (f"sha256(concat_ws('|', {prop}, strftime(data_date, '%Y-%m-%d'), {st}, '{agg}', {q}, {page}, "
            f"coalesce(country, ''), coalesce(device, ''), '', CASE WHEN {anon} THEN 'true' WHEN NOT {anon} THEN 'false' END))")


FACT_CTES = f"""
site_export AS (SELECT data_date, property AS site_url, CASE WHEN is_anonymized THEN '' ELSE query END AS query, country, device,
  upper(search_type) AS search_type, clicks, impressions, (position - 1) * impressions AS sum_top_position,
  is_anonymized AS is_anonymized_query FROM search_raw WHERE search_type <> 'discover'),
url_export AS (SELECT data_date, property AS site_url, page AS url, CASE WHEN is_anonymized THEN '' ELSE query END AS query, country,
  device, upper(search_type) AS search_type, clicks, impressions, (position - 1) * impressions AS sum_position,
  is_anonymized AND search_type <> 'discover' AS is_anonymized_query, is_anonymized AND search_type = 'discover' AS is_anonymized_discover
  FROM search_raw),
site_adapter AS (SELECT data_date, site_url AS property, 'url_prefix' AS property_type, {NORM} AS search_type, 'byProperty' AS aggregation,
  NULLIF(query, '') AS query, CAST(NULL AS VARCHAR) AS page, country, device, clicks, impressions,
  clicks / NULLIF(impressions, 0) AS ctr, sum_top_position / NULLIF(impressions, 0) + 1 AS position,
  is_anonymized_query AS is_anonymized,
  {hash_sql('byProperty', anon='is_anonymized_query', st=NORM, prop='site_url')} AS row_hash, 'final' AS data_state
  FROM site_export WHERE site_url = '{SITE5}'),
url_adapter AS (SELECT data_date, site_url AS property, 'url_prefix' AS property_type, {NORM} AS search_type, 'byPage' AS aggregation,
  NULLIF(query, '') AS query, url AS page, country, device, clicks, impressions,
  clicks / NULLIF(impressions, 0) AS ctr, sum_position / NULLIF(impressions, 0) + 1 AS position,
  (is_anonymized_query OR is_anonymized_discover) AS is_anonymized,
  {hash_sql('byPage', page="coalesce(url, '')", anon='(is_anonymized_query OR is_anonymized_discover)', st=NORM, prop='site_url')} AS row_hash,
  'final' AS data_state FROM url_export WHERE site_url = '{SITE5}'),
wildcard AS (SELECT property, clicks, impressions FROM by_property WHERE property <> '{SITE5}'
  UNION ALL SELECT property, clicks, impressions FROM site_adapter),
targets AS (SELECT 'property:' || property_id AS target_id, site_url AS property FROM registry
  UNION ALL SELECT 'group:' || group_id, property FROM members
  UNION ALL SELECT 'client:' || a.client_id, r.site_url FROM assign a JOIN registry r USING (property_id)),
tw AS (SELECT t.target_id, b.* FROM by_property b JOIN targets t ON b.property = t.property
  WHERE b.search_type = 'web' AND b.data_date BETWEEN DATE '1998-11-06' AND DATE '1998-12-31'
  AND (t.target_id IN ('group:grp_a', 'group:grp_b') OR (t.target_id LIKE 'property:%'
       AND t.property NOT IN ('https://www.site4.example.com/', 'sc-domain:site1.example.com')))),
country_bd AS (SELECT country AS key, {M4} FROM by_property WHERE {WEB} AND {WHOLE} GROUP BY country),
movers_all AS (SELECT coalesce(c.key, p.key) AS key, CAST(coalesce(c.clicks, 0) AS BIGINT) AS clicks,
  CAST(coalesce(p.clicks, 0) AS BIGINT) AS prev_clicks, CAST(coalesce(c.clicks, 0) - coalesce(p.clicks, 0) AS BIGINT) AS delta,
  (c.key IS NOT NULL AND p.key IS NULL) AS is_new
  FROM (SELECT query AS key, SUM(clicks) AS clicks FROM by_property WHERE {WEB} AND {CUR} AND query IS NOT NULL GROUP BY query) c
  FULL OUTER JOIN (SELECT query AS key, SUM(clicks) AS clicks FROM by_property WHERE {WEB} AND {PREV} AND query IS NOT NULL GROUP BY query) p
  ON c.key = p.key),
movers_two AS (SELECT key, clicks, prev_clicks, delta, is_new FROM (SELECT *, row_number() OVER (ORDER BY delta DESC, key ASC NULLS LAST) AS a,
  row_number() OVER (ORDER BY delta ASC, key DESC NULLS FIRST) AS b FROM movers_all) WHERE a <= 50 OR b <= 50)"""


def with_fact(body: str, extra: str = "") -> str:
    return f"WITH {BASE},{CONTROL},{FACT_CTES}{(',' + extra) if extra else ''}\n{body}"


def per_prop(table: str, where: str) -> str:
    return with_fact(f"SELECT property, {M4} FROM {table} WHERE {where} GROUP BY property")


TOPQ = f"""topq AS (SELECT c.key, c.clicks, c.impressions, c.ctr, c.position,
       p.clicks AS prev_clicks, p.impressions AS prev_impressions, p.ctr AS prev_ctr, p.position AS prev_position
FROM (SELECT query AS key, {M4} FROM by_property WHERE {WEB} AND {CUR} AND query IS NOT NULL GROUP BY query
      ORDER BY clicks DESC, impressions DESC, key ASC NULLS LAST LIMIT 200) c
LEFT JOIN (SELECT query AS key, {M4} FROM by_property WHERE {WEB} AND {PREV} AND query IS NOT NULL GROUP BY query) p ON c.key = p.key)"""

PCUR = "data_date BETWEEN DATE '1998-12-04' AND DATE '1998-12-31'"
PPREV = "data_date BETWEEN DATE '1998-11-06' AND DATE '1998-12-03'"


def pq(where_extra: str = "TRUE") -> str:
    return (f"SELECT target_id, query AS key, SUM(position * impressions) / NULLIF(SUM(impressions), 0) AS position, "
            f"SUM(clicks) / NULLIF(SUM(impressions), 0) AS ctr, CAST(SUM(impressions) AS BIGINT) AS impressions, "
            f"CAST(SUM(clicks) AS BIGINT) AS clicks FROM tw WHERE {PCUR} AND query IS NOT NULL AND {where_extra} GROUP BY target_id, query")


def top_per_target(inner: str, order: str, n: int) -> str:
    return (f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY {order}) AS rn "
            f"FROM ({inner})) WHERE rn <= {n}")


ACCOUNT_OF_SITE = "CASE WHEN CAST(regexp_extract(site_url, 'site([0-9]+)', 1) AS INT) % 2 = 1 THEN 'export0' ELSE 'export1' END"

FACT_SQL: dict[str, str] = {
    "scan_property": with_fact(f"""SELECT data_date, property, search_type, query, country, device, clicks, impressions, position,
  {hash_sql('byProperty')} AS row_hash FROM by_property WHERE property = 'https://www.site0.example.com/'"""),
    "union_members": with_fact(f"""SELECT property, {M4} FROM by_property
  WHERE property IN (SELECT property FROM members WHERE group_id = 'grp_b') GROUP BY property"""),
    "wildcard_all": with_fact(f"""SELECT {pk('property')} AS source_table, CAST(count(*) AS BIGINT) AS n_rows,
  CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions FROM wildcard GROUP BY 1"""),
    "native_site_adapter": with_fact("SELECT * FROM site_adapter"),
    "native_url_adapter": with_fact("SELECT * FROM url_adapter"),
    "export_sites": with_fact("SELECT DISTINCT site_url FROM site_export"),
    "export_latest_date": with_fact("SELECT max(data_date) AS latest FROM search_raw"),
    "norm_search_type": with_fact(f"SELECT DISTINCT search_type AS export_type, {NORM} AS search_type FROM url_export"),
    "ingest_response_rows": with_fact("""SELECT property, search_type, data_state, CAST(count(*) AS BIGINT) AS n_rows,
  CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions FROM by_property
  GROUP BY property, search_type, data_state"""),
    "replace_slice": with_fact("""SELECT data_state, search_type, CAST(count(*) AS BIGINT) AS n_rows, CAST(SUM(clicks) AS BIGINT) AS clicks FROM (
  SELECT data_state, search_type, clicks FROM by_property WHERE NOT (data_state = 'fresh' AND search_type = 'web')
  UNION ALL SELECT data_state, search_type, clicks + 1 FROM by_property WHERE data_state = 'fresh' AND search_type = 'web')
  GROUP BY data_state, search_type"""),
    "reconcile_columns": with_fact("""SELECT 'byProperty' AS aggregation, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS missing_hash,
  CAST(count(*) AS BIGINT) AS missing_page FROM by_property
  UNION ALL SELECT 'byPage', CAST(count(*) AS BIGINT), CAST(0 AS BIGINT), CAST(SUM(CASE WHEN page IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM by_page"""),
    "pagination_ceiling": with_fact("""SELECT search_type, CAST(count(*) AS BIGINT) AS cells, CAST(SUM(n) AS BIGINT) AS n_rows,
  CAST(SUM(CASE WHEN n >= 50000 THEN 1 ELSE 0 END) AS BIGINT) AS hit_cells
  FROM (SELECT property, data_date, search_type, count(*) AS n FROM by_page GROUP BY 1, 2, 3) GROUP BY search_type"""),
    "materialize_group": with_fact(f"""SELECT m.group_id, b.data_date, b.query, b.country, b.device,
  CAST(SUM(b.clicks) AS BIGINT) AS clicks, CAST(SUM(b.impressions) AS BIGINT) AS impressions,
  SUM(b.clicks) / NULLIF(SUM(b.impressions), 0) AS ctr, SUM(b.position * b.impressions) / NULLIF(SUM(b.impressions), 0) AS position
  FROM by_property b JOIN members m ON b.property = m.property WHERE m.materialize GROUP BY 1, 2, 3, 4, 5"""),
    "group_view": with_fact(f"""SELECT property, {M4} FROM by_property
  WHERE property IN (SELECT property FROM members WHERE group_id = 'grp_b') GROUP BY property"""),
    "group_union_agg": with_fact(f"""SELECT data_date, query, country, device, {M4} FROM by_property
  WHERE property IN (SELECT property FROM members WHERE group_id = 'grp_b') GROUP BY 1, 2, 3, 4"""),
    "purge_native_account": with_fact(f"""SELECT {pk('site_url')} AS source_table, CAST(count(*) AS BIGINT) AS n_rows,
  CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions FROM site_export
  WHERE {ACCOUNT_OF_SITE} = 'export1' GROUP BY 1"""),
    "discover_export": with_fact(f"""SELECT {pk('site_url')} AS property_id, site_url,
  CASE WHEN starts_with(site_url, 'sc-domain:') THEN 'domain' ELSE 'url_prefix' END AS property_type, 'native_export' AS source, true AS included, {ACCOUNT_OF_SITE} AS account_ids FROM (SELECT DISTINCT site_url FROM site_export)"""),
    "f_search_type": per_prop("by_property", f"search_type = 'image' AND {WHOLE}"),
    "f_date_range": per_prop("by_property", f"{WEB} AND data_date BETWEEN DATE '1998-03-01' AND DATE '1998-03-31'"),
    "f_final_only": per_prop("by_property", f"{WEB} AND {WHOLE} AND data_state = 'final'"),
    "f_device_in": per_prop("by_property", f"{WEB} AND {WHOLE} AND device IN ('MOBILE', 'TABLET')"),
    "f_country_in": per_prop("by_property", f"{WEB} AND {WHOLE} AND country IN ('nation_1', 'nation_7')"),
    "f_position_range": per_prop("by_property", f"{WEB} AND {WHOLE} AND position >= 5 AND position <= 15"),
    "f_query_contains": per_prop("by_property", f"{WEB} AND {WHOLE} AND (lower(query) LIKE '%gear%' OR lower(query) LIKE '%widget%')"),
    "f_page_contains": per_prop("by_page", f"{WEB} AND {WHOLE} AND (lower(page) LIKE '%/economy/%' OR lower(page) LIKE '%/small%')"),
    "f_brand_exclude": per_prop("by_property", f"{WEB} AND {WHOLE} AND lower(query) NOT LIKE '%brand#2%'"),
    "f_brand_segment": per_prop("by_property", f"{WEB} AND {WHOLE} AND {BRAND}"),
    "f_brand_segment_nonbrand": per_prop("by_property", f"{WEB} AND {WHOLE} AND query IS NOT NULL AND NOT {BRAND}"),
    "f_preset_paa": per_prop("by_property", f"""{WEB} AND {WHOLE} AND regexp_matches(lower(query),
  '^(who|what|when|where|why|how|is|are|can|could|does|do|did|will|would|should|which)\\b')"""),
    "f_preset_longtail": per_prop("by_property", f"{WEB} AND {WHOLE} AND len(string_split(trim(query), ' ')) >= 4"),
    "f_require_query": per_prop("by_page", f"{WEB} AND {WHOLE} AND query IS NOT NULL"),
    "f_require_page": per_prop("by_page", f"{WEB} AND {WHOLE} AND page IS NOT NULL"),
    "brand_match": with_fact(f"SELECT DISTINCT query, {BRAND} AS is_brand FROM by_property WHERE query IS NOT NULL"),
    "rule_match": with_fact("""SELECT DISTINCT g.group_id, k.query, k.page FROM (SELECT DISTINCT query, page FROM by_page) k
  JOIN (VALUES ('economy', 'contains', '/economy/'), ('small', 'starts_with', 'https://www.site0.example.com/small')) g(group_id, op, value)
  ON (g.op = 'contains' AND lower(k.page) LIKE '%' || g.value || '%') OR (g.op = 'starts_with' AND lower(k.page) LIKE g.value || '%')"""),
    "without_segment": REPORTS["report_top_pages"],
    "metrics4": with_fact(f"SELECT property, search_type, {M4} FROM by_property GROUP BY property, search_type"),
    "kpis": with_fact(f"SELECT {M4} FROM by_property WHERE {WEB} AND {WHOLE}"),
    "timeseries": ts("month", f"{WEB} AND {WHOLE}"),
    "top_entity": with_fact(f"SELECT query AS key, {M4} FROM by_property WHERE {WEB} AND {WHOLE} AND query IS NOT NULL GROUP BY query"),
    "breakdown": with_fact("SELECT * FROM country_bd"),
    "position_buckets": REPORTS["report_position_buckets"].replace(CUR, WHOLE),
    "ctr_scatter": with_fact(f"SELECT * FROM ({per_query(f'{WEB} AND {WHOLE} AND query IS NOT NULL')}) WHERE impressions > 0"),
    "ctr_curve": REPORTS["report_ctr_curve"].replace(CUR, WHOLE),
    "ctr_bench_rows": with_fact(f"SELECT * FROM ({per_query(f'{WEB} AND {WHOLE} AND query IS NOT NULL')}) WHERE position <= 10 AND impressions > 0"),
    "query_page_pairs": with_fact(f"""SELECT query AS q, page AS p, CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions,
  SUM(position * impressions) / NULLIF(SUM(impressions), 0) AS position FROM by_page
  WHERE {WEB} AND {WHOLE} AND query IS NOT NULL AND page IS NOT NULL GROUP BY query, page"""),
    "striking_distance": with_fact(f"SELECT * FROM ({per_query(f'{WEB} AND {WHOLE} AND query IS NOT NULL')}) WHERE position >= 11 AND position <= 20"),
    "brand_split": REPORTS["report_brand_split"].replace(CUR, WHOLE),
    "brand_timeseries": with_fact(f"""SELECT strftime(CAST(date_trunc('month', data_date) AS DATE), '%Y-%m-%d') AS date,
 CAST(SUM(CASE WHEN {BRAND} THEN clicks ELSE 0 END) AS BIGINT) AS brand,
 CAST(SUM(CASE WHEN NOT {BRAND} THEN clicks ELSE 0 END) AS BIGINT) AS nonbrand,
 CAST(SUM(CASE WHEN {BRAND} THEN impressions ELSE 0 END) AS BIGINT) AS brandImpr,
 CAST(SUM(CASE WHEN NOT {BRAND} THEN impressions ELSE 0 END) AS BIGINT) AS nonbrandImpr
FROM by_property WHERE {WEB} AND {WHOLE} AND query IS NOT NULL GROUP BY 1"""),
    "brand_share": with_fact(f"""SELECT CAST(b AS BIGINT) AS brand_clicks, CAST(n AS BIGINT) AS nonbrand_clicks,
  coalesce(b * 100.0 / NULLIF(b + n, 0), 0.0) AS brand_share FROM (
  SELECT SUM(CASE WHEN {BRAND} THEN clicks ELSE 0 END) AS b, SUM(CASE WHEN NOT {BRAND} THEN clicks ELSE 0 END) AS n
  FROM by_property WHERE {WEB} AND {WHOLE} AND query IS NOT NULL)"""),
    "period_pivot_sum": with_fact(f"""SELECT {pk('property')} AS source_table,
  CAST(SUM(CASE WHEN {CUR} THEN clicks ELSE 0 END) AS BIGINT) AS clicks, CAST(SUM(CASE WHEN {PREV} THEN clicks ELSE 0 END) AS BIGINT) AS prev_clicks
  FROM by_property WHERE {WEB} AND data_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY 1"""),
    "region_movers": with_fact(f"""SELECT CASE WHEN r.site = 5 THEN 'EU' ELSE 'US' END AS region, x.* FROM (
  SELECT {pk('property')} AS source_table, CAST(SUM(CASE WHEN {CUR} THEN clicks ELSE 0 END) AS BIGINT) AS clicks,
  CAST(SUM(CASE WHEN {PREV} THEN clicks ELSE 0 END) AS BIGINT) AS prev_clicks
  FROM by_property WHERE {WEB} AND data_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY 1) x
  JOIN registry r ON r.property_id = x.source_table"""),
    "anomaly_pct": with_fact("""SELECT property, SUM(CASE WHEN is_anonymized THEN impressions ELSE 0 END) / NULLIF(SUM(impressions), 0) AS anomaly_pct
  FROM totals GROUP BY property"""),
    "totals_delta": with_fact("""SELECT t.property, t.data_date, t.search_type, CAST(greatest(0, t.clicks - coalesce(b.c, 0)) AS BIGINT) AS delta_clicks,
  CAST(greatest(0, t.impressions - coalesce(b.i, 0)) AS BIGINT) AS delta_impressions FROM totals t
  LEFT JOIN (SELECT property, data_date, search_type, SUM(clicks) AS c, SUM(impressions) AS i FROM by_property GROUP BY 1, 2, 3) b
  ON t.property = b.property AND t.data_date = b.data_date AND t.search_type = b.search_type WHERE NOT t.is_anonymized"""),
    "home_movers": with_fact(f"""SELECT 'client' AS type, a.client_id AS id, a.client_name AS name, CAST(SUM(x.clicks) AS BIGINT) AS clicks,
  CAST(SUM(x.prev_clicks) AS BIGINT) AS prev_clicks, CAST(SUM(x.clicks) - SUM(x.prev_clicks) AS BIGINT) AS delta,
  CASE WHEN SUM(x.prev_clicks) > 0 THEN (SUM(x.clicks) - SUM(x.prev_clicks)) / SUM(x.prev_clicks) * 100 END AS delta_pct
  FROM (SELECT {pk('property')} AS source_table,
    SUM(CASE WHEN data_date BETWEEN DATE '1998-12-01' AND DATE '1998-12-28' THEN clicks ELSE 0 END) AS clicks,
    SUM(CASE WHEN data_date BETWEEN DATE '1998-11-03' AND DATE '1998-11-30' THEN clicks ELSE 0 END) AS prev_clicks
    FROM by_property WHERE {WEB} AND data_date BETWEEN DATE '1998-11-03' AND DATE '1998-12-28' GROUP BY 1) x
  JOIN registry r ON r.property_id = x.source_table AND r.included JOIN assign a ON a.property_id = x.source_table
  GROUP BY a.client_id, a.client_name"""),
    "cannibalization": with_fact("""
SELECT q.key, q.pages, q.clicks, q.impressions, r.rank, r.page, r.page_clicks, r.page_impressions, r.page_position
FROM q JOIN (SELECT q AS key, CAST(row_number() OVER (PARTITION BY q ORDER BY impressions DESC, p ASC) AS INTEGER) AS rank, p AS page,
                    clicks AS page_clicks, impressions AS page_impressions, position AS page_position FROM pairs) r
  ON q.key = r.key WHERE r.rank <= 8""", f"""
pairs AS (SELECT query AS q, page AS p, CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions,
   SUM(position * impressions) / NULLIF(SUM(impressions), 0) AS position
   FROM by_page WHERE {WEB} AND {WHOLE} AND query IS NOT NULL AND page IS NOT NULL GROUP BY query, page),
q AS (SELECT q AS key, CAST(count(*) AS BIGINT) AS pages, CAST(SUM(clicks) AS BIGINT) AS clicks,
   CAST(SUM(impressions) AS BIGINT) AS impressions FROM pairs GROUP BY q
   HAVING count(*) >= 2 AND SUM(impressions) >= 10 ORDER BY impressions DESC, key ASC LIMIT 200)"""),
    "trend_overlay": with_fact("""SELECT c.date, c.value, p.value AS compare FROM
  (SELECT strftime(data_date, '%Y-%m-%d') AS date, CAST(SUM(clicks) AS BIGINT) AS value, row_number() OVER (ORDER BY data_date) AS i
   FROM by_property WHERE search_type = 'web' AND data_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' GROUP BY data_date) c
  LEFT JOIN (SELECT CAST(SUM(clicks) AS BIGINT) AS value, row_number() OVER (ORDER BY data_date) AS i
   FROM by_property WHERE search_type = 'web' AND data_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' GROUP BY data_date) p
  ON c.i = p.i"""),
    "topk_entities": with_fact(f"""SELECT query AS key, {M4} FROM by_property WHERE {WEB} AND {WHOLE} AND query IS NOT NULL GROUP BY query
  ORDER BY clicks DESC, impressions DESC, key ASC LIMIT 100"""),
    "topk_scatter": with_fact(f"SELECT * FROM ({per_query(f'{WEB} AND {WHOLE} AND query IS NOT NULL')}) WHERE impressions > 0 ORDER BY impressions DESC, key LIMIT 500"),
    "topk_bench": with_fact(f"""SELECT * FROM ({per_query(f'{WEB} AND {WHOLE} AND query IS NOT NULL')}) WHERE position <= 10 AND impressions > 0
  ORDER BY impressions DESC, key LIMIT 200"""),
    "topk_pairs": with_fact(f"""SELECT query AS q, page AS p, CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions,
  SUM(position * impressions) / NULLIF(SUM(impressions), 0) AS position FROM by_page
  WHERE {WEB} AND {WHOLE} AND query IS NOT NULL AND page IS NOT NULL GROUP BY query, page ORDER BY impressions DESC, q, p LIMIT 5000"""),
    "topk_striking": with_fact(f"""SELECT * FROM ({per_query(f'{WEB} AND {WHOLE} AND query IS NOT NULL')}) WHERE position >= 11 AND position <= 20
  ORDER BY impressions DESC, key LIMIT 100"""),
    "movers_two_ended": with_fact("SELECT * FROM movers_two"),
    "gainers_losers": with_fact("""SELECT key, clicks, prev_clicks, delta, is_new, 'gainer' AS side FROM movers_two WHERE delta > 0
  ORDER BY delta DESC, key LIMIT 15""").replace("ORDER BY delta DESC, key LIMIT 15", """QUALIFY row_number() OVER (ORDER BY delta DESC, key) <= 15
  UNION ALL SELECT key, clicks, prev_clicks, delta, is_new, 'loser' FROM movers_two WHERE delta < 0
  QUALIFY row_number() OVER (ORDER BY delta ASC, key) <= 15"""),
    "topn_other": with_fact("""SELECT key, slot, clicks, clicks * 100.0 / SUM(clicks) OVER () AS share FROM (
  SELECT CASE WHEN rn <= 6 THEN key ELSE 'Other' END AS key, CAST(CASE WHEN rn <= 6 THEN rn ELSE 7 END AS INTEGER) AS slot, CAST(SUM(clicks) AS BIGINT) AS clicks
  FROM (SELECT key, clicks, row_number() OVER (ORDER BY clicks DESC, key ASC) AS rn FROM country_bd WHERE clicks > 0) GROUP BY 1, 2)"""),
    "breakdown_top": with_fact("""SELECT *, abs(clicks) / greatest(max(abs(clicks)) OVER (), 1.0) AS bar FROM (
  SELECT *, CAST(row_number() OVER (ORDER BY clicks DESC, key ASC) AS INTEGER) AS rank FROM country_bd WHERE key IS NOT NULL AND key <> '')
  WHERE rank <= 8"""),
    "sorted_page": with_fact("SELECT * FROM topq ORDER BY impressions DESC, key LIMIT 10 OFFSET 10", TOPQ),
    "row_hash": with_fact(f"SELECT property, data_date, search_type, query, country, device, {hash_sql('byProperty')} AS row_hash FROM by_property"),
    "row_hash_native": with_fact("SELECT property, data_date, search_type, query, country, device, is_anonymized, row_hash FROM site_adapter"),
    "pct_delta": with_fact("""SELECT key,
  CASE WHEN prev_clicks IS NULL OR prev_clicks = 0 OR clicks IS NULL THEN NULL ELSE (clicks - prev_clicks) / abs(prev_clicks) * 100 END AS clicks_pct,
  CASE WHEN clicks IS NULL OR prev_clicks IS NULL THEN NULL WHEN prev_clicks = 0 THEN CASE WHEN clicks > 0 THEN 'new' END
       WHEN abs((clicks - prev_clicks) / abs(prev_clicks) * 100) < 0.05 THEN 'flat'
       WHEN (clicks - prev_clicks) / abs(prev_clicks) * 100 > 0 THEN 'good' ELSE 'bad' END AS clicks_chip,
  CASE WHEN position IS NULL OR prev_position IS NULL THEN NULL WHEN prev_position = 0 THEN NULL
       WHEN abs((position - prev_position) / abs(prev_position) * 100) < 0.05 THEN 'flat'
       WHEN (position - prev_position) / abs(prev_position) * 100 > 0 THEN 'bad' ELSE 'good' END AS position_chip
  FROM topq""", TOPQ),
    "resolve_target": with_fact(f"""SELECT property, {M4} FROM by_property WHERE property IN
  (SELECT property FROM targets WHERE target_id = 'client:g_grp_a') GROUP BY property"""),
    "precompute_kpis": with_fact(f"""SELECT target_id, {m4('', PCUR)}, {m4('prev_', PPREV)} FROM tw GROUP BY target_id"""),
    "precompute_timeseries": with_fact(f"""SELECT target_id, strftime(data_date, '%Y-%m-%d') AS date, {M4} FROM tw WHERE {PCUR}
  GROUP BY target_id, data_date"""),
    "precompute_breakdown": with_fact(f"SELECT target_id, device AS key, {M4} FROM tw WHERE {PCUR} GROUP BY target_id, device"),
    "precompute_breakdown_country": with_fact(f"SELECT target_id, country AS key, {M4} FROM tw WHERE {PCUR} GROUP BY target_id, country"),
    "precompute_position_buckets": with_fact(f"""SELECT target_id, strftime(data_date, '%Y-%m-%d') AS date,
 CAST(SUM(CASE WHEN position <= 3 THEN impressions ELSE 0 END) AS BIGINT) AS top3,
 CAST(SUM(CASE WHEN position > 3 AND position <= 10 THEN impressions ELSE 0 END) AS BIGINT) AS p4_10,
 CAST(SUM(CASE WHEN position > 10 AND position <= 20 THEN impressions ELSE 0 END) AS BIGINT) AS p11_20,
 CAST(SUM(CASE WHEN position > 20 AND position <= 50 THEN impressions ELSE 0 END) AS BIGINT) AS p21_50,
 CAST(SUM(CASE WHEN position > 50 THEN impressions ELSE 0 END) AS BIGINT) AS p50plus
 FROM tw WHERE {PCUR} GROUP BY target_id, data_date"""),
    "precompute_ctr_scatter": with_fact(top_per_target(f"SELECT * FROM ({pq()}) WHERE impressions > 0", "impressions DESC, key ASC", 500)),
    "precompute_striking_distance": with_fact(top_per_target(f"SELECT * FROM ({pq()}) WHERE position >= 11 AND position <= 20",
                                                             "impressions DESC, key ASC", 100)),
    "precompute_top_queries": with_fact("""SELECT c.target_id, c.key, c.clicks, c.impressions, c.ctr, c.position,
  p.clicks AS prev_clicks, p.impressions AS prev_impressions, p.ctr AS prev_ctr, p.position AS prev_position
  FROM c LEFT JOIN p ON c.target_id = p.target_id AND c.key = p.key""", f"""
c AS ({top_per_target(f"SELECT target_id, query AS key, {M4} FROM tw WHERE {PCUR} AND query IS NOT NULL GROUP BY target_id, query",
                      "clicks DESC, impressions DESC, key ASC", 200)}),
p AS (SELECT target_id, query AS key, {M4} FROM tw WHERE {PPREV} AND query IS NOT NULL GROUP BY target_id, query)"""),
    "precompute_movers": with_fact("""SELECT target_id, key, clicks, prev_clicks, delta, is_new FROM (
  SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY delta DESC, key ASC) AS a,
            row_number() OVER (PARTITION BY target_id ORDER BY delta ASC, key DESC) AS b FROM m) WHERE a <= 50 OR b <= 50""", f"""
c AS (SELECT target_id, query AS key, {M4} FROM tw WHERE {PCUR} AND query IS NOT NULL GROUP BY target_id, query),
p AS (SELECT target_id, query AS key, {M4} FROM tw WHERE {PPREV} AND query IS NOT NULL GROUP BY target_id, query),
m AS (SELECT coalesce(c.target_id, p.target_id) AS target_id, coalesce(c.key, p.key) AS key, CAST(coalesce(c.clicks, 0) AS BIGINT) AS clicks,
  CAST(coalesce(p.clicks, 0) AS BIGINT) AS prev_clicks, CAST(coalesce(c.clicks, 0) - coalesce(p.clicks, 0) AS BIGINT) AS delta,
  (c.key IS NOT NULL AND p.key IS NULL) AS is_new FROM c FULL OUTER JOIN p ON c.target_id = p.target_id AND c.key = p.key)"""),
}
FACT_SQL["union_all"] = FACT_SQL["wildcard_all"]
FACT_SQL["wildcard_view"] = FACT_SQL["wildcard_all"]
FACT_SQL["group_view_saved"] = FACT_SQL["group_view"]
FACT_SQL["ensure_table"] = FACT_SQL["reconcile_columns"]
FACT_SQL["collect_cells"] = with_fact("""SELECT t AS search_type, status, CAST(count(*) AS BIGINT) AS cells,
  CAST(SUM(CASE n WHEN 0 THEN 1 ELSE 2 END) AS BIGINT) AS api_calls, CAST(SUM(least(n, 4)) AS BIGINT) AS n_rows
  FROM (SELECT t, n, CASE WHEN state = 'fresh' THEN 'collected_fresh' WHEN n > 0 THEN 'collected_with_data' ELSE 'collected_no_data' END AS status
    FROM (SELECT c.property, c.data_date, t, c.state, count(b.property) AS n
      FROM (SELECT property, data_date, max(data_state) AS state FROM by_property GROUP BY 1, 2) c
      CROSS JOIN (VALUES ('web'), ('image'), ('video'), ('news'), ('discover'), ('googleNews')) v(t)
      LEFT JOIN by_property b ON b.property = c.property AND b.data_date = c.data_date AND b.search_type = t
      GROUP BY 1, 2, 3, 4)) GROUP BY t, status""")
FACT_SQL["stream_ingest"] = FACT_SQL["ingest_response_rows"]
FACT_SQL["new_suggestions"] = with_fact("""SELECT * FROM (""" + content_groups_sql(seed_sql("by_page", "page", f"{WEB} AND {CUR}"))
                                        + """) WHERE lower(name) NOT IN ('economy', 'small')""")
FACT_SQL["stage_ndjson"] = with_fact("SELECT property, CAST(count(*) AS BIGINT) AS count FROM by_property GROUP BY property")
FACT_SQL["append_attempt"] = with_control("""SELECT status, CAST(count(*) AS BIGINT) AS count FROM (
  SELECT status FROM attempts UNION ALL SELECT status FROM reconcile) GROUP BY status""")
FACT_SQL["movers_window"] = with_base("""SELECT start, "end", mode, CAST(cs AS DATE) AS compare_start, CAST(ce AS DATE) AS compare_end FROM (
  SELECT m AS start, CAST(last_day(m) AS DATE) AS "end", md AS mode,
         m - CAST(1 + (CAST(last_day(m) AS DATE) - m) AS INTEGER) AS cs, m - 1 AS ce
  FROM (SELECT DISTINCT CAST(date_trunc('month', data_date) AS DATE) AS m FROM by_property), (VALUES ('none'), ('custom')) v(md)
  UNION ALL SELECT m, CAST(last_day(m) AS DATE), 'yoy', m - 365, CAST(last_day(m) AS DATE) - 365
  FROM (SELECT DISTINCT CAST(date_trunc('month', data_date) AS DATE) AS m FROM by_property))""")
FACT_SQL["billing_total"] = with_control(f"""SELECT round(SUM(cost), 2) AS total FROM (SELECT round(SUM(cost), 2) AS cost FROM billing
  WHERE usage_start_time >= {AS_OF} - INTERVAL 30 DAY GROUP BY coalesce(service, 'unknown'), currency)""")
FACT_SQL["group_trend"] = with_fact("""SELECT key, (clicks - prev_clicks) / abs(prev_clicks) * 100 AS change FROM g
  WHERE prev_clicks IS NOT NULL AND prev_clicks <> 0 AND (clicks - prev_clicks) / abs(prev_clicks) * 100 > 0""",
  "g AS (" + GROUPS["report_grouped_entities_saved_topic"].split(BASE, 1)[1].lstrip(",\n").replace("WITH ", "", 1) + ")")


# The greedy topic cover (R17) as a recursive CTE: after round r the unclaimed queries are exactly
# those containing none of the terms chosen so far.
def topic_ctes(seed: str) -> str:
    return f"""
docs AS (SELECT key AS doc, greatest(0, coalesce(impressions, 0)) AS w,
  list_distinct(list_filter(regexp_extract_all(lower(key), '[a-z0-9]+'), lambda t: length(t) >= 3
     AND NOT list_contains({STOPWORDS_SQL}, t) AND NOT list_contains(['brand#2', 'brand#17'], t)
     AND NOT regexp_matches(t, '^[0-9]+$'))) AS terms FROM ({seed}) WHERE key IS NOT NULL AND key <> ''),
dterms AS (SELECT doc, w, terms, unnest(terms) AS term FROM docs),
picks(r, chosen) AS (SELECT 0, CAST([] AS VARCHAR[])
  UNION ALL SELECT p.r + 1, list_append(p.chosen, b.term) FROM picks p,
  LATERAL (SELECT term FROM dterms WHERE NOT list_has_any(dterms.terms, p.chosen) GROUP BY term
           ORDER BY SUM(w + 1) DESC, term LIMIT 1) b WHERE p.r < 12),
clusters AS (SELECT CAST(r AS INTEGER) AS rank, 'auto_' || CAST(r AS VARCHAR) AS group_id, chosen[r] AS name, false AS priority,
  0 AS rule_pos, 'query' AS dimension, 'contains' AS op, chosen[r] AS value FROM picks WHERE r > 0)"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _topic_grouped() -> str:
    seed = seed_sql("by_property", "query", f"{WEB} AND {CUR}")
    s = lambda win, c: f"SUM(CASE WHEN {win} THEN r.{c} ELSE 0 END)"
    body = f"""
SELECT g.name AS key, CAST(coalesce({s(CUR, 'clicks')}, 0) AS BIGINT) AS clicks,
  CAST(coalesce({s(CUR, 'impressions')}, 0) AS BIGINT) AS impressions,
  coalesce({s(CUR, 'clicks')} / NULLIF({s(CUR, 'impressions')}, 0), 0.0) AS ctr,
  coalesce(SUM(CASE WHEN {CUR} THEN r.position * r.impressions ELSE 0 END) / NULLIF({s(CUR, 'impressions')}, 0), 0.0) AS position,
  false AS priority,
  CAST(coalesce({s(PREV, 'clicks')}, 0) AS BIGINT) AS prev_clicks,
  CAST(coalesce({s(PREV, 'impressions')}, 0) AS BIGINT) AS prev_impressions,
  coalesce({s(PREV, 'clicks')} / NULLIF({s(PREV, 'impressions')}, 0), 0.0) AS prev_ctr,
  coalesce(SUM(CASE WHEN {PREV} THEN r.position * r.impressions ELSE 0 END) / NULLIF({s(PREV, 'impressions')}, 0), 0.0) AS prev_position
FROM clusters g LEFT JOIN (SELECT * FROM by_property WHERE {WEB} AND ({CUR} OR {PREV}) AND query IS NOT NULL) r
  ON lower(r.query) LIKE '%' || lower(g.value) || '%'
GROUP BY g.name"""
    return recursive(with_base(body, topic_ctes(seed)))


def topic_by_property_sql(rounds: int = 12) -> str:
    seed = f"""SELECT property, query AS key, CAST(SUM(impressions) AS BIGINT) AS impressions FROM by_property
  WHERE {WEB} AND {CUR} AND query IS NOT NULL GROUP BY property, query"""
    docs = topic_ctes(seed).split("dterms AS", 1)[0].strip().rstrip(",").replace("SELECT key AS doc", "SELECT property, key AS doc", 1)
    ctes, chosen = [docs], []
    for r in range(1, rounds + 1):
        left = "docs d" if r == 1 else (f"docs d LEFT JOIN c{r - 1} c USING (property)")
        free = "" if r == 1 else "WHERE c.taken IS NULL OR NOT list_has_any(d.terms, c.taken)"
        ctes.append(f"""p{r} AS MATERIALIZED (SELECT property, term FROM (
  SELECT property, term, row_number() OVER (PARTITION BY property ORDER BY SUM(w + 1) DESC, term) AS n
  FROM (SELECT property, w, unnest(d.terms) AS term FROM {left} {free}) GROUP BY property, term) WHERE n = 1)""")
        chosen.append(f"SELECT property, {r} AS rank, term FROM p{r}")
        ctes.append(f"c{r} AS MATERIALIZED (SELECT property, list(term) AS taken FROM ({' UNION ALL '.join(chosen)}) GROUP BY property)")
    return with_base(f"SELECT property, CAST(rank AS INTEGER) AS rank, term AS value FROM ({' UNION ALL '.join(chosen)})", ",\n".join(ctes))


TOPIC_SQL = {
    # Round by round and property: the best term over the queries with none of the terms chosen for their property.
    "auto_topic_clusters_by_property": topic_by_property_sql(),
    "auto_topic_clusters": recursive(with_base("SELECT * FROM clusters", topic_ctes(seed_sql("by_property", "query", f"{WEB} AND {CUR}")))),
    "auto_suggest_topic": recursive(with_base("SELECT * FROM clusters", topic_ctes(seed_sql(
        "by_property", "query", f"{WEB} AND data_date BETWEEN DATE '1998-10-03' AND DATE '1998-12-31'")))),
    "report_grouped_entities_topic": _topic_grouped(),
}


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out.update(REPORTS)
    out.update(GROUPS)
    out.update(CONTROL_SQL)
    out.update(FACT_SQL)
    out.update(TOPIC_SQL)
    from clickstack.catalog import ALIASES

    for alias, target in ALIASES.items():
        if target in out:
            out[alias] = out[target]
    return out
