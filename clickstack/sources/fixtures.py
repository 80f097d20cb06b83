"""Search-performance inputs derived from the TPC-H-style test tables.

``search_raw`` turns every lineitem into one raw search row (property, type, query, page, country,
device, metrics). ``attempts`` turns every event into one collection-attempt log row. The control
tables (registry, groups, clients, semantic groups) are derived from those or are small declared
configuration joined against them.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickstack.functions import keys
from clickstack.sources import tables

# Fixed values of the fixture mapping.
FRESH_FROM = dt.date(2001, 10, 1)          # rows on or after this day are provisional
COLLECTED_AT = dt.datetime(2001, 11, 5)    # stamped on every stored fact row (UTC)
LEDGER_ANCHOR = dt.date(2024, 1, 30)       # attempts: data_date = anchor − event_id % 50
BRAND_TERMS = ("brand#2", "brand#17")


def site_url(k) -> F.Column:
    """Property URL for site index k (0-5 url-prefix, 6-7 domain)."""
    return F.when(k < 6, F.concat(F.lit("https://www.site"), k.cast("string"), F.lit(".example.com/"))) \
        .otherwise(F.concat(F.lit("sc-domain:site"), (k - 6).cast("string"), F.lit(".example.com")))


def search_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw search row per lineitem. Joins run orders-side first so the lineitem stream
    shuffles once per key (orderkey, then partkey); the tiny nation table comes last, so that its names
    are not shuffled, and is broadcast by Spark's size statistics, not by a hint."""
    r = lambda n: tables.read(spark, sf_dir, n)
    nation = r("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.lower("n_name").alias("country"))
    cust = r("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    order_nation = (r("orders").select("o_orderkey", "o_custkey").join(cust, "o_custkey")
                    .select(F.col("o_orderkey").alias("l_orderkey"), "c_nationkey"))
    part = r("part").selectExpr(
        "p_partkey AS l_partkey",
        """CASE WHEN p_partkey % 5 = 0 THEN p_name
                WHEN p_partkey % 5 = 1 THEN concat('how to fix ', p_name)
                WHEN p_partkey % 5 = 2 THEN concat('buy ', p_name)
                WHEN p_partkey % 5 = 3 THEN concat(lower(p_brand), ' ', p_name)
                ELSE concat('best ', p_name, ' for ', lower(p_type)) END AS query_text""",
        """CASE WHEN p_partkey % 25 = 0 THEN ''
                ELSE concat(lower(p_type), '/', CAST(p_partkey % 20 AS STRING)) END AS page_path""",
        "p_partkey % 11 = 0 AS is_anonymized",
    )
    li = r("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                              "l_discount", "l_returnflag", "l_shipdate")
    j = li.join(order_nation, "l_orderkey").join(part, "l_partkey").join(nation, "c_nationkey")
    k = F.col("l_suppkey") % 8
    return j.select(
        F.col("l_shipdate").cast("date").alias("data_date"),
        site_url(k).alias("property"),
        F.expr("""CASE WHEN l_linenumber <= 4 THEN 'web' WHEN l_linenumber = 5 THEN 'image'
                       WHEN l_linenumber = 6 THEN 'news' ELSE 'discover' END""").alias("search_type"),
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("string")).otherwise(F.col("query_text")).alias("query"),
        F.concat(F.lit("https://www.site"), k.cast("string"), F.lit(".example.com/"), F.col("page_path")).alias("page"),
        F.col("country"),
        F.expr("""CASE WHEN l_linenumber = 7 THEN NULL WHEN l_returnflag = 'A' THEN 'DESKTOP'
                       WHEN l_returnflag = 'N' THEN 'MOBILE' ELSE 'TABLET' END""").alias("device"),
        F.expr("CAST(floor(CAST(round(l_discount * 100) AS BIGINT) * (CAST(l_quantity AS BIGINT) - 1) / 5) AS BIGINT)").alias("clicks"),
        F.expr("(CAST(l_quantity AS BIGINT) - 1) * 20").alias("impressions"),
        F.expr("1 + CAST((l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 480 AS DOUBLE) / 8").alias("position"),
        F.col("is_anonymized"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One collection-attempt log row per event (a projection: no shuffle)."""
    ev = tables.read(spark, sf_dir, "events")
    k = F.col("user_id") % 8
    url = site_url(k)
    data_date = F.date_sub(F.lit(LEDGER_ANCHOR), (F.col("event_id") % 50).cast("int"))
    return ev.select(
        F.col("event_id"),
        keys.task_id(keys.property_key(url), F.lit("web"), F.lit("byProperty"), data_date).alias("task_id"),
        url.alias("property"),
        F.lit("web").alias("search_type"),
        F.lit("byProperty").alias("aggregation"),
        data_date.alias("data_date"),
        F.when(F.col("user_id") % 7 == 6, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("acct"), (F.col("user_id") % 7).cast("string"))).alias("account_id"),
        F.expr("""CASE event_type WHEN 'purchase' THEN 'collected_with_data' WHEN 'signup' THEN 'collected_no_data'
                  WHEN 'view' THEN 'collected_fresh' WHEN 'click' THEN 'queued' ELSE 'error' END""").alias("status"),
        (F.col("event_id") % 9 + 1).alias("attempt"),
        F.when(F.col("event_type") == "purchase", F.floor("value").cast("long") * 150).alias("row_count"),
        F.when(F.col("user_id") % 10 == 0, F.lit(None).cast("long")).otherwise(F.col("event_id") % 4 + 1).alias("api_calls"),
        F.expr("""CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 4 = 0 THEN 'quotaExceeded: try again'
                  WHEN event_id % 4 = 1 THEN 'invalid_grant'
                  WHEN event_id % 4 = 2 THEN 'Requests for Discover cannot be grouped by device'
                  ELSE 'backendError' END""").alias("error_message"),
        F.col("ts").cast("timestamp").alias("logged_at"),
    )


# Fixed configuration: legacy groups (group A = sites 0-2, group B = sites 2-4, so site 2 is in
# both and "first group wins" applies; group C holds site 0 and its domain property, a
# double-count risk), and the property settings applied to every property.
GROUPS = [
    ("grp_a", "Group A", [0, 1, 2], True),
    ("grp_b", "Group B", [2, 3, 4], False),
    ("grp_c", "Group C", [0, 6], True),
]
NATIVE_SITES = [5]        # site indexes read from a bulk export rather than collected
NO_DASHBOARD_SITES = [4]  # tracked, but without a dashboard
NO_DASHBOARD_GROUPS = ["grp_c"]
REPORT_DAY = dt.date(1998, 12, 31)  # last day of the default reports
UNTRACKED_SITES = [7]     # discovered but not tracked
PROPERTY_CONFIG = {"types": ["web", "image", "news", "discover"],
                   "aggregations": ["byProperty", "byPage", "totals"],
                   "offset_days": 3, "backfill_months": 1}


def site_index(url_col) -> F.Column:
    """Inverse of ``site_url`` for the fixture hosts."""
    n = F.regexp_extract(url_col, r"site(\d+)\.example\.com", 1).try_cast("int")
    return F.when(url_col.startswith("sc-domain:"), n + 6).otherwise(n)


def settings(observations: DataFrame) -> DataFrame:
    """How the fixture sites start in the registry: one row per observed property of the fixture."""
    props = observations.select("property").distinct().withColumn("site", site_index(F.col("property"))).where("site is not null")
    native, cfg = F.col("site").isin(NATIVE_SITES), PROPERTY_CONFIG
    return props.select(
        "property", F.when(native, F.lit("native_export")).otherwise(F.lit("api")).alias("source"),
        (native | ~F.col("site").isin(UNTRACKED_SITES)).alias("included"),
        F.struct(F.array(*[F.lit(t) for t in cfg["types"]]).alias("types"),
                 F.array(*[F.lit(a) for a in cfg["aggregations"]]).alias("aggregations"),
                 F.lit(cfg["offset_days"]).alias("offset_days"),
                 F.lit(cfg["backfill_months"]).alias("backfill_months")).alias("config"),
        F.array(*[F.lit(b) for b in BRAND_TERMS]).alias("brand_terms"))


def merged(observations: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The registry (E3) of ``observations`` with the fixture's settings."""
    from clickstack.operators import ledger

    return ledger.registry_merge(observations, settings(observations), existing)


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property registry: one row per property seen in the attempt log (E3 shape), with its
    accounts, first/last sighting and configuration."""
    return merged(attempts(spark, sf_dir))


def group_members(spark: SparkSession, sf_dir: str, registry_df: DataFrame | None = None) -> DataFrame:
    """(group_id, name, materialize, group_pos, member_pos, property) for the declared groups,
    resolved against the registry."""
    rows = [(g, n, m, gpos, pos, idx) for gpos, (g, n, members, m) in enumerate(GROUPS)
            for pos, idx in enumerate(members)]
    decl = spark.createDataFrame(rows, "group_id string, name string, materialize boolean, group_pos int, "
                                       "member_pos int, site int")
    reg = (registry_df if registry_df is not None else registry(spark, sf_dir))
    reg = reg.select("property", site_index(F.col("property")).alias("site"))
    return decl.join(reg, "site").drop("site")


SAVED_TOPIC_GROUPS = [
    ("widgets", "Widgets", [("query", "contains", "widget")], True),
    ("how_to", "How-to", [("query", "regex", "^how to"), ("query", "starts_with", "how ")], False),
    ("gears", "Gears", [("query", "equals", "hot gear"), ("query", "contains", "gear")], False),
]
SAVED_CONTENT_GROUPS = [
    ("economy", "Economy", [("page", "contains", "/economy/")], False),
    ("small", "Small", [("page", "starts_with", "https://www.site0.example.com/small")], False),
]


def dashboards(registry_df: DataFrame, members: DataFrame) -> DataFrame:
    """The targets whose dashboard is switched on: tracked properties and groups but for the ones named."""
    own = registry_df.where(F.col("included") & ~site_index(F.col("property")).isin(NO_DASHBOARD_SITES))
    groups = members.where(~F.col("group_id").isin(NO_DASHBOARD_GROUPS)).select("group_id").distinct()
    return own.select(F.concat(F.lit("property:"), "property_id").alias("target_id")).unionByName(
        groups.select(F.concat(F.lit("group:"), "group_id").alias("target_id")))


def semantic_groups(spark: SparkSession, kind: str = "topic") -> DataFrame:
    """Saved semantic groups as data: one row per rule (group_id, name, priority, rule_pos,
    dimension, op, value)."""
    src = SAVED_TOPIC_GROUPS if kind == "topic" else SAVED_CONTENT_GROUPS
    rows = [(gid, name, pri, i, d, op, v) for gid, name, rules, pri in src for i, (d, op, v) in enumerate(rules)]
    return spark.createDataFrame(rows, "group_id string, name string, priority boolean, rule_pos int, "
                                       "dimension string, op string, value string")
