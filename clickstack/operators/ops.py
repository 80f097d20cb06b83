"""Operations jobs: usage, activity, invariants, billing, overview, alerts
(D16-D29, C5, C11, C13, L8, L9, A15).

Every job takes an explicit ``as_of`` instant; nothing reads the clock.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickstack.functions import dates, keys
from clickstack.sources.ingest import scratch

PROJECT_QPD = 30_000_000          # fixed value: per-project queries per day
STORAGE_USD_PER_GIB_MONTH = 0.02  # fixed value: storage price used for the estimate
ROW_CEILING = 50_000              # fixed value: rows per property, day and type from the API
ERRORS_PER_HOUR_ALERT = 20        # fixed value: collector-error alert threshold per hour
NO_SUCCESS_HOURS = 23             # fixed value: absence window of the no-collection alert


def _ts(x) -> F.Column:
    return F.lit(x).cast("timestamp")


def one_row(parts: Sequence[DataFrame]) -> DataFrame:
    """Side-by-side combination of one-row aggregates with distinct columns: union them (missing
    columns null) and take each column's only non-null value in one global aggregate."""
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    return u.agg(*[F.max(c).alias(c) for c in u.columns])


# D16 / D17 / C5 ---------------------------------------------------------------------------------
def period_pivot_sum(fact: DataFrame, cur, prev, key: str = "property_key", search_type: str = "web") -> DataFrame:
    """Current and prior clicks per source table in one scan (web)."""
    lo, hi = prev[0], cur[1]
    rows = fact.where((F.col("search_type") == search_type)
                      & F.col("data_date").between(F.lit(lo), F.lit(hi))
                      & F.col("data_month").between(F.lit(lo.replace(day=1)), F.lit(hi.replace(day=1))))
    s = lambda w: F.sum(F.when(F.col("data_date").between(F.lit(w[0]), F.lit(w[1])), F.col("clicks")).otherwise(0))
    return rows.groupBy(F.col(key).alias("source_table")).agg(s(cur).alias("clicks"), s(prev).alias("prev_clicks"))


def home_movers(fact: DataFrame, registry: DataFrame, assignment: DataFrame, as_of) -> DataFrame:
    """Per client, web clicks of the last 28 days (ending as_of − 3) vs the 28 before, from
    tracked properties only; delta and delta %."""
    end = as_of - dt.timedelta(days=3)
    cur = (end - dt.timedelta(days=27), end)
    prev = (cur[0] - dt.timedelta(days=28), cur[0] - dt.timedelta(days=1))
    per = period_pivot_sum(fact, cur, prev)
    tracked = registry.where(F.col("included")).select(F.col("property_id").alias("source_table"))
    j = per.join(tracked, "source_table").join(assignment.withColumnRenamed("property_id", "source_table"), "source_table")
    g = j.groupBy("client_id", "client_name").agg(F.sum("clicks").alias("clicks"), F.sum("prev_clicks").alias("prev_clicks"))
    return g.select(F.lit("client").alias("type"), F.col("client_id").alias("id"), F.col("client_name").alias("name"),
                    "clicks", "prev_clicks", (F.col("clicks") - F.col("prev_clicks")).alias("delta"),
                    F.when(F.col("prev_clicks") > 0, (F.col("clicks") - F.col("prev_clicks")) / F.col("prev_clicks") * 100)
                    .alias("delta_pct"))


def region_movers(fact: DataFrame, registry: DataFrame, region_of: F.Column, cur, prev) -> DataFrame:
    """The same pivot over properties of every export region, labelled by region."""
    per = period_pivot_sum(fact, cur, prev)
    reg = registry.select(F.col("property_id").alias("source_table"), region_of.alias("region"))
    return per.join(reg, "source_table").select("region", "source_table", "clicks", "prev_clicks")


# D18 / D19 / D26 / D28 / D29 / C11 --------------------------------------------------------------
def api_usage(attempts: DataFrame, as_of) -> DataFrame:
    """Per account: calls today (Pacific day of as_of), calls in the last 7×24 h, distinct
    tasks today."""
    now = _ts(as_of)
    today = dates.pacific_day(now)
    a = attempts.where(F.col("logged_at") >= now - F.expr("INTERVAL 7 DAYS"))
    is_today = dates.pacific_day(F.col("logged_at")) == today
    calls = F.coalesce(F.col("api_calls"), F.lit(0))
    return a.groupBy("account_id").agg(
        F.sum(F.when(is_today, calls).otherwise(0)).alias("calls_today"),
        F.sum(calls).alias("calls_7d"),
        F.count_distinct(F.when(is_today, F.col("task_id"))).alias("tasks_today"))


def collection_activity(attempts: DataFrame, as_of, days: int = 14) -> DataFrame:
    """Per Pacific day of the last ``days`` days: distinct tasks and rows collected."""
    now = _ts(as_of)
    n = max(1, int(days))
    a = attempts.where(F.col("logged_at") >= now - F.expr(f"INTERVAL {n} DAYS"))
    return a.groupBy(F.date_format(dates.pacific_day(F.col("logged_at")), "yyyy-MM-dd").alias("day")).agg(
        F.count_distinct("task_id").alias("tasks"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("n_rows"))


def quota_by_account(usage: DataFrame, accounts: DataFrame, registry: DataFrame) -> DataFrame:
    """C11: usage per account with its name (null account → 'unattributed') and the number of
    tracked properties it collects."""
    acct = F.coalesce(F.col("preferred_account_id"), F.col("account_ids")[0])
    props = (registry.where(F.col("included")).select(acct.alias("account_id")).where(F.col("account_id").isNotNull())
             .groupBy("account_id").agg(F.count(F.lit(1)).alias("properties")))
    j = usage.join(accounts.select("account_id", "display_name"), "account_id", "left").join(props, "account_id", "left")
    return j.select("account_id",
                    F.when(F.col("account_id").isNull(), F.lit("unattributed"))
                    .otherwise(F.coalesce("display_name", "account_id")).alias("display_name"),
                    F.when(F.col("account_id").isNull(), F.lit(0)).otherwise(F.coalesce("properties", F.lit(0))).alias("properties"),
                    "calls_today", "calls_7d", "tasks_today")


def capacity(usage: DataFrame, registry: DataFrame) -> DataFrame:
    """Average calls per active property today, % of the daily project quota used, and how
    many more properties fit at that average."""
    today = usage.agg(F.coalesce(F.sum("calls_today"), F.lit(0)).alias("today_calls"))
    active = registry.where(F.col("included")).agg(F.count(F.lit(1)).alias("active"))
    j = one_row([today, active])
    avg = F.col("today_calls") / F.greatest(F.lit(1), F.col("active"))
    headroom = F.greatest(F.lit(0), F.lit(PROJECT_QPD) - F.col("today_calls"))
    return j.select("today_calls", "active",
                    F.round(avg, 2).alias("avg_calls_per_property"),
                    F.round(F.col("today_calls") / F.lit(PROJECT_QPD) * 100, 4).alias("project_qpd_used_pct"),
                    F.when(avg > 0, F.floor(headroom / avg)).alias("est_more_properties"))


def row_ceiling(attempts: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Properties whose cell hit the 50,000-row API ceiling in the last 30 days."""
    now = _ts(as_of)
    return (attempts.where((F.col("row_count") >= ROW_CEILING) & (F.col("logged_at") > now - F.expr(f"INTERVAL {days} DAYS")))
            .select("property").distinct())


def recent_attempts(attempts: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Attempts logged in the last 7 days."""
    now = _ts(as_of)
    return attempts.where(F.col("logged_at") > now - F.expr(f"INTERVAL {days} DAYS")).agg(F.count(F.lit(1)).alias("n"))


# D20 / D21 / D22 / D27 --------------------------------------------------------------------------
def anomaly_pct(totals: DataFrame, by: Sequence[str] = ("property",)) -> DataFrame:
    """Σ impressions of anonymized rows / Σ impressions of all totals rows (raw + delta)."""
    i = F.col("impressions")
    return totals.groupBy(*by).agg(F.try_divide(F.sum(F.when(F.col("is_anonymized"), i).otherwise(0)), F.sum(i)).alias("anomaly_pct"))


def _repeated(rows: DataFrame) -> DataFrame:
    """The row hashes stored more than once. A hash covers its day, so equal ones lie in one month: 64 bits of it and the
    month go through the shuffle first, the hashes themselves only of the few rows whose bits are found again."""
    place = [c for c in ("data_month",) if c in rows.columns]
    bits = rows.select(*place, F.xxhash64("row_hash").alias("bits"))
    again = bits.groupBy(*place, "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*[F.col(c).alias(f"_{c}") for c in (*place, "bits")])
    path = scratch(rows.sparkSession, "repeated")  # stored, so that the join knows how few they are and leaves the rows in place
    again.write.parquet(path)
    again = rows.sparkSession.read.parquet(path)
    own = rows.select(*place, F.xxhash64("row_hash").alias("bits"), "row_hash")
    found = own.join(again, [own[c] == again[f"_{c}"] for c in (*place, "bits")], "left_semi")
    return found.groupBy("row_hash").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)


def row_hash_invariant(tables: dict[str, DataFrame], as_of=None, since_days: int | None = None) -> DataFrame:
    """Per table the number of row hashes stored more than once (optionally over the last
    ``since_days`` days only), and whether all tables are clean."""
    parts = []
    for name, df in tables.items():
        d = df
        if since_days and as_of is not None:
            lo = as_of - dt.timedelta(days=int(since_days))
            d = d.where((F.col("data_date") >= F.lit(lo)) & (F.col("data_month") >= F.lit(lo.replace(day=1))))
        dup = _repeated(d)
        parts.append(dup.agg(F.count(F.lit(1)).alias("duplicates")).select(F.lit(name).alias("view"), "duplicates"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def storage_summary(spark, paths: dict[str, str]) -> DataFrame:
    """Files, rows and bytes per stored table. Rows come from the footers (the count is pushed down to the files), files
    and bytes from the file listing: no data page is read."""
    footers = spark.newSession()  # settings of its own: nothing else that runs is planned by them
    footers.conf.set("spark.sql.sources.useV1SourceList", "")
    footers.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    rows = []
    for name, path in paths.items():
        n = footers.read.parquet(path).agg(F.count(F.lit(1)).alias("n")).first().n
        files = (footers.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
                 .agg(F.count("path").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes")).first())
        rows.append((name, files.files, n, files.n_bytes))
    out = spark.createDataFrame(rows, "dataset string, files long, n_rows long, n_bytes long")  # one row per table
    return out.withColumn("est_monthly_storage_usd",
                          F.round(F.col("n_bytes") / F.lit(1024 ** 3) * STORAGE_USD_PER_GIB_MONTH, 2))


def table_name_collisions(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Sanitized names shared by more than one distinct URL: one row per colliding URL with
    the name's URL count (no per-name collection, however many URLs collide)."""
    pairs = urls.select(keys.property_key(F.col(url_col)).alias("name"), F.col(url_col).alias("url")).distinct()
    counts = pairs.groupBy("name").agg(F.count(F.lit(1)).alias("urls")).where(F.col("urls") > 1)
    return pairs.join(counts, "name").select("name", "urls", "url")


# A15 / D23 / D24 --------------------------------------------------------------------------------
def billing_export(events: DataFrame) -> DataFrame:
    """A billing export shaped like the standard one (nested ``service`` struct), one line per
    event: the event type stands for the service, value for the cost."""
    svc = (F.when(F.col("event_type") == "purchase", "BigQuery").when(F.col("event_type") == "view", "Cloud Run")
           .when(F.col("event_type") == "click", "Cloud Tasks").when(F.col("event_type") == "signup", "Firestore")
           .otherwise("Cloud Storage"))
    return events.select(F.struct(svc.alias("description")).alias("service"),
                         F.when(F.col("user_id") % 5 == 0, "EUR").otherwise("USD").alias("currency"),
                         F.col("value").alias("cost"), F.col("ts").cast("timestamp").alias("usage_start_time"))


def billing_scan(billing: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Billing lines of the last 30 days."""
    return billing.where(F.col("usage_start_time") >= _ts(as_of) - F.expr(f"INTERVAL {days} DAYS"))


def billing_by_service(billing: DataFrame, as_of) -> DataFrame:
    """Cost per service and currency over 30 days, rounded to cents (per-currency rows;
    a grand total across currencies is what the source system shows, see ``billing_total``)."""
    b = billing_scan(billing, as_of)
    return (b.groupBy(F.coalesce(F.col("service.description"), F.lit("unknown")).alias("service"), "currency")
            .agg(F.round(F.sum("cost"), 2).alias("cost")))


def billing_total(by_service: DataFrame) -> DataFrame:
    """D23 total: the sum of the rounded service costs, across currencies, rounded again."""
    return by_service.agg(F.round(F.sum("cost"), 2).alias("total"))


def billing_status(billing: DataFrame, as_of, days: int = 45) -> DataFrame:
    """Rows and latest usage day over the last 45 days."""
    b = billing.where(F.col("usage_start_time") >= _ts(as_of) - F.expr(f"INTERVAL {days} DAYS"))
    return b.agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.to_date("usage_start_time")).alias("latest_day"))


# D25 --------------------------------------------------------------------------------------------
def overview(accounts: DataFrame, registry: DataFrame, prop_status: DataFrame, ledger: DataFrame,
             storage: DataFrame, usage: DataFrame, activity: DataFrame) -> DataFrame:
    """One row: accounts (all / healthy), properties (tracked / available), fact rows and their estimated
    monthly storage cost (D22), API calls today, open errors, newest final collected day, and the activity of the
    last days (D19) as ``day:tasks:rows``, by day."""
    a = accounts.agg(F.count(F.lit(1)).alias("accounts"),
                     F.sum(F.when(F.col("token_health") == "valid", 1).otherwise(0)).alias("healthy_accounts"))
    p = registry.agg(F.sum(F.when(F.col("included"), 1).otherwise(0)).alias("tracking"),
                     F.count(F.lit(1)).alias("total_properties"))
    r = storage.agg(F.sum("n_rows").alias("rows"),
                    F.round(F.sum("n_bytes") / F.lit(1024 ** 3) * STORAGE_USD_PER_GIB_MONTH, 2).alias("est_monthly_storage_usd"))
    line = F.concat_ws(":", "day", F.col("tasks").cast("string"), F.col("n_rows").cast("string"))
    t = activity.agg(F.array_join(F.array_sort(F.collect_list(line)), ",").alias("activity"))  # one entry a day
    u = usage.agg(F.coalesce(F.sum("calls_today"), F.lit(0)).alias("api_calls_today"))
    e = ledger.agg(F.sum(F.when(F.col("status") == "error", 1).otherwise(0)).alias("open_errors"))
    lf = prop_status.agg(F.max(F.when(F.col("data_state") == "final", F.col("last_collected_date"))).alias("latest_final_date"))
    out = one_row([a, p, r, u, e, lf, t])
    return out.withColumn("available", F.col("total_properties") - F.col("tracking"))


# C13 --------------------------------------------------------------------------------------------
def totals_delta(totals_raw: DataFrame, by_property: DataFrame) -> DataFrame:
    """Per (property, day, type): total − Σ byProperty clicks and impressions, clamped at 0."""
    k = ["property", "data_date", "search_type"]
    bp = by_property.groupBy(*k).agg(F.sum("clicks").alias("bp_clicks"), F.sum("impressions").alias("bp_impr"))
    t = totals_raw.where(~F.col("is_anonymized")).select(*k, "clicks", "impressions")
    return t.join(bp, k, "left").select(
        *k, F.greatest(F.lit(0), F.col("clicks") - F.coalesce("bp_clicks", F.lit(0))).alias("delta_clicks"),
        F.greatest(F.lit(0), F.col("impressions") - F.coalesce("bp_impr", F.lit(0))).alias("delta_impressions"))


# L8 / L9 ----------------------------------------------------------------------------------------
def health_checks(dedup: DataFrame, collisions: DataFrame, ceiling: DataFrame, recent: DataFrame,
                  latest_export: DataFrame, accounts: DataFrame) -> DataFrame:
    """One (check, ok, detail) row per check, each a one-row aggregate."""
    # Check names and detail wording of the report.
    c1 = dedup.agg(F.coalesce(F.sum("duplicates"), F.lit(0)).alias("d")).select(
        F.lit("Dedup invariant (row_hash)").alias("check"), (F.col("d") == 0).alias("ok"),
        F.concat(F.col("d").cast("string"), F.lit(" duplicate hash(es)")).alias("detail"))
    c2 = collisions.select("name").distinct().agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("Table-name collisions").alias("check"), (F.col("n") == 0).alias("ok"),
        F.concat(F.col("n").cast("string"), F.lit(" colliding name(s)")).alias("detail"))
    c3 = ceiling.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("API row ceiling").alias("check"), F.lit(True).alias("ok"),
        F.concat(F.col("n").cast("string"), F.lit(" propert(ies) at the 50K/day limit")).alias("detail"))
    c4 = recent.select(F.lit("Recent collection").alias("check"), (F.col("n") > 0).alias("ok"),
                       F.concat(F.col("n").cast("string"), F.lit(" attempts in 7d")).alias("detail"))
    c5 = latest_export.select(F.lit("Export readable").alias("check"), F.lit(True).alias("ok"),
                              F.concat(F.lit("latest export "), F.coalesce(F.col("latest").cast("string"), F.lit("none"))).alias("detail"))
    c6 = accounts.agg(F.count(F.lit(1)).alias("n"),
                      F.sum(F.when(F.col("token_health") == "valid", 1).otherwise(0)).alias("v")).select(
        F.lit("Accounts connected").alias("check"), (F.col("v") > 0).alias("ok"),
        F.concat(F.col("n").cast("string"), F.lit(" account(s)")).alias("detail"))
    return c1.unionByName(c2).unionByName(c3).unionByName(c4).unionByName(c5).unionByName(c6)


def error_bursts(attempts: DataFrame, threshold: int = ERRORS_PER_HOUR_ALERT) -> DataFrame:
    """Hourly collector-error counts above ``threshold`` (tumbling 1-hour windows)."""
    e = attempts.where(F.col("status") == "error")
    g = e.groupBy(F.window("logged_at", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("errors"))
    return g.where(F.col("errors") > threshold).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "errors")


def success_gaps(attempts: DataFrame, as_of, by: Sequence[str] = (), hours: int = NO_SUCCESS_HOURS) -> DataFrame:
    """The times without a successful collection for at least ``hours`` (per ``by``), the one up to ``as_of`` included:
    ``gap_start, gap_end, open``. Successes are first reduced to the first and last of an hour, so what is ordered per group
    grows with time and not with the log."""
    now = _ts(as_of)
    ok = attempts.where(F.col("status").startswith("collected_") & (F.col("logged_at") <= now))
    hour = ok.groupBy(*by, F.date_trunc("hour", "logged_at").alias("hour")).agg(F.min("logged_at").alias("first"), F.max("logged_at").alias("last"))
    return gaps_between(hour, as_of, by, hours)


def gaps_between(hourly: DataFrame, as_of, by: Sequence[str] = (), hours: int = NO_SUCCESS_HOURS) -> DataFrame:
    """The gaps of ``success_gaps`` out of the ``first`` and ``last`` success of each hour."""
    now = _ts(as_of)
    w = Window.partitionBy(*by).orderBy("first")
    then = hourly.select(*by, F.col("last").alias("gap_start"), F.lead("first").over(w).alias("next"))
    out = then.select(*by, "gap_start", F.coalesce("next", now).alias("gap_end"), F.col("next").isNull().alias("open"))
    return out.where(F.col("gap_end") >= F.col("gap_start") + F.expr(f"INTERVAL {hours} HOURS"))


def ops_alerts(attempts: DataFrame, dedup: DataFrame, as_of) -> DataFrame:
    """The three alert conditions as rows (alert, firing, detail): error bursts, no successful
    collection within 23 hours of as_of, any duplicate row hash."""
    now = _ts(as_of)
    bursts = error_bursts(attempts).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("collector_errors").alias("alert"), (F.col("n") > 0).alias("firing"),
        F.concat(F.col("n").cast("string"), F.lit(" hour(s) over threshold")).alias("detail"))
    ok = attempts.where(F.col("status").startswith("collected_") & (F.col("logged_at") <= now))
    last = ok.agg(F.max("logged_at").alias("t")).select(
        F.lit("no_collection").alias("alert"),
        (F.col("t").isNull() | (F.col("t") < now - F.expr(f"INTERVAL {NO_SUCCESS_HOURS} HOURS"))).alias("firing"),
        F.concat(F.lit("last success "), F.coalesce(F.date_format("t", "yyyy-MM-dd HH:mm:ss"), F.lit("never"))).alias("detail"))
    dup = dedup.agg(F.coalesce(F.sum("duplicates"), F.lit(0)).alias("d")).select(
        F.lit("dedup_violation").alias("alert"), (F.col("d") > 0).alias("firing"),
        F.concat(F.col("d").cast("string"), F.lit(" duplicate hash(es)")).alias("detail"))
    return bursts.unionByName(last).unionByName(dup)
