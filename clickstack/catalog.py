"""Named queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator of the inventory.

Every query reads the warehouse (derived once from the given tables) or the raw tables, over the
whole data; parameters are the defaults of the report they stand for.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickstack.functions.filters import Filters
from clickstack.operators import reports as R
from clickstack.sources import fixtures
from clickstack.sources.warehouse import control, fact

QueryFn = Callable[[SparkSession, str], DataFrame]

# The default report: all properties, web, calendar 1998 vs the previous 365 days.
DEFAULT = Filters(start=dt.date(1998, 1, 1), end=dt.date(1998, 12, 31), brand_terms=fixtures.BRAND_TERMS,
                  compare_mode="previous")


def bp(spark, d):
    return fact(spark, d, "by_property")


def pg(spark, d):
    return fact(spark, d, "by_page")


def tot(spark, d):
    return fact(spark, d, "totals")


REPORTS: dict[str, QueryFn] = {
    "report_kpis": lambda s, d: R.report_kpis(bp(s, d), DEFAULT),
    "report_timeseries": lambda s, d: R.report_timeseries(bp(s, d), DEFAULT, "day"),
    "report_timeseries_week": lambda s, d: R.report_timeseries(bp(s, d), DEFAULT, "week"),
    "report_timeseries_month": lambda s, d: R.report_timeseries(bp(s, d), DEFAULT, "month"),
    "report_timeseries_compare": lambda s, d: R.report_timeseries(bp(s, d), DEFAULT, "day", series="compare"),
    "report_top_queries": lambda s, d: R.report_top_queries(bp(s, d), DEFAULT),
    "report_top_pages": lambda s, d: R.report_top_pages(pg(s, d), DEFAULT),
    "top_with_prev_exact": lambda s, d: R.top_with_prev(bp(s, d), DEFAULT, "query", limit=None),
    "report_breakdown": lambda s, d: R.report_breakdown(bp(s, d), DEFAULT, "device"),
    "report_breakdown_country": lambda s, d: R.report_breakdown(bp(s, d), DEFAULT, "country"),
    "report_position_buckets": lambda s, d: R.report_position_buckets(bp(s, d), DEFAULT),
    "report_ctr_scatter": lambda s, d: R.report_ctr_scatter(bp(s, d), DEFAULT),
    "report_striking_distance": lambda s, d: R.report_striking_distance(bp(s, d), DEFAULT),
    "report_movers": lambda s, d: R.report_movers(bp(s, d), DEFAULT, "query"),
    "report_movers_page": lambda s, d: R.report_movers(pg(s, d), DEFAULT, "page"),
    "report_ctr_benchmark": lambda s, d: R.report_ctr_benchmark(bp(s, d), DEFAULT),
    "report_ctr_curve": lambda s, d: R.report_ctr_curve(bp(s, d), DEFAULT),
    "report_cannibalization": lambda s, d: R.report_cannibalization(pg(s, d), DEFAULT),
    "report_content_decay": lambda s, d: R.report_content_decay(pg(s, d), DEFAULT),
    "report_brand_split": lambda s, d: R.report_brand_split(bp(s, d), DEFAULT),
    "report_brand_timeseries": lambda s, d: R.report_brand_timeseries(bp(s, d), DEFAULT),
}


def queries() -> dict[str, QueryFn]:
    out: dict[str, QueryFn] = {}
    out.update(REPORTS)
    out.update(_groups())
    out.update(_ledger_queries())
    out.update(_fact_queries())
    out.update(_streaming_queries())
    out.update(_more_queries())
    for alias, target in ALIASES.items():
        out[alias] = out[target]
    return out


# Groups (R10, R16-R18, C9, D13) ------------------------------------------------------------------
def _groups():
    from clickstack.functions import filters as flt
    from clickstack.functions import text
    from clickstack.operators import groups as G
    from clickstack.operators import metrics as M
    from clickstack.sources import tables

    def seed_pages(s, d):
        return G.seed_entities(pg(s, d), flt.without_segment(DEFAULT), "page")

    def seed_queries(s, d):
        return G.seed_entities(bp(s, d), DEFAULT, "query")

    def topic_clusters_by_property(s, d):
        seed = G.seed_entities(bp(s, d), DEFAULT, "query", by=["property"])
        return G.auto_topic_clusters(seed, fixtures.BRAND_TERMS, ["property"]).select("property", "rank", "value")

    def saved(s, kind):
        return fixtures.semantic_groups(s, kind)

    def group_rules(s, d):
        keys = (bp(s, d).where(flt.to_column(DEFAULT.replace(start=dt.date(1995, 1, 1), end=dt.date(2001, 12, 31)),
                                             require_query=True))
                .select("query", F.lit(None).cast("string").alias("page")).distinct())
        return G.match_groups(keys, saved(s, "topic")).select("group_id", "query")

    def grouped_metrics(s, d):
        rules = {}
        for gid, name, rl, _ in fixtures.SAVED_TOPIC_GROUPS:
            rules[gid] = flt.rule_match([{"dimension": a, "op": b, "value": c} for a, b, c in rl])
        rows = bp(s, d).where(flt.to_column(DEFAULT, require_query=True))
        return M.grouped_metrics(rows, list(rules.values()))

    def first_segment(s, d):
        p = tables.read(s, d, "pages")
        return p.select("page_id", "url", text.first_segment(F.col("url")).alias("segment"))

    def pages_content_groups(s, d):
        p = tables.read(s, d, "pages").select(F.col("url").alias("key"), F.col("page_id").alias("impressions"))
        return G.auto_content_groups(p)

    def title_case(s, d):
        p = tables.read(s, d, "pages")
        seg = text.first_segment(F.col("url"))
        return p.select("page_id", text.title_case(seg).alias("name"))

    def tokenize(s, d):
        q = bp(s, d).where(F.col("query").isNotNull()).select("query").distinct()
        return q.select("query", F.explode(text.tokenize(F.col("query"), fixtures.BRAND_TERMS)).alias("token"))

    return {
        "auto_content_groups": lambda s, d: G.auto_content_groups(seed_pages(s, d)),
        "auto_content_groups_pages": pages_content_groups,
        "auto_topic_clusters": lambda s, d: G.auto_topic_clusters(seed_queries(s, d), fixtures.BRAND_TERMS),
        "auto_topic_clusters_by_property": topic_clusters_by_property,
        "auto_suggest_content": lambda s, d: G.auto_suggest(pg(s, d), "content", DEFAULT.end, fixtures.BRAND_TERMS),
        "auto_suggest_topic": lambda s, d: G.auto_suggest(bp(s, d), "topic", DEFAULT.end, fixtures.BRAND_TERMS),
        "report_grouped_entities_content": lambda s, d: G.report_grouped_entities(pg(s, d), DEFAULT, "content"),
        "report_grouped_entities_topic": lambda s, d: G.report_grouped_entities(bp(s, d), DEFAULT, "topic"),
        "report_grouped_entities_saved_topic": lambda s, d: G.report_grouped_entities(bp(s, d), DEFAULT, "topic", saved(s, "topic")),
        "report_grouped_entities_saved_content": lambda s, d: G.report_grouped_entities(pg(s, d), DEFAULT, "content", saved(s, "content")),
        "group_rules": group_rules,
        "grouped_metrics": grouped_metrics,
        "first_segment": first_segment,
        "title_case": title_case,
        "tokenize": tokenize,
    }


# Control plane: attempts, ledger, registry, accounts ----------------------------------------------
LEDGER_AS_OF = dt.date(2024, 2, 1)                 # reconcile / coverage day
OPS_AS_OF = dt.datetime(2024, 1, 30, 12, 0, 0)     # instant for usage, activity and alert jobs
FACT_AS_OF = fixtures.REPORT_DAY                 # precompute and home movers day


def _ts_text(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def attempts(s, d):
    return control(s, d, "attempts")


def ledger_df(s, d):
    return control(s, d, "ledger")


def registry_df(s, d):
    return control(s, d, "registry")


def _ledger_queries():
    from clickstack.functions import dates, keys, status, text
    from clickstack.operators import ledger as L
    from clickstack.operators import ops as O
    from clickstack.sources import tables

    def reg_out(r):
        return r.select("property_id", "site_url", "property_type", "source", "included",
                        F.array_join("account_ids", ",").alias("account_ids"), "preferred_account_id",
                        _ts_text(F.col("discovered_at")).alias("discovered_at"),
                        _ts_text(F.col("last_seen_at")).alias("last_seen_at"))

    def ledger_out(lg):
        return lg.select("task_id", "property_id", "search_type", "aggregation", "data_date", "status", "attempts",
                         "account_id")

    def members(s, d):
        return control(s, d, "members")

    def assignment(s, d):
        return control(s, d, "assignment")

    def pstatus(s, d):
        return L.property_status(registry_df(s, d), attempts(s, d))

    def accts(s, d):
        return control(s, d, "accounts")

    def usage(s, d):
        return O.api_usage(attempts(s, d), OPS_AS_OF)

    def planned(s, d):
        return L.reconcile(registry_df(s, d), ledger_df(s, d), LEDGER_AS_OF)

    def billing(s, d):
        return O.billing_export(tables.read(s, d, "events"))

    def dedup(s, d):
        return O.row_hash_invariant({"by_property": bp(s, d), "by_page": pg(s, d), "totals": tot(s, d)})

    def page_urls(s, d):
        return tables.read(s, d, "pages").select("url")

    def url_keys(s, d):
        u = page_urls(s, d).unionByName(registry_df(s, d).select(F.col("site_url").alias("url"))).distinct()
        return u.select("url", keys.property_key(F.col("url")).alias("property_key"),
                        keys.property_key_disambiguated(F.col("url")).alias("property_key_disambiguated"),
                        keys.property_type(F.col("url")).alias("property_type"),
                        text.client_name(F.col("url")).alias("client_name"))

    def iso_dates(s, d):
        ev = tables.read(s, d, "events")
        txt = F.concat(F.lit("2024-"), F.lpad(((F.col("event_id") % 14)).cast("string"), 2, "0"), F.lit("-"),
                       F.lpad(((F.col("user_id") % 33)).cast("string"), 2, "0"))
        return ev.select("event_id", txt.alias("text"), dates.valid_iso_date(txt).alias("valid"))

    def cells(s, d):
        r = registry_df(s, d)
        return (r.select("property_id", F.explode("config.types").alias("search_type"))
                .select("property_id", "search_type", F.explode(F.array(*[F.lit(a) for a in
                        ["byProperty", "byPage", "totals"]])).alias("aggregation")))

    def combos(s, d):
        c = cells(s, d)
        return c.select("property_id", "search_type", "aggregation",
                        status.valid_combo(F.col("search_type"), F.col("aggregation")).alias("valid"),
                        F.array_join(status.dims_for(F.col("aggregation"), F.col("search_type")), ",").alias("dims"))

    def classified(s, d):
        a = attempts(s, d).where(F.col("status") == "error")
        return a.select("event_id", "error_message",
                        status.retryable_error(F.col("error_message")).alias("retryable"),
                        status.token_error_class(F.col("error_message")).alias("token_class"),
                        status.dead_letter(F.col("error_message"), F.col("attempt")).alias("next_status"))

    def finality(s, d):
        a = attempts(s, d).where(F.col("status").startswith("collected_"))
        fi = F.date_sub(F.lit(LEDGER_AS_OF), 3)
        fin = status.day_final(F.col("data_date"), fi, F.lit(LEDGER_AS_OF))
        return a.select("event_id", "data_date", fin.alias("is_final"),
                        status.collect_status(fin, F.col("row_count")).alias("collect_status"))

    def pacific(s, d):
        return attempts(s, d).select("event_id", dates.pacific_day(F.col("logged_at")).alias("pt_day"))

    def windows(s, d):
        r = registry_df(s, d)
        oldest, newest = dates.collection_window(F.lit(LEDGER_AS_OF), F.col("config.offset_days"),
                                                 F.col("config.backfill_months"))
        return r.select("property_id", oldest.alias("oldest"), newest.alias("newest"))

    def days(s, d):
        w = windows(s, d)
        rev = w.select("property_id", F.col("newest").alias("oldest"), F.col("oldest").alias("newest"))
        both = w.withColumn("reversed", F.lit(False)).unionByName(rev.withColumn("reversed", F.lit(True)))
        return both.select("property_id", "reversed", F.explode_outer(dates.days_in_range("oldest", "newest")).alias("day"))

    def months(s, d):
        return bp(s, d).select("data_month").distinct()

    def compare_windows(s, d):
        m = months(s, d).select(F.col("data_month").alias("start"), F.last_day("data_month").alias("end"))
        out = []
        for mode, mw in (("previous", False), ("yoy", False), ("yoy", True), ("prev_month", False)):
            cs, ce = dates.compare_window_cols(F.col("start"), F.col("end"), mode, mw)
            out.append(m.select("start", "end", F.lit(mode + ("_weekday" if mw else "")).alias("mode"),
                                cs.alias("compare_start"), ce.alias("compare_end")))
        res = out[0]
        for o in out[1:]:
            res = res.unionByName(o)
        return res

    def task_ids(s, d):
        a = attempts(s, d)
        return a.select("event_id", keys.task_id(keys.property_key(F.col("property")), F.col("search_type"),
                                                 F.col("aggregation"), F.col("data_date")).alias("task_id"))

    return {
        # registry / ledger
        "registry_merge": lambda s, d: reg_out(fixtures.merged(attempts(s, d))),
        "latest_state": lambda s, d: ledger_out(L.latest_state(attempts(s, d))),
        "property_status": lambda s, d: pstatus(s, d).select(
            "property_id", "kind", "last_collected_date", "data_state", "last_error",
            _ts_text(F.col("last_error_at")).alias("last_error_at")),
        "client_assign": lambda s, d: L.client_assign(registry_df(s, d), members(s, d)),
        # Assigned before the groups were made: those properties stay clients of their own.
        "client_assign_kept": lambda s, d: L.client_assign(registry_df(s, d), members(s, d), L.client_assign(
            registry_df(s, d).where(F.array_contains("account_ids", "acct1")), members(s, d).limit(0))),
        "client_kinds": lambda s, d: L.client_kinds(registry_df(s, d), assignment(s, d)),
        "reconcile": planned,
        "plan_missing": lambda s, d: L.missing_days(
            L.expected_cells(registry_df(s, d), LEDGER_AS_OF).where(F.col("aggregation") == "byProperty"),
            ledger_df(s, d).where(F.col("status").isin("collected_with_data", "collected_no_data")),
            ["property_id", "search_type", "aggregation", "data_date"]).select(
                "property_id", "search_type", "aggregation", "data_date"),
        "totals_gate": lambda s, d: planned(s, d).where(F.col("aggregation") == "totals").select(
            "property_id", "search_type", "data_date"),
        "set_difference": lambda s, d: L.missing_days(
            L.expected_cells(registry_df(s, d), LEDGER_AS_OF).where(
                (F.col("aggregation") == "byProperty") & (F.col("search_type") == "web")).select("property_id", "data_date"),
            ledger_df(s, d).where(F.col("status").isin("collected_with_data", "collected_no_data")),
            ["property_id", "data_date"]),
        "coverage_grid": lambda s, d: L.coverage_grid(registry_df(s, d), ledger_df(s, d), LEDGER_AS_OF),
        "requeue_errors": lambda s, d: ledger_out(L.requeue_errors(ledger_df(s, d))),
        "recollect_cell": lambda s, d: L.recollect_cell(
            ledger_out(ledger_df(s, d)),
            ledger_out(ledger_df(s, d)).where(F.col("status") == "collected_fresh")),
        "purge_account": lambda s, d: ledger_out(L.purge_account(ledger_df(s, d), "acct1")),
        "group_pending_by_account": lambda s, d: L.group_pending_by_account(planned(s, d)),
        "freshness": lambda s, d: L.freshness(ledger_df(s, d)),
        "status_mix": lambda s, d: L.status_mix(pstatus(s, d)),
        "double_count": lambda s, d: L.double_count(members(s, d)),
        "existing_members": lambda s, d: L.existing_members(members(s, d), bp(s, d)).select("group_id", "property"),
        "account_property_counts": lambda s, d: L.account_property_counts(registry_df(s, d), accts(s, d)),
        "tasks_by_status": lambda s, d: ledger_out(ledger_df(s, d)).where(F.col("status") == "error")
            .orderBy("task_id").limit(2000),
        "tasks_recent": lambda s, d: ledger_out(ledger_df(s, d)).orderBy("task_id").limit(500),
        "tasks_by_property": lambda s, d: ledger_out(ledger_df(s, d)).where(
            F.col("property_id") == "urlp_www_site0_example_com"),
        "attempts_search": lambda s, d: attempts(s, d).where(F.col("task_id").startswith("urlp_www_site3_example_com__"))
            .orderBy(F.col("logged_at").desc(), F.col("event_id").desc()).limit(200)
            .select("task_id", "property", "search_type", "aggregation", "data_date", "status", "row_count",
                    "error_message", _ts_text(F.col("logged_at")).alias("logged_at")),
        "registry_filter": lambda s, d: reg_out(registry_df(s, d)).where(
            F.col("included") & F.col("site_url").contains("site") & F.array_contains(F.split("account_ids", ","), "acct1"))
            .orderBy("site_url"),
        "registry_filter_status": lambda s, d: registry_df(s, d).join(
            pstatus(s, d).select("property_id", "kind", "last_collected_date"), "property_id")
            .where(F.col("included") & F.lower("site_url").contains("site") & (F.col("kind") == "final"))
            .orderBy(F.col("last_collected_date").desc_nulls_last(), "site_url")
            .select("property_id", "site_url", "kind", "last_collected_date"),
        # ops
        "api_usage": usage,
        "collection_activity": lambda s, d: O.collection_activity(attempts(s, d), OPS_AS_OF, 14),
        "quota_by_account": lambda s, d: O.quota_by_account(usage(s, d), accts(s, d), registry_df(s, d)),
        "capacity": lambda s, d: O.capacity(usage(s, d), registry_df(s, d)),
        "row_ceiling": lambda s, d: O.row_ceiling(attempts(s, d), OPS_AS_OF),
        "recent_attempts": lambda s, d: O.recent_attempts(attempts(s, d), OPS_AS_OF),
        "billing_scan": lambda s, d: O.billing_scan(billing(s, d), OPS_AS_OF).select(
            F.col("service.description").alias("service"), "currency", "cost",
            _ts_text(F.col("usage_start_time")).alias("usage_start_time")),
        "billing_by_service": lambda s, d: O.billing_by_service(billing(s, d), OPS_AS_OF),
        "billing_status": lambda s, d: O.billing_status(billing(s, d), OPS_AS_OF),
        # Every page once more by plain http: both URLs lead to one name.
        "table_name_collisions": lambda s, d: O.table_name_collisions(page_urls(s, d).unionByName(
            page_urls(s, d).select(F.regexp_replace("url", "^https:", "http:").alias("url")))),
        "ops_alerts": lambda s, d: O.ops_alerts(attempts(s, d), dedup(s, d), OPS_AS_OF),
        "error_bursts": lambda s, d: O.error_bursts(attempts(s, d), 2).select(
            _ts_text(F.col("window_start")).alias("window_start"), "errors"),
        "success_gaps": lambda s, d: O.success_gaps(attempts(s, d), OPS_AS_OF, ["property", "account_id"]).select(
            "property", "account_id", _ts_text(F.col("gap_start")).alias("gap_start"), _ts_text(F.col("gap_end")).alias("gap_end"), "open"),
        "health_checks": lambda s, d: _health(s, d),
        "overview": lambda s, d: O.overview(accts(s, d), registry_df(s, d), pstatus(s, d), ledger_df(s, d),
                                            storage(s, d), usage(s, d), O.collection_activity(attempts(s, d), OPS_AS_OF, 14)),
        "row_hash_invariant": dedup,
        # The fresh days appended a second time: each of their rows is found.
        "row_hash_repeated": lambda s, d: O.row_hash_invariant({"by_property": bp(s, d).unionByName(bp(s, d).where("data_state = 'fresh'"))}),
        # functions over the control data
        "property_key": url_keys,
        "valid_iso_date": iso_dates,
        "valid_combo": combos,
        "dims_for": combos,
        "retryable_error": classified,
        "token_error_class": classified,
        "dead_letter": classified,
        "day_final": finality,
        "collect_status": finality,
        "pacific_day": pacific,
        "collection_window": windows,
        "days_in_range": days,
        "compare_window": compare_windows,
        "task_id": task_ids,
        "distinct": lambda s, d: attempts(s, d).where(F.col("account_id").isNotNull()).select("account_id").distinct(),
    }


def _health(s, d):
    from clickstack.operators import ledger as L
    from clickstack.operators import ops as O
    from clickstack.sources import native, tables

    a = attempts(s, d)
    return O.health_checks(
        O.row_hash_invariant({"by_property": bp(s, d), "by_page": pg(s, d), "totals": tot(s, d)}),
        O.table_name_collisions(tables.read(s, d, "pages").select("url")),
        O.row_ceiling(a, OPS_AS_OF), O.recent_attempts(a, OPS_AS_OF),
        native.export_latest_date(native.export_log(s, d)), control(s, d, "accounts"))


# Fact plane: scans, filters, aggregations, top-k, ingest, targets ---------------------------------
WHOLE = Filters(start=dt.date(1995, 1, 1), end=dt.date(2001, 12, 31), brand_terms=fixtures.BRAND_TERMS)
EXPORT_ACCOUNT, OTHER_ACCOUNT = "export0", "export1"
NEW_SITE = 3  # not in the registry before its export is found
SITE0 = "https://www.site0.example.com/"


def storage(s, d):
    from clickstack.operators import ops
    from clickstack.sources.warehouse import FACT_TABLES, Warehouse

    w = Warehouse(s, d).ensure()
    return ops.storage_summary(s, {t: w.path(t) for t in FACT_TABLES})


def _fact_queries():
    from clickstack.functions import filters as flt
    from clickstack.functions import keys, status
    from clickstack.operators import groups as G
    from clickstack.operators import ledger as L
    from clickstack.operators import metrics as M
    from clickstack.operators import ops as O
    from clickstack.operators import topk as K
    from clickstack.plans import precompute as P
    from clickstack.schema import SEARCH_TYPES
    from clickstack.sources import catalog_tables as ct
    from clickstack.sources import collect, ingest, native
    from clickstack.sources.loads import FactStore

    def per_property(rows):
        return M.kpis(rows, ["property"])

    def filt(table, f, **kw):
        return lambda s, d: per_property(table(s, d).where(flt.to_column(f, **kw)))

    def members(s, d):
        return control(s, d, "members")

    def native_sites(s, d):
        return registry_df(s, d).where(F.col("source") == "native_export").select("site_url")

    def site_adapter(s, d):
        return native.native_site_adapter(native.site_export(s, d), native_sites(s, d))

    def url_adapter(s, d):
        return native.native_url_adapter(native.url_export(s, d), native_sites(s, d))

    adapter_cols = ["data_date", "property", "property_type", "search_type", "aggregation", "query", "page", "country",
                    "device", "clicks", "impressions", "ctr", "position", "is_anonymized", "row_hash", "data_state"]

    def wildcard(s, d):
        return native.wildcard_all(bp(s, d), site_adapter(s, d), native_sites(s, d))

    def per_source(df):
        return df.groupBy("source_table").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("clicks").alias("clicks"),
                                              F.sum("impressions").alias("impressions"))

    def responses_path(s, d):
        from clickstack.sources.files import exists
        from clickstack.sources.warehouse import Warehouse

        w = Warehouse(s, d).ensure("by_property")
        path = w.path("responses")
        if not exists(s, path + "/_SUCCESS"):
            ingest.write_responses(bp(s, d), path)
        return path

    def ingested(s, d):
        rows = ingest.map_response_rows(ingest.read_responses(s, responses_path(s, d)), fixtures.COLLECTED_AT)
        return ingest.with_row_hash(rows)

    def state_summary(df):
        return df.groupBy("property", "search_type", "data_state").agg(
            F.count(F.lit(1)).alias("n_rows"), F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))

    def restated(s, d):
        # The whole table as one load, then its fresh web days restated by a newer one.
        store = FactStore(s, ingest.scratch(s, "replace-slice"))
        store.store(bp(s, d))
        fresh = bp(s, d).where((F.col("data_state") == "fresh") & (F.col("search_type") == "web"))
        store.store(fresh.withColumns({"clicks": F.col("clicks") + 1, "loaded_at": F.lit(fixtures.COLLECTED_AT).cast("timestamp")}))
        return store.current()

    def written_ndjson(s, d):
        path = ingest.scratch(s, "stage")
        ingest.stage_ndjson(bp(s, d), path)
        return s.read.json(path).groupBy("property").count()

    def appended(s, d):
        path = ingest.scratch(s, "attempts")
        cols = ["task_id", "property_id", "search_type", "aggregation", "data_date", "account_id", "status", "attempt", "logged_at"]
        log = attempts(s, d).withColumn("property_id", keys.property_key(F.col("property")))
        planned = (L.reconcile(registry_df(s, d), ledger_df(s, d), LEDGER_AS_OF).withColumn("attempt", F.lit(1).cast("long"))
                   .withColumn("logged_at", F.lit(OPS_AS_OF).cast("timestamp")))
        ingest.append_attempt(log.select(*cols), path)
        ingest.append_attempt(planned.select(*cols), path)
        return s.read.parquet(path).groupBy("status").count()

    def old_new(s, d):
        old = bp(s, d).drop("search_appearance", "row_hash")
        new = pg(s, d)
        u = ingest.reconcile_columns(old, new)
        return u.groupBy("aggregation").agg(F.count(F.lit(1)).alias("n_rows"),
                                            F.sum(F.col("row_hash").isNull().cast("long")).alias("missing_hash"),
                                            F.sum(F.col("page").isNull().cast("long")).alias("missing_page"))

    def ceiling(s, d):
        r = ingest.pagination_ceiling(pg(s, d), ("property", "data_date", "search_type"))
        cells = r.groupBy("property", "data_date", "search_type").agg(F.count(F.lit(1)).alias("n"),
                                                                        F.max("hit_ceiling").alias("hit"))
        return cells.groupBy("search_type").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("n_rows"),
                                                F.sum(F.col("hit").cast("long")).alias("hit_cells"))

    def collected(s, d):
        """Every (property, day) in all search types, from pages of two rows, with a ceiling of four."""
        rows = bp(s, d)
        types = F.explode(F.array(*map(F.lit, SEARCH_TYPES))).alias("search_type")
        day = F.date_format("data_date", "yyyy-MM-dd")
        cells = rows.groupBy("property", "data_date").agg(F.max("data_state").alias("state")).select(
            F.col("property").alias("site_url"), day.alias("data_date"), types, F.lit("byProperty").alias("aggregation"),
            F.when(F.col("state") == "fresh", day).alias("first_incomplete_date"))
        pages = collect.reached_pages(cells, ingest.to_responses(rows, 2), 2, 4)
        return collect.attempts_of(pages, 1, OPS_AS_OF)

    def database(s, d):
        """The stored tables of ``d`` as catalog tables."""
        from clickstack.sources.warehouse import Warehouse

        w = Warehouse(s, d).ensure()
        for name in ("members", "registry"):
            w.control(name)
        name = ct.ensure_database(s, "clickstack_" + w.root.rsplit("wh-", 1)[1].replace("-", "_"), w.path("catalog"))
        ct.register_files(s, f"{name}.by_property", w.path("by_property"), ["data_month"])
        ct.register_files(s, f"{name}.members", w.path("control/members"))
        return name

    def evolved(s, d):
        # A table made before two columns were known gains them and takes newer rows.
        path = ingest.scratch(s, "evolved")
        name = f"{database(s, d)}.{path.rsplit('/', 1)[1].replace('-', '_')}"
        old = bp(s, d).drop("search_appearance", "row_hash")
        ct.ensure_table(s, name, old.schema, path, ["data_month"])
        ct.append_rows(s, name, old)
        ct.ensure_table(s, name, pg(s, d).schema, path, ["data_month"])
        ct.append_rows(s, name, pg(s, d))
        return s.table(name).groupBy("aggregation").agg(F.count(F.lit(1)).alias("n_rows"),
                                                        F.sum(F.col("row_hash").isNull().cast("long")).alias("missing_hash"),
                                                        F.sum(F.col("page").isNull().cast("long")).alias("missing_page"))

    def saved_group(s, d):
        name = database(s, d)
        return per_property(s.table(ct.save_group_view(s, name, "grp_b", f"{name}.by_property", f"{name}.members")))

    def discovered_views(s, d):
        # Two discoveries: the odd export sites, then all; the view has both. Names are of this run.
        path = ingest.scratch(s, "discovered")
        name = ct.ensure_database(s, path.rsplit("/", 1)[1].replace("-", "_"), path)
        api = f"{database(s, d)}.by_property"
        sites, export = native_sites(s, d), native.site_export(s, d)
        for found in (sites.where(fixtures.site_index(F.col("site_url")) % 2 == 1), sites):
            ct.discover_native(s, name, found, lambda new: native.native_site_adapter(export, new), path, api)
        return per_source(s.table(f"{name}.all_by_property"))

    def movers_all(s, d):
        return R.report_movers(bp(s, d), DEFAULT, "query", ends=50)

    def assignment(s, d):
        return control(s, d, "assignment")

    def targets(s, d):
        return control(s, d, "targets")

    def pre(report):
        return lambda s, d: P.precompute(control(s, d, "report_sums"), report)

    def breakdown_country(s, d):
        return R.report_breakdown(bp(s, d), WHOLE, "country")

    def top_queries(s, d):
        return R.report_top_queries(bp(s, d), DEFAULT)

    def trend(s, d):
        cur = R.report_timeseries(bp(s, d), DEFAULT, "day")
        cmp_ = R.report_timeseries(bp(s, d), DEFAULT, "day", series="compare")
        return R.trend_overlay(cur, cmp_)

    def discovered(s, d):
        """The registry, one site not known yet, after the exports of two accounts were found: odd sites and even sites."""
        site = fixtures.site_index(F.col("site_url"))
        known = registry_df(s, d).where(site != NEW_SITE)
        found = native.export_sites(native.site_export(s, d))
        first = L.discover_export(found.where(site % 2 == 1), EXPORT_ACCOUNT, OPS_AS_OF, known)
        return L.discover_export(found.where(site % 2 == 0), OTHER_ACCOUNT, OPS_AS_OF, first)

    def discover_export(s, d):
        # Of the accounts only the two discovered: a native property may have others that see it.
        own = F.array_intersect("account_ids", F.array(F.lit(EXPORT_ACCOUNT), F.lit(OTHER_ACCOUNT)))
        return discovered(s, d).where(F.size(own) > 0).select(
            "property_id", "site_url", "property_type", "source", "included", F.array_join(own, ",").alias("account_ids"))

    def purge_native(s, d):
        left = L.purge_native(discovered(s, d), EXPORT_ACCOUNT)
        gone = L.native_of_account(discovered(s, d), EXPORT_ACCOUNT).select(F.col("site_url").alias("property"))
        sites = left.where(F.col("source") == "native_export").select("site_url")
        w = native.wildcard_all(bp(s, d), native.native_site_adapter(native.site_export(s, d), sites), sites)
        return per_source(w.join(gone, "property", "left_anti"))

    def region_movers(s, d):
        region = F.when(fixtures.site_index(F.col("site_url")).isin(fixtures.NATIVE_SITES), "EU").otherwise("US")
        return O.region_movers(bp(s, d), registry_df(s, d), region,
                               (dt.date(1998, 1, 1), dt.date(1998, 12, 31)), (dt.date(1997, 1, 1), dt.date(1997, 12, 31)))

    return {
        # scans and sources
        "scan_property": lambda s, d: bp(s, d).where(F.col("property") == SITE0).select(
            "data_date", "property", "search_type", "query", "country", "device", "clicks", "impressions", "position",
            "row_hash"),
        "union_members": lambda s, d: per_property(bp(s, d).join(
            members(s, d).where(F.col("group_id") == "grp_b").select("property"), "property", "left_semi")),
        "wildcard_all": lambda s, d: per_source(wildcard(s, d)),
        "union_all": lambda s, d: per_source(wildcard(s, d)),
        "native_site_adapter": lambda s, d: site_adapter(s, d).select(*adapter_cols),
        "native_url_adapter": lambda s, d: url_adapter(s, d).select(*adapter_cols),
        "export_sites": lambda s, d: native.export_sites(native.site_export(s, d)),
        "export_latest_date": lambda s, d: native.export_latest_date(native.export_log(s, d)),
        "norm_search_type": lambda s, d: native.url_export(s, d).select(
            F.col("search_type").alias("export_type"), keys.norm_search_type(F.col("search_type")).alias("search_type")).distinct(),
        "ingest_response_rows": lambda s, d: state_summary(ingested(s, d)),
        "replace_slice": lambda s, d: restated(s, d).groupBy("data_state", "search_type").agg(
            F.count(F.lit(1)).alias("n_rows"), F.sum("clicks").alias("clicks")),
        "stage_ndjson": written_ndjson,
        "append_attempt": appended,
        "reconcile_columns": old_new,
        "pagination_ceiling": ceiling,
        "collect_cells": lambda s, d: collected(s, d).groupBy("search_type", "status").agg(
            F.count(F.lit(1)).alias("cells"), F.sum("api_calls").alias("api_calls"), F.sum("row_count").alias("n_rows")),
        "ensure_table": evolved,
        "group_view_saved": saved_group,
        "wildcard_view": discovered_views,
        "materialize_group": lambda s, d: P.materialize_groups(bp(s, d), members(s, d)),
        "group_view": lambda s, d: per_property(P.group_view(s, bp(s, d), members(s, d), "grp_b")),
        "group_union_agg": lambda s, d: M.group_union_agg(bp(s, d).join(
            members(s, d).where(F.col("group_id") == "grp_b").select("property"), "property", "left_semi")),
        "purge_native_account": purge_native,
        "discover_export": discover_export,
        "storage_summary": storage,
        "storage_rows": lambda s, d: storage(s, d).select("dataset", "n_rows"),
        # filters, one clause each (metrics per property over the whole table)
        "f_search_type": filt(bp, WHOLE.replace(search_type="image")),
        "f_date_range": filt(bp, Filters(start=dt.date(1998, 3, 1), end=dt.date(1998, 3, 31))),
        "f_final_only": filt(bp, WHOLE.replace(final_only=True)),
        "f_device_in": filt(bp, WHOLE.replace(device=("MOBILE", "TABLET"))),
        "f_country_in": filt(bp, WHOLE.replace(country=("nation_1", "nation_7"))),
        "f_position_range": filt(bp, WHOLE.replace(position_min=5, position_max=15)),
        "f_query_contains": filt(bp, WHOLE.replace(query="gear, widget")),
        "f_page_contains": filt(pg, WHOLE.replace(page="/economy/, /small")),
        "f_brand_exclude": filt(bp, WHOLE.replace(brand_exclude=("brand#2",))),
        "f_brand_segment": filt(bp, WHOLE.replace(segment="brand")),
        "f_brand_segment_nonbrand": filt(bp, WHOLE.replace(segment="nonbrand")),
        "f_preset_paa": filt(bp, WHOLE.replace(presets=("paa",))),
        "f_preset_longtail": filt(bp, WHOLE.replace(presets=("longtail",))),
        "f_require_query": filt(pg, WHOLE, require_query=True),
        "f_require_page": filt(pg, WHOLE, require_page=True),
        "brand_match": lambda s, d: bp(s, d).where(F.col("query").isNotNull()).select("query").distinct().select(
            "query", flt.brand_match(fixtures.BRAND_TERMS).alias("is_brand")),
        "rule_match": lambda s, d: G.match_groups(
            pg(s, d).select("query", "page").distinct(),
            fixtures.semantic_groups(s, "content")).select("group_id", "query", "page"),
        "without_segment": lambda s, d: R.report_top_pages(pg(s, d), DEFAULT.replace(segment="brand")),
        # aggregations over the whole table
        "metrics4": lambda s, d: M.kpis(bp(s, d), ["property", "search_type"]),
        "kpis": lambda s, d: M.kpis(bp(s, d).where(flt.to_column(WHOLE))),
        "timeseries": lambda s, d: M.timeseries(bp(s, d).where(flt.to_column(WHOLE)), "month"),
        "top_entity": lambda s, d: M.top_entity(bp(s, d).where(flt.to_column(WHOLE, require_query=True)), "query"),
        "breakdown": breakdown_country,
        "position_buckets": lambda s, d: M.position_buckets(bp(s, d).where(flt.to_column(WHOLE))),
        "ctr_scatter": lambda s, d: M.ctr_scatter(bp(s, d).where(flt.to_column(WHOLE, require_query=True))),
        "ctr_curve": lambda s, d: M.ctr_curve(bp(s, d).where(flt.to_column(WHOLE, require_query=True))),
        "ctr_bench_rows": lambda s, d: M.ctr_bench_rows(bp(s, d).where(flt.to_column(WHOLE, require_query=True))),
        "query_page_pairs": lambda s, d: M.query_page_pairs(
            pg(s, d).where(flt.to_column(WHOLE, require_query=True, require_page=True))),
        "striking_distance": lambda s, d: M.striking_distance(bp(s, d).where(flt.to_column(WHOLE, require_query=True))),
        "brand_split": lambda s, d: M.brand_split(bp(s, d).where(flt.to_column(WHOLE)), fixtures.BRAND_TERMS),
        "brand_timeseries": lambda s, d: M.brand_timeseries(bp(s, d).where(flt.to_column(WHOLE)), fixtures.BRAND_TERMS,
                                                            "month"),
        "brand_share": lambda s, d: R.brand_share(M.brand_split(bp(s, d).where(flt.to_column(WHOLE)),
                                                                fixtures.BRAND_TERMS)),
        "period_pivot_sum": lambda s, d: O.period_pivot_sum(
            bp(s, d), (dt.date(1998, 1, 1), dt.date(1998, 12, 31)), (dt.date(1997, 1, 1), dt.date(1997, 12, 31))),
        "region_movers": region_movers,
        "anomaly_pct": lambda s, d: O.anomaly_pct(tot(s, d)),
        "totals_delta": lambda s, d: O.totals_delta(tot(s, d), bp(s, d)),
        "home_movers": lambda s, d: O.home_movers(bp(s, d), registry_df(s, d), assignment(s, d), FACT_AS_OF),
        "cannibalization": lambda s, d: R.report_cannibalization(pg(s, d), WHOLE),
        "trend_overlay": trend,
        # top-k over the whole table
        "topk_entities": lambda s, d: K.topk_entities(
            M.top_entity(bp(s, d).where(flt.to_column(WHOLE, require_query=True)), "query"), 100),
        "topk_scatter": lambda s, d: K.topk_scatter(M.ctr_scatter(bp(s, d).where(flt.to_column(WHOLE, require_query=True))), 500),
        "topk_bench": lambda s, d: K.topk_bench(M.ctr_bench_rows(bp(s, d).where(flt.to_column(WHOLE, require_query=True))), 200),
        "topk_pairs": lambda s, d: K.topk_pairs(M.query_page_pairs(
            pg(s, d).where(flt.to_column(WHOLE, require_query=True, require_page=True))), 5000),
        "topk_striking": lambda s, d: K.topk_striking(
            M.striking_distance(bp(s, d).where(flt.to_column(WHOLE, require_query=True))), 100),
        "movers_two_ended": movers_all,
        "gainers_losers": lambda s, d: K.gainers_losers(movers_all(s, d), 15),
        "topn_other": lambda s, d: K.topn_other(breakdown_country(s, d), "key", "clicks", 6),
        "breakdown_top": lambda s, d: K.breakdown_top(breakdown_country(s, d), "clicks", 8),
        "sorted_page": lambda s, d: K.sorted_page(top_queries(s, d), "impressions", True, 1, 10),
        # functions over fact rows
        "row_hash": lambda s, d: bp(s, d).select("property", "data_date", "search_type", "query", "country", "device",
                                                 keys.row_hash().alias("row_hash")),
        "row_hash_native": lambda s, d: site_adapter(s, d).select("property", "data_date", "search_type", "query",
                                                                  "country", "device", "is_anonymized", "row_hash"),
        "pct_delta": lambda s, d: top_queries(s, d).select(
            "key", status.pct_value(F.col("clicks"), F.col("prev_clicks")).alias("clicks_pct"),
            status.pct_delta(F.col("clicks"), F.col("prev_clicks"), "clicks").alias("clicks_chip"),
            status.pct_delta(F.col("position"), F.col("prev_position"), "position").alias("position_chip")),
        "group_trend": lambda s, d: G.group_trend(G.report_grouped_entities(
            bp(s, d), DEFAULT, "topic", fixtures.semantic_groups(s, "topic")), "clicks", "growing").select("key", "change"),
        # targets
        "resolve_target": lambda s, d: per_property(P.resolve_target(bp(s, d), targets(s, d), "client:g_grp_a")),
        "precompute_kpis": pre("kpis"),
        "precompute_timeseries": pre("timeseries"),
        "precompute_top_queries": pre("top-queries"),
        "precompute_breakdown": pre("breakdown"),
        "precompute_breakdown_country": pre("breakdown-country"),
        "precompute_position_buckets": pre("position-buckets"),
        "precompute_ctr_scatter": pre("ctr-scatter"),
        "precompute_striking_distance": pre("striking-distance"),
        "precompute_movers": pre("movers"),
    }


# Streaming (S1, S2) -------------------------------------------------------------------------------
def _streaming_queries():
    from clickstack.schema import ATTEMPT
    from clickstack.sources import ingest
    from clickstack.sources.files import exists
    from clickstack.sources.warehouse import Warehouse
    from clickstack.streaming import ingest_stream, ops_stream

    def responses(s, d):
        w = Warehouse(s, d).ensure("by_property")
        path = w.path("responses")
        if not exists(s, path + "/_SUCCESS"):
            ingest.write_responses(bp(s, d), path)
        return path

    def attempt_files(s, d):
        w = Warehouse(s, d).ensure()
        path = w.path("attempt_log")
        if not exists(s, path + "/_SUCCESS"):
            (attempts(s, d).select(*[f.name for f in ATTEMPT.fields])
             .repartitionByRange(16, "logged_at").write.mode("overwrite").parquet(path))
        return path

    def stream_ingest(s, d):
        run = ingest.scratch(s, "stream-ingest")
        t = ingest_stream.run_available(s, responses(s, d), run + "/table", run + "/checkpoint", fixtures.COLLECTED_AT,
                                        max_files_per_trigger=1)
        return t.groupBy("property", "search_type", "data_state").agg(
            F.count(F.lit(1)).alias("n_rows"), F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))

    def stream_ops(s, d):
        run = ingest.scratch(s, "stream-ops")
        out = ops_stream.run_available(s, attempt_files(s, d), run + "/sink", run + "/checkpoint")
        return out.select(_ts_text(F.col("window_start")).alias("window_start"), "errors", "alert", "late")

    def stream_gaps(s, d):
        run = ingest.scratch(s, "stream-gaps")
        out = ops_stream.run_gaps(s, attempt_files(s, d), run + "/sink", run + "/checkpoint", OPS_AS_OF, ["property", "account_id"])
        return out.select("property", "account_id", _ts_text(F.col("gap_start")).alias("gap_start"),
                          _ts_text(F.col("gap_end")).alias("gap_end"), "open")

    return {"stream_ingest": stream_ingest, "stream_ops": stream_ops, "stream_gaps": stream_gaps}


# Remaining inventory entries and names that stand for a part of a larger query --------------------
def _more_queries():
    from clickstack.functions import dates
    from clickstack.functions import filters as flt
    from clickstack.operators import groups as G
    from clickstack.operators import ledger as L
    from clickstack.operators import ops as O
    from clickstack.sources import tables

    def new_suggestions(s, d):
        seed = G.seed_entities(pg(s, d), flt.without_segment(DEFAULT), "page")
        suggested = G.auto_content_groups(seed)
        saved = fixtures.semantic_groups(s, "content").select("name").distinct()
        return L.new_suggestions(suggested, saved)

    def movers_windows(s, d):
        m = bp(s, d).select("data_month").distinct().select(F.col("data_month").alias("start"),
                                                             F.last_day("data_month").alias("end"))
        parts = []
        for mode in ("none", "custom", "yoy"):
            cs, ce = dates.movers_window_cols(F.col("start"), F.col("end"), mode)
            parts.append(m.select("start", "end", F.lit(mode).alias("mode"), cs.alias("compare_start"),
                                  ce.alias("compare_end")))
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    def billing_total(s, d):
        return O.billing_total(O.billing_by_service(O.billing_export(tables.read(s, d, "events")), OPS_AS_OF))

    return {"new_suggestions": new_suggestions, "movers_window": movers_windows, "billing_total": billing_total}


# Inventory names whose operator is computed inside another registered query (same result).
ALIASES = {
    "auto_topic_clusters_exact": "auto_topic_clusters",  # R17: one path for any number of queries
    "top_with_prev": "report_top_queries",          # C1
    "movers": "report_movers",                      # C2
    "content_decay": "report_content_decay",        # C3
    "ctr_benchmark": "report_ctr_benchmark",        # C4
    "property_key_disambiguated": "property_key",   # H4
    "property_type": "property_key",                # H5
    "client_name": "property_key",                  # H25
}
