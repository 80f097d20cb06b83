"""Control-plane jobs over the attempt log, the task ledger and the property registry
(E3-E6, L1-L7, C6-C8, C10, C12, C14, C15, D30, D31, D33).

The ledger is not a mutable store here: it is the latest state per task derived from the
append-only attempt log (E5), and every "write" job returns the new rows or the new table as a
DataFrame, which the caller appends or overwrites.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickstack.functions import dates, keys, status, text
from clickstack.schema import TERMINAL_FINAL

IN_FLIGHT = ["pending", "queued"]
KEEP_ON_PURGE = ["collected_with_data", "collected_no_data", "skipped"]


# E3 ---------------------------------------------------------------------------------------------
REGISTRY_CONFIG = "struct<types:array<string>,aggregations:array<string>,offset_days:int,backfill_months:int>"


def registry_merge(observations: DataFrame, settings: DataFrame | None = None, existing: DataFrame | None = None) -> DataFrame:
    """Many discovery observations (property, account_id, logged_at) → one registry row per property.

    Accounts are unioned; the account of the first observation that has one is preferred; the first sighting is
    kept, the last refreshed. ``settings(property, source, included, config, brand_terms)`` says how a new
    property starts; without a row there it is an API property, excluded until someone tracks it, without configuration.
    Rows of ``existing`` (a registry) keep their preferred account, inclusion, configuration and brand terms, and stay when
    nothing new was observed of them. A source named by ``settings`` is newer than the one on record: a site found
    in an export becomes native, and native properties are always included. Of observations at the same time the
    smaller account counts as first."""
    obs = observations.select("property", "account_id", "logged_at")
    seen = obs.groupBy("property").agg(
        F.array_sort(F.collect_set("account_id")).alias("new_accounts"),
        F.min(F.when(F.col("account_id").isNotNull(), F.struct("logged_at", "account_id")))["account_id"].alias("first_account"),
        F.min("logged_at").alias("first_seen"), F.max("logged_at").alias("last_seen"))
    if settings is not None:
        seen = seen.join(settings.select("property", "source", "included", "config", "brand_terms"), "property", "left")
    else:
        seen = seen.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (
            ("source", "string"), ("included", "boolean"), ("config", REGISTRY_CONFIG), ("brand_terms", "array<string>"))])
    accounts_, kept, source = F.col("new_accounts"), lambda c: F.col(c), F.col("source")
    preferred, discovered, last = F.col("first_account"), F.col("first_seen"), F.col("last_seen")
    if existing is not None:
        old = existing.select("property", *[F.col(c).alias(f"old_{c}") for c in (
            "account_ids", "preferred_account_id", "discovered_at", "last_seen_at", "source", "included", "config", "brand_terms")])
        seen = seen.join(old, "property", "full_outer")
        none = F.array().cast("array<string>")
        accounts_ = F.array_sort(F.array_union(F.coalesce("old_account_ids", none), F.coalesce("new_accounts", none)))
        kept, source = (lambda c: F.coalesce(f"old_{c}", c)), F.coalesce("source", "old_source")
        preferred = F.coalesce("old_preferred_account_id", "first_account")
        discovered, last = F.least("old_discovered_at", "first_seen"), F.greatest("old_last_seen_at", "last_seen")
    source = F.coalesce(source, F.lit("api"))
    return seen.select(
        keys.property_key(F.col("property")).alias("property_id"),
        F.col("property").alias("site_url"),
        keys.property_type(F.col("property")).alias("property_type"),
        source.alias("source"),
        F.when(source == "native_export", F.lit(True)).otherwise(F.coalesce(kept("included"), F.lit(False))).alias("included"),
        accounts_.alias("account_ids"), preferred.alias("preferred_account_id"),
        discovered.alias("discovered_at"), last.alias("last_seen_at"),
        kept("config").alias("config"), kept("brand_terms").alias("brand_terms"), F.col("property"))


# L5, L6 -----------------------------------------------------------------------------------------
def discover_export(sites: DataFrame, account_id: str, seen_at, existing: DataFrame) -> DataFrame:
    """The registry with the sites (``site_url``) of an export account. A new site starts as an included native
    property; a known one gains the account, becomes native and included, and keeps its other settings."""
    found = sites.select(F.col("site_url").alias("property")).distinct()
    observations = found.select("property", F.lit(account_id).alias("account_id"), F.lit(seen_at).cast("timestamp").alias("logged_at"))
    settings = found.select("property", F.lit("native_export").alias("source"), F.lit(True).alias("included"),
                            F.lit(None).cast(REGISTRY_CONFIG).alias("config"), F.lit(None).cast("array<string>").alias("brand_terms"))
    return registry_merge(observations, settings, existing)


def _native_of(account_id: str):
    return F.coalesce((F.col("source") == "native_export") & F.array_contains("account_ids", account_id), F.lit(False))


def native_of_account(registry: DataFrame, account_id: str) -> DataFrame:
    """The native properties of an export account."""
    return registry.where(_native_of(account_id))


def purge_native(registry: DataFrame, account_id: str) -> DataFrame:
    """The registry without the account's native properties; those of other accounts stay."""
    return registry.where(~_native_of(account_id))


# E5 ---------------------------------------------------------------------------------------------
def latest_state(attempts: DataFrame) -> DataFrame:
    """E5: the ledger: per task the state of its latest attempt (last write wins). All columns come from one
    attempt; of attempts at the same time the one with the higher number, then the larger row, is the latest."""
    state = F.struct("logged_at", "attempt", "status", "property", "search_type", "aggregation", "data_date", "account_id")
    last = attempts.groupBy("task_id").agg(F.max(state).alias("s"))
    return last.select(
        "task_id", "s.property", "s.search_type", "s.aggregation", "s.data_date", "s.status", F.col("s.attempt").alias("attempts"),
        "s.account_id", F.col("s.logged_at").alias("updated_at"), keys.property_key(F.col("s.property")).alias("property_id"))


# E6 ---------------------------------------------------------------------------------------------
def property_status(registry: DataFrame, attempts: DataFrame) -> DataFrame:
    """Last collected day and its state, last error; the status kind: imported (native),
    error (only if newer than the last success), fresh / final, collecting (tracked), untracked."""
    ok = F.col("status").startswith("collected_")
    err = F.col("status") == "error"
    s = attempts.groupBy("property").agg(
        F.max(F.when(ok, F.col("data_date"))).alias("last_collected_date"),
        F.max(F.when(ok, F.struct("data_date", "logged_at", F.when(F.col("status") == "collected_fresh", "fresh")
                                  .otherwise("final").alias("state"))))["state"].alias("data_state"),
        F.max(F.when(ok, F.col("logged_at"))).alias("last_collected_at"),
        F.max(F.when(err, F.struct("logged_at", "error_message")))["error_message"].alias("last_error"),
        F.max(F.when(err, F.col("logged_at"))).alias("last_error_at"))
    j = registry.join(s, registry.site_url == s.property, "left").drop(s.property)
    errored = F.col("last_error_at").isNotNull() & (F.col("last_collected_at").isNull()
                                                     | (F.col("last_error_at") > F.col("last_collected_at")))
    kind = (F.when(F.col("source") == "native_export", F.lit("imported"))
            .when(errored, F.lit("error"))
            .when(F.col("last_collected_date").isNotNull(),
                  F.when(F.col("data_state") == "fresh", F.lit("fresh")).otherwise(F.lit("final")))
            .when(F.col("included"), F.lit("collecting"))
            .otherwise(F.lit("untracked")))
    return j.select("property_id", "site_url", "included", "source", "last_collected_date", "data_state",
                    "last_collected_at", "last_error", "last_error_at", kind.alias("kind"))


# E4 ---------------------------------------------------------------------------------------------
def client_assign(registry: DataFrame, members: DataFrame, assigned: DataFrame | None = None) -> DataFrame:
    """Every group becomes a client 'g_<group>' (a property in several groups goes to the
    first, by group order then member order); every remaining tracked or native property
    becomes its own client 'p_<property>' named from its URL. Properties that ``assigned`` (an earlier
    result) lists keep their client and its name. Returns (property_id, client_id, client_name)."""
    out = ["property_id", "client_id", "client_name"]
    kept = registry.select("property_id").join(assigned.select(*out), "property_id") if assigned is not None else None
    open_ = registry.join(assigned.select("property_id"), "property_id", "left_anti") if assigned is not None else registry
    order = Window.partitionBy("property").orderBy("group_pos", "member_pos")
    gm = members.withColumn("rn", F.row_number().over(order)).where(F.col("rn") == 1)
    grouped = open_.join(gm.select(F.col("property").alias("site_url"), "group_id", "name"), "site_url") \
        .select("property_id", F.concat(F.lit("g_"), F.col("group_id")).alias("client_id"), F.col("name").alias("client_name"))
    rest = (open_.join(grouped.select("property_id"), "property_id", "left_anti")
            .where(F.col("included") | (F.col("source") == "native_export"))
            .select("property_id", F.concat(F.lit("p_"), F.col("property_id")).alias("client_id"),
                    text.client_name(F.col("site_url")).alias("client_name")))
    every = grouped.unionByName(rest)
    return every if kept is None else every.unionByName(kept.select(*out))


def client_kinds(registry: DataFrame, assignment: DataFrame) -> DataFrame:
    """Per client: member count and kind: export (every member native) / rollup (>1) / property."""
    j = assignment.join(registry.select("property_id", "source"), "property_id")
    g = j.groupBy("client_id", "client_name").agg(
        F.count(F.lit(1)).alias("property_count"),
        F.bool_and(F.col("source") == "native_export").alias("all_export"))
    return g.select("client_id", "client_name", "property_count",
                    F.when(F.col("all_export"), "export").when(F.col("property_count") > 1, "rollup")
                    .otherwise("property").alias("kind"))


# L1 with C6 / C7 --------------------------------------------------------------------------------
def expected_cells(registry: DataFrame, as_of, scope: Sequence[str] | None = None) -> DataFrame:
    """Registry × aggregations × types × days of each property's collection window (H11, H12),
    invalid combinations dropped (H14); API properties that are tracked and have an account."""
    reg = registry.where(F.col("included") & (F.col("source") != "native_export"))
    if scope:
        reg = reg.where(F.col("property_id").isin(list(scope)))
    reg = reg.withColumn("account_id", F.coalesce(F.col("preferred_account_id"), F.col("account_ids")[0])) \
        .where(F.col("account_id").isNotNull())
    today = F.lit(as_of).cast("date")
    oldest, newest = dates.collection_window(today, F.col("config.offset_days"), F.col("config.backfill_months"))
    cells = (reg.select("property_id", "account_id",
                        F.explode("config.aggregations").alias("aggregation"), "config", oldest.alias("oldest"),
                        newest.alias("newest"))
             .select("property_id", "account_id", "aggregation", F.explode("config.types").alias("search_type"),
                     "oldest", "newest")
             .where(status.valid_combo(F.col("search_type"), F.col("aggregation")))
             .select("property_id", "account_id", "aggregation", "search_type",
                     F.explode(dates.days_in_range(F.col("oldest"), F.col("newest"))).alias("data_date")))
    return cells


def reconcile(registry: DataFrame, ledger: DataFrame, as_of, scope: Sequence[str] | None = None) -> DataFrame:
    """L1: pending tasks for every expected cell that is not final-terminal (C6), totals only
    on days whose byProperty cell is final-terminal (C7), never over an in-flight task."""
    cells = expected_cells(registry, as_of, scope)
    lk = ledger.select("property_id", "search_type", "aggregation", "data_date", "status", F.col("task_id"))
    terminal = lk.where(F.col("status").isin(TERMINAL_FINAL))
    k = ["property_id", "search_type", "aggregation", "data_date"]
    missing = cells.join(terminal.select(*k), k, "left_anti")
    bp_terminal = terminal.where(F.col("aggregation") == "byProperty").select(
        "property_id", "search_type", "data_date")
    totals = missing.where(F.col("aggregation") == "totals").join(
        bp_terminal, ["property_id", "search_type", "data_date"], "left_semi")
    planned = missing.where(F.col("aggregation") != "totals").unionByName(totals)
    with_id = planned.withColumn("task_id", keys.task_id(F.col("property_id"), F.col("search_type"),
                                                         F.col("aggregation"), F.col("data_date")))
    in_flight = lk.where(F.col("status").isin(IN_FLIGHT)).select("task_id")
    return (with_id.join(in_flight, "task_id", "left_anti")
            .select("task_id", "property_id", "search_type", "aggregation", "data_date",
                    F.lit("pending").alias("status"), F.lit(0).cast("long").alias("attempts"), "account_id"))


def missing_days(window_days: DataFrame, terminal_days: DataFrame, k: Sequence[str]) -> DataFrame:
    """G3 / C6 on day sets: window days minus final-terminal days."""
    return window_days.join(terminal_days.select(*k).distinct(), list(k), "left_anti")


# L2-L5, L7 --------------------------------------------------------------------------------------
def requeue_errors(ledger: DataFrame) -> DataFrame:
    """L2: every error task back to pending with zero attempts."""
    e = F.col("status") == "error"
    return (ledger.withColumn("attempts", F.when(e, F.lit(0).cast("long")).otherwise(F.col("attempts")))
            .withColumn("status", F.when(e, F.lit("pending")).otherwise(F.col("status"))))


def recollect_cell(ledger: DataFrame, requests: DataFrame) -> DataFrame:
    """L3: force the requested cells to pending (latest write wins): requested tasks replace
    their ledger row, new ones are added."""
    req = requests.select("task_id", "property_id", "search_type", "aggregation", "data_date",
                          F.lit("pending").alias("status"), F.lit(0).cast("long").alias("attempts"), "account_id")
    keep = ledger.select(*req.columns).join(req.select("task_id"), "task_id", "left_anti")
    return keep.unionByName(req)


def purge_account(ledger: DataFrame, account_id: str) -> DataFrame:
    """L4: drop the account's tasks except terminal coverage history."""
    return ledger.where(~((F.col("account_id") == account_id) & ~F.col("status").isin(KEEP_ON_PURGE))
                        | F.col("account_id").isNull())


def group_pending_by_account(tasks: DataFrame, scope: Sequence[str] | None = None) -> DataFrame:
    """Pending tasks with an account, optionally scoped, counted per account."""
    t = tasks.where((F.col("status") == "pending") & F.col("account_id").isNotNull())
    if scope:
        t = t.where(F.col("property_id").isin(list(scope)))
    return t.groupBy("account_id").agg(F.count(F.lit(1)).alias("pending"))


# C8 ---------------------------------------------------------------------------------------------
def coverage_grid(registry: DataFrame, ledger: DataFrame, as_of) -> DataFrame:
    """Every (aggregation, type, day) of each tracked property's window with its ledger
    status or 'not_planned' (invalid combinations are kept and show not_planned)."""
    today = F.lit(as_of).cast("date")
    oldest, newest = dates.collection_window(today, F.col("config.offset_days"), F.col("config.backfill_months"))
    grid = (registry.select("property_id", F.explode("config.aggregations").alias("aggregation"), "config",
                            oldest.alias("oldest"), newest.alias("newest"))
            .select("property_id", "aggregation", F.explode("config.types").alias("search_type"), "oldest", "newest")
            .select("property_id", "aggregation", "search_type",
                    F.explode(dates.days_in_range(F.col("oldest"), F.col("newest"))).alias("data_date")))
    k = ["property_id", "search_type", "aggregation", "data_date"]
    return (grid.join(ledger.select(*k, "status"), k, "left")
            .select(*k, F.coalesce(F.col("status"), F.lit("not_planned")).alias("state")))


def freshness(ledger: DataFrame) -> DataFrame:
    """Newest day collected with data, per property."""
    return ledger.groupBy("property_id").agg(
        F.max(F.when(F.col("status") == "collected_with_data", F.col("data_date"))).alias("freshness"))


def status_mix(prop_status: DataFrame) -> DataFrame:
    """Tracked properties per status kind."""
    return prop_status.where(F.col("included")).groupBy("kind").agg(F.count(F.lit(1)).alias("properties"))


# C10, C12, C14, C15 -----------------------------------------------------------------------------
def double_count(members: DataFrame) -> DataFrame:
    """Per group, true when it holds a domain property d and a URL-prefix property whose
    host is d or ends with '.d'."""
    m = members.select("group_id", "property", keys.property_type(F.col("property")).alias("ptype"))
    dom = m.where(F.col("ptype") == "domain").select(
        "group_id", F.lower(F.regexp_replace("property", "^sc-domain:", "")).alias("d"))
    host = F.lower(F.coalesce(F.try_parse_url(F.col("property"), F.lit("HOST")), F.lit("")))
    # A host meets the domains that are one of its own endings, whole labels each: an equi-join on group and domain.
    labels = F.split(host, "[.]")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = m.where(F.col("ptype") == "url_prefix").select("group_id", F.explode(endings).alias("d")).distinct()
    hit = hosts.join(dom, ["group_id", "d"], "left_semi").select("group_id").distinct().withColumn("double_count", F.lit(True))
    return (members.select("group_id").distinct().join(hit, "group_id", "left")
            .select("group_id", F.coalesce("double_count", F.lit(False)).alias("double_count")))


def existing_members(members: DataFrame, fact: DataFrame) -> DataFrame:
    """Group members that have rows in the fact table (semi join)."""
    present = fact.select("property").distinct()
    return members.join(present, "property", "left_semi")


def account_property_counts(registry: DataFrame, accounts: DataFrame) -> DataFrame:
    """C14: properties reachable per account (exploded account ids), left-joined to accounts."""
    c = registry.select(F.explode("account_ids").alias("account_id")).groupBy("account_id") \
        .agg(F.count(F.lit(1)).alias("property_count"))
    return (accounts.join(c, "account_id", "left")
            .select("account_id", "display_name", F.coalesce("property_count", F.lit(0)).alias("property_count")))


def new_suggestions(suggested: DataFrame, saved: DataFrame) -> DataFrame:
    """Suggested groups whose lower-cased name is not already saved."""
    s = saved.select(F.lower("name").alias("lname")).distinct()
    return suggested.withColumn("lname", F.lower("name")).join(s, "lname", "left_anti").drop("lname")


def accounts(attempts: DataFrame) -> DataFrame:
    """The account table as seen in the attempt log: display name, token health from the latest
    error class of the account (H19), last success."""
    a = attempts.where(F.col("account_id").isNotNull())
    ok = F.col("status").startswith("collected_")
    g = a.groupBy("account_id").agg(
        F.max(F.struct("logged_at", "error_message"))["error_message"].alias("last_message"),
        F.max(F.when(ok, F.col("logged_at"))).alias("last_success_at"))
    health = F.when(F.coalesce(F.col("last_message"), F.lit("")).rlike(status.REVOKED_MESSAGE),
                    status.token_error_class(F.col("last_message"))).otherwise(F.lit("valid"))
    return g.select("account_id", F.concat(F.lit("Account "), F.regexp_extract("account_id", r"(\d+)$", 1)).alias("display_name"),
                    health.alias("token_health"), "last_success_at")
