"""Planner, registry and status rules on small literal tables."""

import datetime as dt

from pyspark.sql import functions as F

from clickstack.operators import ledger as L
from clickstack.sources import fixtures

D = dt.date.fromisoformat


def _registry(spark, props):
    """props: (site_url, source, included, accounts)."""
    obs = []
    t = dt.datetime(2026, 1, 1)
    for url, _src, _inc, accts in props:
        for a in accts:
            obs.append((url, a, t))
    seen = spark.createDataFrame(obs, "property string, account_id string, logged_at timestamp")
    config = fixtures.settings(seen.limit(1).withColumn("property", F.lit("https://www.site0.example.com/"))).first()
    reg = L.registry_merge(seen, spark.createDataFrame([(u, s, i, config.config, config.brand_terms) for u, s, i, _ in props], (
        f"property string, source string, included boolean, config {L.REGISTRY_CONFIG}, brand_terms array<string>")))
    over = spark.createDataFrame([(u, s, i) for u, s, i, _ in props], "site_url string, src string, inc boolean")
    return (reg.join(over, "site_url").withColumn("source", F.col("src")).withColumn("included", F.col("inc"))
            .drop("src", "inc"))


def _ledger(spark, rows):
    return spark.createDataFrame(rows, "task_id string, property_id string, search_type string, aggregation string, "
                                       "data_date date, status string, attempts long, account_id string")


def test_totals_gate_and_scope(spark):
    reg = _registry(spark, [("https://www.a.com/", "api", True, ["acct1"]), ("https://www.b.com/", "api", True, ["acct1"]),
                            ("https://www.n.com/", "native_export", True, ["acct2"]),
                            ("https://www.u.com/", "api", False, ["acct1"])])
    as_of = D("2026-02-01")
    empty = _ledger(spark, [])
    plan = L.reconcile(reg, empty, as_of)
    assert plan.where(F.col("aggregation") == "totals").count() == 0          # nothing until byProperty is terminal
    assert {r.property_id for r in plan.select("property_id").distinct().collect()} == {"urlp_www_a_com", "urlp_www_b_com"}
    led = _ledger(spark, [("x", "urlp_www_a_com", "web", "byProperty", D("2026-01-10"), "collected_with_data", 1, "acct1")])
    plan2 = L.reconcile(reg, led, as_of)
    tot = plan2.where(F.col("aggregation") == "totals").collect()
    assert [(r.property_id, r.search_type, r.data_date) for r in tot] == [("urlp_www_a_com", "web", D("2026-01-10"))]
    scoped = L.reconcile(reg, empty, as_of, scope=["urlp_www_b_com"])
    assert {r.property_id for r in scoped.select("property_id").distinct().collect()} == {"urlp_www_b_com"}
    assert L.reconcile(reg, empty, as_of, scope=[]).count() == plan.count()   # empty scope = all
    # in-flight tasks are not clobbered; error tasks are planned again
    tid = "urlp_www_a_com__web__byPage__20260105"
    inflight = _ledger(spark, [(tid, "urlp_www_a_com", "web", "byPage", D("2026-01-05"), "queued", 1, "acct1")])
    assert L.reconcile(reg, inflight, as_of).where(F.col("task_id") == tid).count() == 0
    err = _ledger(spark, [(tid, "urlp_www_a_com", "web", "byPage", D("2026-01-05"), "error", 8, "acct1")])
    assert L.reconcile(reg, err, as_of).where(F.col("task_id") == tid).count() == 1


def test_double_count(spark):
    def dc(urls):
        m = spark.createDataFrame([("g", u) for u in urls], "group_id string, property string")
        return L.double_count(m).first().double_count
    assert dc(["sc-domain:example.com", "https://www.example.com/"]) is True
    assert dc(["sc-domain:example.com", "https://www.other.com/"]) is False
    assert dc(["https://a.com/", "https://b.com/"]) is False


def test_registry_merge(spark):
    obs = spark.createDataFrame([("https://www.site1.example.com/", "acct1", dt.datetime(2026, 1, 1)),
                                 ("https://www.site1.example.com/", "acct2", dt.datetime(2026, 2, 1)),
                                 ("https://www.site1.example.com/", "acct1", dt.datetime(2026, 3, 1))],
                                "property string, account_id string, logged_at timestamp")
    r = L.registry_merge(obs).first()
    assert r.account_ids == ["acct1", "acct2"]
    assert r.preferred_account_id == "acct1"                    # first observation kept
    assert r.discovered_at == dt.datetime(2026, 1, 1) and r.last_seen_at == dt.datetime(2026, 3, 1)


def test_registry_merge_keeps_what_is_known(spark):
    """Any host will do; a known row keeps its settings, gains accounts, and stays when it is not seen again."""
    cols = "property string, account_id string, logged_at timestamp"
    day = lambda n: dt.datetime(2026, 1, n)
    first = L.registry_merge(spark.createDataFrame(
        [("https://www.acme.com/", None, day(1)), ("https://www.acme.com/", "b", day(2)), ("https://www.acme.com/", "a", day(2)),
         ("sc-domain:shop.org", "c", day(3))], cols))
    acme = first.where("property like '%acme%'").first()
    assert (acme.preferred_account_id, acme.account_ids, acme.source, acme.included) == ("a", ["a", "b"], "api", False)
    known = first.withColumn("included", F.lit(True))
    again = {r.property: r for r in L.registry_merge(spark.createDataFrame(
        [("https://www.acme.com/", "z", day(9)), ("https://new.net/", "z", day(9))], cols), None, known).collect()}
    acme = again["https://www.acme.com/"]
    assert (acme.included, acme.source, acme.preferred_account_id, acme.account_ids) == (True, "api", "a", ["a", "b", "z"])
    assert (acme.discovered_at, acme.last_seen_at) == (day(1), day(9))
    assert again["sc-domain:shop.org"].account_ids == ["c"] and again["https://new.net/"].included is False
    # A newer source wins, and native properties are always included.
    native = L.registry_merge(spark.createDataFrame([("https://new.net/", "z", day(9))], cols), None,
                              first.withColumns({"source": F.lit("native_export"), "property": F.lit("https://new.net/")}).limit(1)).first()
    assert (native.source, native.included) == ("native_export", True)


def test_export_discovery_and_purge(spark):
    """Sites the registry lacks and sites known from the API become native properties, and a purge takes one account's only."""
    at = dt.datetime(2026, 1, 1)
    api = L.registry_merge(spark.createDataFrame([("https://api.com/", "a", at)], "property string, account_id string, logged_at timestamp"))
    sites = lambda *urls: spark.createDataFrame([(u,) for u in urls], "site_url string")
    one = L.discover_export(sites("https://new.net/", "https://api.com/"), "export0", at, api)
    both = L.discover_export(sites("https://other.org/", "https://other.org/"), "export1", at, one)
    got = {r.site_url: (r.source, r.account_ids, r.included) for r in both.collect()}
    assert got == {"https://api.com/": ("native_export", ["a", "export0"], True), "https://new.net/": ("native_export", ["export0"], True),
                   "https://other.org/": ("native_export", ["export1"], True)}
    assert sorted(r.site_url for r in L.native_of_account(both, "export0").collect()) == ["https://api.com/", "https://new.net/"]
    assert [r.site_url for r in L.purge_native(both, "export0").collect()] == ["https://other.org/"]


def test_export_queries_use_the_registry(spark):
    """Both accounts' sites are found, the one that the registry lacks among them; a purge leaves the other account's."""
    from clickstack import catalog
    from tests.conftest import SF_SMALL

    q = catalog.queries()
    found = {r.site_url: (r.source, r.account_ids) for r in q["discover_export"](spark, SF_SMALL).collect()}
    urls = {n: f"https://www.site{n}.example.com/" for n in range(6)} | {6: "sc-domain:site0.example.com", 7: "sc-domain:site1.example.com"}
    assert found == {u: ("native_export", f"export{1 - n % 2}") for n, u in urls.items()}
    left = {r.source_table for r in q["purge_native_account"](spark, SF_SMALL).collect()}
    assert left == {f"urlp_www_site{n}_example_com" for n in (0, 2, 4)} | {"domain_site0_example_com"}


def test_assigned_clients_stay(spark):
    from clickstack.sources.warehouse import control
    from tests.conftest import SF_SMALL

    reg, members = control(spark, SF_SMALL, "registry"), control(spark, SF_SMALL, "members")
    held = spark.createDataFrame([("urlp_www_site2_example_com", "mine", "Mine"), ("gone", "x", "X")], "property_id string, client_id string, client_name string")
    got = {r.property_id: r.client_id for r in L.client_assign(reg, members, held).collect()}
    assert got["urlp_www_site2_example_com"] == "mine" and got["urlp_www_site1_example_com"] == "g_grp_a" and "gone" not in got
    again = L.client_assign(reg, members, L.client_assign(reg, members, held))
    assert {r.property_id: r.client_id for r in again.collect()} == got


def test_double_count_by_whole_labels(spark):
    rows = [("a", "sc-domain:shop.org"), ("a", "https://m.shop.org/x"), ("b", "sc-domain:shop.org"), ("b", "https://myshop.org/"),
            ("c", "sc-domain:SHOP.org"), ("c", "http://shop.org"), ("d", "sc-domain:org"), ("d", "https://a.b.c.org:8080/"), ("e", "https://m.shop.org/"), ("f", "sc-domain:x.y")]
    got = {r.group_id: r.double_count for r in L.double_count(spark.createDataFrame(rows, "group_id string, property string")).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": True, "e": False, "f": False}


def test_repeated_hashes_are_found(spark):
    from clickstack.operators import ops

    rows = [(f"h{i}", dt.date(2026, 1 + i % 3, 1)) for i in range(300)] + [("h5", dt.date(2026, 3, 1)), ("h5", dt.date(2026, 3, 1)), ("h7", dt.date(2026, 2, 1))]
    df = spark.createDataFrame(rows, "row_hash string, data_month date")
    assert ops.row_hash_invariant({"t": df, "clean": df.limit(0)}).collect() == [("t", 2), ("clean", 0)]
    plan = ops._repeated(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan


def test_latest_state_of_equal_times(spark):
    """Columns never mix attempts, and the row does not depend on the order of the log."""
    from clickstack.schema import ATTEMPT

    t, d = dt.datetime(2026, 1, 1), dt.date(2026, 1, 1)
    rows = [("k", "https://a/", "web", "byPage", d, "acct9", "error", 1, None, None, "x", t),
            ("k", "https://a/", "web", "byPage", d, None, "collected_with_data", 2, 5, 1, None, t),
            ("k", "https://a/", "web", "byPage", d, "acct1", "queued", 3, None, None, None, t - dt.timedelta(hours=1))]
    for order in (rows, rows[::-1]):
        r = L.latest_state(spark.createDataFrame(order, ATTEMPT)).first()
        assert (r.status, r.attempts, r.account_id) == ("collected_with_data", 2, None)


def test_property_status(spark):
    reg = spark.createDataFrame([("p1", "https://www.site1.example.com/", True, "api"),
                                 ("p2", "https://www.site2.example.com/", True, "api"),
                                 ("p3", "https://www.site5.example.com/", True, "native_export"),
                                 ("p4", "https://www.site4.example.com/", False, "api")],
                                "property_id string, site_url string, included boolean, source string")
    t = dt.datetime
    att = spark.createDataFrame([
        ("https://www.site1.example.com/", D("2026-06-01"), "collected_with_data", None, t(2026, 6, 2)),
        ("https://www.site1.example.com/", D("2026-06-01"), "error", "boom", t(2026, 6, 1)),     # older error: ignored
        ("https://www.site2.example.com/", D("2026-06-01"), "collected_fresh", None, t(2026, 6, 1)),
        ("https://www.site2.example.com/", D("2026-06-02"), "error", "boom", t(2026, 6, 3)),     # newer error wins
        ("https://www.site5.example.com/", D("2026-06-01"), "error", "boom", t(2026, 6, 3)),
    ], "property string, data_date date, status string, error_message string, logged_at timestamp")
    k = {r.property_id: r.kind for r in L.property_status(reg, att).collect()}
    assert k == {"p1": "final", "p2": "error", "p3": "imported", "p4": "untracked"}


def test_client_assign_first_group_wins(spark):
    from clickstack.sources.warehouse import control
    from tests.conftest import SF_SMALL

    a = {r.property_id: r.client_id for r in control(spark, SF_SMALL, "assignment").collect()}
    assert a["urlp_www_site2_example_com"] == "g_grp_a"        # in groups A and B: A wins
    assert a["urlp_www_site3_example_com"] == "g_grp_b"
    assert a["urlp_www_site5_example_com"] == "p_urlp_www_site5_example_com"
    assert "domain_site1_example_com" not in a                  # untracked, not native
    assert fixtures.GROUPS[0][0] == "grp_a"


def test_daily_run(spark, tmp_path):
    from clickstack.catalog import FACT_AS_OF, LEDGER_AS_OF
    from clickstack.plans import daily
    from tests.conftest import SF_SMALL

    steps = {r.step: r.rows for r in daily.run(spark, SF_SMALL, str(tmp_path), FACT_AS_OF, LEDGER_AS_OF).collect()}
    assert steps["discover"] == 8 and steps["reconcile"] > 0 and steps["precompute"] > 0
    assert steps["dedup_duplicates"] == 0
