"""Literal cases for the date, key, filter and status functions."""

import datetime as dt

from pyspark.sql import functions as F

from clickstack.functions import dates, keys, status, text
from clickstack.functions import filters as flt
from clickstack.functions.filters import Filters

D = dt.date.fromisoformat


def test_compare_window_modes():
    assert dates.compare_window("2026-05-01", "2026-05-28", "previous") == (D("2026-04-03"), D("2026-04-30"))
    assert dates.compare_window("2026-05-01", "2026-05-28", "yoy") == (D("2025-05-01"), D("2025-05-28"))
    assert dates.compare_window("2026-05-01", "2026-05-28", "yoy", match_weekdays=True) == (D("2025-05-02"), D("2025-05-29"))
    assert dates.compare_window("2026-03-31", "2026-03-31", "prev_month") == (D("2026-02-28"), D("2026-02-28"))
    assert dates.compare_window("2026-05-01", "2026-05-28", "custom") is None
    assert dates.compare_window("2026-05-01", "2026-05-28", "none") is None
    assert dates.movers_window("2026-05-01", "2026-05-28", "none") == (D("2026-04-03"), D("2026-04-30"))
    assert dates.movers_window("2026-05-01", "2026-05-28", "custom") == (D("2026-04-03"), D("2026-04-30"))


def test_compare_window_columns_match_driver_rule(spark):
    df = spark.createDataFrame([(D("2026-05-01"), D("2026-05-28")), (D("2026-03-31"), D("2026-03-31"))], "s date, e date")
    for mode, mw in (("previous", False), ("yoy", False), ("yoy", True), ("prev_month", False)):
        cs, ce = dates.compare_window_cols("s", "e", mode, mw)
        for r in df.select("s", "e", cs.alias("cs"), ce.alias("ce")).collect():
            assert (r.cs, r.ce) == dates.compare_window(r.s, r.e, mode, match_weekdays=mw)


def test_pacific_day_and_window(spark):
    r = spark.sql("SELECT TIMESTAMP '2026-06-18 05:30:00' AS ts").select(dates.pacific_day("ts").alias("d")).first()
    assert r.d == D("2026-06-17")
    today = F.lit(D("2026-06-18"))
    o1, n1 = dates.collection_window(today, 3, 1)
    o2, _ = dates.collection_window(today, 3, 240)
    r = spark.range(1).select(o1.alias("o1"), n1.alias("n1"), o2.alias("o2")).first()
    assert (r.o1, r.n1, r.o2) == (D("2026-05-18"), D("2026-06-15"), D("2025-02-18"))
    # Month subtraction overflows like a JS Date: Mar 31 − 1 month = Mar 3.
    r = spark.range(1).select(dates.subtract_months_overflow(F.lit(D("2026-03-31")), 1).alias("d")).first()
    assert r.d == D("2026-03-03")


def test_days_in_range(spark):
    df = spark.createDataFrame([(D("2026-06-13"), D("2026-06-15")), (D("2026-06-15"), D("2026-06-13"))], "s date, e date")
    out = [r.d for r in df.select(dates.days_in_range("s", "e").alias("d")).collect()]
    assert out[0] == [D("2026-06-13"), D("2026-06-14"), D("2026-06-15")]
    assert out[1] == []


def test_valid_iso_date(spark):
    df = spark.createDataFrame([("2026-02-28",), ("2026-02-30",), ("2026-2-1",), ("x",)], "t string")
    assert [r.v for r in df.select(dates.valid_iso_date("t").alias("v")).collect()] == [True, False, False, False]


def _row(**kw):
    base = dict(property="sc-domain:example.com", data_date=D("2026-06-15"), search_type="web",
                aggregation="byProperty", query="shoes", page=None, country="usa", device="MOBILE",
                search_appearance=None, is_anonymized=False, clicks=1)
    base.update(kw)
    return base


def _hash(spark, rows):
    schema = ("property string, data_date date, search_type string, aggregation string, query string, page string, "
              "country string, device string, search_appearance string, is_anonymized boolean, clicks long")
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    return [r.h for r in df.select(keys.row_hash().alias("h")).collect()]


def test_row_hash(spark):
    import hashlib

    h = _hash(spark, [_row(), _row(query="boots"), _row(device="DESKTOP"), _row(data_date=D("2026-06-16")),
                      _row(clicks=99), _row(query=None), _row(query=""), _row(is_anonymized=True)])
    assert len(h[0]) == 64 and all(c in "0123456789abcdef" for c in h[0])
    assert h[1] != h[0] and h[2] != h[0] and h[3] != h[0]
    assert h[4] == h[0]                      # metrics are not part of the tuple
    assert h[5] == h[6]                      # null and '' collapse
    assert h[7] != h[0]                      # the anonymized flag is
    expect = hashlib.sha256("sc-domain:example.com|2026-06-15|web|byProperty|shoes||usa|MOBILE||false".encode()).hexdigest()
    assert h[0] == expect


def test_property_keys(spark):
    df = spark.createDataFrame([("https://www.Example.com/a-b/",), ("sc-domain:example.com",), ("http://x.org",)], "u string")
    r = df.select(keys.property_key("u").alias("k"), keys.property_type("u").alias("t"),
                  text.client_name(F.col("u")).alias("c")).collect()
    assert [x.k for x in r] == ["urlp_www_example_com_a_b", "domain_example_com", "urlp_x_org"]
    assert [x.t for x in r] == ["url_prefix", "domain", "url_prefix"]
    assert [x.c for x in r] == ["Example.com/a-b", "example.com", "x.org"]


def test_norm_search_type(spark):
    df = spark.createDataFrame([("WEB",), ("GOOGLE_NEWS",), ("Weird",)], "s string")
    assert [r.n for r in df.select(keys.norm_search_type("s").alias("n")).collect()] == ["web", "googleNews", "weird"]


def test_filters_select_rows(spark):
    """A comma list means any of its words; excluded terms and brand segments cut whole queries; null queries fit no query filter."""
    queries = ["oak table", "pine shelf", "oak shelf zumo", "Zumo", None, "lamp"]
    df = spark.createDataFrame([(q, f"https://h/{i}", "web", D("2031-03-04"), D("2031-03-01")) for i, q in enumerate(queries)],
                               "query string, page string, search_type string, data_date date, data_month date")
    base = Filters(start="2031-03-01", end="2031-03-31", brand_terms=("zumo",))
    pick = lambda f: sorted(r.query or "-" for r in df.where(flt.to_column(f)).collect())
    assert pick(base.replace(query="table, shelf")) == ["oak shelf zumo", "oak table", "pine shelf"]
    assert pick(base.replace(query="table, shelf", brand_exclude=("zumo",))) == ["oak table", "pine shelf"]
    assert pick(base.replace(segment="brand")) == ["Zumo", "oak shelf zumo"]
    assert pick(base.replace(segment="nonbrand")) == ["lamp", "oak table", "pine shelf"]


def test_presets(spark):
    df = spark.createDataFrame([("how to fix a tap",), ("buy  cheap  tap",), ("tap",), ("What is x",)], "query string") \
        .withColumn("search_type", F.lit("web")).withColumn("data_date", F.lit(D("2026-05-02"))) \
        .withColumn("data_month", F.lit(D("2026-05-01")))
    f = Filters(start="2026-05-01", end="2026-05-28")
    paa = [r.query for r in df.where(flt.to_column(f.replace(presets=("paa",)))).collect()]
    assert paa == ["how to fix a tap", "What is x"]
    lt = [r.query for r in df.where(flt.to_column(f.replace(presets=("longtail",)))).collect()]
    assert lt == ["how to fix a tap", "buy  cheap  tap"]   # double spaces count as words


def test_status_classifiers(spark):
    df = spark.createDataFrame([("quotaExceeded: try again", 1), ("invalid_grant", 1), ("backendError", 8), (None, 1)],
                               "m string, a int")
    r = df.select(status.retryable_error("m").alias("r"), status.token_error_class("m").alias("t"),
                  status.dead_letter("m", "a").alias("d")).collect()
    assert [x.r for x in r] == [True, False, True, False]
    assert [x.t for x in r] == ["broken", "revoked", "broken", "broken"]
    assert [x.d for x in r] == ["queued", "error", "error", "error"]


def test_dims_and_combos(spark):
    df = spark.createDataFrame([("byProperty", "web"), ("byPage", "discover"), ("byProperty", "discover"), ("totals", "web")],
                               "a string, t string")
    r = df.select(status.dims_for("a", "t").alias("d"), status.valid_combo("t", "a").alias("v")).collect()
    assert [x.d for x in r] == [["query", "country", "device"], ["page", "country"], None, []]
    assert [x.v for x in r] == [True, True, False, True]


def test_text_helpers(spark):
    df = spark.createDataFrame([("https://www.x.com/blog/a",), ("https://www.x.com/",), ("https://x.com",),
                                ("/?p=2",), ("https://x.com//a/b",)], "p string")
    assert [r.s for r in df.select(text.first_segment("p").alias("s")).collect()] == ["blog", "", "", "?p=2", "a"]
    df2 = spark.createDataFrame([("how-to_guides",), ("a--b",)], "s string")
    assert [r.t for r in df2.select(text.title_case("s").alias("t")).collect()] == ["How To Guides", "A B"]


def test_table_name_collisions(spark):
    from clickstack.operators import ops

    u = spark.createDataFrame([("https://a.com/x-y",), ("http://a.com/x_y",), ("https://b.com/",), ("https://a.com/x.y",)],
                              "url string")
    got = sorted(map(tuple, ops.table_name_collisions(u).collect()))
    assert got == [("urlp_a_com_x_y", 3, "http://a.com/x_y"), ("urlp_a_com_x_y", 3, "https://a.com/x-y"),
                   ("urlp_a_com_x_y", 3, "https://a.com/x.y")]
