"""Cells collected page by page: against a plain loop over the same pages, errors, odd rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from clickstack.schema import API_RESPONSE
from clickstack.sources import collect, ingest
from clickstack.sources.loads import FactStore

AT = dt.datetime(2024, 2, 1, 12)
DAY = "2024-01-20"


def api_row(n):
    return {"keys": [f"q{n}", "usa", "MOBILE"], "clicks": float(n), "impressions": 10.0 + n, "ctr": 0.5, "position": 2.0}


def plan(spark, sizes, boundary=None):
    cells = [(f"https://{name}.com/", DAY, "web", "byProperty", boundary) for name in sizes]
    return spark.createDataFrame(cells, "site_url string, data_date string, search_type string, aggregation string, first_incomplete_date string")


def fetch_from(sizes, broken=()):
    def fetch(cell, start, limit):
        name = cell["site_url"].split("//")[1].split(".")[0]
        if name in broken and start >= broken[name][0]:
            raise RuntimeError(broken[name][1])
        return [api_row(n) for n in range(start, min(start + limit, sizes[name]))]
    return fetch


def by_plain_loop(size, per_page, ceiling):
    """(rows, calls) of a cell of ``size`` rows."""
    rows = calls = start = 0
    while True:
        page = max(0, min(per_page, size - start))
        rows, calls = rows + page, calls + 1
        if page == 0 or start + per_page >= ceiling:
            return rows, calls
        start += per_page


SIZES = {f"s{n}": n for n in (0, 1, 2, 3, 4, 5, 6, 7, 9)}


@pytest.mark.parametrize("per_page, ceiling", [(3, 6), (2, 5), (10, 10), (1, 1)])
def test_pages_rows_and_calls_equal_a_plain_loop(spark, per_page, ceiling):
    cells = plan(spark, SIZES)
    got = collect.collect_cells(cells.unionByName(cells), fetch_from(SIZES), per_page, ceiling)
    found = {r.site_url: (r.n, r.calls) for r in got.groupBy("site_url").agg(
        F.sum(F.size("rows")).alias("n"), F.max("api_calls").alias("calls")).collect()}
    assert found == {f"https://{s}.com/": by_plain_loop(n, per_page, ceiling) for s, n in SIZES.items()}


@pytest.mark.parametrize("per_page, ceiling", [(3, 6), (2, 5), (10, 10)])
def test_pages_at_hand_give_the_same_rows(spark, per_page, ceiling):
    pages = [(f"https://{s}.com/", DAY, "web", "byProperty", None, [api_row(i) for i in range(a, min(a + per_page, n))], None, a)
             for s, n in SIZES.items() for a in range(0, n, per_page)]
    schema = collect.T.StructType([*API_RESPONSE.fields, collect.T.StructField("start_row", collect.T.LongType())])
    reached = collect.reached_pages(plan(spark, SIZES), spark.createDataFrame(pages, schema), per_page, ceiling)
    asked = collect.collect_cells(plan(spark, SIZES), fetch_from(SIZES), per_page, ceiling)
    assert reached.schema.names == asked.schema.names
    key = lambda r: (r.site_url, r.start_row)
    assert sorted(reached.collect(), key=key) == sorted(asked.collect(), key=key)


def test_nothing_after_a_gap_is_reached(spark):
    schema = collect.T.StructType([*API_RESPONSE.fields, collect.T.StructField("start_row", collect.T.LongType())])
    pages = [("https://a.com/", DAY, "web", "byProperty", None, [api_row(1)], None, start) for start in (0, 4)]
    got = collect.reached_pages(plan(spark, {"a": 1, "b": 0}), spark.createDataFrame(pages, schema), 2, 100)
    assert sorted((r.site_url, r.start_row, len(r.rows), r.api_calls) for r in got.collect()) == [
        ("https://a.com/", 0, 1, 2), ("https://b.com/", 0, 0, 1)]


def test_an_error_keeps_no_page_and_others_go_on(spark):
    sizes = {"ok": 5, "late": 5, "gone": 5, "none": 0}
    broken = {"late": (3, "503 backend error, please retry: rateLimitExceeded"), "gone": (0, "")}
    got = collect.collect_cells(plan(spark, sizes), fetch_from(sizes, broken), 3, 9)
    log = {r.property.split("//")[1][:-5]: r for r in collect.attempts_of(got, 1, AT).collect()}
    assert (log["ok"].row_count, log["ok"].api_calls, log["ok"].status) == (5, 3, "collected_with_data")
    assert (log["none"].row_count, log["none"].api_calls, log["none"].status) == (0, 1, "collected_no_data")
    assert (log["late"].row_count, log["late"].api_calls) == (0, 1) and "503" in log["late"].error_message
    assert (log["gone"].error_message, log["gone"].status, log["gone"].api_calls) == ("RuntimeError", "error", 0)


def test_a_day_not_final_is_fresh_and_the_task_has_its_id(spark):
    got = collect.collect_cells(plan(spark, {"a": 2}, DAY), fetch_from({"a": 2}), 3, 9)
    row = collect.attempts_of(got, 2, AT).first()
    assert (row.status, row.attempt, row.data_date) == ("collected_fresh", 2, dt.date(2024, 1, 20))
    assert row.task_id.endswith("__web__byProperty__20240120")


def test_collected_pages_go_into_the_store(spark):
    root = ingest.scratch(spark, "collect")
    got = collect.collect_cells(plan(spark, SIZES), fetch_from(SIZES), 3, 6)
    ingest.store_responses(spark, got.withColumn("loaded_at", F.lit(AT)), root, AT)
    stored = {r.property: r.n for r in FactStore(spark, root).current().groupBy("property").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert stored == {f"https://{s}.com/": min(n, 6) for s, n in SIZES.items() if n}


def test_an_empty_plan_null_numbers_and_wrong_sizes(spark):
    assert collect.collect_cells(plan(spark, SIZES).limit(0), fetch_from(SIZES)).count() == 0
    got = collect.collect_cells(plan(spark, {"a": 1}), lambda cell, start, limit: [] if start else [{"keys": None}], 3, 9).first()
    assert [tuple(r) for r in got.rows] == [(None, None, None, None, None)]
    with pytest.raises(ValueError):
        collect.collect_cells(plan(spark, SIZES), fetch_from(SIZES), 0)
