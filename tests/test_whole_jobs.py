"""Queries named in reviews for doing less than their whole job, over rows of their own."""

import datetime as dt

from clickstack import catalog

ROWS = "data_date date, data_month date, property string, search_type string, query string, clicks long, impressions long, position double"


def test_bench_rows_weigh_all_positions_of_a_query(spark, monkeypatch):
    day, month = dt.date(1998, 3, 5), dt.date(1998, 3, 1)
    row = lambda q, clicks, shown, at: (day, month, "https://a/", "web", q, clicks, shown, at)
    fact = spark.createDataFrame([
        row("both", 3, 30, 2.0), row("both", 1, 10, 18.0),   # 6 on the whole: both rows count
        row("deep", 1, 10, 5.0), row("deep", 1, 90, 40.0),   # 36.5 on the whole, 5 among the first ten
    ], ROWS)
    monkeypatch.setattr(catalog, "bp", lambda s, d: fact)
    for name in ("ctr_bench_rows", "topk_bench"):
        got = {r.key: (r.clicks, r.impressions, r.position) for r in catalog.queries()[name](spark, "unused").collect()}
        assert got == {"both": (4, 40, 6.0)}, name
