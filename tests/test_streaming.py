"""Structured Streaming jobs: micro-batched ingest equals the batch mapping and replays cleanly;
alert windows respect the watermark."""

import datetime as dt

from pyspark.sql import functions as F

from clickstack.sources import ingest
from clickstack.sources.loads import FactStore
from clickstack.streaming import ingest_stream, ops_stream

COLLECTED = dt.datetime(2001, 11, 5)
COLS = ["property", "data_date", "search_type", "query", "country", "device", "clicks", "impressions", "data_state",
        "row_hash"]


def test_stream_ingest_micro_batches_and_replay(spark, tmp_path):
    from clickstack.catalog import bp
    from tests.conftest import SF_SMALL

    fact = bp(spark, SF_SMALL).where(F.col("data_month").between(dt.date(2001, 9, 1), dt.date(2001, 11, 1)))
    src = str(tmp_path / "responses")
    ingest.to_responses(fact).repartition(4).write.json(src)
    target = str(tmp_path / "table")
    out = ingest_stream.run_available(spark, src, target, str(tmp_path / "ck1"), COLLECTED, max_files_per_trigger=1)
    got = sorted(map(tuple, out.select(*COLS).collect()), key=str)
    exp = sorted(map(tuple, fact.select(*COLS).collect()), key=str)
    assert got == exp
    # replay every file through a fresh checkpoint: slice replacement keeps the table identical
    again = ingest_stream.run_available(spark, src, target, str(tmp_path / "ck2"), COLLECTED, max_files_per_trigger=2)
    assert sorted(map(tuple, again.select(*COLS).collect()), key=str) == exp


def test_stream_ingest_restated_and_mixed_cells(spark, tmp_path):
    """A cell loaded twice in one batch counts once, and a page load leaves the property rows of its day alone."""
    from clickstack.schema import API_RESPONSE

    def cell(aggregation, keys, clicks, loaded, day="2026-05-01"):
        at = dt.datetime(2026, 5, 3, loaded) if loaded is not None else None
        return ("https://www.acme.com/", day, "web", aggregation, None, [(keys, clicks, 10.0, 0.1, 1.0)], at)

    def load(name, cells):
        spark.createDataFrame(cells, API_RESPONSE).write.json(str(tmp_path / "in" / name))

    def table():
        out = ingest_stream.run_available(spark, str(tmp_path / "in/*"), str(tmp_path / "table"), str(tmp_path / "ck"), COLLECTED)
        return sorted((r.aggregation, str(r.data_date), r["query"], r.clicks) for r in out.collect())

    load("a", [cell("byProperty", ["q", "usa", "MOBILE"], 1.0, None), cell("byProperty", ["q", "usa", "MOBILE"], 2.0, 5),
               cell("byProperty", ["q", "usa", "MOBILE"], 3.0, 4), cell("byProperty", ["r", "usa", "MOBILE"], 4.0, 1, "2026-05-02")])
    assert table() == [("byProperty", "2026-05-01", "q", 2), ("byProperty", "2026-05-02", "r", 4)]
    load("b", [cell("byPage", ["q", "https://www.acme.com/x", "usa", "MOBILE"], 7.0, 6)])
    load("c", [cell("byProperty", ["q", "usa", "MOBILE"], 9.0, 8)])
    rows = table()
    assert [r[0] for r in rows] == ["byPage", "byProperty", "byProperty"] and rows[0][3] == 7
    assert rows[1:] == [("byProperty", "2026-05-01", "q", 9), ("byProperty", "2026-05-02", "r", 4)]


def _cell(aggregation, rows, loaded):
    at = dt.datetime(2026, 5, 3, loaded) if loaded is not None else None
    return ("https://www.acme.com/", "2026-05-01", "web", aggregation, None, [(k, c, 10.0, 0.1, 1.0) for k, c in rows], at)


def test_stream_ingest_pages_and_late_loads(spark, tmp_path):
    """Pages of a load that come in different batches all stay, and an older load that comes later replaces nothing."""
    from clickstack.schema import API_RESPONSE

    def arrive(name, *cells):
        spark.createDataFrame(list(cells), API_RESPONSE).coalesce(1).write.json(str(tmp_path / "in" / name))
        out = ingest_stream.run_available(spark, str(tmp_path / "in/*"), str(tmp_path / "table"), str(tmp_path / "ck"), COLLECTED,
                                          max_files_per_trigger=1)
        return sorted((r["query"], r.clicks) for r in out.collect())

    k = lambda q: [q, "usa", "MOBILE"]
    assert arrive("a", _cell("byProperty", [(k("q"), 1.0)], None)) == [("q", 1)]
    assert arrive("b", _cell("byProperty", [(k("r"), 2.0)], None)) == [("q", 1), ("r", 2)]
    assert arrive("c", _cell("byProperty", [(k("q"), 3.0)], 5)) == [("q", 3)]
    assert arrive("d", _cell("byProperty", [(k("s"), 4.0)], 5)) == [("q", 3), ("s", 4)]
    assert arrive("e", _cell("byProperty", [(k("q"), 8.0), (k("t"), 8.0)], 4)) == [("q", 3), ("s", 4)]
    assert arrive("f", _cell("byProperty", [], 7)) == [("q", 3), ("s", 4)]
    assert arrive("g", _cell("byProperty", [(k("s"), 4.0)], 5)) == [("q", 3), ("s", 4)]
    assert arrive("h", _cell("byProperty", [(k("u"), 9.0)], 6)) == [("u", 9)]


def test_daily_ingests_all_aggregations(spark, tmp_path):
    from clickstack.catalog import FACT_AS_OF, LEDGER_AS_OF
    from clickstack.plans import daily
    from clickstack.schema import API_RESPONSE
    from tests.conftest import SF_SMALL

    cells = [_cell("byProperty", [(["q", "usa", "MOBILE"], 1.0)], 5), _cell("totals", [([], 2.0)], 5),
             _cell("byPage", [(["q", "https://www.acme.com/x", "usa", "MOBILE"], 3.0)], 5)]
    spark.createDataFrame(cells, API_RESPONSE).write.json(str(tmp_path / "in"))
    steps = {r.step: r.rows for r in daily.run(spark, SF_SMALL, str(tmp_path / "out"), FACT_AS_OF, LEDGER_AS_OF, str(tmp_path / "in")).collect()}
    assert steps["ingest"] == 3
    stored = FactStore(spark, str(tmp_path / "out" / "facts")).current().collect()
    assert {r.aggregation: r.clicks for r in stored} == {"byProperty": 1, "byPage": 3, "totals": 2}


def test_error_windows_watermark(spark, tmp_path):
    rows = [("t", "p", "web", "byProperty", dt.date(2024, 1, 1), None, "error", 1, None, None, "x", dt.datetime(2024, 1, 1, 10, m))
            for m in range(0, 50, 2)]
    rows += [("t", "p", "web", "byProperty", dt.date(2024, 1, 1), None, "error", 1, None, None, "x", dt.datetime(2024, 1, 1, 13, 0))]
    from clickstack.schema import ATTEMPT

    src = str(tmp_path / "log")
    spark.createDataFrame(rows[:-1], ATTEMPT).write.parquet(src + "/a")
    spark.createDataFrame(rows[-1:], ATTEMPT).write.parquet(src + "/b")
    out = ops_stream.run_available(spark, src + "/*", str(tmp_path / "sink"), str(tmp_path / "ck"), max_files_per_trigger=1)
    got = {r.window_start: (r.errors, r.alert) for r in out.collect()}
    # every hour is there, the newest one too, and nothing came too late
    assert got == {dt.datetime(2024, 1, 1, 10, 0): (25, True), dt.datetime(2024, 1, 1, 13, 0): (1, False)}
    assert {r.late for r in out.collect()} == {0}


def test_hours_follow_late_attempts(spark, tmp_path):
    """A late attempt raises the hour that is on record already; the gap stays open until a success ends it."""
    from clickstack.schema import ATTEMPT

    def row(status, hour, minute=0, day=1):
        return ("t", "p", "web", "byProperty", dt.date(2024, 1, 1), "a", status, 1, None, None, "x", dt.datetime(2024, 1, day, hour, minute))

    src = str(tmp_path / "log")
    arrive = lambda name, rows: spark.createDataFrame(rows, ATTEMPT).coalesce(1).write.parquet(f"{src}/{name}")
    run = lambda: {r.window_start.hour: r.errors for r in ops_stream.run_available(
        spark, src + "/*", str(tmp_path / "sink"), str(tmp_path / "ck"), max_files_per_trigger=1).collect()}
    gaps = lambda day: [(r.gap_start.day, r.gap_end.day, r.open) for r in ops_stream.run_gaps(
        spark, src + "/*", str(tmp_path / "sink2"), str(tmp_path / "ck2"), dt.datetime(2024, 1, day, 12), ["property"]).collect()]
    arrive("a", [row("error", 10), row("error", 15), row("collected_fresh", 9)])
    assert run() == {10: 1, 15: 1}
    assert gaps(1) == [] and gaps(3) == [(1, 3, True)]
    arrive("b", [row("error", 10, 5), row("collected_no_data", 8, day=4)])
    assert run() == {10: 2, 15: 1}
    assert gaps(4) == [(1, 4, False)]
