"""Ingest: response mapping, idempotent slice replacement (replay, overlap, crash), ceiling."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from clickstack.sources import ingest
from clickstack.sources.loads import FactStore

COLLECTED = dt.datetime(2026, 6, 18, 12, 0)


def _responses(spark, rows, day="2026-06-15", agg="byProperty", st="web", fi=None):
    data = [{"site_url": "sc-domain:example.com", "data_date": day, "search_type": st, "aggregation": agg,
             "first_incomplete_date": fi, "rows": [{"keys": k, "clicks": c, "impressions": i, "ctr": None,
                                                     "position": p} for k, c, i, p in rows]}]
    from clickstack.schema import API_RESPONSE

    return spark.createDataFrame(data, API_RESPONSE)


def test_response_mapping(spark):
    r = _responses(spark, [(["blue widgets", "aus", "DESKTOP"], 3.0, 10.0, 2.5)])
    out = ingest.map_response_rows(r, COLLECTED).first()
    assert (out.query, out.country, out.device, out.page) == ("blue widgets", "aus", "DESKTOP", None)
    assert (out.clicks, out.impressions, out.ctr, out.is_anonymized) == (3, 10, 0.0, False)
    assert out.data_state == "final" and out.property_type == "domain"
    page = _responses(spark, [(["https://x/a", "aus"], None, None, None)], agg="byPage", st="discover")
    p = ingest.map_response_rows(page, COLLECTED).first()
    assert (p.query, p.page, p.country, p.device, p.clicks) == (None, "https://x/a", "aus", None, 0)
    fresh = ingest.map_response_rows(_responses(spark, [(["q", "aus", "MOBILE"], 1.0, 1.0, 1.0)], fi="2026-06-15"),
                                     COLLECTED).first()
    assert fresh.data_state == "fresh"


def _rows(spark, day, clicks_by_query):
    r = _responses(spark, [([q, "usa", "MOBILE"], float(c), 100.0, 3.0) for q, c in clicks_by_query], day=day)
    return ingest.with_row_hash(ingest.map_response_rows(r, COLLECTED)).drop("data_month")


def _table(store):
    return {(r.data_date.isoformat(), r.query): r.clicks for r in store.current().collect()}


def _at(rows, hour):
    return rows.withColumn("loaded_at", F.lit(dt.datetime(2026, 6, 18, hour)).cast("timestamp"))


def test_store_replay_overlap_crash(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "t"))
    a = _at(_rows(spark, "2026-06-14", [("a", 1), ("b", 2)]), 1)
    b = _at(_rows(spark, "2026-06-15", [("a", 5)]), 1)
    assert _table(store) == {}
    store.store(a)
    store.store(b)
    first = _table(store)
    hashes = sorted(r.row_hash for r in store.current().collect())
    # replay: same rows again → same table, no doubling
    store.store(b)
    store.store(a)
    assert _table(store) == first
    assert sorted(r.row_hash for r in store.current().collect()) == hashes
    # overlap: a restated day replaces only its own slice
    store.store(_at(_rows(spark, "2026-06-15", [("a", 7), ("c", 1)]), 2))
    assert _table(store) == {("2026-06-14", "a"): 1, ("2026-06-14", "b"): 2, ("2026-06-15", "a"): 7, ("2026-06-15", "c"): 1}
    # an older load that comes later changes nothing and writes nothing
    before = store.loads().count()
    assert store.store(_at(_rows(spark, "2026-06-15", [("z", 9)]), 1)) is None and store.loads().count() == before
    # crash between two loads: re-running the whole batch converges to the same table
    store.store(_at(_rows(spark, "2026-06-14", [("a", 9)]), 3))
    store.store(_at(_rows(spark, "2026-06-14", [("a", 9)]), 3))
    t = _table(store)
    assert t[("2026-06-14", "a")] == 9 and ("2026-06-14", "b") not in t
    assert len(t) == 3


def test_store_half_written_load_is_not_seen(spark, tmp_path, monkeypatch):
    """Rows whose load was not listed (a crash, or a write under way) do not exist for readers."""
    store = FactStore(spark, str(tmp_path / "t"))
    store.store(_at(_rows(spark, "2026-06-14", [("a", 1)]), 1))

    def crash(self, cells, load_id, part):
        assert _table(store) == {("2026-06-14", "a"): 1}
        raise RuntimeError("lost")

    monkeypatch.setattr(FactStore, "_list", crash)
    with pytest.raises(RuntimeError):
        store.store(_at(_rows(spark, "2026-06-14", [("a", 5), ("b", 5)]), 2))
    monkeypatch.undo()
    assert _table(store) == {("2026-06-14", "a"): 1}
    store.store(_at(_rows(spark, "2026-06-14", [("a", 5), ("b", 5)]), 2))
    assert _table(store) == {("2026-06-14", "a"): 5, ("2026-06-14", "b"): 5}
    assert store.vacuum() == 2  # the replaced load and the lost one
    assert _table(store) == {("2026-06-14", "a"): 5, ("2026-06-14", "b"): 5}


def test_store_writes_own_rows_only_and_compacts(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "t"))
    rows = lambda: spark.read.parquet(store.rows_path).count()
    days = [f"2026-06-{k:02d}" for k in range(1, 9)]
    for k, day in enumerate(days):
        store.store(_at(_rows(spark, day, [(f"q{i}", i + k) for i in range(20)]), 1))
    assert rows() == 160
    store.store(_at(_rows(spark, days[0], [("q0", 100)]), 2))
    assert rows() == 161  # the month is not rewritten
    store.store(_at(_rows(spark, "2026-07-01", [("q0", 7)]), 2))
    want = _table(store)
    assert len(want) == 142
    july = store.current(dt.date(2026, 6, 30))
    assert [r.data_date for r in july.collect()] == [dt.date(2026, 7, 1)]
    assert store.compact() == 2 and _table(store) == want
    assert store.vacuum() == 10 and _table(store) == want and rows() == 142
    assert [r.data_date for r in store.current(dt.date(2026, 6, 30)).collect()] == [dt.date(2026, 7, 1)]
    assert store.current(last=dt.date(2026, 6, 2)).count() == 21
    assert store.compact() == 0 and store.vacuum() == 0
    # a compacted cell is replaced, and goes on, like any other
    store.store(_at(_rows(spark, days[0], [("q1", 3)]), 2))
    store.store(_at(_rows(spark, days[1], [("q1", 4)]), 3))
    t = _table(store)
    assert (t[(days[0], "q0")], t[(days[0], "q1")], t[(days[1], "q1")]) == (100, 3, 4) and (days[1], "q0") not in t


def test_store_reads_older_files_with_the_new_schema(spark, tmp_path):
    """Files written before a column was added read it as null."""
    store = FactStore(spark, str(tmp_path / "t"))
    store.store(_at(_rows(spark, "2026-06-14", [("a", 1)]), 1))
    old = spark.read.parquet(store.rows_path).drop("search_appearance", "property_type")
    other = FactStore(spark, str(tmp_path / "old"))
    old.write.partitionBy("aggregation", "part", "load_id").parquet(other.rows_path)
    store.loads().write.parquet(other.loads_path)
    other.store(_at(_rows(spark, "2026-06-15", [("b", 2)]), 1))
    got = {r.query: r.property_type for r in other.current().collect()}
    assert got == {"a": None, "b": "domain"}


def test_empty_result_keeps_slice(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "t"))
    store.store(_rows(spark, "2026-06-14", [("a", 1)]))
    assert store.store(_rows(spark, "2026-06-14", [("a", 1)]).limit(0)) is None
    assert ingest.store_responses(spark, _responses(spark, [], day="2026-06-14"), store.root, COLLECTED) is None
    assert _table(store) == {("2026-06-14", "a"): 1}


def test_pagination_ceiling(spark):
    rows = spark.range(50_010).select(F.lit("p").alias("property"), F.lit(dt.date(2026, 6, 1)).alias("data_date"),
                                      F.lit("web").alias("search_type"), F.lit("byPage").alias("aggregation"),
                                      F.col("id").cast("string").alias("query"), F.lit(None).cast("string").alias("page"),
                                      F.lit("usa").alias("country"), F.lit("MOBILE").alias("device"))
    out = ingest.pagination_ceiling(rows)
    assert out.count() == 50_010
    assert out.where(~F.col("hit_ceiling")).count() == 0


def test_responses_round_trip(spark):
    from clickstack.catalog import bp
    from tests.conftest import SF_SMALL

    fact = bp(spark, SF_SMALL).where(F.col("data_month") == dt.date(1998, 1, 1))
    back = ingest.map_response_rows(ingest.to_responses(fact), COLLECTED)
    cols = ["property", "data_date", "search_type", "query", "country", "device", "clicks", "impressions", "data_state"]
    assert sorted(map(tuple, fact.select(*cols).collect()), key=str) == sorted(map(tuple, back.select(*cols).collect()), key=str)


def test_writers_write_everything(spark):
    """The staging query stages the whole table, and the log holds both of two different batches."""
    from clickstack import catalog
    from tests.conftest import SF_SMALL

    q = catalog.queries()
    staged = {r.property: r["count"] for r in q["stage_ndjson"](spark, SF_SMALL).collect()}
    assert staged == {r.property: r["count"] for r in catalog.bp(spark, SF_SMALL).groupBy("property").count().collect()}
    logged = {r.status: r["count"] for r in q["append_attempt"](spark, SF_SMALL).collect()}
    expected = {r.status: r["count"] for r in catalog.attempts(spark, SF_SMALL).groupBy("status").count().collect()}
    assert logged == expected | {"pending": q["reconcile"](spark, SF_SMALL).count()}
