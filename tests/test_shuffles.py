"""What large jobs shuffle, spill and write: small cases of the rules that keep it in proportion."""

import datetime as dt
import gzip
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from clickstack.operators import ops
from clickstack.sources import ingest, loads, warehouse
from clickstack.streaming import ingest_stream

STAGE = ("data_date date, property string, search_type string, query string, page string, country string, device string, "
         "clicks long, impressions long, position double, is_anonymized boolean")


@pytest.fixture
def stage(spark):
    day = dt.date(1998, 1, 30)
    rows = [(day + dt.timedelta(days=i % 3), "https://a/", ("web", "news", "discover")[i % 3], None if i % 5 == 0 else f"q{i % 4}",
             f"https://a/{i % 2}", "fr", None, i, 2 * i, 1.5, i % 7 == 0) for i in range(60)]
    return spark.createDataFrame(rows + rows[:9], STAGE)


@pytest.mark.parametrize("build", [warehouse.build_by_page, warehouse.build_by_property])
def test_one_shuffle_aggregates_and_lays_out(stage, build):
    laid_out = build(stage, 3)
    plan = laid_out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan
    before_sort = plan[plan.index("Sort [data_month"):]
    assert "sha2" not in before_sort  # hashes are made after the sort
    assert sorted(map(str, laid_out.collect())) == sorted(map(str, build(stage).collect()))


def test_tasks_follow_the_rows(spark):
    assert warehouse.tasks_for(spark, 0) == 1
    assert warehouse.tasks_for(spark, 200_000_000) > 400


def test_repeated_hashes_leave_the_rows_in_place(spark):
    rows = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("row_hash"), F.lit(dt.date(1998, 1, 1)).alias("data_month"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        found = ops._repeated(rows.unionByName(rows.limit(2)).unionByName(rows.limit(1)))
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["count"] for r in found.collect()) == [2, 3]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_staged_rows_are_compressed(spark, tmp_path):
    rows = spark.range(100).select("id", F.lit("https://www.site0.example.com/").alias("property"))
    ingest.stage_ndjson(rows, str(tmp_path / "staged"))
    assert {p.suffix for p in (tmp_path / "staged").glob("part-*")} == {".gz"}
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "staged")).collect()) == list(range(100))


@pytest.mark.parametrize("few", [0, 100])
def test_rows_that_come_twice_count_once(spark, tmp_path, monkeypatch, stage, few):
    monkeypatch.setattr(loads, "FEW", few)
    rows = warehouse.build_by_property(stage)
    again = rows.where("query = 'q1'").withColumn("clicks", F.col("clicks") + 5).withColumn(
        "collected_at", F.col("collected_at") + F.expr("interval 1 day"))
    store = loads.FactStore(spark, str(tmp_path / "store"))
    store.store(rows.unionByName(again))
    want = {(r.row_hash, r.clicks + (5 if r.query == "q1" else 0)) for r in rows.collect()}
    got = [(r.row_hash, r.clicks) for r in store.current().collect()]
    assert set(got) == want and len(got) == len(want)
    assert again.count() > 0


def test_pages_are_stored_where_they_are(spark, tmp_path, monkeypatch):
    page = lambda at, clicks: ("https://a/", "1998-01-05", "web", "byProperty", None, [(["q", "fr", "MOBILE"], clicks, 9.0, 0.1, 2.0)], 0, at)
    cells = spark.createDataFrame([page(None, 1.0), page(dt.datetime(2001, 1, 1), 2.0), page(dt.datetime(2001, 1, 2), 3.0)],
                                  "site_url string, data_date string, search_type string, aggregation string, first_incomplete_date string, "
                                  "rows array<struct<keys array<string>, clicks double, impressions double, ctr double, position double>>, "
                                  "start_row long, loaded_at timestamp")
    monkeypatch.setattr(ingest, "newest_loads", None)  # its join would shuffle whole pages
    assert ingest.store_responses(spark, cells, str(tmp_path / "store"), dt.datetime(2001, 11, 5))
    assert [r.clicks for r in loads.FactStore(spark, str(tmp_path / "store")).current().collect()] == [3]


PAGE = ('{"site_url": "https://a/", "data_date": "1998-01-%02d", "search_type": "web", "aggregation": "byProperty", '
        '"rows": [{"keys": ["q%d", "fr", "MOBILE"], "clicks": %d.0, "impressions": 9.0, "ctr": 0.1, "position": 2.0}]}')


def test_one_gzipped_file_is_stored_by_several_tasks(spark, tmp_path):
    """A batch of one file that can't be split: all cores work on it, and each line counts once."""
    src = tmp_path / "in"
    src.mkdir()
    lines = [PAGE % (i % 28 + 1, i, i) for i in range(200)]
    (src / "a.json.gz").write_bytes(gzip.compress("\n".join(lines).encode()))
    out = ingest_stream.run_available(spark, str(src), str(tmp_path / "table"), str(tmp_path / "ck"), dt.datetime(2001, 11, 5), 1)
    assert sorted((r["query"], r.clicks) for r in out.collect()) == sorted((f"q{i}", i) for i in range(200))
    assert len(list((tmp_path / "table" / "rows").rglob("part-*"))) > 1 or spark.sparkContext.defaultParallelism == 1


def test_lines_parse_as_files_do(spark, tmp_path):
    """Blank, cut off, foreign and wrongly encoded lines, and several pages in a line."""
    odd = [PAGE % (1, 1, 1), "", "  ", PAGE[:60], "7", "null", "{}", '{"rows": 3, "site_url": "https://b/"}', f"[{PAGE % (2, 2, 2)}, {PAGE % (3, 3, 3)}]",
           PAGE % (4, 4, 4) + "\r", (PAGE % (5, 5, 5)).replace("fr", "côte"), '{"site_url": "https://c/", "rows": []}']
    bad = (PAGE % (6, 6, 6)).encode().replace(b"fr", b"\xff\xfe")
    path = tmp_path / "a.json.gz"
    path.write_bytes(gzip.compress("\n".join(odd).encode() + b"\n" + bad + b"\n"))
    rows = lambda df: sorted(map(str, df.where(F.size("rows") > 0).collect()))
    got = ingest.parse_lines(spark.read.text(str(path)))
    assert rows(got) == rows(ingest.read_responses(spark, str(path))) and len(rows(got)) == 5


def test_response_files_grow_with_the_input(spark, tmp_path, monkeypatch, stage):
    fact = warehouse.build_by_property(stage)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for per_file, most in ((1_000_000, 8), (3, fact.count() // 3 + 1)):
            monkeypatch.setattr(ingest, "ROWS_PER_FILE", per_file)
            ingest.write_responses(fact, path := str(tmp_path / str(per_file)))
            assert 1 < len(list(Path(path).glob("part-*.json.gz"))) <= most
            back = ingest.map_response_rows(ingest.read_responses(spark, path), dt.datetime(2001, 11, 5))
            cols = ["property", "data_date", "search_type", "query", "country", "device", "clicks", "impressions"]
            assert sorted(map(str, back.select(*cols).collect())) == sorted(map(str, fact.select(*cols).collect()))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_only_asked_for_tables_are_built(spark, tmp_path, monkeypatch, stage):
    monkeypatch.setattr(warehouse.fixtures, "search_raw", lambda s, d: stage)
    w = warehouse.Warehouse(spark, str(tmp_path))
    w.root = str(tmp_path / "wh")
    there = lambda: {t for t in warehouse.FACT_TABLES if (tmp_path / "wh" / t).exists()}
    assert w.ensure("by_property").table("by_property").count() and there() == {"by_property"}
    assert w.ensure("totals").ready(("totals",)) and there() == {"by_property", "totals"}
    assert w.ensure().ready() and there() == set(warehouse.FACT_TABLES)


def test_cells_without_a_day_stay_out(spark, tmp_path, stage):
    """One load whose cells are all told is stored without a join; a cell that is not whole is left out as before."""
    rows = warehouse.build_by_property(stage)
    store = loads.FactStore(spark, str(tmp_path / "store"))
    store.store(rows.unionByName(rows.limit(1).withColumn("data_date", F.lit(None).cast("date"))))
    assert sorted(r.row_hash for r in store.current().collect()) == sorted(r.row_hash for r in rows.collect())
