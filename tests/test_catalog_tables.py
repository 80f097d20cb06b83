"""Catalog tables that gain columns, saved views, discoveries that refresh the view of all properties."""

import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickstack.sources import catalog_tables as ct
from clickstack.sources import ingest


@pytest.fixture()
def db(spark):
    path = ingest.scratch(spark, "catalog-test")
    return ct.ensure_database(spark, f"t_{uuid.uuid4().hex[:8]}", path), path


ROWS = "property string, property_key string, clicks long, data_month string"


def rows(spark, *items):
    return spark.createDataFrame([(f"https://{s}.com/", s, c, "2024-01") for s, c in items], ROWS)


def test_an_older_table_gains_columns_and_reads_old_files(spark, db):
    name, path = f"{db[0]}.facts", f"{db[1]}/facts"
    old = rows(spark, ("a", 1))
    assert ct.ensure_table(spark, name, old.schema, path, ["data_month"]) is True
    ct.append_rows(spark, name, old)
    newer = rows(spark, ("b", 2)).withColumn("row_hash", F.lit("h"))
    assert ct.ensure_table(spark, name, newer.schema, path, ["data_month"]) is False
    assert ct.ensure_table(spark, name, newer.schema, path, ["data_month"]) is False
    ct.append_rows(spark, name, newer.select("row_hash", "data_month", "clicks", "property_key", "property"))
    ct.append_rows(spark, name, old)
    got = spark.table(name).select("property_key", "clicks", "row_hash", "data_month").collect()
    assert sorted(map(tuple, got), key=str) == [("a", 1, None, "2024-01"), ("a", 1, None, "2024-01"), ("b", 2, "h", "2024-01")]
    plan = spark.table(name).where("data_month = '2024-02'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(data_month" in plan


def test_another_type_or_an_unknown_column_is_an_error(spark, db):
    name, path = f"{db[0]}.facts", f"{db[1]}/facts"
    ct.ensure_table(spark, name, T.StructType([T.StructField("n", T.LongType())]), path)
    with pytest.raises(ValueError, match="other types for N"):
        ct.ensure_table(spark, name, T.StructType([T.StructField("N", T.StringType()), T.StructField("m", T.StringType())]), path)
    assert spark.table(name).columns == ["n"]
    with pytest.raises(ValueError, match="no columns x"):
        ct.append_rows(spark, name, spark.range(1).select(F.col("id").alias("n"), F.col("id").alias("x")))


def test_registered_files_are_found_again_after_a_new_partition(spark, db):
    name, path = f"{db[0]}.files", f"{db[1]}/files"
    rows(spark, ("a", 1)).write.partitionBy("data_month").parquet(path)
    ct.register_files(spark, name, path, ["data_month"])
    rows(spark, ("b", 5)).withColumn("data_month", F.lit("2024-02")).write.mode("append").partitionBy("data_month").parquet(path)
    ct.register_files(spark, name, path, ["data_month"])
    assert spark.table(name).agg(F.sum("clicks")).first()[0] == 6


def test_a_group_view_follows_members_and_goes_without_rows(spark, db):
    facts, members = f"{db[0]}.facts", f"{db[0]}.members"
    data = rows(spark, ("a", 1), ("b", 2), ("c", 4))
    ct.ensure_table(spark, facts, data.schema, f"{db[1]}/facts", ["data_month"])
    ct.append_rows(spark, facts, data)
    pairs = "group_id string, property string"
    ct.ensure_table(spark, members, T.StructType.fromDDL(pairs), f"{db[1]}/members")
    quote = "it's-1"
    assert ct.save_group_view(spark, db[0], quote, facts, members) is None
    # A member that comes twice, one without rows, and one of another group.
    ct.append_rows(spark, members, spark.createDataFrame(
        [(quote, "https://a.com/"), (quote, "https://a.com/"), (quote, "https://x.com/"), ("other", "https://c.com/")], pairs))
    view = ct.save_group_view(spark, db[0], quote, facts, members)
    assert view == f"{db[0]}.group_it_s_1"
    assert [r.clicks for r in spark.table(view).collect()] == [1]
    ct.append_rows(spark, members, spark.createDataFrame([(quote, "https://b.com/")], pairs))
    assert sorted(r.clicks for r in spark.table(view).collect()) == [1, 2]
    assert [t.isTemporary for t in spark.catalog.listTables(db[0]) if t.name == "group_it_s_1"] == [False]
    spark.sql(f"CREATE OR REPLACE VIEW {db[0]}.nobody AS SELECT * FROM {members} WHERE false")
    assert ct.save_group_view(spark, db[0], quote, facts, f"{db[0]}.nobody") is None
    assert not spark.catalog.tableExists(view)


def test_a_discovered_site_shows_up_in_the_wildcard_view(spark, db):
    name, path = db
    api = f"{name}.api"
    ct.ensure_table(spark, api, rows(spark, ("a", 1)).withColumn("only_api", F.lit(1)).schema, f"{path}/api", ["data_month"])
    ct.append_rows(spark, api, rows(spark, ("a", 1), ("b", 2)).withColumn("only_api", F.lit(7)))
    export = rows(spark, ("b", 20), ("c", 30)).withColumn("only_native", F.lit("n"))
    calls = []

    def adapted(sites):
        calls.append(sorted(r.site_url for r in sites.collect()))
        return export.join(sites.select(F.col("site_url").alias("property")), "property", "left_semi")

    def sites(*names):
        return spark.createDataFrame([(n and f"https://{n}.com/",) for n in names], "site_url string")

    def seen():
        return sorted(tuple(r) for r in spark.table(f"{name}.all_by_property").select(
            "source_table", "clicks", F.coalesce("only_api", F.lit(0)), F.coalesce("only_native", F.lit("-"))).collect())

    assert ct.discover_native(spark, name, sites(), adapted, path, api) == 0
    assert seen() == [("a", 1, 7, "-"), ("b", 2, 7, "-")]
    assert ct.discover_native(spark, name, sites("c", "c", None), adapted, path, api) == 1
    assert seen() == [("a", 1, 7, "-"), ("b", 2, 7, "-"), ("c", 30, 0, "n")]
    assert ct.discover_native(spark, name, sites("b", "c"), adapted, path, api) == 1
    assert ct.discover_native(spark, name, sites("b", "c"), adapted, path, api) == 0
    assert calls == [[], ["https://c.com/"], ["https://b.com/"], []]
    assert seen() == [("a", 1, 7, "-"), ("b", 20, 0, "n"), ("c", 30, 0, "n")]


def test_rows_of_a_discovery_that_failed_are_not_seen(spark, db):
    name, path = db
    api = f"{name}.api"
    ct.ensure_table(spark, api, rows(spark).schema, f"{path}/api", ["data_month"])
    export = rows(spark, ("b", 20))
    site = spark.createDataFrame([("https://b.com/",)], "site_url string")
    assert ct.discover_native(spark, name, site.limit(0), lambda s: export.limit(0), path, api) == 0
    # As if the list had not been written: rows of a discovery that nobody knows.
    ct.append_rows(spark, f"{name}.native_by_property", export.withColumn("found_in", F.lit("lost")))
    assert ct.discover_native(spark, name, site, lambda s: export, path, api) == 1
    assert [r.clicks for r in spark.table(f"{name}.all_by_property").collect()] == [20]
