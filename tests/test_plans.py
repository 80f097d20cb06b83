"""Physical-plan properties that matter at scale."""

from clickstack import catalog
from tests.conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_report_prunes_partitions_and_pushes_filters(spark):
    df = catalog.queries()["report_kpis"](spark, SF_SMALL)
    p = df._jdf.queryExecution().sparkPlan().toString()
    assert "PartitionFilters: [" in p and "data_month" in p
    assert "PushedFilters: [" in p and "search_type" in p


def test_report_reads_only_needed_columns(spark):
    df = catalog.queries()["report_breakdown"](spark, SF_SMALL)
    p = df._jdf.queryExecution().sparkPlan().toString()
    assert "ReadSchema: struct<" in p
    read = p.split("ReadSchema: struct<", 1)[1].split(">", 1)[0]
    assert "row_hash" not in read and "page" not in read


def test_per_target_top_k_limits_before_shuffle(spark):
    df = catalog.queries()["precompute_top_queries"](spark, SF_SMALL)
    df.collect()
    assert "WindowGroupLimit" in plan(df)


def test_single_target_top_k_is_take_ordered(spark):
    df = catalog.queries()["report_ctr_scatter"](spark, SF_SMALL)
    assert "TakeOrderedAndProject" in df._jdf.queryExecution().sparkPlan().toString()


def test_each_ranked_period_reads_only_its_partitions(spark):
    df = catalog.queries()["report_top_queries"](spark, SF_SMALL)
    p = df._jdf.queryExecution().sparkPlan().toString()
    scans = [line for line in p.split("\n") if "FileScan parquet" in line]
    assert len(scans) == 2
    for line in scans:
        pf = line.split("PartitionFilters: [", 1)[1].split("], PushedFilters", 1)[0]
        assert ("1997-" in pf) != ("1998-" in pf)      # each branch prunes to its own year


def test_kpis_one_scan_for_both_periods(spark):
    df = catalog.queries()["report_kpis"](spark, SF_SMALL)
    assert df._jdf.queryExecution().sparkPlan().toString().count("FileScan parquet") == 1
