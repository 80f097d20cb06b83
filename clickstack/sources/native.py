"""Bulk-export sources and their adapters to the fact shape.

The export tables are read as DataFrames (here derived from the staged raw rows: one site-level
table, one url-level table and an export log). Adapters serve every native property in one job
by semi-joining the export to the registry's native properties, instead of one view per property.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickstack.functions import keys
from clickstack.sources import warehouse as wh


def stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wh.Warehouse(spark, sf_dir).ensure()
    return spark.read.parquet(w.path("stage"))


def site_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """searchdata_site_impression-shaped rows (anonymized queries stored as '')."""
    s = stage(spark, sf_dir).where(F.col("search_type") != "discover")
    return s.select("data_date", F.col("property").alias("site_url"),
                    F.when(F.col("is_anonymized"), F.lit("")).otherwise(F.col("query")).alias("query"),
                    "country", "device", F.upper("search_type").alias("search_type"), "clicks", "impressions",
                    ((F.col("position") - 1) * F.col("impressions")).alias("sum_top_position"),
                    F.col("is_anonymized").alias("is_anonymized_query"))


def url_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """searchdata_url_impression-shaped rows."""
    s = stage(spark, sf_dir)
    disc = F.col("search_type") == "discover"
    return s.select("data_date", F.col("property").alias("site_url"), F.col("page").alias("url"),
                    F.when(F.col("is_anonymized"), F.lit("")).otherwise(F.col("query")).alias("query"),
                    "country", "device", F.upper("search_type").alias("search_type"), "clicks", "impressions",
                    ((F.col("position") - 1) * F.col("impressions")).alias("sum_position"),
                    (F.col("is_anonymized") & ~disc).alias("is_anonymized_query"),
                    (F.col("is_anonymized") & disc).alias("is_anonymized_discover"))


def export_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ExportLog-shaped rows: one per exported day."""
    return stage(spark, sf_dir).select("data_date").distinct()


def _adapt(df: DataFrame, aggregation: str, page, pos_sum: str, anonymized, collected_at) -> DataFrame:
    impr = F.col("impressions")
    return df.select(
        "data_date", F.col("site_url").alias("property"), keys.property_type(F.col("site_url")).alias("property_type"),
        keys.norm_search_type(F.col("search_type")).alias("search_type"), F.lit(aggregation).alias("aggregation"),
        F.nullif(F.col("query"), F.lit("")).alias("query"), page.alias("page"), "country", "device",
        F.lit(None).cast("string").alias("search_appearance"), "clicks", "impressions",
        F.try_divide(F.col("clicks"), impr).alias("ctr"),
        (F.try_divide(F.col(pos_sum), impr) + 1).alias("position"),
        anonymized.alias("is_anonymized"),
        keys.row_hash_native(F.col("site_url"), F.col("data_date"), F.col("search_type"), aggregation, F.col("query"),
                             page if aggregation == "byPage" else None, F.col("country"), F.col("device"),
                             anonymized).alias("row_hash"),
        F.lit(collected_at).cast("timestamp").alias("collected_at"), F.lit("final").alias("data_state"),
        keys.property_key(F.col("site_url")).alias("property_key"),
        F.trunc("data_date", "month").alias("data_month"))


def native_site_adapter(export: DataFrame, native_sites: DataFrame, collected_at=dt.datetime(2001, 11, 5)) -> DataFrame:
    """A4: site export → byProperty shape for every native property (semi join on site_url)."""
    rows = export.join(native_sites.select(F.col("site_url")), "site_url", "left_semi")
    return _adapt(rows, "byProperty", F.lit(None).cast("string"), "sum_top_position", F.col("is_anonymized_query"),
                  collected_at)


def native_url_adapter(export: DataFrame, native_sites: DataFrame, collected_at=dt.datetime(2001, 11, 5)) -> DataFrame:
    """A5: url export → byPage shape; anonymized = query OR discover anonymized."""
    rows = export.join(native_sites.select(F.col("site_url")), "site_url", "left_semi")
    return _adapt(rows, "byPage", F.col("url"), "sum_position",
                  F.col("is_anonymized_query") | F.col("is_anonymized_discover"), collected_at)


def export_sites(export: DataFrame) -> DataFrame:
    """Distinct site URLs of an export, sorted."""
    return export.select("site_url").distinct().orderBy("site_url")


def export_latest_date(log: DataFrame) -> DataFrame:
    """Newest exported day."""
    return log.agg(F.max("data_date").alias("latest"))


def wildcard_all(api_fact: DataFrame, native_fact: DataFrame | None, native_sites: DataFrame | None = None) -> DataFrame:
    """A3: every property's rows with ``source_table``: API rows of non-native properties unioned by
    name with the native adapter rows (either side may be absent)."""
    parts = []
    if api_fact is not None:
        api = api_fact
        if native_sites is not None:
            api = api.join(native_sites.select(F.col("site_url").alias("property")), "property", "left_anti")
        parts.append(api)
    if native_fact is not None:
        parts.append(native_fact)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumn("source_table", F.col("property_key"))
