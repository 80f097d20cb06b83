"""Targets and multi-target jobs.

A target is a property, a legacy group or a client; ``membership`` lists (target_id, property).
R19 computes each default report for EVERY dashboard-enabled target from sums that one pass over the facts
makes (``cube``); there is no per-target loop on the driver.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickstack.functions.filters import Filters
from clickstack.operators import metrics as M
from clickstack.plans import cube


def membership(registry: DataFrame, members: DataFrame, assignment: DataFrame, dashboards: DataFrame) -> DataFrame:
    """(target_id, target_type, property, dashboard_enabled) for properties, groups and clients. ``dashboards`` lists the
    properties and groups whose dashboard is switched on; clients have none of their own."""
    props = registry.select(F.concat(F.lit("property:"), F.col("property_id")).alias("target_id"),
                            F.lit("property").alias("target_type"), F.col("site_url").alias("property"))
    groups = members.select(F.concat(F.lit("group:"), F.col("group_id")).alias("target_id"),
                            F.lit("group").alias("target_type"), "property")
    clients = assignment.join(registry.select("property_id", F.col("site_url").alias("property")), "property_id") \
        .select(F.concat(F.lit("client:"), F.col("client_id")).alias("target_id"), F.lit("client").alias("target_type"),
                "property")
    on = dashboards.select("target_id").distinct().withColumn("dashboard_enabled", F.lit(True))
    every = props.unionByName(groups).unionByName(clients)
    return every.join(on, "target_id", "left").withColumn("dashboard_enabled", F.coalesce("dashboard_enabled", F.lit(False)))


def resolve_target(fact: DataFrame, members: DataFrame, target_id: str) -> DataFrame:
    """The fact rows of one target (semi join to its members)."""
    m = members.where(F.col("target_id") == target_id).select("property")
    return fact.join(m, "property", "left_semi")


def default_view(as_of) -> Filters:
    """The precompute view: 28 days ending as_of, web, compared with the previous 28 days."""
    end = as_of if isinstance(as_of, dt.date) else dt.date.fromisoformat(str(as_of))
    return Filters(start=end - dt.timedelta(days=27), end=end, compare_mode="previous")


def precompute(sums: DataFrame, report: str) -> DataFrame:
    """One default report for every enabled target (columns: target_id + the report's columns), from the shared sums."""
    return cube.REPORTS[report](sums)


def write_precompute(spark: SparkSession, fact: DataFrame, targets: DataFrame, as_of, root: str) -> dict[str, str]:
    """R19 materialised: the facts are read once for the sums; each report is written from these, partitioned by target."""
    cube.write(cube.build(fact, targets, default_view(as_of)), f"{root}/sums")
    sums = spark.read.parquet(f"{root}/sums")
    out = {}
    for r in cube.REPORTS:
        path = f"{root}/{r}"
        precompute(sums, r).write.mode("overwrite").partitionBy("target_id").parquet(path)
        out[r] = path
    return out


def materialize_groups(fact: DataFrame, members: DataFrame) -> DataFrame:
    """For every group flagged for materialisation, its union re-weighted by (date,
    query, country, device); groups without members produce no rows (dropped snapshot)."""
    m = members.where(F.col("materialize")).select("group_id", "property")
    rows = fact.join(m, "property")
    return rows.groupBy("group_id", "data_date", "query", "country", "device").agg(*M.metrics4())


def write_materialized(df: DataFrame, path: str) -> None:
    """A13 write: all groups in one job, one partition folder per group (overwrite)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("group_id").parquet(path)


def group_view(spark: SparkSession, fact: DataFrame, members: DataFrame, group_id: str) -> DataFrame:
    """The live union of a group's members, as a temp view. Members without data add no rows, so they need no test of
    their own (C12): the facts are read once."""
    own = members.where(F.col("group_id") == group_id).select("property").distinct()
    name = f"group_{group_id}"
    fact.join(own, "property", "left_semi").createOrReplaceTempView(name)
    return spark.table(name)
