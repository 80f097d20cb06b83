"""The daily run as one driver script of Spark jobs (discover → reconcile → ingest → materialize
→ precompute → dedup check). Every step reads and writes tables under one shared root; each
step is idempotent, so a failed run is simply started again.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickstack.operators import ledger, ops
from clickstack.plans import precompute as P
from clickstack.sources import fixtures, ingest, native
from clickstack.sources.loads import FactStore
from clickstack.sources.warehouse import Warehouse


def run(spark: SparkSession, sf_dir: str, out_root: str, fact_as_of: dt.date, ledger_as_of: dt.date,
        responses_dir: str | None = None) -> DataFrame:
    """Returns one row per step: (step, rows)."""
    w = Warehouse(spark, sf_dir).ensure()
    steps: list[tuple[str, int]] = []

    # 1. Discover: export sites merged into the registry (E3), native properties flagged.
    exported = native.export_sites(native.site_export(spark, sf_dir)).select(
        F.col("site_url").alias("property"), F.lit(None).cast("string").alias("account_id"),
        F.lit(dt.datetime.combine(ledger_as_of, dt.time())).cast("timestamp").alias("logged_at"))
    attempts = w.control("attempts")
    seen = attempts.select("property", "account_id", "logged_at").unionByName(exported)
    registry = fixtures.merged(seen, w.control("registry"))
    registry.write.mode("overwrite").parquet(f"{out_root}/registry")
    registry = spark.read.parquet(f"{out_root}/registry")
    steps.append(("discover", registry.count()))

    # 2. Reconcile: pending tasks for missing cells (L1), grouped per account for dispatch.
    planned = ledger.reconcile(registry, w.control("ledger"), ledger_as_of)
    planned.write.mode("overwrite").parquet(f"{out_root}/planned")
    steps.append(("reconcile", spark.read.parquet(f"{out_root}/planned").count()))

    # 3. Ingest whatever responses are present (S1 in batch form: map → hash → merge cells), all aggregations.
    if responses_dir:
        ingest.store_responses(spark, ingest.read_responses(spark, responses_dir), f"{out_root}/facts", dt.datetime.combine(ledger_as_of, dt.time()))
        steps.append(("ingest", FactStore(spark, f"{out_root}/facts").current().count()))

    # 4. Materialized group snapshots (A13), all groups in one job.
    fact = w.table("by_property")
    members = w.control("members")
    P.write_materialized(P.materialize_groups(fact, members), f"{out_root}/materialized")
    steps.append(("materialize", spark.read.parquet(f"{out_root}/materialized").count()))

    # 5. Default reports for every target.
    paths = P.write_precompute(spark, fact, w.control("targets"), fact_as_of, f"{out_root}/precompute")
    steps.append(("precompute", sum(spark.read.parquet(p).count() for p in paths.values())))

    # 6. Dedup invariant.
    dup = ops.row_hash_invariant({t: w.table(t) for t in ("by_property", "by_page", "totals")})
    steps.append(("dedup_duplicates", int(dup.agg(F.sum("duplicates")).first()[0] or 0)))
    return spark.createDataFrame(steps, "step string, rows long")
