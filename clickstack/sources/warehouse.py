"""The fact warehouse: ``by_property``, ``by_page`` and ``totals`` written once per input set.

Layout (same for every fact table): Parquet partitioned by ``data_month``, range-partitioned and
sorted by (data_date, property, query) so each file covers a narrow date range (min/max skipping
inside a month) and rows of one property and query sit together (the clustering of the source
system). Report date filters carry a ``data_month`` predicate, which Spark turns into partition
pruning.

The raw rows are first staged as Parquet (the landing step of ingest); the three aggregations
then read the stage rather than re-running the joins three times. Staged rows are range-partitioned
before they are aggregated, by grouping columns alone: the one shuffle serves the aggregation and the
layout, and the derived columns (hash, keys) are made after it and after the sort. Position of a stored row is
the (impressions+1)-weighted mean of its raw rows snapped to 1/8, so every later sum of
position × impressions stays exact in floating point and two engines agree bit for bit.
"""

from __future__ import annotations

import os
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickstack.functions import keys
from clickstack.schema import FACT_COLUMNS
from clickstack.session import let_go, storage_root
from clickstack.sources import fixtures, tables
from clickstack.sources.files import exists, size_of

FACT_TABLES = ("by_property", "by_page", "totals")
_LOCKS: dict[str, threading.Lock] = {}
_GLOBAL = threading.Lock()
_READ: dict[tuple, DataFrame] = {}


TARGET_PARTITION_BYTES = 32 * 1024 * 1024
ROWS_PER_TASK = 400_000  # raw rows that a task aggregates and sorts: about 100 MB of memory each time


def partitions_for(spark: SparkSession, nbytes: int, expansion: float = 1.0) -> int | None:
    """Partition count for ``nbytes`` of compressed input at ~32 MB per partition, or None when
    the session's shuffle partitions already suffice (then AQE sizes the shuffle itself)."""
    base = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    n = int(nbytes * expansion // TARGET_PARTITION_BYTES) + 1
    return n if n > base else None


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for ``rows`` raw rows, so that none of them spills; small inputs use the session's shuffle partitions."""
    base = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(rows // ROWS_PER_TASK + 1, min(base, rows // 50_000 + 1))


def with_month(df: DataFrame) -> DataFrame:
    return df.withColumn("data_month", F.trunc("data_date", "month"))


STORED = FACT_COLUMNS + ["property_key", "data_month"]


def finish_fact(df: DataFrame, aggregation: str, collected_at=fixtures.COLLECTED_AT) -> DataFrame:
    """Stamp the constant and derived columns of a stored fact row."""
    out = (df
           .withColumn("property_type", keys.property_type(F.col("property")))
           .withColumn("aggregation", F.lit(aggregation))
           .withColumn("search_appearance", F.lit(None).cast("string"))
           .withColumn("collected_at", F.lit(collected_at).cast("timestamp"))
           .withColumn("data_state", F.when(F.col("data_date") >= F.lit(fixtures.FRESH_FROM), "fresh")
                       .otherwise("final"))
           .withColumn("property_key", keys.property_key(F.col("property"))))
    for c in ("query", "page", "country", "device"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    out = out.withColumn("row_hash", keys.row_hash())
    return (out if "data_month" in out.columns else with_month(out)).select(*STORED)


def snapped_position(pos_w: str = "pos_w", w: str = "w"):
    return F.round(F.lit(8.0) * F.col(pos_w) / F.col(w)) / 8


def _agg(df: DataFrame, keys_: list[str]) -> DataFrame:
    return (df.groupBy(*keys_)
            .agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"),
                 F.sum(F.col("position") * (F.col("impressions") + 1)).alias("pos_w"),
                 F.sum(F.col("impressions") + 1).alias("w"))
            .withColumn("position", snapped_position())
            .withColumn("ctr", F.coalesce(F.try_divide(F.col("clicks"), F.col("impressions")), F.lit(0.0)))
            .drop("pos_w", "w"))


LAYOUT = ["data_month", "data_date", "property", "query"]


def _build(rows: DataFrame, names: list[str], aggregation: str, tasks: int | None) -> DataFrame:
    """``rows`` aggregated by ``names``; with ``tasks`` in the stored layout, by one shuffle. Its ranges go over all of the
    grouping columns, so a day, property or query with many rows still spreads, and a group is never split."""
    if tasks:
        rows = rows.repartitionByRange(tasks, *names)
    g = _agg(rows, names).withColumn("is_anonymized", F.lit(False))
    if tasks:
        g = with_month(g).sortWithinPartitions(*LAYOUT)  # before the long derived columns
    return finish_fact(g, aggregation)


def build_by_page(stage: DataFrame, tasks: int | None = None) -> DataFrame:
    return _build(stage.where(~F.col("is_anonymized")),
                  ["data_date", "property", "query", "search_type", "country", "device", "page"], "byPage", tasks)


def build_by_property(stage: DataFrame, tasks: int | None = None) -> DataFrame:
    return _build(stage.where(~F.col("is_anonymized") & F.col("search_type").isin("web", "image", "news")),
                  ["data_date", "property", "query", "search_type", "country", "device"], "byProperty", tasks)


def build_totals(stage: DataFrame, by_property: DataFrame) -> DataFrame:
    """Raw daily total per (day, property, type) plus the anonymized delta row (C13):
    total − Σ by_property, clamped at 0, position 0."""
    k = ["data_date", "property", "search_type"]
    raw = _agg(stage.where(F.col("search_type") != "discover"), k)
    bp = by_property.groupBy(*k).agg(F.sum("clicks").alias("bp_clicks"), F.sum("impressions").alias("bp_impr"))
    delta = (raw.join(bp, k, "left")
             .select(*k,
                     F.greatest(F.lit(0), F.col("clicks") - F.coalesce("bp_clicks", F.lit(0))).alias("clicks"),
                     F.greatest(F.lit(0), F.col("impressions") - F.coalesce("bp_impr", F.lit(0))).alias("impressions"))
             .withColumn("ctr", F.when(F.col("impressions") > 0, F.col("clicks") / F.col("impressions"))
                         .otherwise(F.lit(0.0)))
             .withColumn("position", F.lit(0.0))
             .withColumn("is_anonymized", F.lit(True)))
    both = raw.withColumn("is_anonymized", F.lit(False)).unionByName(delta)
    return finish_fact(both, "totals")


def write_fact(df: DataFrame, path: str) -> None:
    """Write rows that are in the stored layout: ordered by month first, they need no other sort. Half of a row's bytes are
    the hash in hexadecimal, which zstd halves."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", "zstd")
       .partitionBy("data_month").parquet(path))


def _code_version() -> str:
    """Hash of the package's modules (its optional part aside): changed code never reuses stored tables."""
    import hashlib
    from pathlib import Path

    pkg = Path(__file__).resolve().parent.parent
    h = hashlib.sha256()
    for path in sorted(pkg.rglob("*.py")):
        rel = path.relative_to(pkg)
        if rel.parts[0] != "llm" and rel.name not in ("oracle.py", "catalog.py"):
            h.update(str(rel).encode() + path.read_bytes())
    return h.hexdigest()[:8]


_VERSION = _code_version()


class Warehouse:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.root = f"{storage_root(spark)}/wh-{tables.fingerprint(spark, sf_dir)}-{_VERSION}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def ready(self, names: tuple[str, ...] = FACT_TABLES) -> bool:
        return all(exists(self.spark, self.path(t) + "/_SUCCESS") for t in names)

    def build(self, names: tuple[str, ...] = FACT_TABLES) -> None:
        """Stage the raw rows, then the fact tables of ``names`` (totals need by_property). Shuffle sizes follow the input: the
        joins of the build run with ~32 MB per shuffle partition (restored afterwards), and each fact
        table gets its tasks from the number of staged rows."""
        spark = self.spark
        inputs = sum(size_of(spark, os.path.join(self.sf_dir, f"{t}.parquet"))
                     for t in ("lineitem", "orders", "customer", "part"))
        saved = spark.conf.get("spark.sql.shuffle.partitions", "200")
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions_for(spark, inputs, expansion=3.0) or saved))
        try:
            stage_path = self.path("stage")
            if not exists(spark, stage_path + "/_SUCCESS"):
                raw = fixtures.search_raw(spark, self.sf_dir)
                raw.write.mode("overwrite").option("compression", "zstd").parquet(stage_path)
                del raw
                let_go(spark)
            stage = spark.read.parquet(stage_path)
            n = tasks_for(spark, stage.count())  # from the footers
            if "by_page" in names and not exists(spark, self.path("by_page") + "/_SUCCESS"):
                write_fact(build_by_page(stage, n), self.path("by_page"))
                let_go(spark)
            if {"by_property", "totals"} & set(names) and not exists(spark, self.path("by_property") + "/_SUCCESS"):
                write_fact(build_by_property(stage, n), self.path("by_property"))
                let_go(spark)
            if "totals" in names and not exists(spark, self.path("totals") + "/_SUCCESS"):
                bp = spark.read.parquet(self.path("by_property"))
                totals = build_totals(stage, bp).repartitionByRange("data_date", "property", "query")
                write_fact(totals.sortWithinPartitions(*LAYOUT), self.path("totals"))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", saved)

    def ensure(self, *names: str) -> Warehouse:
        """The fact tables of ``names`` are there, all of them without names."""
        names = names or FACT_TABLES
        with _GLOBAL:
            lock = _LOCKS.setdefault(self.root, threading.Lock())
        with lock:
            if not self.ready(names):
                self.build(names)
        return self

    def table(self, name: str) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, id(self.spark), self.root, name)
        with _GLOBAL:
            df = _READ.get(key)
        if df is None:
            self.ensure(name)
            df = self.spark.read.parquet(self.path(name))
            with _GLOBAL:
                _READ[key] = df
        return df


def _control_builders():
    from clickstack.operators import ledger
    from clickstack.plans import cube, precompute

    def attempts(w):
        # The attempt log: range-partitioned (sized from the events bytes) and sorted on
        # logged_at, so time-range scans skip files.
        n = partitions_for(w.spark, size_of(w.spark, os.path.join(w.sf_dir, "events.parquet")), expansion=2.0)
        a = fixtures.attempts(w.spark, w.sf_dir)
        a = a.repartitionByRange(n, "logged_at") if n else a.repartitionByRange("logged_at")
        return a.sortWithinPartitions("logged_at")

    return {
        "attempts": (attempts, ()),
        "registry": (lambda w: fixtures.merged(w.control("attempts")), ("attempts",)),
        "ledger": (lambda w: ledger.latest_state(w.control("attempts")), ("attempts",)),
        "accounts": (lambda w: ledger.accounts(w.control("attempts")), ("attempts",)),
        "members": (lambda w: fixtures.group_members(w.spark, w.sf_dir, w.control("registry")), ("registry",)),
        "assignment": (lambda w: ledger.client_assign(w.control("registry"), w.control("members")), ("members",)),
        "targets": (lambda w: precompute.membership(
            w.control("registry"), w.control("members"), w.control("assignment"),
            fixtures.dashboards(w.control("registry"), w.control("members"))), ("assignment",)),
        "report_sums": (lambda w: cube.build(w.table("by_property"), w.control("targets"),
                                             precompute.default_view(fixtures.REPORT_DAY)), ("targets",)),
    }


def _control(self: Warehouse, name: str) -> DataFrame:
    """A stored control table (attempt log, registry, ledger, accounts, group members, client
    assignment, target membership), derived once from the input tables."""
    key = (self.spark.sparkContext.applicationId, id(self.spark), self.root, "control/" + name)
    with _GLOBAL:
        df = _READ.get(key)
        lock = _LOCKS.setdefault(self.root + "/control/" + name, threading.Lock())
    if df is not None:
        return df
    with lock:
        path = self.path("control/" + name)
        if not exists(self.spark, path + "/_SUCCESS"):
            build, _deps = _control_builders()[name]
            rows = build(self)
            rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(
                *[c for c in ("part",) if c in rows.columns]).parquet(path)
        df = self.spark.read.parquet(path)
    with _GLOBAL:
        _READ[key] = df
    return df


Warehouse.control = _control


def warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    return Warehouse(spark, sf_dir)


def fact(spark: SparkSession, sf_dir: str, name: str = "by_property") -> DataFrame:
    return Warehouse(spark, sf_dir).table(name)


def fact_inline(spark: SparkSession, sf_dir: str, name: str = "by_property") -> DataFrame:
    """The same fact table as a plan over the raw tables, without writing anything (for a one-off
    query on a small input, e.g. the smoke check)."""
    stage = fixtures.search_raw(spark, sf_dir)
    if name == "by_page":
        return build_by_page(stage)
    bp = build_by_property(stage)
    return bp if name == "by_property" else build_totals(stage, bp)


def control(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return Warehouse(spark, sf_dir).control(name)
