"""Ingest: raw API response files → fact rows → appended loads.

Response files are newline JSON, one object per API page of a cell:
``{site_url, data_date, search_type, aggregation, first_incomplete_date, rows: [{keys, clicks, ...}]}``.
Many cells are mapped in one job; the positional ``keys`` are resolved with the per-(aggregation,
type) dimension list (H15) as a Column, not per row in Python.
"""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickstack.functions import keys, status
from clickstack.schema import API_RESPONSE, FACT_COLUMNS
from clickstack.session import let_go, storage_root
from clickstack.sources.loads import FactStore

ROWS_PER_PAGE = 25_000   # fixed value: rows per API page
MAX_ROWS_PER_DAY = 50_000  # fixed value: API ceiling per property, day and type
CELL = ["site_url", "data_date", "search_type", "aggregation"]
SHARES = 8  # tasks that read one file at most: each decompresses all of it
ROWS_PER_FILE = 2_000_000


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(API_RESPONSE).json(path)


def parse_lines(lines: DataFrame) -> DataFrame:
    """The responses in lines of text (``value``), as ``read_responses`` has them. One task reads a file that can't be split, as a
    gzipped one; where that leaves cores idle, several tasks read it, and each parses its share of the lines: nothing is moved."""
    spark = lines.sparkSession
    tasks = lines._jdf.queryExecution().toRdd().getNumPartitions()
    n = max(1, min(SHARES, spark.sparkContext.defaultParallelism // max(1, tasks)))
    numbered = lines.select("value", F.monotonically_increasing_id().alias("at"))  # by the place in the file
    shares = [numbered.where(F.col("at") % n == k).select("value") for k in range(n)]
    valid = reduce(DataFrame.unionAll, shares).where(F.is_valid_utf8("value"))  # others are no JSON
    text = getattr(valid._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(spark.read.schema(API_RESPONSE)._jreader.json(text), spark)


def newest_loads(responses: DataFrame) -> DataFrame:
    """Of cells that were loaded more than once, the pages of the newest load only (``loaded_at``, null oldest);
    pages of one load share its time."""
    newest = responses.groupBy(*CELL).agg(F.max("loaded_at").alias("newest"))
    same = [F.col(f"r.{c}") == F.col(f"n.{c}") for c in CELL] + [F.col("r.loaded_at").eqNullSafe(F.col("n.newest"))]
    return responses.alias("r").join(newest.alias("n"), reduce(and_, same), "left_semi")


def map_response_rows(responses: DataFrame, collected_at, today=None) -> DataFrame:
    """One fact row per API row: keys by position for the cell's dimensions, metrics null → 0,
    property type, collected_at, data_state from the cell's first incomplete day (H16), not
    anonymized, no row hash yet. What holds for a page as a whole is worked out before its rows are taken apart."""
    dims = status.dims_for(F.col("aggregation"), F.col("search_type"))
    d, names = F.to_date("data_date"), ("query", "page", "country", "device")
    final = status.day_final(d, F.to_date("first_incomplete_date"), today)
    pages = responses.where(F.size("rows") > 0).select(
        d.alias("data_date"), F.col("site_url").alias("property"), keys.property_type(F.col("site_url")).alias("property_type"),
        keys.property_key(F.col("site_url")).alias("property_key"), "search_type", "aggregation",
        *[F.array_position(dims, F.lit(n)).cast("int").alias(f"at_{n}") for n in names],
        F.when(final, F.lit("final")).otherwise(F.lit("fresh")).alias("data_state"),
        (F.col("loaded_at") if "loaded_at" in responses.columns else F.lit(None).cast("timestamp")).alias("loaded_at"), "rows")
    r = pages.select("*", F.explode("rows").alias("r")).where(F.col("r").isNotNull())

    def dim(name: str):
        i = F.col(f"at_{name}")
        return F.when(i > 0, F.get(F.col("r.keys"), i - 1)).alias(name)

    return r.select(
        "data_date", "property", "property_type", "search_type", "aggregation", *map(dim, names),
        F.lit(None).cast("string").alias("search_appearance"),
        F.coalesce(F.col("r.clicks"), F.lit(0.0)).cast("long").alias("clicks"),
        F.coalesce(F.col("r.impressions"), F.lit(0.0)).cast("long").alias("impressions"),
        F.coalesce(F.col("r.ctr"), F.lit(0.0)).alias("ctr"),
        F.coalesce(F.col("r.position"), F.lit(0.0)).alias("position"),
        F.lit(False).alias("is_anonymized"),
        F.lit(collected_at).cast("timestamp").alias("collected_at"), "data_state", "loaded_at", "property_key")


def with_row_hash(rows: DataFrame) -> DataFrame:
    """H1 on mapped rows, plus the storage columns and, where known, when the row was loaded."""
    key = F.col("property_key") if "property_key" in rows.columns else keys.property_key(F.col("property"))
    return (rows.withColumn("row_hash", keys.row_hash())
            .select(*FACT_COLUMNS, *[c for c in ("loaded_at",) if c in rows.columns], key.alias("property_key"))
            .withColumn("data_month", F.trunc("data_date", "month")))


def pagination_ceiling(rows: DataFrame, slice_keys=("property", "data_date", "search_type", "aggregation")) -> DataFrame:
    """Every row, with ``hit_ceiling`` where its slice has as many rows as the API returns at most
    (50,000) or more. Only counts per slice are aggregated; a hot slice is one partial count per task."""
    full = rows.groupBy(*slice_keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= MAX_ROWS_PER_DAY)
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in slice_keys]
    joined = rows.alias("r").join(full.alias("f"), reduce(and_, same), "left")
    return joined.select("r.*", F.col("f._n").isNotNull().alias("hit_ceiling"))


def to_responses(fact: DataFrame, rows_per_page: int = ROWS_PER_PAGE) -> DataFrame:
    """The API responses that would have produced ``fact`` (byProperty rows): one object per
    (cell, page of 25,000). A cell holds at most 50,000 rows (the API ceiling), so the per-page
    collect is bounded."""
    cell = ["property", "data_date", "search_type", "aggregation"]
    w = Window.partitionBy(*cell).orderBy(F.col("query").asc_nulls_first(), F.col("country").asc_nulls_first(),
                                          F.col("device").asc_nulls_first())
    dims = status.dims_for(F.col("aggregation"), F.col("search_type"))
    key_arr = F.transform(dims, lambda d: F.when(d == "query", F.col("query")).when(d == "page", F.col("page"))
                          .when(d == "country", F.col("country")).otherwise(F.col("device")))
    rows = fact.select(*cell, "data_state", F.floor((F.row_number().over(w) - 1) / rows_per_page).alias("page_no"),
                       F.struct(key_arr.alias("keys"), F.col("clicks").cast("double").alias("clicks"),
                                F.col("impressions").cast("double").alias("impressions"), F.col("ctr"),
                                F.col("position")).alias("row"))
    g = rows.groupBy(*cell, "page_no").agg(F.collect_list("row").alias("rows"), F.max("data_state").alias("state"))
    return g.select(F.col("property").alias("site_url"), F.date_format("data_date", "yyyy-MM-dd").alias("data_date"),
                    "search_type", "aggregation",
                    F.when(F.col("state") == "fresh", F.date_format("data_date", "yyyy-MM-dd")).alias("first_incomplete_date"),
                    "rows", (F.col("page_no") * rows_per_page).alias("start_row"))


def write_responses(fact: DataFrame, path: str) -> None:
    """``to_responses`` as gzipped files, which grow with the input up to ``ROWS_PER_FILE``: a stream takes them one by one."""
    files = max(8, fact.count() // ROWS_PER_FILE + 1)
    to_responses(fact).coalesce(files).write.mode("overwrite").option("compression", "gzip").json(path)
    let_go(fact.sparkSession)


def stage_ndjson(rows: DataFrame, path: str) -> None:
    """A10: write rows as newline JSON (the load staging step), gzipped: names and dates come again in every row."""
    rows.write.mode("overwrite").option("compression", "gzip").json(path)


def store_responses(spark: SparkSession, responses: DataFrame, root: str, collected_at) -> str | None:
    """Map responses (A8), hash the rows (H1) and store them in the fact store below ``root`` (A9); the load's id. Responses
    without rows leave what is stored alone."""
    # Pages are read for their cells, for repeated hashes and to be written. The store keeps the newest load of each cell
    # (``newest_loads``), without moving pages.
    held = responses.where(F.size("rows") > 0).persist()
    cells = held.select(F.col("site_url").alias("property"), F.to_date("data_date").alias("data_date"), "search_type", "aggregation", "loaded_at")
    try:
        return FactStore(spark, root).store(with_row_hash(map_response_rows(held, collected_at)), cells)
    finally:
        held.unpersist()


def append_attempt(rows: DataFrame, path: str) -> None:
    """Append log rows."""
    rows.write.mode("append").parquet(path)


def reconcile_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    """Align an older table with the current schema: missing columns are added as nulls."""
    return old.unionByName(new, allowMissingColumns=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run of a writing job."""
    return f"{storage_root(spark)}/runs/{name}-{dt.datetime.now(dt.timezone.utc):%Y%m%d%H%M%S}-{uuid.uuid4().hex[:8]}"
