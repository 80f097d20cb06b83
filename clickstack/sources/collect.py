"""Collection of cells page by page (A16, A8, A11): which pages are asked for, and the attempt that comes of it.

A cell is one (site, day, type, aggregation). Its pages are asked for from row 0 on until one is empty, or until
the next would begin at the ceiling. Of a cell whose pages do not all come nothing is kept but the error.

* ``collect_cells`` asks a function of the caller (an API client, say) inside the tasks: the plan of cells stays distributed,
  a task holds one cell at a time, at most ``max_rows`` rows.
* ``reached_pages`` answers the same from pages that are at hand as rows.
* ``attempts_of`` makes the attempt log rows of either. Both give one row per page, and one without rows for a cell that has
  none; ``map_response_rows`` and the fact store take them as they are.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T

from clickstack.functions import keys, status
from clickstack.schema import API_RESPONSE
from clickstack.sources.ingest import CELL, MAX_ROWS_PER_DAY, ROWS_PER_PAGE

#: ``fetch(cell, start_row, row_limit)``: the API rows of a page, each with ``keys, clicks, impressions, ctr, position``.
Fetch = Callable[[dict, int, int], list[dict]]

PLAN = [*CELL, "first_incomplete_date"]
PAGES = T.StructType([T.StructField(f.name, f.dataType) for f in API_RESPONSE.fields if f.name != "loaded_at"] + [
    T.StructField("start_row", T.LongType()), T.StructField("api_calls", T.LongType()), T.StructField("error_message", T.StringType())])
NUMBERS = ("clicks", "impressions", "ctr", "position")


def _checked(rows_per_page: int, max_rows: int) -> None:
    if rows_per_page < 1 or max_rows < 1:
        raise ValueError("rows_per_page and max_rows must be at least 1")


def _row(row: dict) -> dict:
    return {"keys": row.get("keys")} | {n: None if row.get(n) is None else float(row[n]) for n in NUMBERS}


def collect_cells(cells: DataFrame, fetch: Fetch, rows_per_page: int = ROWS_PER_PAGE, max_rows: int = MAX_ROWS_PER_DAY) -> DataFrame:
    """One row per page of each cell of ``cells`` (the columns of a cell, days as text, and ``first_incomplete_date`` if known).

    ``api_calls`` are the answered calls of the cell, the empty last one included. An exception of ``fetch`` becomes the
    cell's ``error_message``; other cells go on. Equal cells are collected once. Write the result before using it
    twice, or the calls are made again."""
    _checked(rows_per_page, max_rows)
    plan = cells if "first_incomplete_date" in cells.columns else cells.withColumn("first_incomplete_date", F.lit(None).cast("string"))
    schema = to_arrow_schema(PAGES)

    def one(cell: dict) -> list[dict]:
        pages, calls = [], 0
        try:
            for start in range(0, max_rows, rows_per_page):
                rows = [_row(r) for r in fetch(dict(cell), start, rows_per_page)]
                calls += 1
                if not rows:
                    break
                pages.append({"start_row": start, "rows": rows, "error_message": None})
        except Exception as failed:  # whatever the client raises is the outcome of the attempt
            pages = [{"start_row": 0, "rows": [], "error_message": str(failed) or type(failed).__name__}]
        pages = pages or [{"start_row": 0, "rows": [], "error_message": None}]
        return [cell | page | {"api_calls": calls} for page in pages]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(one(cell), schema)

    return plan.select(*PLAN).dropDuplicates(CELL).mapInArrow(run, PAGES)


def reached_pages(cells: DataFrame, pages: DataFrame, rows_per_page: int = ROWS_PER_PAGE, max_rows: int = MAX_ROWS_PER_DAY) -> DataFrame:
    """What ``collect_cells`` would bring for ``cells`` where ``pages`` (responses with ``start_row``, one per page) are all that
    there is: a page after a gap, an empty page or the ceiling is not reached. Windows are per cell, over its pages."""
    _checked(rows_per_page, max_rows)
    plan = cells if "first_incomplete_date" in cells.columns else cells.withColumn("first_incomplete_date", F.lit(None).cast("string"))
    plan = plan.select(*PLAN).dropDuplicates(CELL)
    full = pages.where((F.size("rows") > 0) & (F.col("start_row") < max_rows) & (F.col("start_row") % rows_per_page == 0))
    in_order = Window.partitionBy(*CELL).orderBy("start_row")
    full = full.select(*CELL, "rows", F.col("start_row").cast("long").alias("start_row"))
    full = full.where(F.size("rows") > 0).withColumn("nth", F.row_number().over(in_order) - 1)
    reached = full.where(F.col("start_row") == F.col("nth") * rows_per_page).drop("nth")
    joined = plan.alias("c").join(reached.alias("p"), reduce(and_, [F.col(f"c.{c}").eqNullSafe(F.col(f"p.{c}")) for c in CELL]), "left")
    last = F.max("start_row").over(Window.partitionBy(*CELL))
    # After the last full page one empty page is asked for, if that begins below the ceiling.
    read = F.when(last.isNull(), 1).otherwise(last / rows_per_page + 1 + (last + rows_per_page < max_rows).cast("long"))
    out = joined.select(*[F.col(f"c.{c}").alias(c) for c in PLAN], "p.rows", "p.start_row").withColumn("api_calls", read.cast("long"))
    none = F.array().cast(API_RESPONSE["rows"].dataType)
    return out.select(*PLAN, F.coalesce("rows", none).alias("rows"), F.coalesce("start_row", F.lit(0)).cast("long").alias("start_row"),
                      "api_calls", F.lit(None).cast("string").alias("error_message"))


def attempts_of(collected: DataFrame, attempt: int, logged_at: dt.datetime, today=None) -> DataFrame:
    """One attempt per cell: its rows and calls, and the status that follows (H17; after an error H20). Null sites, days,
    types or aggregations make cells of their own, without a task id that a plan knows."""
    cells = collected.groupBy(*PLAN).agg(F.sum(F.size("rows").cast("long")).alias("row_count"), F.max("api_calls").alias("api_calls"),
                                         F.max("error_message").alias("error_message"))
    day = F.to_date("data_date")
    done = status.collect_status(status.day_final(day, F.to_date("first_incomplete_date"), today), F.col("row_count"))
    number = F.lit(attempt).cast("long")
    state = F.when(F.col("error_message").isNull(), done).otherwise(status.dead_letter(F.col("error_message"), number))
    return cells.select(
        keys.task_id(keys.property_key(F.col("site_url")), F.col("search_type"), F.col("aggregation"), day).alias("task_id"),
        F.col("site_url").alias("property"), "search_type", "aggregation", day.alias("data_date"),
        F.lit(None).cast("string").alias("account_id"), state.alias("status"), number.alias("attempt"), "row_count", "api_calls",
        "error_message", F.lit(logged_at).cast("timestamp").alias("logged_at"))
