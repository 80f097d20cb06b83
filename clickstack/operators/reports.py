"""Composite reports (R1-R15) with their joins (C1-C4) and the cannibalization window.

Each report is ``report_x(fact, filters, by=(), ...) -> DataFrame``. ``fact`` is already resolved
to a target (R20) or carries a ``target_id`` column named in ``by`` so one job answers every
target (R19). Where both periods end in ONE aggregate (KPIs, grouped metrics) they are read in
one scan: the WHERE clause keeps rows of either window (both prune partitions) and conditional
sums split them; sums of a period with no rows are null, exactly like a separate query over an
empty window. Where each period is ranked on its own (C1-C3), each period is its own scan of its
own partitions, so no row is read twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickstack.functions import filters as flt
from clickstack.functions.filters import Filters
from clickstack.operators import metrics as M
from clickstack.operators import topk


def _period(f: Filters, window) -> Column:
    return flt.date_range(window[0], window[1], prune_months=False)


def two_period_scan(fact: DataFrame, f: Filters, window, require_query=False, require_page=False) -> DataFrame:
    """Rows matching the filters in the current window or in ``window`` (None = current only)."""
    base = flt.to_column(f, require_query, require_page, with_dates=False)
    cur = flt.date_range(f.start, f.end)
    if window is None:
        return fact.where(base & cur)
    return fact.where(base & (cur | flt.date_range(window[0], window[1])))


def period_metrics(f: Filters, window, prefix_cur: str = "", prefix_prev: str = "prev_") -> list[Column]:
    """metrics4 for the current window and for ``window``; null sums when a window has no rows."""
    def m(cond: Column, prefix: str) -> list[Column]:
        c = F.sum(F.when(cond, F.col("clicks")))
        i = F.sum(F.when(cond, F.col("impressions")))
        p = F.sum(F.when(cond, F.col("position") * F.col("impressions")))
        return [c.alias(f"{prefix}clicks"), i.alias(f"{prefix}impressions"),
                F.try_divide(c, i).alias(f"{prefix}ctr"), F.try_divide(p, i).alias(f"{prefix}position")]
    out = m(_period(f, (f.start, f.end)), prefix_cur)
    if window is None:
        return out + [F.lit(None).cast(t).alias(prefix_prev + n) for n, t in
                      (("clicks", "long"), ("impressions", "long"), ("ctr", "double"), ("position", "double"))]
    return out + m(_period(f, window), prefix_prev)


# R1 ---------------------------------------------------------------------------------------------
def report_kpis(fact: DataFrame, f: Filters, by: Sequence[str] = ()) -> DataFrame:
    """Current and comparison KPIs in one row (per target)."""
    win = f.compare()
    return two_period_scan(fact, f, win).groupBy(*by).agg(*period_metrics(f, win))


# R2 ---------------------------------------------------------------------------------------------
def report_timeseries(fact: DataFrame, f: Filters, rollup: str = "day", series: str = "current",
                      by: Sequence[str] = ()) -> DataFrame:
    """R2: D4; ``series='compare'`` returns the same series over the comparison window."""
    if series == "compare":
        win = f.compare()
        if win is None:
            return M.timeseries(fact.limit(0), rollup, by)
        f = f.shifted(win)
    return M.timeseries(fact.where(flt.to_column(f)), rollup, by)


# C1 / R3 / R4 -----------------------------------------------------------------------------------
def period_entities(fact: DataFrame, f: Filters, window, dim: str, by: Sequence[str] = ()) -> DataFrame:
    """D5 for one window: metrics by ``dim`` over rows of that window only (its own partitions)."""
    g = f.shifted(window)
    rows = fact.where(flt.to_column(g, require_query=dim == "query", require_page=dim == "page"))
    return M.top_entity(rows, dim, by)


def top_with_prev(fact: DataFrame, f: Filters, dim: str, limit: int | None = 200, by: Sequence[str] = ()) -> DataFrame:
    """The current top-``limit`` entities (all with ``limit=None``), each with its metrics in the whole
    prior period (null when it had no rows then). Each period is its own pruned scan and aggregate."""
    win = f.compare()
    rank = (lambda df: topk.topk_entities(df, limit, by)) if limit else (lambda df: df)
    cur = rank(period_entities(fact, f, (f.start, f.end), dim, by))
    if win is None:
        return cur.select(*by, "key", "clicks", "impressions", "ctr", "position",
                          *[F.lit(None).cast(t).alias("prev_" + n) for n, t in
                            (("clicks", "long"), ("impressions", "long"), ("ctr", "double"), ("position", "double"))])
    prev = period_entities(fact, f, win, dim, by).select(
        *by, "key", F.col("clicks").alias("prev_clicks"), F.col("impressions").alias("prev_impressions"),
        F.col("ctr").alias("prev_ctr"), F.col("position").alias("prev_position"))
    return cur.join(prev, [*by, "key"], "left")


def report_top_queries(fact: DataFrame, f: Filters, limit: int = 200, by: Sequence[str] = ()) -> DataFrame:
    """R3."""
    return top_with_prev(fact, f, "query", limit, by)


def report_top_pages(fact_page: DataFrame, f: Filters, limit: int = 200, by: Sequence[str] = ()) -> DataFrame:
    """R4 (reads by_page; the brand segment is dropped)."""
    return top_with_prev(fact_page, flt.without_segment(f), "page", limit, by)


# R5-R8 ------------------------------------------------------------------------------------------
def report_breakdown(fact: DataFrame, f: Filters, dim: str = "device", by: Sequence[str] = ()) -> DataFrame:
    """D6 by device (default) or country."""
    return M.breakdown(fact.where(flt.to_column(f)), "country" if dim == "country" else "device", by)


def report_position_buckets(fact: DataFrame, f: Filters, by: Sequence[str] = ()) -> DataFrame:
    """R6."""
    return M.position_buckets(fact.where(flt.to_column(f)), by)


def report_ctr_scatter(fact: DataFrame, f: Filters, limit: int = 500, by: Sequence[str] = ()) -> DataFrame:
    """D8 + F2."""
    return topk.topk_scatter(M.ctr_scatter(fact.where(flt.to_column(f, require_query=True)), by), limit, by)


def report_striking_distance(fact: DataFrame, f: Filters, limit: int = 100, by: Sequence[str] = ()) -> DataFrame:
    """The position bounds move from the rows to the aggregate (D12 + F5)."""
    rows = fact.where(flt.to_column(flt.without_position(f), require_query=True))
    return topk.topk_striking(M.striking_distance(rows, f.position_min, f.position_max, by), limit, by)


# C2 / R9 ----------------------------------------------------------------------------------------
def report_movers(fact: DataFrame, f: Filters, dim: str = "query", ends: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """Every entity of either period, full outer join (C2), then the 50 largest gains and 50
    largest losses (F6). ``is_new`` = no rows in the prior period."""
    dim = "page" if dim == "page" else "query"
    if dim == "page":
        f = flt.without_segment(f)
    win = f.movers()
    cur = period_entities(fact, f, (f.start, f.end), dim, by)
    prev = period_entities(fact, f, win, dim, by)
    joined = (cur.select(*by, "key", F.col("clicks").alias("c"), F.lit(True).alias("in_cur"))
              .join(prev.select(*by, "key", F.col("clicks").alias("pc"), F.lit(True).alias("in_prev")),
                    [*by, "key"], "full"))
    movers = joined.select(
        *by, "key",
        F.coalesce("c", F.lit(0)).alias("clicks"),
        F.coalesce("pc", F.lit(0)).alias("prev_clicks"),
        (F.coalesce("c", F.lit(0)) - F.coalesce("pc", F.lit(0))).alias("delta"),
        (F.col("in_cur").isNotNull() & F.col("in_prev").isNull()).alias("is_new"))
    return topk.two_ended(movers, ends, by)


# R10 lives in clickstack.operators.groups.

# C4 / R11 ---------------------------------------------------------------------------------------
def report_ctr_benchmark(fact: DataFrame, f: Filters, limit: int = 200, by: Sequence[str] = ()) -> DataFrame:
    """Per-query rows (D10 + F3) joined to the site curve (D9) on the rounded weighted
    position (C4). The curve has at most 10 rows per target, so it is broadcast. A curve point
    with no impressions counts as benchmark 0; a missing point gives null."""
    rows_in = fact.where(flt.to_column(f, require_query=True))
    curve = M.ctr_curve(rows_in, by).select(*by, "pos", F.coalesce("ctr", F.lit(0.0)).alias("benchmark"))
    rows = topk.topk_bench(M.ctr_bench_rows(rows_in, by), limit, by)
    rows = rows.withColumn("pos", F.round(F.col("position")).cast("long"))
    out = rows.join(F.broadcast(curve), [*by, "pos"], "left")
    return out.select(*by, "key", "position", "ctr", "impressions", "clicks", "benchmark",
                      (F.col("ctr") - F.col("benchmark")).alias("diff"))


def report_ctr_curve(fact: DataFrame, f: Filters, by: Sequence[str] = ()) -> DataFrame:
    """The benchmark curve half of R11."""
    return M.ctr_curve(fact.where(flt.to_column(f, require_query=True)), by)


# E1 / R12 ---------------------------------------------------------------------------------------
def report_cannibalization(fact_page: DataFrame, f: Filters, min_impressions: int = 10, top: int = 200, competing: int = 8, by: Sequence[str] = ()) -> DataFrame:
    """All (query, page) pairs (D11), grouped per query:
    page count, Σclicks, Σimpressions and the ``competing`` pages with most impressions (E1);
    queries on ≥ 2 pages with ≥ ``min_impressions``; the ``top`` queries by impressions.
    Returns one row per (query, competing page) with ``rank``."""
    f = flt.without_segment(f)
    pairs = M.query_page_pairs(fact_page.where(flt.to_column(f, require_query=True, require_page=True)), by)
    per_q = (pairs.groupBy(*by, F.col("q").alias("key"))
             .agg(F.count(F.lit(1)).alias("pages"), F.sum("clicks").alias("clicks"),
                  F.sum("impressions").alias("impressions"))
             .where((F.col("pages") >= 2) & (F.col("impressions") >= (min_impressions or 10))))
    per_q = topk.top_n(per_q, topk.by_impressions(), top, by)
    w = Window.partitionBy(*by, "q").orderBy(F.col("impressions").desc(), F.col("p").asc())
    ranked = (pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= competing)
              .select(*by, F.col("q").alias("key"), "rank", F.col("p").alias("page"),
                      F.col("clicks").alias("page_clicks"), F.col("impressions").alias("page_impressions"),
                      F.col("position").alias("page_position")))
    return per_q.join(ranked, [*by, "key"], "inner")


def cannibalization_nested(flat: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """R12 in its API shape: one row per query with ``competing`` as an ordered array (≤ 8)."""
    comp = F.struct("rank", "page", F.col("page_clicks").alias("clicks"),
                    F.col("page_impressions").alias("impressions"), F.col("page_position").alias("position"))
    return (flat.groupBy(*by, "key", "pages", "clicks", "impressions")
            .agg(F.array_sort(F.collect_list(comp)).alias("competing")))


# C3 / R13 ---------------------------------------------------------------------------------------
def report_content_decay(fact_page: DataFrame, f: Filters, decay_only: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Every page of both periods; only pages with prior clicks > 0 (an inner
    join, C3); delta ascending. ``decay_only`` keeps delta_pct ≤ −20 like the opportunities view."""
    f = flt.without_segment(f)
    win = f.movers()
    cur = period_entities(fact_page, f, (f.start, f.end), "page", by)
    prev = period_entities(fact_page, f, win, "page", by)
    j = cur.select(*by, "key", "clicks").join(
        prev.select(*by, "key", F.col("clicks").alias("prev_clicks")).where(F.col("prev_clicks") > 0), [*by, "key"])
    out = j.select(*by, "key", "clicks", "prev_clicks", (F.col("clicks") - F.col("prev_clicks")).alias("delta"),
                   ((F.col("clicks") - F.col("prev_clicks")) / F.col("prev_clicks") * 100).alias("delta_pct"))
    return out.where(F.col("delta_pct") <= -20) if decay_only else out


# R14 / R15 --------------------------------------------------------------------------------------
def report_brand_split(fact: DataFrame, f: Filters, by: Sequence[str] = ()) -> DataFrame:
    """D14 with the segment removed; empty without brand terms."""
    terms = [t for t in f.brand_terms if t.strip()]
    if not terms:
        return fact.sparkSession.createDataFrame(
            [], "segment string, clicks long, impressions long, ctr double, position double")
    return M.brand_split(fact.where(flt.to_column(flt.without_segment(f))), terms, by)


def report_brand_timeseries(fact: DataFrame, f: Filters, rollup: str = "day", by: Sequence[str] = ()) -> DataFrame:
    """D15; empty without brand terms."""
    terms = [t for t in f.brand_terms if t.strip()]
    if not terms:
        return fact.sparkSession.createDataFrame(
            [], "date string, brand long, nonbrand long, brandImpr long, nonbrandImpr long")
    return M.brand_timeseries(fact.where(flt.to_column(flt.without_segment(f))), terms, rollup, by)


def brand_share(split: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Brand clicks / (brand + nonbrand) × 100, 0 without clicks."""
    b = F.sum(F.when(F.col("segment") == "brand", F.col("clicks")).otherwise(0))
    n = F.sum(F.when(F.col("segment") == "nonbrand", F.col("clicks")).otherwise(0))
    return split.groupBy(*by).agg(
        b.alias("brand_clicks"), n.alias("nonbrand_clicks"),
        F.coalesce(F.try_divide(b * 100.0, b + n), F.lit(0.0)).alias("brand_share"))


def trend_overlay(current: DataFrame, compare: DataFrame, value: str = "clicks", by: Sequence[str] = ()) -> DataFrame:
    """The comparison series aligned to the current one by index (row_number over date)."""
    w = Window.partitionBy(*by).orderBy("date")
    c = current.select(*by, "date", F.col(value).alias("value")).withColumn("i", F.row_number().over(w))
    p = compare.select(*by, "date", F.col(value).alias("compare")).withColumn("i", F.row_number().over(w)).drop("date")
    return c.join(p, [*by, "i"], "left").select(*by, "date", "value", "compare")
