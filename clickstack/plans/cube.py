"""The aggregates that all default reports of all targets share (R19): one pass over the facts.

The rows of both windows are read once, joined to the dashboard-enabled targets of their property, and summed by
GROUPING SETS: per target and period, day, query, device, country, and day and position tier. Every report is then a small job on
these sums. Rows are copied per set only as partial sums, before the one shuffle.

``part`` names the set a row belongs to; the table is stored in one folder per part, so a report reads its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickstack.functions import filters as flt
from clickstack.functions.filters import Filters
from clickstack.operators import metrics as M
from clickstack.operators import topk

BY = ["target_id"]
#: Upper ends of the position tiers (the last one is open) and their report columns.
TIERS = ((3, "top3"), (10, "p4_10"), (20, "p11_20"), (50, "p21_50"), (None, "p50plus"))
#: The columns of each part beside target and period.
PARTS = {"total": [], "day": ["day"], "query": ["query"], "device": ["device"], "country": ["country"], "tier": ["day", "tier"]}
SUMS = ["clicks", "impressions", "weighted"]


def _tier() -> Column:
    out = F.lit(TIERS[-1][1])
    for top, name in reversed(TIERS[:-1]):
        out = F.when(F.col("position") <= top, F.lit(name)).otherwise(out)
    return out


def build(fact: DataFrame, targets: DataFrame, f: Filters) -> DataFrame:
    """``part, target_id, current`` with the part's columns (null in other parts) and the sums, for the targets that
    are enabled. Days, devices, countries and tiers are kept of the current window only: no report needs more."""
    before = f.compare()
    window = flt.date_range(f.start, f.end)
    rows = fact.where(flt.to_column(f, with_dates=False) & (window | flt.date_range(*before)))
    now = flt.date_range(f.start, f.end, prune_months=False)
    of_now = lambda c: F.when(now, c)
    rows = rows.select(
        "property", now.alias("current"), of_now(F.col("data_date")).alias("day"), "query", of_now(F.col("device")).alias("device"),
        of_now(F.col("country")).alias("country"), of_now(_tier()).alias("tier"), "clicks", "impressions",
        (F.col("position") * F.col("impressions")).alias("weighted"))
    enabled = targets.where("dashboard_enabled").select("target_id", "property")
    rows = rows.join(enabled, "property")
    names = ["target_id", "current", "day", "query", "device", "country", "tier"]
    sets = [[F.col(c) for c in (*BY, "current", *own)] for own in PARTS.values()]
    # The sets differ in which columns they hold: the bits of grouping_id, first column highest, 1 where left out.
    ids = {sum(1 << (len(names) - 1 - i) for i, c in enumerate(names) if c not in (*BY, "current", *own)): part for part, own in PARTS.items()}
    part = F.lit(None).cast("string")
    for gid, name in ids.items():
        part = F.when(F.col("gid") == gid, F.lit(name)).otherwise(part)
    out = rows.groupingSets(sets, *[F.col(c) for c in names]).agg(F.grouping_id().alias("gid"), *[F.sum(c).alias(c) for c in SUMS])
    # Rows of the earlier window have no day, device, country or tier.
    return out.withColumn("part", part).drop("gid").where("current or part in ('total', 'query')")


def write(cube: DataFrame, path: str) -> None:
    cube.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("part").parquet(path)


def _of(cube: DataFrame, part: str, current: bool | None = True) -> DataFrame:
    rows = cube.where(F.col("part") == part)
    return rows if current is None else rows.where(F.col("current") if current else ~F.col("current"))


def _ratios(clicks: str = "clicks", impressions: str = "impressions", weighted: str = "weighted") -> list[Column]:
    return [F.try_divide(F.col(clicks), F.col(impressions)), F.try_divide(F.col(weighted), F.col(impressions))]


def _metrics(rows: DataFrame, *columns: Column) -> DataFrame:
    ctr, position = _ratios()
    return rows.select(*BY, *columns, "clicks", "impressions", ctr.alias("ctr"), position.alias("position"))


def _entities(cube: DataFrame, current: bool = True) -> DataFrame:
    return _metrics(_of(cube, "query", current).where(F.col("query").isNotNull()), F.col("query").alias("key"))


def kpis(cube: DataFrame) -> DataFrame:
    """R1 of every target; a period without rows is null."""
    wide = _of(cube, "total", None).groupBy(*BY).agg(*[
        F.sum(F.when(F.col("current") == now, F.col(c))).alias(p + c) for now, p in ((True, ""), (False, "prev_")) for c in SUMS])
    out = []
    for p in ("", "prev_"):
        ctr, position = _ratios(p + "clicks", p + "impressions", p + "weighted")
        out += [p + "clicks", p + "impressions", ctr.alias(p + "ctr"), position.alias(p + "position")]
    return wide.select(*BY, *out)


def timeseries(cube: DataFrame) -> DataFrame:
    return _metrics(_of(cube, "day"), F.date_format("day", "yyyy-MM-dd").alias("date"))


def breakdown(cube: DataFrame, dim: str) -> DataFrame:
    return _metrics(_of(cube, dim), F.col(dim).alias("key"))


def position_buckets(cube: DataFrame) -> DataFrame:
    tiers = [F.sum(F.when(F.col("tier") == name, F.col("impressions")).otherwise(0)).alias(name) for _, name in TIERS]
    return _of(cube, "tier").groupBy(*BY, F.date_format("day", "yyyy-MM-dd").alias("date")).agg(*tiers)


def top_queries(cube: DataFrame, limit: int = 200) -> DataFrame:
    """The first queries of every target with their figures in the earlier window."""
    prev = _entities(cube, False).select(*BY, "key", *[F.col(c).alias("prev_" + c) for c in ("clicks", "impressions", "ctr", "position")])
    return topk.topk_entities(_entities(cube), limit, BY).join(prev, [*BY, "key"], "left")


def ctr_scatter(cube: DataFrame, limit: int = 500) -> DataFrame:
    rows = _entities(cube).where(F.col("impressions") > 0)
    return topk.topk_scatter(rows, limit, BY).select(*BY, "key", "position", "ctr", "impressions", "clicks")


def striking_distance(cube: DataFrame, limit: int = 100, low: int | None = None, high: int | None = None) -> DataFrame:
    lo, hi = M.clamp_position_bound(low, 11), M.clamp_position_bound(high, 20)
    rows = _entities(cube).where((F.col("position") >= lo) & (F.col("position") <= hi))
    return topk.topk_striking(rows, limit, BY).select(*BY, "key", "position", "ctr", "impressions", "clicks")


def movers(cube: DataFrame, ends: int = 50) -> DataFrame:
    """Both periods of a query side by side in one sum, no join."""
    rows = _of(cube, "query", None).where(F.col("query").isNotNull())
    clicks = lambda now: F.coalesce(F.sum(F.when(F.col("current") == now, F.col("clicks"))), F.lit(0))
    both = rows.groupBy(*BY, F.col("query").alias("key")).agg(
        clicks(True).alias("clicks"), clicks(False).alias("prev_clicks"), F.bool_and("current").alias("is_new"))
    return topk.two_ended(both.select(*BY, "key", "clicks", "prev_clicks", (F.col("clicks") - F.col("prev_clicks")).alias("delta"), "is_new"), ends, BY)


REPORTS = {
    "kpis": kpis, "timeseries": timeseries, "top-queries": top_queries, "breakdown": lambda c: breakdown(c, "device"),
    "breakdown-country": lambda c: breakdown(c, "country"), "position-buckets": position_buckets, "ctr-scatter": ctr_scatter,
    "striking-distance": striking_distance, "movers": movers,
}


def report_names() -> Sequence[str]:
    return tuple(REPORTS)
