"""Aggregations over fact rows.

Every function takes an already-filtered fact DataFrame and optional extra grouping columns
``by`` (e.g. ``["target_id"]``), so one job can serve many targets at once (R19). All metrics are
algebraic sums, so Spark computes partial aggregates before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickstack.functions import filters as flt


def weighted_position(pos: Column | str = "position", impr: Column | str = "impressions") -> Column:
    p = F.col(pos) if isinstance(pos, str) else pos
    i = F.col(impr) if isinstance(impr, str) else impr
    return F.try_divide(F.sum(p * i), F.sum(i))


def metrics4(cond: Column | None = None, prefix: str = "") -> list[Column]:
    """Σclicks, Σimpressions, Σclicks/Σimpressions, Σ(position×impressions)/Σimpressions,
    optionally restricted to rows where ``cond`` holds (conditional sums in one scan)."""
    def gate(x: Column) -> Column:
        return x if cond is None else F.when(cond, x).otherwise(F.lit(0))
    clicks = F.sum(gate(F.col("clicks")))
    impr = F.sum(gate(F.col("impressions")))
    pos = F.sum(gate(F.col("position") * F.col("impressions")))
    return [clicks.alias(f"{prefix}clicks"), impr.alias(f"{prefix}impressions"),
            F.try_divide(clicks, impr).alias(f"{prefix}ctr"),
            F.try_divide(pos, impr).alias(f"{prefix}position")]


def group_union_agg(members_fact: DataFrame) -> DataFrame:
    """A group's union re-weighted by (date, query, country, device)."""
    return members_fact.groupBy("data_date", "query", "country", "device").agg(*metrics4())


def kpis(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """D3: one row of metrics (per ``by`` group)."""
    return df.groupBy(*by).agg(*metrics4())


def bucket(rollup: str = "day") -> Column:
    """Time bucket as 'yyyy-MM-dd': day, Monday week, or month."""
    d = F.col("data_date")
    b = F.trunc(d, "week") if rollup == "week" else F.trunc(d, "month") if rollup == "month" else d
    return F.date_format(b, "yyyy-MM-dd")


def timeseries(df: DataFrame, rollup: str = "day", by: Sequence[str] = ()) -> DataFrame:
    """Metrics per bucket, no gap fill."""
    return df.groupBy(*by, bucket(rollup).alias("date")).agg(*metrics4())


def top_entity(df: DataFrame, dim: str, by: Sequence[str] = ()) -> DataFrame:
    """Metrics by query or page (not yet limited)."""
    return df.groupBy(*by, F.col(dim).alias("key")).agg(*metrics4())


def breakdown(df: DataFrame, dim: str = "device", by: Sequence[str] = ()) -> DataFrame:
    """Metrics by device or country."""
    return df.groupBy(*by, F.col(dim).alias("key")).agg(*metrics4())


def position_buckets(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Impressions per day in row-position tiers."""
    p, i = F.col("position"), F.col("impressions")
    tier = lambda c: F.sum(F.when(c, i).otherwise(0))
    return df.groupBy(*by, bucket("day").alias("date")).agg(
        tier(p <= 3).alias("top3"),
        tier((p > 3) & (p <= 10)).alias("p4_10"),
        tier((p > 10) & (p <= 20)).alias("p11_20"),
        tier((p > 20) & (p <= 50)).alias("p21_50"),
        tier(p > 50).alias("p50plus"))


def per_query(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per-query weighted position, ctr, impressions, clicks (shared by D8, D10, D12)."""
    return df.groupBy(*by, F.col("query").alias("key")).agg(
        weighted_position().alias("position"),
        F.try_divide(F.sum("clicks"), F.sum("impressions")).alias("ctr"),
        F.sum("impressions").alias("impressions"),
        F.sum("clicks").alias("clicks"))


def ctr_scatter(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per query, impressions > 0 (filter on the aggregate)."""
    return per_query(df, by).where(F.col("impressions") > 0)


def ctr_curve(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ctr by rounded row position, 1..10."""
    pos = F.round(F.col("position")).cast("long")
    return (df.groupBy(*by, pos.alias("pos"))
            .agg(F.try_divide(F.sum("clicks"), F.sum("impressions")).alias("ctr"),
                 F.sum("impressions").alias("impressions"))
            .where(F.col("pos").between(1, 10)))


def ctr_bench_rows(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per query with weighted position ≤ 10 and impressions > 0."""
    return per_query(df, by).where((F.col("position") <= 10) & (F.col("impressions") > 0))


def query_page_pairs(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Metrics by (query, page)."""
    return df.groupBy(*by, F.col("query").alias("q"), F.col("page").alias("p")).agg(
        F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"),
        weighted_position().alias("position"))


def clamp_position_bound(v, default: int) -> int:
    x = default if not v else v
    return int(min(max(round(x), 1), 1000))


def striking_distance(df: DataFrame, pmin=None, pmax=None, by: Sequence[str] = ()) -> DataFrame:
    """Per query with weighted position in [min, max] (defaults 11, 20; rounded, 1..1000)."""
    lo, hi = clamp_position_bound(pmin, 11), clamp_position_bound(pmax, 20)
    return per_query(df, by).where((F.col("position") >= lo) & (F.col("position") <= hi))


def grouped_metrics(df: DataFrame, exprs: Sequence[Column | None], by: Sequence[str] = ()) -> DataFrame:
    """N boolean groups in one scan: g{i}_clicks, g{i}_impr, g{i}_ctr, g{i}_pos."""
    cols = []
    for i, e in enumerate(exprs):
        cond = e if e is not None else F.lit(False)
        c, im, ct, po = metrics4(cond)
        cols += [c.alias(f"g{i}_clicks"), im.alias(f"g{i}_impr"), ct.alias(f"g{i}_ctr"), po.alias(f"g{i}_pos")]
    return df.groupBy(*by).agg(*cols)


def brand_split(df: DataFrame, terms: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Brand / nonbrand rows over rows with a query."""
    bm = flt.brand_match(terms)
    seg = F.when(bm, F.lit("brand")).otherwise(F.lit("nonbrand"))
    return df.where(F.col("query").isNotNull()).groupBy(*by, seg.alias("segment")).agg(*metrics4())


def brand_timeseries(df: DataFrame, terms: Sequence[str], rollup: str = "day", by: Sequence[str] = ()) -> DataFrame:
    """Brand / nonbrand clicks and impressions per bucket as four columns."""
    bm = flt.brand_match(terms)
    s = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0))
    return (df.where(F.col("query").isNotNull())
            .groupBy(*by, bucket(rollup).alias("date"))
            .agg(s(bm, "clicks").alias("brand"), s(~bm, "clicks").alias("nonbrand"),
                 s(bm, "impressions").alias("brandImpr"), s(~bm, "impressions").alias("nonbrandImpr")))
