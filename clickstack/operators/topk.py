"""Sorts, limits and top-k.

Without extra grouping keys a top-k is ``orderBy().limit()`` (TakeOrderedAndProject: each task
keeps its own k rows, only k × tasks rows reach the final merge). With grouping keys it is
``row_number() <= k`` over a window, which Spark plans with a partial WindowGroupLimit before the
shuffle, so a hot group never ships all its rows. Every order ends with the key ascending so ties
are deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, order: Sequence[Column], n: int | None, by: Sequence[str] = (),
          rank_col: str | None = None) -> DataFrame:
    """The first ``n`` rows by ``order`` (per ``by`` group); ``n=None`` keeps all rows."""
    if n is not None and n < 1:
        raise ValueError(f"a top list holds at least one row, not {n}")
    if n is None and not rank_col:
        return df
    if not by and not rank_col:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    rc = rank_col or "_rn"
    out = df.withColumn(rc, F.row_number().over(w))
    if n is not None:
        out = out.where(F.col(rc) <= n)
    return out if rank_col else out.drop(rc)


def by_clicks(key: str = "key") -> list[Column]:
    return [F.col("clicks").desc_nulls_last(), F.col("impressions").desc_nulls_last(), F.col(key).asc_nulls_last()]


def by_impressions(key: str = "key") -> list[Column]:
    return [F.col("impressions").desc_nulls_last(), F.col(key).asc_nulls_last()]


def topk_entities(df: DataFrame, limit=100, by: Sequence[str] = ()) -> DataFrame:
    """clicks ↓, impressions ↓, key ↑; the first ``limit``; ``None`` keeps all."""
    return top_n(df, by_clicks(), limit, by)


def topk_scatter(df: DataFrame, limit=500, by: Sequence[str] = ()) -> DataFrame:
    """impressions ↓, the first ``limit``."""
    return top_n(df, by_impressions(), limit, by)


def topk_bench(df: DataFrame, limit=200, by: Sequence[str] = ()) -> DataFrame:
    """impressions ↓, the first ``limit``."""
    return top_n(df, by_impressions(), limit, by)


def topk_pairs(df: DataFrame, limit=5000, by: Sequence[str] = ()) -> DataFrame:
    """(query, page) pairs by impressions ↓, the first ``limit``."""
    order = [F.col("impressions").desc_nulls_last(), F.col("q").asc_nulls_last(), F.col("p").asc_nulls_last()]
    return top_n(df, order, limit, by)


def topk_striking(df: DataFrame, limit=100, by: Sequence[str] = ()) -> DataFrame:
    """impressions ↓, the first ``limit``."""
    return top_n(df, by_impressions(), limit, by)


def two_ended(df: DataFrame, n: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """the top ``n`` and bottom ``n`` rows by delta, no row twice. The bottom end is the
    reverse of the same total order (delta ↓, key ↑). Each end is its own top-k (partial limit
    before any shuffle, per target with ``by``); the bottom drops rows already in the top."""
    desc = [F.col("delta").desc(), F.col("key").asc_nulls_last()]
    asc = [F.col("delta").asc(), F.col("key").desc_nulls_first()]
    top = top_n(df, desc, n, by)
    bottom = top_n(df, asc, n, by)
    k = [*by, "key"]
    return top.unionByName(bottom.join(top.select(*k), k, "left_anti"))


def gainers_losers(df: DataFrame, n: int = 15, by: Sequence[str] = ()) -> DataFrame:
    """rows with delta > 0 (largest first) and delta < 0 (most negative first), ``n`` each,
    tagged by ``side``."""
    g = top_n(df.where(F.col("delta") > 0), [F.col("delta").desc(), F.col("key").asc_nulls_last()], n, by)
    l_ = top_n(df.where(F.col("delta") < 0), [F.col("delta").asc(), F.col("key").asc_nulls_last()], n, by)
    return g.withColumn("side", F.lit("gainer")).unionByName(l_.withColumn("side", F.lit("loser")))


def topn_other(df: DataFrame, name: str, value: str, n: int = 6, by: Sequence[str] = ()) -> DataFrame:
    """F8: positive values ↓, the first ``n`` kept by name, the rest summed as 'Other';
    ``share`` = percent of the shown total."""
    shown = df.where(F.col(value) > 0)
    first = top_n(shown.select(*by, name, value), [F.col(value).desc(), F.col(name).asc_nulls_last()], n, by)
    # At most n rows a group from here on: their slots, and by them what is left over.
    w = Window.partitionBy(*by).orderBy(F.col(value).desc(), F.col(name).asc_nulls_last())
    named = first.withColumn("slot", F.row_number().over(w))
    taken = first.select(*[F.col(c).alias(f"_{c}") for c in (*by, name)])
    left = shown.join(taken, [shown[c].eqNullSafe(taken[f"_{c}"]) for c in (*by, name)], "left_anti")
    other = left.groupBy(*by).agg(F.sum(value).alias(value)).where(F.col(value).isNotNull()).select(
        *by, F.lit("Other").alias(name), value, F.lit(n + 1).alias("slot"))
    out = named.select(*by, name, value, "slot").unionByName(other)
    tot = Window.partitionBy(*by)
    return out.withColumn("share", F.col(value) * 100.0 / F.sum(value).over(tot))


def breakdown_top(df: DataFrame, metric: str = "clicks", n: int = 8, by: Sequence[str] = ()) -> DataFrame:
    """blank keys dropped, metric ↓ (position ↑), first ``n``, bar = |v| / max(|v|, 1)
    (position bars are 1 − that)."""
    o = F.col(metric).asc() if metric == "position" else F.col(metric).desc()
    top = top_n(df.where(F.col("key").isNotNull() & (F.col("key") != "")), [o, F.col("key").asc()], n, by,
                rank_col="rank").where(F.col("rank") <= n)
    mx = F.greatest(F.max(F.abs(F.col(metric))).over(Window.partitionBy(*by)), F.lit(1.0))
    frac = F.abs(F.col(metric)) / mx
    return top.withColumn("bar", (F.lit(1.0) - frac) if metric == "position" else frac)


def sorted_page(df: DataFrame, sort_key: str = "clicks", descending: bool = True, page: int = 0,
                size: int = 10) -> DataFrame:
    """sort by any column and direction, one page of ``size`` rows."""
    o = F.col(sort_key).desc_nulls_last() if descending else F.col(sort_key).asc_nulls_last()
    return df.orderBy(o, F.col("key").asc_nulls_last()).offset(page * size).limit(size)
