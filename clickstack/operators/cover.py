"""Greedy cover of weighted term sets (R17), exact and without a scan per choice.

The next term is the one with the largest weight among the sets that hold none of the terms chosen so
far (ties: the smallest term). Scores only ever decrease as sets are claimed, so the terms that matter
for the next choices are among the first by score now. A pass therefore takes the ``WIDTH`` first terms, writes each set
as a bit mask over them, sums the weights of equal masks, and plays the choices out on these sums: at most
``2 ** WIDTH`` numbers a target, whatever the data. A choice stands as long as it comes before every term that the
pass left out could come, which their score before the pass bounds; then the next pass goes on with what
is unclaimed. The first choice of a pass always stands, most often all of them do.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickstack import session as lineage
from clickstack.operators import topk

#: Terms of a pass: the masks of one target are at most 2 ** WIDTH numbers.
WIDTH = 18


def play(masks: np.ndarray, weights: np.ndarray, terms: list[str], scores: list[int], closed: bool, limit: int) -> list[str]:
    """The choices that stand, in order: ``terms`` by score, then name; ``closed`` if no term was left out."""
    bits = (masks[:, None] >> np.arange(len(terms))) & 1
    chosen, left = [], np.ones(len(masks), bool)
    while len(chosen) < limit:
        now = [sum(weights[left & (bits[:, j] == 1)].tolist()) for j in range(len(terms))]
        j = min(range(len(terms)), key=lambda k: (-now[k], terms[k]))
        stands = closed or (-now[j], terms[j]) <= (-scores[-1], terms[-1])
        if now[j] <= 0 or not stands:
            break
        chosen.append(terms[j])
        left &= bits[:, j] == 0
    return chosen


def greedy_cover(sets: DataFrame, by: Sequence[str] = (), limit: int = 12, width: int = WIDTH) -> DataFrame:
    """``by, rank, term``: up to ``limit`` terms per target covering ``sets`` (``by, terms, weight``; terms distinct,
    weights positive whole numbers). Each pass reads ``sets`` twice; of the targets only those that are not done."""
    spark = sets.sparkSession
    keys = list(by)
    kinds = dict(sets.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keys), "rank int", "term string", "more boolean"])
    done = spark.createDataFrame([], schema)
    left = sets
    while True:
        found = _one_pass(left, keys, limit, width, done, schema)
        # Without target columns these are at most ``limit`` rows; with them, a few rows per target.
        found = spark.createDataFrame(found.collect(), schema) if not keys else lineage.cut_lineage(found)
        done = done.unionByName(found)
        going = found.where("more")
        if going.isEmpty():
            return done.where(F.col("term").isNotNull()).select(*keys, "rank", "term")
        left = _unclaimed(sets, done, going, keys)


def _unclaimed(sets: DataFrame, done: DataFrame, going: DataFrame, keys: list[str]) -> DataFrame:
    """The sets of targets that go on which hold none of their terms."""
    chosen = done.where(F.col("term").isNotNull())
    if not keys:
        terms = F.array(*[F.lit(r.term) for r in chosen.collect()]).cast("array<string>")
        return sets.where(~F.arrays_overlap("terms", terms))
    taken = chosen.join(going.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.collect_list("term").alias("taken"))
    return sets.join(taken, keys).where(~F.arrays_overlap("terms", "taken")).drop("taken")


def _one_pass(sets: DataFrame, keys: list[str], limit: int, width: int, done: DataFrame, schema: str) -> DataFrame:
    scores = sets.select(*keys, F.explode("terms").alias("term"), "weight").groupBy(*keys, "term").agg(F.sum("weight").alias("score"))
    first = topk.top_n(scores, [F.col("score").desc(), F.col("term").asc()], width + 1, keys)
    before = done.where(F.col("term").isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("chosen"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("score"), "term")))  # width + 1 rows a target at most
    told = first.groupBy(*keys).agg(ordered.alias("all"))
    told = told.select(*keys, F.slice("all", 1, width).alias("first"), (F.size("all") <= width).alias("closed"))
    if keys:
        told = told.join(before, keys, "left")
        masked = sets.join(told.select(*keys, F.col("first.term").alias("names")), keys)
    else:
        row = told.first()
        if row is None:
            return sets.sparkSession.createDataFrame([], schema)
        n = before.agg(F.sum("chosen")).first()[0]
        told = sets.sparkSession.createDataFrame([(row.first, row.closed, n)], "first array<struct<score:long,term:string>>, closed boolean, chosen long")
        masked = sets.withColumn("names", F.array(*[F.lit(r.term) for r in row.first]))
    bit = F.transform("terms", lambda t: F.array_position("names", t))
    mask = F.aggregate(bit, F.lit(0).cast("long"), lambda acc, p: F.when(p > 0, acc + F.expr("1L") * F.pow(F.lit(2.0), p - 1).cast("long")).otherwise(acc))
    sums = masked.select(*keys, mask.alias("mask"), "weight").where("mask > 0").groupBy(*keys, "mask").agg(F.sum("weight").alias("weight"))

    def run(key, own: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        names = [*keys, "rank", "term", "more"]
        if own.empty or met.empty:
            return pd.DataFrame([], columns=names)
        r = met.iloc[0]
        had = 0 if pd.isna(r["chosen"]) else int(r["chosen"])
        terms, scores_ = [x["term"] for x in r["first"]], [-int(x["score"]) for x in r["first"]]
        chosen = play(own["mask"].to_numpy(), own["weight"].to_numpy(), terms, scores_, bool(r["closed"]), limit - had)
        more = not r["closed"] and had + len(chosen) < limit
        group = key[: len(keys)]
        rows = [(*group, had + i + 1, t, more) for i, t in enumerate(chosen)]
        return pd.DataFrame(rows, columns=names)

    if not keys:
        one = F.lit(0).alias("_one")
        return sums.groupBy(one).cogroup(told.groupBy(one)).applyInPandas(run, schema)
    told = told.select(*[F.col(k).alias(f"_{k}") for k in keys], "first", "closed", "chosen")  # both sides come from ``sets``
    return sums.groupBy(*keys).cogroup(told.groupBy(*[f"_{k}" for k in keys])).applyInPandas(run, schema)


# Python workers get this module's functions by value: they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
