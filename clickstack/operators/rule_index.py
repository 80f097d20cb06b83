"""Matching many group rules against many keys by an index of rule fragments.

A rule that looks for a text (``contains``, ``starts_with``, ``equals``) can only match a key that holds every run of three
characters of that text. Of these runs the one that the fewest keys hold stands for the rule. Keys meet rules by an equi-join on
(dimension, run), and only such pairs are tested. Rules without such a run (patterns, shorter texts) are left
to the caller.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickstack.functions import filters as flt

RUN = 3
TEXT_OPS = ("contains", "starts_with", "equals")


def runs_of(text: Column) -> Column:
    """The distinct runs of three characters of a text, lower-cased; none of a shorter or null one."""
    low = F.lower(text)
    n = F.coalesce(F.length(low), F.lit(0)) - (RUN - 1)
    every = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: low.substr(i, F.lit(RUN)))
    return F.when(n > 0, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def indexable() -> Column:
    """Rules that the index serves."""
    return F.col("op").isin(*TEXT_OPS) & F.col("dimension").isin("query", "page") & (F.length(F.trim(F.col("value"))) >= RUN)


def _key_runs(keys: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by, query, page, dimension, run``: a row per run of a key's query or page."""
    both = F.array(*[F.struct(F.lit(d).alias("dimension"), runs_of(F.col(d)).alias("runs")) for d in ("query", "page")])
    dims = keys.select(*by, "query", "page", F.explode(both).alias("d"))
    return dims.select(*by, "query", "page", "d.dimension", F.explode("d.runs").alias("run"))


def match(keys: DataFrame, rules: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, query, page, group_id``: the distinct pairs of a key and a group of which an indexable rule matches. ``keys`` holds
    distinct (query, page) per ``by``; null queries and pages are keys like any other."""
    own = rules.where(indexable())
    held = _key_runs(keys, by)
    of_rules = own.select(*by, "group_id", "dimension", "op", "value", F.explode(runs_of(F.trim(F.col("value")))).alias("run"))
    # How many keys hold each run that a rule has: the rarest one stands for the rule.
    asked = of_rules.select(*by, "dimension", "run").distinct()
    seen = held.join(asked, [*by, "dimension", "run"], "left_semi").groupBy(*by, "dimension", "run").agg(F.count(F.lit(1)).alias("keys"))
    rarest = Window.partitionBy(*by, "group_id", "dimension", "op", "value").orderBy(F.coalesce("keys", F.lit(0)), "run")
    chosen = of_rules.join(seen, [*by, "dimension", "run"], "left").withColumn("_place", F.row_number().over(rarest)).where(
        (F.col("_place") == 1) & F.col("keys").isNotNull()).select(*by, "dimension", "run", "group_id", "op", "value")
    pairs = held.join(chosen, [*by, "dimension", "run"])
    fits = flt.rule_match_column(F.col("dimension"), F.col("op"), F.col("value"), F.col("page"), F.col("query"))
    return pairs.where(fits).select(*by, "query", "page", "group_id").distinct()
