"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A document is a bag of words weighted by their counts. For each of ``samples`` draws every word gets two
gamma variates and a shift from hashes of the word, which turn its weight ``w`` into a level ``t`` and a
value: ``t = floor(ln w / r + b)``, ``ln a = ln c - r (t - b + 1)``. The (word, t) with the least value is
the sample. Two documents share a sample with a probability equal to their generalised Jaccard
similarity, the sum of smaller over the sum of larger counts.

Neighbours in id order are found without a global window: ids are cut into ranges at ids that occur, and
the first document of a range is also filed, as a guard, at the end of the range before. Texts are
shuffled once, by range; words are counted and the least values taken inside the same partitions.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickstack.llm.base import text_of

SAMPLES = 32
#: Draws worked out at once: a word's row is repeated for every so many, which keeps the compiled code short.
DRAWS = 8
#: Documents per range on average, and ranges at most (their bounds are held on the driver).
RANGE_ROWS = 2000
RANGES = 10_000
SPACE = "[ \\t\\n\\u000b\\f\\r]+"
#: What stands behind the last white space; begins at a word's start only, so one pass finds it.
LAST_WORD = "(?<![^ \\t\\n\\u000b\\f\\r])[^ \\t\\n\\u000b\\f\\r]++$"
LOW31, LOW32 = (1 << 31) - 1, (1 << 32) - 1


def range_bounds(rows: DataFrame, key: str) -> list[int]:
    """Ascending keys that occur, the least first, at even ranks: at most ``RANGES`` numbers."""
    head = rows.agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("least")).first()
    parts = min(RANGES, -(-head.n // RANGE_ROWS))
    if parts <= 1:
        return [head.least] if head.n else []
    at = [i / parts for i in range(1, parts)]
    found = rows.agg(F.percentile_approx(key, at, 100 * parts)).first()[0]
    return sorted({head.least, *found})


def range_of(key: Column, bounds: list[int]) -> Column:
    """Number of the range that holds ``key``: a search over every so many bounds, then between two."""
    step = max(1, int(len(bounds) ** 0.5))
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    block = F.size(F.filter(longs([b[0] for b in blocks]), lambda b: b <= key))
    within = F.size(F.filter(F.element_at(F.array(*[longs(b) for b in blocks]), block), lambda b: b <= key))
    return (block - 1) * step + within - 1


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``part, place, guard, doc_id, text, next_text``: every document and the one after it by id, the first
    after the last; equal ids go by text. Guards repeat the first document of the next range."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).withColumn(
        "key", F.coalesce("doc_id", F.lit(-(2**63)).cast("long")))
    bounds = range_bounds(rows, "key")
    if not bounds:
        return rows.select(F.lit(0).alias("part"), F.lit(0).alias("place"), F.lit(False).alias("guard"), "doc_id", "text",
                           F.col("text").alias("next_text"))
    part, last = range_of(F.col("key"), bounds), len(bounds) - 1
    opens = F.col("key").isin(bounds) if len(bounds) <= 10 else F.element_at(
        F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("part") + 1) == F.col("key")
    rows = rows.withColumn("part", part)
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("guard"))
    guard = F.struct(F.when(F.col("part") == 0, F.lit(last)).otherwise(F.col("part") - 1).alias("part"), F.lit(True).alias("guard"))
    dealt = rows.withColumn("into", F.explode(F.when(opens, F.array(own, guard)).otherwise(F.array(own)))).select(
        "into.part", "into.guard", "key", "doc_id", "text")
    in_part = Window.partitionBy("part").orderBy("guard", "key", "text")
    return dealt.repartition(len(bounds), "part").select(
        "part", F.row_number().over(in_part).alias("place"), "guard", "doc_id", "text",
        F.lead("text").over(in_part).alias("next_text"))


def _unit(bits: Column) -> Column:
    """31 bits to a number in (0, 1)."""
    return (bits + F.lit(0.5)) / F.lit(float(1 << 31))


def _values(k: int) -> list[Column]:
    """Of draw ``k`` of a chunk for the hashed word ``term``: r, the shift b, ln c, and the word's mark."""
    one = F.xxhash64(F.col("term"), F.col("chunk") * F.lit(DRAWS) + F.lit(k))
    two, three = F.xxhash64(one), F.xxhash64(one, F.lit(1))
    low = lambda h: _unit(h.bitwiseAND(F.lit(LOW31)))
    high = lambda h: _unit(F.shiftrightunsigned(h, 33))
    return [(-F.log(low(one) * high(one))).alias(f"r{k}"), low(three).alias(f"b{k}"),
            F.log(-F.log(low(two) * high(two))).alias(f"c{k}"), F.shiftrightunsigned(three, 32).alias(f"m{k}")]


def _sample(k: int, weight: str, log_weight: str) -> Column:
    """The value (29 bits or more above, least first) and the mark of (word, level) below, as one long."""
    r, b, c, m = (F.col(f"{x}{k}") for x in "rbcm")
    level = F.floor(F.col(log_weight) / r + b)
    value = F.greatest(c - r * (level - b + 1) + 200, F.lit(0.0))
    mark = (m + level * F.lit(0x9E3779B1)).bitwiseAND(F.lit(LOW32))
    return F.when(F.col(weight) > 0, F.shiftleft((value * F.lit(float(1 << 22))).cast("long"), 32).bitwiseOR(mark))


def _likeness(a: Column, b: Column, samples: int) -> Column:
    same = reduce(add, [F.when(a[k].eqNullSafe(b[k]), 1).otherwise(0) for k in range(samples)])
    return same / F.lit(float(samples))


def sampled(words: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """Per ``keys``: the samples ``own`` and ``edited`` of the word counts ``w0`` and ``w1`` of ``term``,
    as arrays of marks; an array of nulls where no word has a count."""
    logs = words.withColumn("l0", F.log(F.greatest("w0", F.lit(1)).cast("double"))).withColumn(
        "l1", F.log(F.greatest("w1", F.lit(1)).cast("double")))
    chunks = logs.withColumn("chunk", F.explode(F.array(*[F.lit(c) for c in range(-(-samples // DRAWS))])))
    drawn = chunks.select(*keys, "chunk", "w0", "w1", "l0", "l1", *[v for k in range(DRAWS) for v in _values(k)])
    least = drawn.groupBy(*keys, "chunk").agg(
        *[F.min(_sample(k, "w0", "l0")).alias(f"x{k}") for k in range(DRAWS)],
        *[F.min(_sample(k, "w1", "l1")).alias(f"y{k}") for k in range(DRAWS)])
    marks = lambda p: F.array(*[F.col(f"{p}{k}").bitwiseAND(F.lit(LOW32)) for k in range(DRAWS)])
    parts = least.select(*keys, F.struct("chunk", marks("x").alias("own"), marks("y").alias("edited")).alias("one")).groupBy(*keys).agg(
        F.sort_array(F.collect_list("one")).alias("parts"))
    whole = lambda side: F.slice(F.flatten(F.col(f"parts.{side}")), 1, samples)
    return parts.select(*keys, whole("own").alias("own"), whole("edited").alias("edited"))


def weighted_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """One row per input row: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``.

    The edited text has its last quarter of code points replaced by as many (or all) from the start of the
    next document in id order; after the last comes the first. Fingerprints are the samples as hex digits;
    a likeness is the share of equal samples.

    Null texts count as empty. Texts without words have the empty fingerprint; two of them are alike, one and
    a text with words are not. Equal ids go by text, null ids come first, repeated rows are rows of their
    own. A single row is its own neighbour; an empty table gives an empty result. Only id and text are read."""
    rows = with_next(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("head", F.left("text", (F.col("n_chars") - cut).cast("int"))).withColumn(
        "edited", F.concat("head", F.left(F.coalesce("next_text", F.lit("")), cut)))
    # Words that end inside the common head are split once; behind them both texts go their own way.
    rows = rows.withColumn("head", F.regexp_replace("head", LAST_WORD, "")).withColumn("upto", F.length("head") + 1)
    tail = lambda c: F.split(F.substr(F.col(c), F.col("upto"), F.length(c)), SPACE)
    keys = ["part", "place", "guard", "doc_id", "n_chars", "sha_a", "sha_b", "sha_c", "sha_d"]
    sha = F.sha2("edited", 256)
    rows = rows.withColumn("sha", sha).select(
        "part", "place", "guard", "doc_id", "n_chars",
        *[F.conv(F.substring("sha", 1 + 16 * i, 16), 16, -10).cast("long").alias(f"sha_{x}") for i, x in enumerate("abcd")],
        F.split("head", SPACE).alias("both"), tail("text").alias("mine"), tail("edited").alias("theirs"))
    rows = rows.withColumn("n_both", F.size("both")).withColumn("n_mine", F.col("n_both") + F.size("mine"))
    terms = rows.select(*keys, "n_both", "n_mine", F.posexplode(F.concat("both", "mine", "theirs")).alias("at", "word"))
    real = F.col("word") != ""
    counted = terms.groupBy(*keys, F.xxhash64("word").alias("term")).agg(
        F.sum((real & (F.col("at") < F.col("n_mine"))).cast("int")).alias("w0"),
        F.sum((real & ((F.col("at") < F.col("n_both")) | (F.col("at") >= F.col("n_mine")))).cast("int")).alias("w1"))
    prints = sampled(counted, keys, samples)
    after = Window.partitionBy("part").orderBy("place")
    prints = prints.withColumn("next", F.lead("own").over(after)).where(~F.col("guard"))
    text = lambda c: F.concat(*[F.coalesce(F.lpad(F.lower(F.hex(F.col(c)[k])), 8, "0"), F.lit("")) for k in range(samples)])
    return prints.select(
        "doc_id", "n_chars", F.lower(F.concat(*[F.lpad(F.hex(f"sha_{x}"), 16, "0") for x in "abcd"])).alias("edited_sha256"),
        text("own").alias("fingerprint"), text("edited").alias("edited_fingerprint"),
        _likeness(F.col("own"), F.col("edited"), samples).alias("near_edited"),
        _likeness(F.col("own"), F.col("next"), samples).alias("near_next"))
