"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every source has a token target. Among all document rates between 0 and 2 that meet the targets, the
rates of least relative entropy to 1 are exponentially tilted: ``min(2, exp(dual * size / mean size))``
with one dual number per source. The convex dual is solved by Newton iterations, each one aggregation
over (source, size) counts; a bracket keeps every step inside known bounds. All sums are taken over
whole numbers, so reruns agree bit for bit whatever the order of the rows.

Rates are rounded into whole copies by order sampling: a document's rate is first cut to its whole part,
then documents get one more copy in ascending order of a hashed draw divided by the cut-off part, up to
the words still missing; what is left then is filled with documents that fit into it, the largest first, until
none does, and with one more where that ends nearer to the target. A hot source is cut into as many order bins as its rows need: a window runs over bins, and inside one
bin only where the cut falls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickstack.llm.base import stash, text_of

#: Fixed values of the mix: weights of the sources in order, share of all words, highest multiple.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Rates are whole multiples of 1 / UNIT; rows of a source per order bin.
UNIT = 1 << 30
BIN_ROWS = 1 << 14


def words(text: Column) -> Column:
    """Number of runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, n, target`` from ``sizes(source, size)``.

    A level L is sought with sum(min(most * size, L * weight)) equal to the wanted words. Sources in order
    of the level at which they are full: those before the cut are full, the rest share what is left by
    weight. The windows run over one row per source."""
    order = F.col("source").isNull(), F.col("source")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    rank = F.pmod(F.row_number().over(Window.orderBy(*order)) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int"))
    whole = Window.partitionBy(F.lit(0))
    by_level = Window.partitionBy(F.lit(0)).orderBy("full_at", *order)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    cap = F.col("source_size") * most
    out = (
        per.withColumn("weight", weight).withColumn("want", F.sum("source_size").over(whole) * share)
        .withColumn("full_at", cap / F.col("weight"))
        .withColumn("level", (F.col("want") - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(after))
        # The level holds from the first source that it does not fill.
        .withColumn("cut", F.min(F.when(F.col("full_at") >= F.col("level"), F.struct("full_at", "level"))).over(whole)["level"]))
    even = F.least(cap.cast("double"), F.col("weight") * F.col("cut"))
    return out.select("source", "source_size", "n", F.coalesce(even, cap.cast("double")).alias("target"))


def _rate(dual: Column, size: Column, mean: Column, most: int) -> Column:
    """The tilted rate in whole multiples of 1 / UNIT."""
    return F.round(F.least(F.lit(float(most)), F.exp(F.least(dual * size / mean, F.lit(50.0)))) * F.lit(float(UNIT))).cast("long")


def solve_duals(counts: DataFrame, goals: DataFrame, most: int = MOST, rounds: int = 60, tolerance: float = 1e-7) -> DataFrame:
    """``source, dual, mean``: Newton iterations on the dual of every source at once.

    ``counts(source, size, copies)`` has the rows per size. Sources whose target is zero or the highest
    multiple of their size need no dual and are left out. A step that leaves the bracket of known bounds
    is replaced by the middle of the bracket."""
    state = goals.where((F.col("target") > 0) & (F.col("target") < F.lit(most * (1 - 1e-12)) * F.col("source_size"))).select(
        "source", "target", (F.col("source_size") / F.col("n")).alias("mean"), F.lit(0.0).alias("dual"),
        F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(False).alias("done"))
    state = stash(state, "mixing-dual")
    exact = lambda c: c.cast("decimal(38,0)")
    for _ in range(rounds):
        rate = _rate(F.col("dual"), F.col("size"), F.col("mean"), most)
        moved = F.when(rate < most * UNIT, rate * F.round(F.col("size") / F.col("mean") * 1024)).otherwise(0)
        sums = (
            counts.alias("c").join(state.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")))
            .select("s.*", "size", "copies", rate.alias("rate"), moved.cast("decimal(38,0)").alias("moved"))
            .groupBy("source", "target", "mean", "dual", "low", "high", "done")
            .agg((F.sum(exact(F.col("rate")) * exact(F.col("size") * F.col("copies"))).cast("double") / UNIT).alias("got"),
                 (F.sum(F.col("moved") * exact(F.col("size") * F.col("copies"))).cast("double") / UNIT / 1024).alias("slope")))
        short = F.col("got") < F.col("target")
        low = F.when(short, F.col("dual")).otherwise(F.col("low"))
        high = F.when(short, F.col("high")).otherwise(F.col("dual"))
        newton = F.col("dual") + (F.col("target") - F.col("got")) / F.col("slope")
        # Until both bounds are known a step goes at most 4 away.
        inside = F.greatest(F.coalesce(F.col("low2"), F.col("dual") - 4), F.least(F.coalesce(F.col("high2"), F.col("dual") + 4), newton))
        middle = (F.coalesce(F.col("low2"), F.col("dual") - 4) + F.coalesce(F.col("high2"), F.col("dual") + 4)) / 2
        near = F.abs(F.col("got") - F.col("target")) <= tolerance * F.col("target") + 0.5
        step = F.when(near | F.col("done"), F.col("dual")).when(F.col("slope") <= 0, middle).when(
            (newton <= F.coalesce(F.col("low2"), newton - 1)) | (newton >= F.coalesce(F.col("high2"), newton + 1)), middle).otherwise(inside)
        state = stash(
            sums.withColumn("low2", low).withColumn("high2", high).select(
                "source", "target", "mean", step.alias("dual"), F.col("low2").alias("low"), F.col("high2").alias("high"),
                (near | F.col("done")).alias("done")), "mixing-dual")
        if state.where(~F.col("done")).isEmpty():
            break
    return state.select("source", "dual", "mean")


def fill_sizes(fitting: DataFrame) -> DataFrame:
    """``source, f_size, n, take`` from ``fitting(source, size, n, rest)``: how many of the ``n`` documents of a size
    are taken when sizes are gone through once, the largest first, and each takes what still fits. A document left over
    was larger than the rest in its turn, so none fits in the end; the smallest of them comes in addition where that
    ends nearer to the target.

    One row of distinct sizes per source is gone through, all below twice the rest, which is less than one document."""
    one = fitting.groupBy("source", "rest").agg(F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("sizes"))
    entry = "struct<f_size: bigint, n: bigint, take: bigint>"

    def step(state, it):
        take = F.least(it["n"], F.floor(state["rest"] / it["size"]))
        took = F.struct(it["size"].alias("f_size"), it["n"].alias("n"), take.alias("take"))
        return F.struct((state["rest"] - take * it["size"]).alias("rest"),
                        F.when(take > 0, F.concat(state["takes"], F.array(took))).otherwise(state["takes"]).alias("takes"),
                        F.when(take < it["n"], took).otherwise(state["least"]).alias("least"))

    def finish(state):
        least = state["least"]
        one_more = F.struct(least["f_size"].alias("f_size"), least["n"].alias("n"), (least["take"] + 1).alias("take"))
        others = F.filter(state["takes"], lambda t: t["f_size"] != least["f_size"])
        return F.when(least["f_size"] < 2 * state["rest"], F.concat(others, F.array(one_more))).otherwise(state["takes"])

    start = F.struct(F.col("rest").cast("double").alias("rest"), F.expr(f"cast(array() as array<{entry}>)").alias("takes"),
                     F.expr(f"cast(null as {entry})").alias("least"))
    return one.select("source", F.inline(F.aggregate("sizes", start, step, finish)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target, rate, copies, taken, row_hash``.

    ``copies`` (0 to ``most``) says how often the mix takes the document, ``taken`` is copies times size.
    Sources are ordered by code point, null last, and get ``weights`` in turn; targets above ``most`` times
    a source's size are cut there and the rest is shared anew by weight. No document whose rate is above its
    copies fits into what a source misses in the end.

    Null and wordless texts have size 0 and are never taken. Repeated rows are rounded one by one. An empty
    table gives an empty result. Only id, text and source are read."""
    rows = stash(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        words(text_of(text_col)).alias("size"), F.xxhash64(text_of(text_col)).alias("row_hash")), "mixing-sizes")
    goals = stash(targets(rows, weights, share, most), "mixing-targets")
    counts = stash(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("copies")), "mixing-counts")
    duals = solve_duals(counts, goals, most)
    known = goals.alias("g").join(duals.alias("d"), F.col("g.source").eqNullSafe(F.col("d.source")), "left").select("g.*", "dual", "mean")
    known = stash(known, "mixing-known")

    rate = F.when(F.col("dual").isNotNull(), _rate(F.col("dual"), F.col("size"), F.col("mean"), most)).when(
        F.col("target") > 0, F.lit(most * UNIT).cast("long")).otherwise(F.lit(0).cast("long"))
    rated = rows.alias("r").join(known.alias("k"), F.col("r.source").eqNullSafe(F.col("k.source"))).select(
        "r.*", "source_size", "n", "target", rate.alias("units"))
    part = F.pmod(F.col("units"), F.lit(UNIT))
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "doc_id", "row_hash"), 33) + 1) / F.lit(float(1 << 31))
    rated = (
        rated.withColumn("base", F.floor(F.col("units") / F.lit(UNIT)).cast("long")).withColumn("part", part)
        .withColumn("order", F.when((F.col("part") > 0) & (F.col("size") > 0), F.least(draw * UNIT / F.col("part"), F.lit(1e6))))
        .withColumn("bins", F.ceil(F.col("n") / BIN_ROWS)))
    # Expected cuts lie near order 1, where the bins are evenly spaced; one bin holds all beyond 2.
    rated = rated.withColumn("bin", F.when(F.col("order").isNotNull(), F.floor(F.least("order", F.lit(2.0)) * F.col("bins")).cast("long")))
    base_words = rated.groupBy("source").agg(F.sum(F.col("base") * F.col("size")).alias("base_words"))
    in_source = Window.partitionBy("source").orderBy("bin")
    # One row per bin: a small table, some sixteen thousand rows to one.
    bins = rated.where("bin is not null").groupBy("source", "bin").agg(F.sum("size").alias("words"))
    bins = bins.alias("b").join(base_words.alias("w"), F.col("b.source").eqNullSafe(F.col("w.source"))).join(
        goals.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))).select(
        "b.source", "bin", "words", (F.col("target") - F.col("base_words")).alias("missing"))
    bins = stash(bins.withColumn("upto", F.sum("words").over(in_source)).withColumn("before", F.col("upto") - F.col("words")),
                 "mixing-bins")
    keyed = rated.alias("r").join(
        bins.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.bin") == F.col("b.bin")), "left").select(
        "r.*", "missing", "upto", "before")
    # Only the bin in which the cut falls is put in order, by draw.
    at_cut = (F.col("before") < F.col("missing")) & (F.col("upto") > F.col("missing"))
    inside = Window.partitionBy("source", "bin").orderBy("order", "doc_id", "row_hash", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    clear = keyed.where(~F.coalesce(at_cut, F.lit(False))).withColumn("more", (F.coalesce(F.col("upto") <= F.col("missing"), F.lit(False))).cast("long"))
    cut = keyed.where(at_cut).withColumn("run", F.sum("size").over(inside)).withColumn(
        "more", (F.col("before") + F.col("run") <= F.col("missing")).cast("long")).drop("run")
    dealt = stash(clear.unionByName(cut).select(
        "doc_id", "source", "size", "source_size", "target", "units", "row_hash", "part", (F.col("base") + F.col("more")).alias("copies")),
        "mixing-dealt")
    # What is left of a target, less than the document at the cut, goes to documents that fit, the largest first.
    free = (F.col("part") > 0) & (F.col("size") > 0) & (F.col("copies") * UNIT < F.col("units"))
    rest = dealt.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("rest"))
    fitting = (
        dealt.where(free).groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")).alias("f")
        .join(rest.alias("x"), F.col("f.source").eqNullSafe(F.col("x.source"))).where(F.col("size") < 2 * F.col("rest"))
        .select("f.source", "size", "n", "rest"))
    fill = stash(fill_sizes(fitting), "mixing-fill")
    filled = dealt.withColumn("draw", F.shiftrightunsigned(F.xxhash64(F.lit("fill"), "doc_id", "row_hash"), 33) / F.lit(float(1 << 31)))
    filled = filled.alias("d").join(
        fill.alias("f"), free & F.col("d.source").eqNullSafe(F.col("f.source")) & (F.col("d.size") == F.col("f.f_size")), "left").select(
        "d.*", "n", "take")
    # Of a size that is taken in part, bins of rows by draw: again only the bin with the cut is put in order.
    filled = filled.withColumn("bin", F.when(F.col("take") < F.col("n"), F.floor(F.col("draw") * F.ceil(F.col("n") / BIN_ROWS))))
    bins = filled.where("bin is not null").groupBy("source", "size", "bin").agg(F.count(F.lit(1)).alias("rows"))
    upto = F.sum("rows").over(Window.partitionBy("source", "size").orderBy("bin"))
    bins = stash(bins.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("rows")), "mixing-fill-bins")
    filled = filled.alias("d").join(bins.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.size") == F.col("b.size"))
                                    & (F.col("d.bin") == F.col("b.bin")), "left").select("d.*", "upto", "before")
    at_cut = F.coalesce((F.col("before") < F.col("take")) & (F.col("upto") > F.col("take")), F.lit(False))
    whole = F.coalesce((F.col("take") == F.col("n")) | (F.col("upto") <= F.col("take")), F.lit(False))
    place = F.row_number().over(Window.partitionBy("source", "size", "bin").orderBy("draw", "doc_id", "row_hash"))
    clear = filled.where(~at_cut).withColumn("more", whole.cast("long"))
    cut = filled.where(at_cut).withColumn("place", place).withColumn(
        "more", (F.col("before") + F.col("place") <= F.col("take")).cast("long")).drop("place")
    copies = F.col("copies") + F.col("more")
    return clear.unionByName(cut).select(
        "doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target",
        (F.col("units") / float(UNIT)).alias("rate"), copies.alias("copies"), (copies * F.col("size")).alias("taken"), "row_hash")
