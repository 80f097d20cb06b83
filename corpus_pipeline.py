"""From raw documents to packed training sequences.

Five stages, each written as Parquet and read back as the next one's input: reject documents of low
quality, drop exact copies, keep one document of each near-duplicate group, mix the sources to their target
weights (documents may repeat or go), pack what is left into sequences.

Every stage but the last returns the columns of its input, whatever they are. Null texts count as empty, null
ids are ids like any other, rows repeated with equal id and text are one document to the deduplicating
stages and documents of their own to the others; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickstack.llm import exact_dedup, mixing, packing, quality, simhash_dedup
from clickstack.llm.base import ASCII_SPACE, stash, text_of
from clickstack.llm.suspects import may_hold

#: Names for helper columns that no table is expected to have.
ID, HASH, COPIES = "__pipeline_id", "__pipeline_hash", "__pipeline_copies"


def _without(docs: DataFrame, key, dropped: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` without the rows listed in ``dropped`` and with one row for each listed in ``repeated``; both are
    (id, hash) tables, ``key`` is the hash of a row. Of repeated rows the longest text stays."""
    columns = docs.columns
    dropped, repeated = stash(dropped, "pipeline-dropped"), stash(repeated, "pipeline-repeated")
    listed = dropped.select("hash").unionByName(repeated.select("hash")).select(F.xxhash64("hash").alias("bits"))
    suspect = may_hold(listed, "bits")(F.xxhash64(HASH))
    keyed = docs.withColumn(HASH, key)
    # Texts move only where their hash may be on a list; the others stay in place.
    clear, keyed = keyed.where(~suspect).select(*columns), keyed.where(suspect)
    same = lambda t: keyed["doc_id"].eqNullSafe(t["id"]) & (keyed[HASH] == t["hash"])
    left = keyed.join(dropped, same(dropped), "left_anti")
    if repeated.isEmpty():
        return clear.unionByName(left.select(*columns))
    keyed = left
    many = left.join(repeated, same(repeated), "left_semi")
    one = many.groupBy("doc_id", HASH).agg(F.max_by(
        F.struct(*[F.col(f"`{c}`") for c in columns]), F.struct(F.length(text_of("text")), text_of("text"))).alias("row"))
    return clear.unionByName(left.join(repeated, same(repeated), "left_anti").select(*columns)).unionByName(one.select("row.*"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score of at least 0.3)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_quality(docs, quality.fit_quality(docs, labels))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    found = stash(exact_dedup.exact_dedup(docs).where("group_size > 1").select(
        F.col("doc_id").alias("id"), F.col("text_sha256").alias("hash"), "kept"), "pipeline-exact")
    # An id with one kept and one dropped row cannot be: both have the group's id that stays.
    repeated = found.where("kept").groupBy("id", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    key = F.sha2(F.translate(text_of("text"), ASCII_SPACE, ""), 256)
    return _without(docs, key, found.where("not kept").drop("kept").distinct(), repeated)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the SimHash links: the one with the smallest id."""
    found = stash(simhash_dedup.simhash_near_dedup(docs).select(
        F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), F.col("component_id").alias("component")), "pipeline-near")
    heads = found.where(F.col("id").eqNullSafe(F.col("component")))
    first = heads.groupBy("component").agg(F.min("hash").alias("first"))
    dropped = found.alias("f").join(first.alias("h"), F.col("f.component").eqNullSafe(F.col("h.component"))).where(
        ~(F.col("id").eqNullSafe(F.col("f.component")) & (F.col("hash") == F.col("first")))).select("id", "hash").distinct()
    repeated = heads.groupBy("id", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return _without(docs, F.xxhash64(text_of("text")), dropped, repeated)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    columns = docs.columns
    taken = stash(mixing.mix(docs).groupBy("doc_id", "row_hash", "source").agg(
        F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).where("copies > 0"), "pipeline-mix")
    keyed = docs.withColumn(HASH, F.xxhash64(text_of("text")))
    rows = keyed.alias("d").join(
        taken.alias("t"), F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col(f"d.{HASH}") == F.col("t.row_hash"))
        & F.col("d.source").cast("string").eqNullSafe(F.col("t.source"))).select(
        "d.*", F.col("t.copies").alias(COPIES), F.col("t.rows").alias(ID))
    # Rows that repeat share the copies of all of them: each takes its part, the first ones the rest.
    turn = F.row_number().over(Window.partitionBy("doc_id", HASH, "source").orderBy(F.lit(0)))
    many = rows.where(F.col(ID) > 1).withColumn(
        COPIES, F.floor(F.col(COPIES) / F.col(ID)) + (turn <= F.col(COPIES) % F.col(ID)).cast("long"))
    each = rows.where(F.col(ID) == 1).unionByName(many).where(F.col(COPIES) > 0)
    return each.withColumn(COPIES, F.explode(F.sequence(F.lit(1).cast("long"), F.col(COPIES)))).select(*columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in the sequences."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("simhash near-dedup", near_duplicates),
    ("source mixing", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: SQL can express neither the classifier nor the later stages; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
