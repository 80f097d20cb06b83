"""A bounded sample of labelled texts for fitting a classifier on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickstack.llm.base import held_out, text_of


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int, max_chars: int,
                    id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """At most ``max_rows`` (text, label) pairs with at most ``max_chars`` code points together,
    half of the rows from either label as far as there are as many. Rows held out for
    measurement, null labels and null ids are never taken. The choice follows a hash of the id, so
    it is the same on every run and does not grow with the input. Texts come whole; equal texts of one id and
    label come once."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col))
    ranked = usable.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"),
        F.xxhash64(F.lit("sample"), F.col(id_col).cast("long")).alias("draw"))
    chosen = None
    for value in (0, 1):
        part = ranked.where(F.col("label") == value).orderBy("draw", "doc_id").limit(max_rows // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most max_rows rows of three numbers: small whatever the input is.
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").withColumn("hash", F.xxhash64("text"))
    keys = ["draw", "doc_id", "label", "hash"]
    # Rows repeated under one id count once, and different texts of one id are rows of their own within the bound.
    sizes = found.select(*keys, F.length("text").alias("n")).distinct().orderBy("draw", "doc_id", "n", "label", "hash").limit(max_rows)
    taken, total = [], 0
    for row in sizes.collect():
        if total + row.n <= max_chars:
            taken.append(tuple(row[k] for k in keys))
            total += row.n
    if not taken:
        return []
    spark = docs.sparkSession
    kept = spark.createDataFrame(taken, "draw long, doc_id long, label int, hash long")
    rows = found.join(F.broadcast(kept), keys).groupBy(*keys).agg(F.first("text").alias("text")).collect()
    return [(r.text, r.label) for r in sorted(rows, key=lambda r: (r.draw, r.doc_id, r.text, r.label))]
