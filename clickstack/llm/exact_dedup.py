"""Exact deduplication with counting quotient filters.

Each input partition builds counting quotient filters of its 64-bit text fingerprints, one per
shard of the fingerprint space. A filter stores, per quotient, the run of sorted remainders with
their counts. The filters of a shard merge losslessly by their sorted remainders. Only texts whose
fingerprint is counted more than once go on to byte verification, where rows are grouped by the
normalised text itself.

Skew: a text that makes up a third of the rows is one remainder with a count in each filter, and
one partially aggregated row per task in the verification. The last join is keyed on the
fingerprint of small digest rows; its right side has one row per repeated text, so a hot key
splits by adaptive skew handling.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickstack.llm.base import ASCII_SPACE, ship_by_value, stash, text_of

#: Fingerprints a shard holds on average, and quotient bits inside a shard.
SHARD_ROWS = 1 << 19
QUOTIENT_BITS = 16
#: Fingerprints a task gathers before it writes its filters out.
FLUSH_ROWS = 1 << 22


class CountingQuotientFilter:
    """The filter of one shard. A fingerprint below the shard bits splits into a quotient (the run
    it belongs to) and a remainder; runs hold sorted distinct remainders, each with a count."""

    def __init__(self, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.runs, self.remainders, self.counts = runs, remainders, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray, shard_bits: int) -> "CountingQuotientFilter":
        rest = np.uint64(64 - shard_bits - QUOTIENT_BITS)
        kept = fingerprints << np.uint64(shard_bits) >> np.uint64(shard_bits) if shard_bits else fingerprints
        order = np.argsort(kept, kind="stable")
        kept, counts = kept[order], counts[order]
        first = np.flatnonzero(np.r_[True, kept[1:] != kept[:-1]]) if len(kept) else np.zeros(0, int)
        distinct = kept[first]
        quotients = (distinct >> rest).astype(np.int64)
        runs = np.bincount(quotients, minlength=1 << QUOTIENT_BITS).astype(np.uint32)
        remainders = distinct & ((np.uint64(1) << rest) - np.uint64(1))
        return cls(runs, remainders, np.add.reduceat(counts, first) if len(first) else counts)

    def fingerprints(self, shard: int, shard_bits: int) -> np.ndarray:
        """The exact fingerprints that went in."""
        rest = np.uint64(64 - shard_bits - QUOTIENT_BITS)
        quotients = np.repeat(np.arange(len(self.runs), dtype=np.uint64), self.runs)
        low = (quotients << rest) | self.remainders
        return low | (np.uint64(shard) << np.uint64(64 - shard_bits)) if shard_bits else low

    def to_row(self) -> tuple[bytes, bytes, bytes]:
        used = np.flatnonzero(self.runs).astype(np.uint16)
        runs = np.concatenate([used.astype(np.uint32), self.runs[used]])
        return runs.tobytes(), self.remainders.tobytes(), self.counts.astype(np.uint32).tobytes()

    @classmethod
    def from_row(cls, runs: bytes, remainders: bytes, counts: bytes) -> "CountingQuotientFilter":
        used, lengths = np.frombuffer(runs, np.uint32).reshape(2, -1)
        full = np.zeros(1 << QUOTIENT_BITS, np.uint32)
        full[used] = lengths
        return cls(full, np.frombuffer(remainders, np.uint64), np.frombuffer(counts, np.uint32).astype(np.int64))


def _filters_of(fingerprints: list[np.ndarray], shard_bits: int) -> pa.RecordBatch:
    values = np.concatenate(fingerprints) if fingerprints else np.zeros(0, np.uint64)
    values, counts = np.unique(values, return_counts=True)
    shards = (values >> np.uint64(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(values), np.int64)
    cuts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]) if len(values) else np.zeros(0, int)
    rows = []
    for a, b in zip(cuts, [*cuts[1:], len(values)]):
        rows.append((int(shards[a]), *CountingQuotientFilter.build(values[a:b], counts[a:b], shard_bits).to_row()))
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])],
        names=["shard", "runs", "remainders", "counts"])


def repeated_fingerprints(digest: DataFrame, fp_col: str = "fp") -> DataFrame:
    """``fp, n``: the fingerprints that occur more than once, by building and merging filters."""
    shards, rows = 1, digest.count()
    while shards * SHARD_ROWS < rows:
        shards *= 2
    shard_bits = shards.bit_length() - 1

    def build(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            rows += len(held[-1])
            if rows >= FLUSH_ROWS:
                yield _filters_of(held, shard_bits)
                held, rows = [], 0
        if held:
            yield _filters_of(held, shard_bits)

    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [CountingQuotientFilter.from_row(*r) for r in zip(pdf.runs, pdf.remainders, pdf["counts"])]
        merged = CountingQuotientFilter.build(
            np.concatenate([p.fingerprints(0, shard_bits) for p in parts]),
            np.concatenate([p.counts for p in parts]), shard_bits)
        many = merged.counts > 1
        fps = merged.fingerprints(int(key[0]), shard_bits)[many]
        return pd.DataFrame({"fp": fps.view(np.int64), "n": merged.counts[many].astype(np.int64)})

    filters = digest.select(fp_col).mapInArrow(build, "shard long, runs binary, remainders binary, counts binary")
    return filters.groupBy("shard").applyInPandas(merge, "fp long, n long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after deleting ASCII white space. Of equal texts the row with
    the most code points in the original text stays, then the smallest id (a null id counts as
    the smallest).

    Null texts count as empty; empty texts equal one another. Rows repeated with the same id and
    text are members of the same group and all marked kept, since nothing tells them apart. An
    empty table gives an empty result; other columns, whatever their names, are not read.
    """
    text = text_of(text_col)
    norm = F.translate(text, ASCII_SPACE, "")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    digest = stash(
        rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), norm.alias("norm"))
        .select("doc_id", "n_chars", F.xxhash64("norm").alias("fp"), F.unhex(F.sha2("norm", 256)).alias("sha")),
        "dedup-digest")
    repeated = stash(repeated_fingerprints(digest), "dedup-repeated")

    # Byte verification of the texts behind repeated fingerprints: grouped by the text itself. The
    # row that stays is the largest of n_chars * 2^65 + (2^63 - doc_id), one decimal that
    # hash aggregation can keep in place.
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    two63, two65 = F.lit(Decimal(2**63)).cast("decimal(20,0)"), F.lit(Decimal(2**65)).cast("decimal(20,0)")
    lowest = F.lit(-(2**63)).cast("long")
    checked = (
        rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), norm.alias("norm"))
        .withColumn("fp", F.xxhash64("norm")).join(repeated.select("fp"), "fp")
        .withColumn("doc_id", F.coalesce("doc_id", lowest))
        .groupBy("fp", "norm")
        .agg(F.max((wide("n_chars") * two65 + (two63 - wide("doc_id"))).cast("decimal(38,0)")).alias("best"),
             F.count(F.lit(1)).alias("group_size"))
        .select("fp", F.unhex(F.sha2("norm", 256)).alias("sha"), "group_size",
                (two63 - F.pmod("best", two65.cast("decimal(38,0)"))).cast("decimal(20,0)").cast("long").alias("best_id")))
    classes = checked.select(
        "fp", "sha", "group_size", F.when(F.col("best_id") != lowest, F.col("best_id")).alias("best_id"))
    out = digest.join(classes, ["fp", "sha"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("best_id"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


ship_by_value(__name__)
