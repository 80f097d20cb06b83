"""Hard negatives by Kronecker-packed products.

Rows are cut into blocks by a hash of their id, anchors into blocks of their own, and every anchor block meets
every row block once (a stated query set against all rows, in blocks). In such a cell the components of
all the block's rows are biased to be non-negative and laid side by side, one field a row, in one wide
integer per component. An anchor multiplies each of these integers by its own biased component and adds
the products: every field of the sum then holds one row's inner product plus known bias terms, which are
subtracted after unpacking. Fields are as wide as the largest sum that the cell can have, so nothing is
ever carried into a neighbour and all scores are exact integers.

A cell returns the best few rows per anchor only; the best of all cells are a top-k per anchor in Spark. The
first pass finds the positives, the second the negatives in the score band of each positive.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickstack.llm.base import ship_by_value, stash

#: Components are multiplied by this and floored.
SCALE = 256
#: Ids divisible by this are anchors.
ANCHOR_EVERY = 100
POSITIVES, NEGATIVES = 5, 5
#: A negative's score is at least so many hundredths of the positive's, and at most the positive's.
MARGIN = 80
#: Rows and anchors of a block, on average.
BLOCK_ROWS, BLOCK_ANCHORS = 4096, 1024

_LONG = (1 << 63) - 1


def usable_rows(table: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """``vec_id, label, v``: rows that take part, vectors scaled and floored (whole numbers as doubles, so any
    finite component is exact); one row per id, the least by label and then by vector."""
    inf = F.lit(float("inf"))
    whole = F.transform(F.col(vector_col), lambda x: F.lit(float(SCALE)) * x.cast("double"))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), whole.alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != inf), F.lit(False)))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    # floor() would turn doubles into 64-bit integers: below 2^53 it is exact, larger doubles are whole already.
    rows = rows.withColumn("v", F.transform("v", lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def _matrix(vectors) -> np.ndarray:
    """Rows of whole numbers, shorter ones filled up with zeros: 64-bit integers, or Python's where those are too small."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    if np.abs(out).max(initial=0) < 2.0**31:
        return out.astype(np.int64)
    exact = np.empty(out.shape, object)
    exact[...] = [[int(x) for x in row] for row in out]
    return exact


class PackedRows:
    """The rows of a block as one wide integer per component, to be multiplied by anchors of at most ``high``
    after a bias of ``bias`` that makes their components non-negative."""

    def __init__(self, rows: np.ndarray, bias: int, high: int):
        self.n, self.dims = rows.shape
        self.anchor_bias = bias
        self.bias = max(0, -int(rows.min(initial=0)))
        lifted = rows + self.bias
        most = self.dims * high * int(lifted.max(initial=0))
        self.bytes = 4 if most < 1 << 32 else 8 if most < 1 << 62 else most.bit_length() // 8 + 1
        self.sums = rows.sum(axis=1) if self.dims else np.zeros(self.n, np.int64)
        if self.bytes > 8:
            self.sums = np.array([int(x) for x in self.sums], object)
        self.wide = [self._pack(lifted[:, j]) for j in range(self.dims)]

    def _pack(self, column: np.ndarray) -> int:
        if self.bytes <= 8:
            return int.from_bytes(column.astype(f"<u{self.bytes}").tobytes(), "little")
        return int.from_bytes(b"".join(int(x).to_bytes(self.bytes, "little") for x in column), "little")

    def scores(self, anchor: np.ndarray) -> np.ndarray:
        """The exact inner product of the anchor and every row: one multiplication per component."""
        anchor = [int(x) for x in anchor]
        total = 0
        for wide, x in zip(self.wide, anchor):
            if lifted := x + self.anchor_bias:
                total += wide * lifted
        raw = total.to_bytes(self.n * self.bytes, "little")
        if self.bytes <= 8:
            fields = np.frombuffer(raw, f"<u{self.bytes}").astype(np.int64)
        else:
            fields = np.array([int.from_bytes(raw[k : k + self.bytes], "little") for k in range(0, len(raw), self.bytes)], object)
        shared = self.bias * sum(anchor) + self.dims * self.anchor_bias * self.bias
        return fields - self.anchor_bias * self.sums - shared


def first_by_score(scores: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` of ``places`` (ascending) with the highest scores, ties by place."""
    if len(places) > k:
        s = scores[places]
        least = np.partition(s, len(s) - k)[len(s) - k] if s.dtype != object else sorted(s, reverse=True)[k - 1]
        above, level = places[s > least], places[s == least]
        places = np.concatenate([above, level[: k - len(above)]])
    return np.array(sorted(places, key=lambda i: (-scores[i], i)), np.int64)


def _blocks(rows: DataFrame, n: int, size: int, name: str) -> tuple[DataFrame, int]:
    """The rows with the number of their block, a hash of the id, and the count of blocks."""
    count = max(1, -(-n // size))
    return rows.withColumn(name, F.pmod(F.xxhash64(F.lit(name), "vec_id"), F.lit(count)).cast("int")), count


def _gathered(rows: DataFrame, block: str, *extra: str) -> DataFrame:
    """One row per block: its rows, at most a few times the block size, ordered by id."""
    return rows.groupBy(block).agg(F.array_sort(F.collect_list(F.struct("vec_id", "label", "v", *extra))).alias("rows"))


def _cells(anchors: DataFrame, rows: DataFrame, anchor_blocks: int, row_blocks: int, find, schema: str) -> DataFrame:
    """``find`` applied to every pair of an anchor block and a row block."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("row_block", every(row_blocks))
    right = rows.withColumn("anchor_block", every(anchor_blocks))
    keys = ["anchor_block", "row_block"]

    def run(key, own: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        names = [part.split()[0] for part in schema.split(", ")]
        if own.empty or met.empty:
            return pd.DataFrame([], columns=names)
        found = find(own["rows"].iloc[0], met["rows"].iloc[0])
        return pd.DataFrame(found, columns=names)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def _meet(anchors, rows):
    """(anchor, ids of the rows, labels of the rows, scores) of every anchor of a cell."""
    ids = np.array([r["vec_id"] for r in rows], np.int64)
    labels = np.array([r["label"] for r in rows], np.int64)
    both = _matrix([r["v"] for r in rows] + [a["v"] for a in anchors])
    own = both[len(rows) :]
    bias = max(0, -int(own.min(initial=0)))
    packed = PackedRows(both[: len(rows)], bias, int(own.max(initial=0)) + bias)
    for a, v in zip(anchors, own):
        yield a, ids, labels, packed.scores(v)


def _long(score) -> int:
    return max(-_LONG, min(_LONG, int(score)))


def _positives(anchors, rows):
    out = []
    for a, ids, labels, scores in _meet(anchors, rows):
        places = np.flatnonzero((labels == a["label"]) & (ids != a["vec_id"]))
        out.extend((a["vec_id"], ids[i], _long(scores[i])) for i in first_by_score(scores, places, POSITIVES))
    return out


def _negatives(anchors, rows):
    out = []
    for a, ids, labels, scores in _meet(anchors, rows):
        other = labels != a["label"]
        for p in a["positives"]:
            high = int(p["positive_score"])
            low = -(-MARGIN * high // 100)
            places = np.flatnonzero(other & (scores >= low) & (scores <= high))
            out.extend((a["vec_id"], p["positive_id"], high, ids[i], _long(scores[i]))
                       for i in first_by_score(scores, places, NEGATIVES))
    return out


def hard_negatives(table: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
                   relabel=None, anchor_every: int = ANCHOR_EVERY, block_rows: int = BLOCK_ROWS,
                   block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Scores are integer inner products of the scaled, floored vectors; higher comes first, ties by smaller id.
    An anchor (id divisible by ``anchor_every``) has as positives its first five other rows of its label, each
    positive the first five rows of other labels that score from 80 to 100 hundredths of it. ``relabel`` maps
    the columns (id, label) to the label that counts.

    Rows with a null id, label, vector or component, or a component that is not finite, take no part. Rows
    repeated under one id count once, as the least by label, then vector. A shorter vector counts as filled up with
    zeros; an empty one scores 0. Scores beyond 64 bits are compared exactly within a cell and returned as the nearest
    such number. An anchor without positives, or a positive without fitting rows, has no result; an
    empty table gives an empty result. Other columns are not read.
    """
    rows = usable_rows(table, id_col, label_col, vector_col)
    if relabel is not None:
        rows = rows.withColumn("label", relabel(F.col("vec_id"), F.col("label")).cast("long"))
    rows = stash(rows, "negatives-rows")
    n = rows.count()
    anchors = rows.where(F.pmod("vec_id", F.lit(anchor_every)) == 0)
    dealt, row_blocks = _blocks(rows, n, block_rows, "row_block")
    asked, anchor_blocks = _blocks(anchors, anchors.count(), block_anchors, "anchor_block")
    packed = stash(_gathered(dealt, "row_block"), "negatives-blocks")

    found = _cells(_gathered(asked, "anchor_block"), packed, anchor_blocks, row_blocks, _positives,
                   "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    best = found.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= POSITIVES)
    positives = stash(best.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives")),
                      "negatives-positives")

    told = asked.join(positives, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")
    found = _cells(_gathered(told, "anchor_block", "positives"), packed, anchor_blocks, row_blocks, _negatives,
                   "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ship_by_value(__name__)
