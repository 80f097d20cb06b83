"""Which rows may be on a list: a bitmap of hashes, so that only those rows need a join with it.

The bitmap has sixteen bits for each listed hash, two of them set, up to ``MOST_BITS``: a fixed bound on what is sent
around. A row whose bits are not set is surely not on the list and stays where it is. Of the others about one in seventy
is not on the list either; the join decides. A list that outgrows the bound lets more rows through to
the join, never fewer.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickstack.llm.base import ship_by_value

LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of each hash, from its lower and its upper half."""
    own = hashes.astype(np.int64).view(np.uint64)
    return own & np.uint64(bits - 1), (own >> np.uint64(32)) & np.uint64(bits - 1)


def may_hold(listed: DataFrame, hash_col: str, most_bits: int = MOST_BITS) -> Callable[[Column], Column]:
    """A test of 64-bit hashes: false where a hash is surely not in ``listed``. Null hashes are never listed."""
    spark = listed.sparkSession
    hashes = listed.select(F.col(hash_col).cast("long").alias("h")).where("h is not null")
    n = hashes.count()
    if not n:
        return lambda column: F.lit(False)
    bits = LEAST_BITS
    while bits < min(16 * n, most_bits):
        bits *= 2
    mask = F.lit(bits - 1).cast("long")
    places = hashes.select(F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask))).alias("p"))
    word = places.groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    held = np.zeros(bits // 64, np.int64)
    own = word.toPandas()  # at most ``bits / 64`` numbers
    held[own["w"].to_numpy()] = own["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(held)

    @F.pandas_udf("boolean")
    def test(column: pd.Series) -> pd.Series:
        known = column.notna().to_numpy()
        first, second = _places(column.fillna(0).to_numpy(), bits)
        words = shared.value.view(np.uint64)
        is_set = lambda p: (words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return pd.Series(known & is_set(first) & is_set(second))

    return test


ship_by_value(__name__)
