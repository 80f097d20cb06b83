"""Raw input tables (one parquet file per table) with per-session DataFrame reuse."""

from __future__ import annotations

import os
import threading

from pyspark.sql import DataFrame, SparkSession

from clickstack.sources.files import stamp

_CACHE: dict[tuple, DataFrame] = {}
_LOCK = threading.Lock()

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, id(spark), sf_dir, name)
    with _LOCK:
        df = _CACHE.get(key)
        if df is None:
            df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
            _CACHE[key] = df
        return df


def fingerprint(spark: SparkSession, sf_dir: str, names=("lineitem", "orders", "customer", "nation", "part", "events", "pages")) -> str:
    """A stable token for the input files (path, size, time) so derived tables rebuild on change."""
    import hashlib

    h = hashlib.sha256(sf_dir.encode())
    for n in names:
        h.update(f"{n}:{stamp(spark, os.path.join(sf_dir, n + '.parquet'))}".encode())
    return h.hexdigest()[:16]
