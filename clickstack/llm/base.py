"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickstack.session import checkpoint_root

#: The white space of the text contracts: blank, tab, line feed, vertical tab, form feed, return.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def ship_by_value(module_name: str) -> None:
    """Send a module's functions to Python workers by value, so workers need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ship_by_value(__name__)


def text_of(col: str | Column) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back: computed once,
    survives lost executors, and its size is known to the planner when it picks joins."""
    spark: SparkSession = df.sparkSession
    path = f"{checkpoint_root(spark)}/llm/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept away from training: crc32 of the id's decimal text is divisible by five."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def process_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, whatever task asks for it."""
    holder = sys.modules.setdefault("_llm_process_cache", types.ModuleType("_llm_process_cache"))
    return holder.__dict__.setdefault(name, {})
