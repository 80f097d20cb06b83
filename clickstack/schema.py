"""Declared table schemas (additive evolution only: new columns are nullable)."""

from pyspark.sql import types as T

FACT = T.StructType([
    T.StructField("data_date", T.DateType(), False),
    T.StructField("property", T.StringType(), False),
    T.StructField("property_type", T.StringType(), False),
    T.StructField("search_type", T.StringType(), False),
    T.StructField("aggregation", T.StringType(), False),
    T.StructField("query", T.StringType(), True),
    T.StructField("page", T.StringType(), True),
    T.StructField("country", T.StringType(), True),
    T.StructField("device", T.StringType(), True),
    T.StructField("search_appearance", T.StringType(), True),
    T.StructField("clicks", T.LongType(), False),
    T.StructField("impressions", T.LongType(), False),
    T.StructField("ctr", T.DoubleType(), False),
    T.StructField("position", T.DoubleType(), False),
    T.StructField("is_anonymized", T.BooleanType(), False),
    T.StructField("row_hash", T.StringType(), False),
    T.StructField("collected_at", T.TimestampType(), False),
    T.StructField("data_state", T.StringType(), False),
])

FACT_COLUMNS = [f.name for f in FACT.fields]

ATTEMPT = T.StructType([
    T.StructField("task_id", T.StringType(), False),
    T.StructField("property", T.StringType(), False),
    T.StructField("search_type", T.StringType(), False),
    T.StructField("aggregation", T.StringType(), False),
    T.StructField("data_date", T.DateType(), False),
    T.StructField("account_id", T.StringType(), True),
    T.StructField("status", T.StringType(), False),
    T.StructField("attempt", T.LongType(), False),
    T.StructField("row_count", T.LongType(), True),
    T.StructField("api_calls", T.LongType(), True),
    T.StructField("error_message", T.StringType(), True),
    T.StructField("logged_at", T.TimestampType(), False),
])

# One raw API result row: positional keys plus four metrics.
API_ROW = T.StructType([
    T.StructField("keys", T.ArrayType(T.StringType()), True),
    T.StructField("clicks", T.DoubleType(), True),
    T.StructField("impressions", T.DoubleType(), True),
    T.StructField("ctr", T.DoubleType(), True),
    T.StructField("position", T.DoubleType(), True),
])

# One response file: the request cell it answers, its rows and, where known, when the cell was loaded.
API_RESPONSE = T.StructType([
    T.StructField("site_url", T.StringType(), False),
    T.StructField("data_date", T.StringType(), False),
    T.StructField("search_type", T.StringType(), False),
    T.StructField("aggregation", T.StringType(), False),
    T.StructField("first_incomplete_date", T.StringType(), True),
    T.StructField("rows", T.ArrayType(API_ROW), True),
    T.StructField("loaded_at", T.TimestampType(), True),
])

RULE = T.StructType([
    T.StructField("dimension", T.StringType(), False),
    T.StructField("op", T.StringType(), False),
    T.StructField("value", T.StringType(), False),
])

# Search types and aggregations of the data model.
SEARCH_TYPES = ["web", "image", "video", "news", "discover", "googleNews"]
AGGREGATIONS = ["byProperty", "byPage", "totals"]
TERMINAL_FINAL = ["collected_with_data", "collected_no_data"]
