"""Collector alerts over the attempt log, as Structured Streaming jobs.

Two small running tables follow the log: errors per hour, and the first and last success per hour. Both run in
update mode: whatever an hour's figures are after a batch is appended to the table with the number of the batch, and the
newest row of an hour counts. So an hour alerts as soon as it passes the threshold, needs no later event to be
closed, and a late attempt still counts. State holds one row per hour (and group) of the last ``KEEP``;
attempts that come later than that are counted as dropped, never lost in silence.

"No success for 23 hours" fires on absence: the gap is measured up to the time that the reader asks for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickstack.operators import ops
from clickstack.schema import ATTEMPT

#: How long an hour's state is kept after its last attempt could come.
KEEP = "45 days"
ERRORS = "errors long"
SUCCESSES = "first timestamp, last timestamp"


def error_windows(attempts: DataFrame, keep: str = KEEP) -> DataFrame:
    """Errors per hour."""
    e = attempts.where(F.col("status") == "error").withWatermark("logged_at", keep)
    g = e.groupBy(F.window("logged_at", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("errors"))
    return g.select(F.col("w.start").alias("window_start"), "errors")


def success_windows(attempts: DataFrame, by: Sequence[str] = (), keep: str = KEEP) -> DataFrame:
    """First and last success per hour (and ``by``)."""
    ok = attempts.where(F.col("status").startswith("collected_")).withWatermark("logged_at", keep)
    g = ok.groupBy(*by, F.window("logged_at", "1 hour").alias("w")).agg(F.min("logged_at").alias("first"), F.max("logged_at").alias("last"))
    return g.select(*by, F.col("w.start").alias("window_start"), "first", "last")


def _run(spark: SparkSession, windows, source_dir: str, sink: str, checkpoint: str, max_files: int) -> int:
    """Follow every attempt file present now; how many attempts came too late for their hour."""
    log = spark.readStream.schema(ATTEMPT).option("maxFilesPerTrigger", str(max_files)).parquet(source_dir)

    def keep(batch: DataFrame, batch_id: int) -> None:
        # A batch that is run again writes the same rows again under its number: the newest row of an hour stays the same.
        batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(sink)

    q = (windows(log).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return sum(op.numRowsDroppedByWatermark for p in q.recentProgress for op in p.stateOperators)


def newest(spark: SparkSession, sink: str, keys: Sequence[str], values: str) -> DataFrame:
    """The newest row of each hour."""
    names = [v.split()[0] for v in values.split(", ")]
    table = spark.read.parquet(sink)
    return table.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch").alias("v")).select(*keys, "v.*")


def run_available(spark: SparkSession, source_dir: str, sink_path: str, checkpoint: str, max_files_per_trigger: int = 8) -> DataFrame:
    """``window_start, window_end, errors, alert`` of every hour with errors, and ``late``: the attempts that were dropped."""
    late = _run(spark, error_windows, source_dir, sink_path, checkpoint, max_files_per_trigger)
    w = newest(spark, sink_path, ["window_start"], ERRORS)
    return w.select("window_start", (F.col("window_start") + F.expr("INTERVAL 1 HOUR")).alias("window_end"), "errors",
                    (F.col("errors") > ops.ERRORS_PER_HOUR_ALERT).alias("alert"), F.lit(late).cast("long").alias("late"))


def run_gaps(spark: SparkSession, source_dir: str, sink_path: str, checkpoint: str, as_of, by: Sequence[str] = (),
             max_files_per_trigger: int = 8) -> DataFrame:
    """The times without a success (``ops.success_gaps``) as of ``as_of``, from the running table."""
    _run(spark, lambda log: success_windows(log, by), source_dir, sink_path, checkpoint, max_files_per_trigger)
    hourly = newest(spark, sink_path, [*by, "window_start"], SUCCESSES)
    return ops.gaps_between(hourly.where(F.col("last") <= F.lit(as_of)), as_of, by)
