"""Response files → fact store, as a Structured Streaming job.

New response files are picked up by the file source; each micro-batch maps the rows (A8), hashes them (H1) and
appends them to the fact store as one load (A9, ``sources/loads``): it writes its own rows only, whatever
is stored already. Of a cell the newest load counts, its pages may come in different batches, and an older load that
comes later is left out. Storing is idempotent, so the at-least-once delivery of ``foreachBatch`` after
a failure gives the same table. Late or restated days simply arrive as new files and replace their cells until
they are final; that is why ``first_incomplete_date`` stays a data column (``data_state``) and not a
Spark watermark: fresh rows must be stored and queryable at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clickstack.sources import ingest
from clickstack.sources.loads import FactStore


def start(spark: SparkSession, source_dir: str, target_path: str, checkpoint: str, collected_at,
          available_now: bool = True, max_files_per_trigger: int | None = None):
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    lines = reader.text(source_dir)  # parsed in the batch, by all cores

    def apply(batch: DataFrame, batch_id: int) -> None:
        ingest.store_responses(batch.sparkSession, ingest.parse_lines(batch.select("value")), target_path, collected_at)

    w = lines.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def run_available(spark: SparkSession, source_dir: str, target_path: str, checkpoint: str, collected_at,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """Process every file present now, stop, and return the current rows of the store."""
    q = start(spark, source_dir, target_path, checkpoint, collected_at, True, max_files_per_trigger)
    q.awaitTermination()
    return FactStore(spark, target_path).current()
