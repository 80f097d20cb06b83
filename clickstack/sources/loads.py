"""A fact store that is only appended to (A9, S1): what replaces a slice is a newer load of its cell.

A cell is one (property, day, type, aggregation). Rows lie in plain Parquet below ``rows``, in folders by aggregation, part
and load. A load is stored as it comes, in the part ``fresh`` of its aggregations, sorted by day; compaction moves rows
into one part per month. ``loads`` lists which load holds which version of a cell. A version is whole: the current one is the
one with the newest ``loaded_at`` (null oldest), of equal ones the one that was stored last.

* Storing writes the rows of a batch, then its part of ``loads`` as one file. Rows whose load is not listed yet do
  not exist for readers, so nobody sees half a slice, and what a failed attempt left behind is never read.
* Pages of one load can come in different batches: a page that finds a version with its own ``loaded_at`` is
  stored together with that version's other rows, as a new version. Only such cells are read back.
* Readers skip folders without a current version and, inside of the others, the versions that a newer one replaced. Both
  lists come from ``loads`` and are as small as what was restated since the last compaction; rows are not shuffled.
* ``compact`` rewrites the months that have fresh or replaced versions, each as one folder, ``vacuum`` deletes
  folders that no reader needs any more. Both can be started again after a failure.

Storing is meant for one writer at a time (a stream, or the daily run); readers need no lock.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickstack.schema import FACT
from clickstack.sources.files import delete, exists

FEW = 100_000  # cells or repeated hashes that are sent to every task; more are shuffled with the rows
CELL = ["property", "data_date", "search_type", "aggregation"]
PLACE = ["aggregation", "part", "load_id"]
FRESH = "fresh"

#: Stored rows: the fact columns (missing ones of older files read as null), their storage columns, and the folders.
ROWS = T.StructType([T.StructField(f.name, f.dataType, True) for f in FACT.fields if f.name != "aggregation"] + [
    T.StructField("property_key", T.StringType()), T.StructField("loaded_at", T.TimestampType()),
    T.StructField("aggregation", T.StringType()), T.StructField("part", T.StringType()), T.StructField("load_id", T.StringType())])
#: Columns of a row before it has a place.
NAMES = [f.name for f in ROWS.fields if f.name not in ("part", "load_id")]
LOADS = "property string, data_date date, search_type string, aggregation string, loaded_at timestamp, seq long, load_id string, part string"


def _age(loaded_at: str = "loaded_at") -> Column:
    """``loaded_at`` as a number that orders nulls first."""
    return F.coalesce(F.unix_micros(F.col(loaded_at)), F.lit(-(1 << 62)))


def _on(left: DataFrame, right: DataFrame, names: Iterable[str]) -> Column:
    return reduce(and_, [left[n] == right[n] for n in names])


class FactStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.rows_path, self.loads_path = f"{self.root}/rows", f"{self.root}/loads"

    # --- reading ----------------------------------------------------------------------------------
    def loads(self) -> DataFrame:
        """Every version of every cell."""
        if not exists(self.spark, self.loads_path):
            return self.spark.createDataFrame([], LOADS)
        return self.spark.read.schema(LOADS).parquet(self.loads_path)

    def versions(self) -> DataFrame:
        """``loads`` with ``current``: whether a version is its cell's newest."""
        newest = Window.partitionBy(*CELL).orderBy(_age().desc(), F.col("seq").desc(), F.col("load_id").desc())
        return self.loads().withColumn("current", F.row_number().over(newest) == 1)

    def newest(self) -> DataFrame:
        """The current version of each cell."""
        version = F.struct(_age().alias("age"), "seq", "load_id", "loaded_at", "part")
        return self.loads().groupBy(*CELL).agg(F.max(version).alias("v")).select(*CELL, "v.*")

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(ROWS).parquet(self.rows_path)

    def current(self, first=None, last=None) -> DataFrame:
        """The rows of the current versions, of the days from ``first`` to ``last`` if given: other months are not read, and
        files of fresh loads are sorted by day."""
        month = F.trunc("data_date", "month").alias("data_month")
        if not exists(self.spark, self.rows_path):
            return self.spark.createDataFrame([], ROWS).select(*NAMES, month)
        versions = self.versions()
        live = versions.groupBy(*PLACE).agg(F.bool_or("current").alias("live")).where("live").drop("live")
        replaced = versions.where(~F.col("current")).join(live, PLACE, "left_semi").select(*CELL, "load_id")
        rows = self._stored()
        for day, holds in ((first, lambda c, d: c >= d), (last, lambda c, d: c <= d)):
            if day is not None:
                rows = rows.where(holds(F.col("data_date"), F.lit(day)) & ((F.col("part") == FRESH) | holds(F.col("part"), F.lit(f"{day:%Y-%m}"))))
        rows = rows.join(live, PLACE, "left_semi")
        return rows.join(replaced, _on(rows, replaced, [*CELL, "load_id"]), "left_anti").select(*NAMES, month)

    # --- writing ----------------------------------------------------------------------------------
    def store(self, rows: DataFrame, cells: DataFrame | None = None) -> str | None:
        """Store ``rows`` (fact rows with ``loaded_at``) as versions of their cells; the load's id, None if nothing was new.

        Of a cell with several loads in ``rows`` the newest counts, older loads than the stored one are left out, a row
        that comes twice (by ``row_hash``) counts once. ``cells`` lists (cell, loaded_at) where the caller knows them
        without computing the rows. Equal calls, also after a failure in between, give the same table."""
        if "loaded_at" not in rows.columns:
            rows = rows.withColumn("loaded_at", F.lit(None).cast("timestamp"))
        told = (rows if cells is None else cells).select(*CELL, "loaded_at")
        told = told.groupBy(*CELL).agg(F.max(F.struct(_age().alias("age"), "loaded_at")).alias("n"), F.min(_age()).alias("oldest")).select(
            *CELL, F.col("n.age").alias("new_age"), F.col("n.loaded_at").alias("new_at"), (F.col("oldest") == F.col("n.age")).alias("one_load"))
        held = self.newest().withColumnsRenamed({c: f"held_{c}" for c in ("age", "seq", "load_id", "loaded_at", "part")})
        plan = told.join(held, CELL, "left").withColumn("due", F.col("held_age").isNull() | (F.col("new_age") >= F.col("held_age")))
        plan = self._held(plan.withColumn("goes_on", F.coalesce(F.col("held_age") == F.col("new_age"), F.lit(False))))
        held_back = [plan]
        try:
            whole_cell = reduce(and_, [F.col(c).isNotNull() for c in CELL], F.col("due") & F.col("one_load"))
            counts = plan.agg(F.count_if("due").alias("n"), F.count_if("goes_on").alias("again"), F.count_if(whole_cell).alias("whole"),
                              F.count(F.lit(1)).alias("told")).first()
            if not counts.n:
                return None
            plan = plan.where("due")
            load_id = uuid.uuid4().hex
            # A restated row of the same load wins over the stored one; of equal hashes in one batch, the latest.
            fresh = rows
            if counts.whole < counts.told:
                due = plan.select(*CELL, "new_age")
                fresh = rows.withColumn("_age", _age()).join(F.broadcast(due) if counts.n <= FEW else due, CELL).where("_age = new_age")
            fresh = self._once(fresh, held_back)
            fresh = fresh.select(*[F.col(c) if c in fresh.columns else F.lit(None).cast(ROWS[c].dataType).alias(c) for c in NAMES])
            whole = fresh
            if counts.again:
                own = plan.where("goes_on").select(*CELL, F.col("held_load_id").alias("load_id"), F.col("held_part").alias("part"))
                kept = self._stored().join(own, [*CELL, "part", "load_id"], "left_semi").select(*NAMES)
                whole = kept.join(fresh.select(*CELL, "row_hash"), [*CELL, "row_hash"], "left_anti").select(*NAMES).unionByName(fresh)
            self._append(whole.withColumn("part", F.lit(FRESH)), load_id, even=False)
            self._list(plan.select(*CELL, F.col("new_at").alias("loaded_at"), (F.coalesce("held_seq", F.lit(0)) + 1).alias("seq")), load_id, F.lit(FRESH))
            return load_id
        finally:
            for df in held_back:
                df.unpersist()

    def _held(self, few: DataFrame) -> DataFrame:
        """Few rows out of a shuffle, kept: Spark leaves as many partitions as the shuffle had, here each core gets one."""
        return few.coalesce(max(1, self.spark.sparkContext.defaultParallelism)).persist()

    def _once(self, rows: DataFrame, held_back: list[DataFrame]) -> DataFrame:
        """The latest of the rows that share cell and hash. Only 64 bits of these go through the shuffle, and the rows whose bits
        are found again; all rows only where more than a few are."""
        again = Window.partitionBy(*CELL, "row_hash").orderBy(*[F.col(c).desc() for c in ("collected_at", "impressions", "clicks", "position")])
        latest = lambda df: df.withColumn("_place", F.row_number().over(again)).where("_place = 1")
        rows = rows.withColumn("_bits", F.xxhash64(*CELL, "row_hash"))
        found = self._held(rows.groupBy("_bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_bits"))
        held_back.append(found)
        n = found.count()
        if not n:
            return rows
        if n > FEW:
            return latest(rows)
        found = F.broadcast(found)
        return rows.join(found, "_bits", "left_anti").unionByName(latest(rows.join(found, "_bits", "left_semi")).drop("_place"))

    def _append(self, rows: DataFrame, load_id: str, even: bool = True) -> None:
        """With ``even``, even tasks and a folder's rows together where they fit, without a sampling pass; else rows are
        written from where they are, a file for each task, which compaction puts together."""
        order = ["aggregation", "part", "data_date", "property", "query"]
        rows = rows.withColumn("load_id", F.lit(load_id))
        ((rows.hint("rebalance", *order[:2]) if even else rows).sortWithinPartitions(*order)
         .write.mode("append").option("compression", "zstd").partitionBy(*PLACE).parquet(self.rows_path))

    def _list(self, cells: DataFrame, load_id: str, part: Column) -> None:
        """List the load's cells: one file, so that it appears at once. There are fewer cells than rows that the load holds."""
        listed = cells.select(*CELL, "loaded_at", F.col("seq").cast("long").alias("seq"), F.lit(load_id).alias("load_id"), part.alias("part"))
        listed.coalesce(1).write.mode("append").parquet(self.loads_path)

    # --- keeping house ----------------------------------------------------------------------------
    def compact(self) -> int:
        """Move the (aggregation, month) parts that have fresh versions, replaced ones next to current ones, or several folders into one
        folder each; how many. Readers see the old folders until the new load is listed."""
        month = F.date_format("data_date", "yyyy-MM")
        versions = self.versions()
        live = versions.groupBy(*PLACE).agg(F.bool_or("current").alias("live"))
        told = versions.join(live, PLACE).withColumn("month", month)
        fresh = F.col("part") == FRESH
        parts = told.groupBy("aggregation", "month").agg(
            F.count_if(F.col("current") & fresh).alias("fresh"), F.count_if(~F.col("current") & F.col("live") & ~fresh).alias("gone"),
            F.count_distinct(F.when(F.col("current"), F.col("load_id"))).alias("folders"))
        due = parts.where("fresh > 0 or gone > 0 or folders > 1").select("aggregation", "month").persist()
        try:
            n = due.count()
            if n:
                load_id = uuid.uuid4().hex
                of_due = lambda df: df.withColumn("month", month).join(due, ["aggregation", "month"], "left_semi").drop("month")
                self._append(of_due(self.current()).select(*NAMES, month.alias("part")), load_id)
                self._list(of_due(self.newest()).withColumn("seq", F.col("seq") + 1), load_id, month)
            return n
        finally:
            due.unpersist()

    def vacuum(self) -> int:
        """Delete the folders without a current version, those of failed attempts too; how many. Not while a store is under way
        or readers are still busy with a plan made before the last compaction."""
        if not exists(self.spark, self.rows_path):
            return 0
        found = self._stored().select(*PLACE, F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]*$", 1).alias("folder")).distinct()
        live = self.versions().where("current").select(*PLACE).distinct()
        gone = found.join(live, PLACE, "left_anti").select("folder").distinct()
        n = 0
        for r in gone.toLocalIterator():  # folder names only, one partition of them at a time
            delete(self.spark, r.folder)
            n += 1
        return n
