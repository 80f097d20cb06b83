"""Catalog tables and views that outlive a session (A12, A14, A3, L6): in the session's catalog, so with a metastore other
sessions and SQL tools see them too.

* ``ensure_table`` creates a table with declared partitions, or adds the columns that an older one lacks; files written
  before read as null there.
* ``register_files`` lists an already written partitioned folder as a table, nothing is copied.
* ``save_group_view`` keeps the union of a group's members as a view, without a view while no member has rows.
* ``discover_native`` stores the rows of newly found export sites and refreshes the view of all properties.

All tables are external: dropping one leaves its files. Views name their columns when they are made, so refresh them after
a table gained one. Storing is meant for one writer at a time, as in the fact store.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NATIVE_SITES = "native_sites"
SITE_FIELDS = T.StructType([T.StructField("site_url", T.StringType()), T.StructField("found_in", T.StringType())])


def quoted(name: str) -> str:
    """A table name, or database and table, in back quotes."""
    return ".".join(f"`{part.replace('`', '``')}`" for part in name.split("."))


def text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ensure_database(spark: SparkSession, name: str, location: str) -> str:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(name)} LOCATION {text(location)}")
    return name


def ensure_table(spark: SparkSession, name: str, schema: T.StructType, location: str, partitions: Sequence[str] = ()) -> bool:
    """Create ``name``, or add what an existing table lacks of ``schema`` as nullable columns; True if it was created.

    Columns that only the table has stay. A column with another type than the table's is an error: nothing is changed then."""
    if not spark.catalog.tableExists(name):
        fields = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
        parted = f"PARTITIONED BY ({', '.join(map(quoted, partitions))})" if partitions else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {quoted(name)} ({fields}) USING parquet {parted} LOCATION {text(location)}")
        return True
    held = {f.name.lower(): f.dataType for f in spark.table(name).schema.fields}
    other = [f.name for f in schema.fields if held.get(f.name.lower(), f.dataType) != f.dataType]
    if other:
        raise ValueError(f"{name} holds other types for {', '.join(other)}")
    missing = [f for f in schema.fields if f.name.lower() not in held]
    if missing:
        added = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in missing)
        spark.sql(f"ALTER TABLE {quoted(name)} ADD COLUMNS ({added})")
    return False


def register_files(spark: SparkSession, name: str, path: str, partitions: Sequence[str] = ()) -> str:
    """The partitioned Parquet folder ``path`` as table ``name``; partitions written since the last call are found."""
    ensure_table(spark, name, spark.read.parquet(path).schema, path, partitions)
    if partitions:
        spark.catalog.recoverPartitions(name)
    return name


def append_rows(spark: SparkSession, name: str, rows: DataFrame) -> None:
    """Append ``rows`` by column name; columns that they lack become null, others than the table's are an error."""
    schema = spark.table(name).schema
    unknown = set(rows.columns) - set(schema.names)
    if unknown:
        raise ValueError(f"{name} has no columns {', '.join(sorted(unknown))}")
    have = set(rows.columns)
    rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]) \
        .write.insertInto(name)


def group_view_name(group_id: str) -> str:
    return "group_" + re.sub(r"[^a-zA-Z0-9]", "_", group_id)


def save_group_view(spark: SparkSession, database: str, group_id: str, fact_table: str, members_table: str) -> str | None:
    """The view of a group's rows; None, and no view, while no member has rows. Members are looked up when the view is
    read, so a changed membership needs no new view."""
    view = f"{database}.{group_view_name(group_id)}"
    rows = (f"SELECT f.* FROM {quoted(fact_table)} f LEFT SEMI JOIN {quoted(members_table)} m "
            f"ON f.property = m.property AND m.group_id = {text(group_id)}")
    if spark.sql(rows).isEmpty():
        spark.sql(f"DROP VIEW IF EXISTS {quoted(view)}")
        return None
    spark.sql(f"CREATE OR REPLACE VIEW {quoted(view)} AS {rows}")
    return view


def refresh_wildcard_view(spark: SparkSession, database: str, view: str, api_table: str, native_table: str) -> str:
    """A3: the rows of all properties with ``source_table``: of native sites the export's rows, of others the API's.
    A column that only one of both tables has is null in the rows of the other."""
    api, native = ({f.name: f.dataType for f in spark.table(t).schema.fields} for t in (api_table, native_table))
    columns = api | {n: t for n, t in native.items() if n != "found_in"}

    def listed(alias: str, own: dict) -> str:
        return ", ".join(f"{alias}.{quoted(n)}" if n in own else f"CAST(NULL AS {t.simpleString()}) AS {quoted(n)}"
                         for n, t in columns.items())

    sites = quoted(f"{database}.{NATIVE_SITES}")
    name = f"{database}.{view}"
    spark.sql(
        f"CREATE OR REPLACE VIEW {quoted(name)} AS "
        f"SELECT {listed('a', api)}, a.property_key AS source_table FROM {quoted(api_table)} a "
        f"LEFT ANTI JOIN {sites} s ON a.property = s.site_url UNION ALL "
        f"SELECT {listed('n', native)}, n.property_key AS source_table FROM {quoted(native_table)} n "
        f"LEFT SEMI JOIN {sites} s ON n.property = s.site_url AND n.found_in = s.found_in")
    return name


def discover_native(spark: SparkSession, database: str, sites: DataFrame, adapted: Callable[[DataFrame], DataFrame], root: str,
                    api_table: str, native_name: str = "native_by_property", view: str = "all_by_property") -> int:
    """Store the export rows of the sites (``site_url``) that were not known yet, then list the sites and refresh the
    wildcard view; how many sites were new. ``adapted`` maps a table of sites to their rows in the fact shape.

    Rows count only once their discovery is listed, so a discovery that failed half way leaves nothing that readers see and
    can be run again; one that finds no new site only refreshes the view. Null sites are left out."""
    known = f"{database}.{NATIVE_SITES}"
    ensure_table(spark, known, SITE_FIELDS, f"{root}/{NATIVE_SITES}")
    found_in = uuid.uuid4().hex
    new = sites.select("site_url").where(F.col("site_url").isNotNull()).distinct().join(spark.table(known), "site_url", "left_anti")
    # One file of the new sites: the rows and the list are made from the same ones.
    path = f"{root}/found/{found_in}"
    new.withColumn("found_in", F.lit(found_in)).write.parquet(path)
    new = spark.read.schema(SITE_FIELDS).parquet(path)
    count = new.count()
    rows = adapted(new.select("site_url")).withColumn("found_in", F.lit(found_in))
    native = f"{database}.{native_name}"
    ensure_table(spark, native, rows.schema, f"{root}/{native_name}", ["data_month"])
    if count:
        append_rows(spark, native, rows)
        append_rows(spark, known, new)
    refresh_wildcard_view(spark, database, view, api_table, native)
    return count
