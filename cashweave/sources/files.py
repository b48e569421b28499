"""CSV in, tables out: typed reads with lineage, overwriting writes with row counts."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cashweave.schemas import FORECAST, SOURCES

CORRUPT = "_corrupt_record"


def read_bronze(spark: SparkSession, path: str, table: str, mode: str = "PERMISSIVE") -> DataFrame:
    """Header CSV with the table's fixed schema plus ingestion time and file name.

    PERMISSIVE keeps the text of a malformed line in ``_corrupt_record`` so it
    can be quarantined; FAILFAST stops the job on the first one.
    """
    schema = StructType([*SOURCES[table].read_schema.fields, StructField(CORRUPT, StringType())])
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", mode)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
        .withColumn("_ingested_at", F.current_timestamp())
        .withColumn("_source_file", F.col("_metadata.file_name"))
    )


def use_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}{where}")
    spark.sql(f"USE {name}")


def write_table(
    df: DataFrame,
    name: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
) -> int:
    """Replace a table, schema included; the row count is observed during the write."""
    rows = Observation()
    writer = df.observe(rows, F.count(F.lit(1)).alias("rows")).write.format(fmt).mode("overwrite")
    if fmt == "delta":
        writer = writer.option("overwriteSchema", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)
    return rows.get["rows"]


def replace_partitions(df: DataFrame, name: str) -> None:
    """Replace only the partitions present in ``df`` of a partitioned table.

    The mode is a session setting for catalog tables (a writer option would be
    ignored and the whole table replaced), so the write has a session of its own.
    """
    spark = df.sparkSession
    whole = name if "." in name else f"{spark.catalog.currentDatabase()}.{name}"
    view = f"rows_{uuid.uuid4().hex}"
    df.select(*spark.table(name).columns).createGlobalTempView(view)
    try:
        other = spark.newSession()
        other.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        other.table(f"global_temp.{view}").write.insertInto(whole, overwrite=True)
    finally:
        spark.catalog.dropGlobalTempView(view)
    spark.catalog.refreshTable(name)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def for_tenant(df: DataFrame, tenant_id: str | None) -> DataFrame:
    """Optional tenant filter; a literal equality that reaches the scan."""
    return df if tenant_id is None else df.where(F.col("tenant_id") == F.lit(tenant_id))


def read_forecast(
    spark: SparkSession,
    table: str = "cash_forecast",
    tenant_id: str | None = None,
    csv_path: str | None = None,
) -> DataFrame:
    """A stored forecast in day order, from its table or from CSV.

    Dates and flags come typed either way. While no forecast was written the
    result is empty.
    """
    if csv_path is not None:
        stored = spark.read.schema(FORECAST).option("header", True).csv(csv_path)
    elif spark.catalog.tableExists(table):
        stored = spark.table(table)
    else:
        stored = spark.createDataFrame([], FORECAST)
    return for_tenant(stored, tenant_id).orderBy("tenant_id", "forecast_date")
