"""Incremental load: new files of a folder into a Silver table, in any order, any number of times.

A file stream reads what arrived since its checkpoint. Rows seen before are dropped by the
stream's state, so a file that is delivered twice costs a look-up and rewrites nothing. What
is new is merged with the stored rows of the same partitions, and only of those: a
partition is a tenant and a bucket of the key's hash, so all rows of a key meet in one and a
large tenant is many. The merge is the deduplication of the full refresh (the lowest row of
each key); it is associative and idempotent, so the table equals a full refresh over all
files delivered so far.

A merged partition is written to a folder of its own, then the catalogue's partition is
pointed at it: readers see a partition before or after, never half of it. The stream
commits a batch when all its partitions are switched; if the driver is lost before, the
batch runs again from the same files and ends in the same rows. Folders that partitions
have left stay for running readers.

For a large key space set ``spark.sql.streaming.stateStore.providerClass`` to the RocksDB
provider: the state is then on disk, 8 bytes of digest and the key for each row seen.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cashweave.operators.clean import dedupe, mark_rejects, rejects, to_silver
from cashweave.schemas import SOURCES
from cashweave.session import checkpointed
from cashweave.sources.files import CORRUPT

BUCKET = "key_bucket"


@dataclass(frozen=True)
class Feed:
    """A folder of CSV files of one source table, and where its rows go."""

    table: str  # name in SOURCES
    folder: str
    target: str  # Silver table
    location: str  # of the target's partitions and of the rejects, in a shared store
    checkpoint: str
    buckets: int = 32  # of each tenant; fixed once the target exists
    files_per_batch: int | None = None


def key_bucket(table: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*SOURCES[table].key), F.lit(buckets)).cast("int")


def arriving(spark: SparkSession, feed: Feed) -> DataFrame:
    """Rows of the folder's files as a stream, with lineage and reject reason; each distinct row once."""
    source = SOURCES[feed.table]
    reader = (
        spark.readStream.schema(StructType([*source.read_schema.fields, StructField(CORRUPT, StringType())]))
        .option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
    )
    if feed.files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", feed.files_per_batch)
    rows = reader.csv(feed.folder).withColumns({"_ingested_at": F.current_timestamp(), "_source_file": F.col("_metadata.file_name")})
    # a hash skips nulls, so a value's place is hashed with it
    told = [F.struct(F.lit(i), F.col(c).cast("string")) for i, c in enumerate([*source.columns, CORRUPT])]
    seen = rows.withColumn("_digest", F.xxhash64(*told)).dropDuplicates([*source.key, "_digest"])
    return mark_rejects(seen.drop("_digest"), feed.table)


def create_target(spark: SparkSession, feed: Feed) -> None:
    """The empty target, unless it exists."""
    columns = ", ".join(f"`{n}` {'DATE' if n in SOURCES[feed.table].dates else t.simpleString()}" for n, t in SOURCES[feed.table].columns.items())
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {feed.target} ({columns}, {BUCKET} INT) USING parquet "
        f"PARTITIONED BY (tenant_id, {BUCKET}) LOCATION '{feed.location}/table'"
    )


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def merge(spark: SparkSession, feed: Feed, new: DataFrame) -> int:
    """Merge Silver rows into the partitions that they touch; returns how many partitions were switched.

    The list of touched partitions is catalogue data: at most tenants x buckets.
    """
    source = SOURCES[feed.table]
    new = checkpointed(new.withColumn(BUCKET, key_bucket(feed.table, feed.buckets)))
    parts = new.select("tenant_id", BUCKET).distinct()
    touched = parts.collect()
    if not touched:
        return 0
    stored = spark.table(feed.target).join(parts, ["tenant_id", BUCKET], "left_semi")
    merged = dedupe(stored.select(*new.columns).unionByName(new), [*source.key, BUCKET])
    folder = f"{feed.location}/merged-{uuid.uuid4().hex}"
    place = F.concat(F.hex("tenant_id"), F.lit("-"), F.col(BUCKET).cast("string"))
    merged.withColumn("place", place).drop("tenant_id", BUCKET).repartition("place").write.partitionBy("place").parquet(folder)
    for tenant, bucket in touched:
        spec = f"PARTITION (tenant_id = {_text(tenant)}, {BUCKET} = {bucket})"
        at = f"LOCATION {_text(f'{folder}/place={tenant.encode().hex().upper()}-{bucket}')}"
        spark.sql(f"ALTER TABLE {feed.target} ADD IF NOT EXISTS {spec} {at}")
        spark.sql(f"ALTER TABLE {feed.target} {spec} SET {at}")
    spark.catalog.refreshTable(feed.target)
    return len(touched)


def load_new_files(spark: SparkSession, feed: Feed) -> int:
    """Take in all files that arrived since the last call; returns how many partitions were rewritten."""
    create_target(spark, feed)
    switched = []

    def take(batch: DataFrame, number: int) -> None:
        rows = checkpointed(batch)  # the batch's state is computed once
        # a batch that runs again replaces its rejects
        rejects(rows, feed.table).write.mode("overwrite").parquet(f"{feed.location}/rejected/batch={number}")
        switched.append(merge(rows.sparkSession, feed, to_silver(rows, feed.table)))

    query = (
        arriving(spark, feed).writeStream.foreachBatch(take)
        .option("checkpointLocation", feed.checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    spark.catalog.refreshTable(feed.target)
    return sum(switched)


def rejected(spark: SparkSession, feed: Feed) -> DataFrame:
    """Rows of all batches that did not reach the target, with the reason."""
    return spark.read.parquet(f"{feed.location}/rejected").drop("batch")
