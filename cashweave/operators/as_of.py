"""As-of lookup: for each request the latest row of a tenant's series on or before a day, without a range join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def as_of(
    requests: DataFrame, series: DataFrame, asked: str = "asked_date", day: str = "position_date",
    values: Sequence[str] = ("closing_balance",),
) -> DataFrame:
    """``requests`` with ``as_of_date``, the values of that day, and ``age_days``; NULL before the first day.

    Requests are first reduced to the distinct days that each tenant is asked about, so the window
    runs over at most two rows a calendar day however many requests there are. Both sides are
    stacked, sorted once by tenant and day, and the last known row is carried forward. A
    request without tenant or day finds nothing; of several rows of one day the highest counts.
    """
    row = F.struct(F.col(day).alias("as_of_date"), *values)
    known = series.where(F.col(day).isNotNull()).groupBy("tenant_id", F.col(day).alias("_day")).agg(F.max(row).alias("_row"))
    wanted = requests.where(F.col(asked).isNotNull() & F.col("tenant_id").isNotNull()).select("tenant_id", F.col(asked).alias("_day")).distinct()
    stacked = known.withColumn("_asked", F.lit(False)).unionByName(
        wanted.select("tenant_id", "_day", F.lit(None).cast(known.schema["_row"].dataType).alias("_row"), F.lit(True).alias("_asked"))
    )
    # a row of the same day comes before the request
    so_far = Window.partitionBy("tenant_id").orderBy("_day", "_asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = stacked.withColumn("_row", F.last("_row", ignorenulls=True).over(so_far)).where("_asked")
    found = found.select(F.col("tenant_id").alias("_tenant"), "_day", "_row")
    joined = requests.join(found, (F.col("tenant_id") == F.col("_tenant")) & (F.col(asked) == F.col("_day")), "left")
    return joined.select(*requests.columns, "_row.as_of_date", *[F.col(f"_row.{v}").alias(v) for v in values]).withColumn(
        "age_days", F.datediff(asked, "as_of_date")
    )
