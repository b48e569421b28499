"""Bronze to Silver: required keys, one row per natural key, real dates, quarantine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DecimalType

from cashweave.schemas import SOURCES
from cashweave.sources.files import CORRUPT

REASON = "reject_reason"


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """Keep, per key, the row whose other columns sort lowest (nulls first).

    ``min`` of a struct is a partial aggregate: copies collapse on the map side,
    so a key that holds a large share of the rows never lands whole in one task.
    """
    rest = list(order) if order is not None else [c for c in df.columns if c not in keys]
    unlisted = [c for c in df.columns if c not in keys and c not in rest]
    kept = df.groupBy(*keys).agg(F.min(F.struct(*rest, *unlisted)).alias("_row"))
    return kept.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def _reject_reason(df: DataFrame, table: str) -> Column:
    source = SOURCES[table]
    malformed = F.col(CORRUPT).isNotNull() if CORRUPT in df.columns else F.lit(False)
    missing = F.lit(False)
    for name in source.required:
        missing = missing | F.col(name).isNull()
    bad_date = F.lit(False)
    for name in source.required_dates:
        bad_date = bad_date | F.try_to_date(F.col(name)).isNull()
    inexact = F.lit(False)
    for name, kind in source.columns.items():
        if isinstance(kind, DecimalType):
            inexact = inexact | ~F.col(name).eqNullSafe(F.col(name).try_cast(kind))
    return (
        F.when(malformed, "malformed record")
        .when(missing, "missing key")
        .when(bad_date, "bad date")
        .when(inexact, "inexact amount")
    )


def mark_rejects(bronze: DataFrame, table: str) -> DataFrame:
    """Adds ``reject_reason``, NULL for good rows.

    Stored with Bronze, it lets both the Silver build and the reject table
    filter on one column the file format keeps null counts for.
    """
    if REASON in bronze.columns:
        return bronze
    return bronze.withColumn(REASON, _reject_reason(bronze, table))


def rejects(bronze: DataFrame, table: str) -> DataFrame:
    """Rows that do not reach Silver, with the reason; nothing disappears silently."""
    return mark_rejects(bronze, table).where(F.col(REASON).isNotNull())


def unreadable_dates(bronze: DataFrame, table: str) -> DataFrame:
    """Accepted rows whose optional date is not one: the row stays, its date is NULL, the text is kept here."""
    source = SOURCES[table]
    accepted = mark_rejects(bronze, table).where(F.col(REASON).isNull())
    found = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value"),
                 (F.col(c).isNotNull() & F.try_to_date(F.col(c)).isNull()).alias("bad"))
        for c in source.optional_dates
    ])
    return accepted.select(*source.key, F.inline(found)).where("bad").drop("bad")


def to_silver(bronze: DataFrame, table: str) -> DataFrame:
    """Typed, deduplicated table with exactly the source columns."""
    source = SOURCES[table]
    accepted = mark_rejects(bronze, table).where(F.col(REASON).isNull())
    typed = accepted.select(
        *[
            F.try_to_date(F.col(c)).alias(c) if c in source.dates
            else F.col(c).cast(kind).alias(c) if isinstance(kind, DecimalType)
            else F.col(c)
            for c, kind in source.columns.items()
        ]
    )
    return dedupe(typed, source.key)
