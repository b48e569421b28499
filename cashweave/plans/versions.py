"""Published versions: a refresh becomes visible as a whole, or not at all.

A refresh writes its tables under names of its own (``gold_x__v7`` in the database
``<database>__versions``), where no reader looks. The catalogue view ``published`` of that
database lists which pieces make up each table; replacing this one view is the switch.
The views of the database itself, ``<database>.gold_x``, follow it: each is replaced as a
whole, and ``sync`` finishes what a lost driver left. Readers that need several tables of the same
refresh take a ``Snapshot``.

A refresh of one tenant writes that tenant's rows only. Its piece covers the tenant in the
older ones, which stay as they are; after ``FOLD_AFTER`` covered tenants the next piece is
a whole table again. Columns are joined by name, so a new column is null in older pieces.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from cashweave.sources.files import write_table

FOLD_AFTER = 32
MANIFEST = "published"
_NUMBER = re.compile(r"__v(\d+)$")


class StaleVersion(RuntimeError):
    """Another refresh was published since this one began."""


@dataclass(frozen=True)
class Piece:
    """One written table: all tenants (None), or one tenant's rows that cover those of older pieces."""

    source: str
    tenant_id: str | None = None


Pieces = dict[str, tuple[Piece, ...]]


def _text(value: str | None) -> str:
    if value is None:
        return "CAST(NULL AS STRING)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def compose(spark: SparkSession, pieces: Sequence[Piece]) -> DataFrame:
    """The rows of a table; a tenant's rows come from its latest piece. The filters reach the partitions."""
    out = None
    for k, piece in enumerate(pieces):
        rows = spark.table(piece.source)
        for later in pieces[k + 1 :]:
            rows = rows.where(~F.col("tenant_id").eqNullSafe(F.lit(later.tenant_id)))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def covered(pieces: Sequence[Piece], new: Piece) -> tuple[Piece, ...]:
    """Pieces with a new one on top; what it covers entirely goes."""
    if new.tenant_id is None:
        return (new,)
    return (*[p for p in pieces if p.tenant_id != new.tenant_id], new)


class Snapshot:
    """The tables of one published version, whatever is published later."""

    def __init__(self, spark: SparkSession, pieces: Pieces, number: int):
        self.spark, self.pieces, self.number = spark, pieces, number

    def __call__(self, name: str) -> DataFrame:
        return compose(self.spark, self.pieces[name])

    def __contains__(self, name: str) -> bool:
        return name in self.pieces


@dataclass
class Draft:
    """A refresh in the making: reads its own tables where written, else the version it began from."""

    versions: Versions
    base: Snapshot
    number: int
    tenant_id: str | None = None
    pieces: Pieces = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.versions.spark

    def __call__(self, name: str) -> DataFrame:
        return compose(self.spark, self.pieces[name] if name in self.pieces else self.base.pieces[name])

    def write(self, name: str, df: DataFrame, fmt: str = "parquet", partition_by: Sequence[str] = (), whole: bool = False) -> int:
        """Write a table of this version, unseen by readers; returns the rows of ``df``.

        In a refresh of one tenant ``df`` holds that tenant's rows, unless it is the ``whole`` table.
        """
        target = f"{self.versions.store}.{name}__v{self.number}"
        below = self.base.pieces.get(name, ())
        tenant_id = None if whole or not below else self.tenant_id
        pieces = covered(below, Piece(target, tenant_id))
        if sum(p.tenant_id is not None for p in pieces) <= FOLD_AFTER:
            rows = write_table(df, target, fmt, partition_by)
        else:
            seen = Observation()
            others = compose(self.spark, pieces[:-1]).where(~F.col("tenant_id").eqNullSafe(F.lit(tenant_id)))
            own = df.observe(seen, F.count(F.lit(1)).alias("rows"))
            write_table(others.unionByName(own, allowMissingColumns=True), target, fmt, partition_by)
            pieces, rows = (Piece(target),), seen.get["rows"]
        self.pieces[name] = pieces
        return rows

    def publish(self) -> Snapshot:
        return self.versions._publish(self)


class Versions:
    def __init__(self, spark: SparkSession, database: str, location: str | None = None):
        self.spark, self.database, self.store = spark, database, f"{database}__versions"
        for name, folder in ((database, location), (self.store, f"{location}/versions" if location else None)):
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}" + (f" LOCATION '{folder}'" if folder else ""))

    def _stored(self) -> list[str]:
        return [r["tableName"] for r in self.spark.sql(f"SHOW TABLES IN {self.store}").collect() if not r["isTemporary"]]

    def published(self) -> Snapshot:
        """What readers see now; nothing before the first refresh. The manifest has a row for each piece of a table."""
        pieces: dict[str, list[Piece]] = {}
        number = 0
        if MANIFEST in self._stored():
            for r in sorted(self.spark.table(f"{self.store}.{MANIFEST}").collect(), key=lambda r: r["place"]):
                number = r["version"]
                pieces.setdefault(r["table_name"], []).append(Piece(r["source"], r["tenant_id"]))
        return Snapshot(self.spark, {k: tuple(v) for k, v in pieces.items()}, number)

    def begin(self, tenant_id: str | None = None) -> Draft:
        """A new draft on the published version. Its number is taken by creating a view, which only one driver can."""
        base = self.published()
        taken = [int(m[1]) for m in map(_NUMBER.search, self._stored()) if m]
        number = max([base.number, *taken]) + 1
        self.spark.sql(f"CREATE VIEW {self.store}.started__v{number} AS SELECT current_timestamp() AS at")
        return Draft(self, base, number, tenant_id)

    def _publish(self, draft: Draft) -> Snapshot:
        now = self.published()
        if now.number != draft.base.number:
            raise StaleVersion(f"version {now.number} was published since version {draft.number} began from {draft.base.number}")
        pieces = {**draft.base.pieces, **draft.pieces}
        values = ", ".join(
            f"({draft.number}, {_text(name)}, {place}, {_text(p.source)}, {_text(p.tenant_id)})"
            for name, own in pieces.items() for place, p in enumerate(own)
        )
        self.spark.sql(
            f"CREATE OR REPLACE VIEW {self.store}.{MANIFEST} AS "
            f"SELECT * FROM VALUES {values} AS t(version, table_name, place, source, tenant_id)"
        )
        self.sync()
        self.vacuum(keep=now)
        return Snapshot(self.spark, pieces, draft.number)

    def sync(self) -> None:
        """Point the database's views at the published version; run again, it changes nothing."""
        for name, pieces in self.published().pieces.items():
            columns = compose(self.spark, pieces).columns
            parts = []
            for k, piece in enumerate(pieces):
                has = set(self.spark.table(piece.source).columns)
                shown = ", ".join(f"`{c}`" if c in has else f"NULL AS `{c}`" for c in columns)
                later = " AND ".join(f"NOT (tenant_id <=> {_text(p.tenant_id)})" for p in pieces[k + 1 :])
                parts.append(f"SELECT {shown} FROM {piece.source}" + (f" WHERE {later}" if later else ""))
            self.spark.sql(f"CREATE OR REPLACE VIEW {self.database}.{name} AS " + " UNION ALL ".join(parts))

    def vacuum(self, keep: Snapshot | None = None) -> list[str]:
        """Drop what no version needs: tables older than the published version that neither it nor ``keep`` reads."""
        now = self.published()
        needed = {p.source.rpartition(".")[2] for s in (now, keep) if s is not None for own in s.pieces.values() for p in own}
        gone = []
        for name in self._stored():
            found = _NUMBER.search(name)
            if found and name not in needed and int(found[1]) <= now.number:
                kind = "VIEW" if name.startswith("started__v") else "TABLE"
                self.spark.sql(f"DROP {kind} IF EXISTS {self.store}.{name}")
                gone.append(name)
        return gone
