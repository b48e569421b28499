"""Shared helpers: input tables, staged intermediate results, vectorised text primitives.

Python functions here run inside Spark tasks on one Arrow batch at a time; work
arrays are sized by `CHUNK_BYTES` of text, or by one document if that is longer.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CHUNK_BYTES = 1 << 19
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


# --- staged results ---------------------------------------------------------


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; the warehouse where the cluster names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/") + "/staged"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several branches read, and read it back: lineage ends in the shared folder."""
    return restage(df, name)[0]


def restage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As `stage`, with the path for `discard`."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with released_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """What runs inside gives its shuffle files back at its end, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_RELEASE)
        else:
            spark.conf.set(_RELEASE, before)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged table that no later plan reads."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- Python in tasks --------------------------------------------------------

Batches = Iterator[pa.RecordBatch]


def in_tasks(df: DataFrame, function: Callable[[Batches], Batches], schema) -> DataFrame:
    """`mapInArrow` whose worker gives its memory back at the end of a partition.

    Python workers stay alive between tasks, several to an executor; what the last
    task left in their allocators would count against every later stage.
    """

    def run(batches: Batches) -> Batches:
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    _POWERS.update(up=np.ones(1, np.uint64), down=np.ones(1, np.uint64))
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def groups(batches: Batches, keys: list[str]) -> Iterator[pd.DataFrame]:
    """Consecutive rows with equal keys, of sorted rows."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        part = batch.to_pandas()
        if rest is not None and len(rest):
            part = pd.concat([rest, part], ignore_index=True)
        if not len(part):
            continue
        new = (part[keys] != part[keys].shift()).any(axis=1).to_numpy()
        starts = np.flatnonzero(new)
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield part.iloc[a:b]
        rest = part.iloc[starts[-1] :]
    if rest is not None and len(rest):
        yield rest


# --- text as arrays ---------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their offsets; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        width, kind = 8, np.int64
    else:
        width, kind = 4, np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind, len(column) + 1, column.offset * width).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data, offsets


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets from 0) of runs of texts of at most `limit` bytes, or of one text."""
    data, offsets = utf8(column)
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        high = min(high, rows)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of True, cut at the texts' boundaries."""
    n = len(inside)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def table(inside: str | None = None, outside: str | None = None) -> np.ndarray:
    """Byte classes as a table of 256 booleans, from the bytes inside or outside."""
    out = np.full(256, inside is None)
    out[np.frombuffer((inside or outside or "").encode("latin-1"), np.uint8)] = inside is not None
    return out


SPACE = " \t\n\x0b\x0c\r"
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32

# --- hashing ----------------------------------------------------------------

_RANDOM = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) <= n:
        size = 1 << max(16, n.bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of a polynomial hash; `segment_hash` takes differences of them."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_RANDOM[data] * up[: len(data)], out=out[1:])
    return out


def segment_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte segment, the same wherever it stands."""
    _, down = _powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def segment_hash_of(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """As `segment_hash`, of segments of 64-bit values."""
    up, _ = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return segment_hash(sums, starts, ends)


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words and, for each text, the index of its first word (one more at the end)."""
    data = LOWERED[data]
    starts, ends = spans(inside[data], offsets)
    return segment_hash(prefix_sums(data), starts, ends), np.searchsorted(starts, offsets)
