"""Hard-negative mining over an inverted multi-index, exact by certified bounds.

The vectors' two halves have a codebook each; a pair of codewords is a cell. For an anchor
q a half's bound is q.c + |q| r, with c the codeword and r the largest distance of any row
to it, so the sum of two half bounds is no less than any score in the cell. A heap visits
the cells by falling sums (multi-sequence order). A search asks for the k best rows of the
anchor's label, or of other labels, whose score lies in a window; it ends where the next
cell's bound is under the k-th score found, or under the window. What is left unvisited
cannot hold a row of the result, so the result equals brute force whatever the codebooks are.

The codebooks are fitted on a sample of at most `SAMPLE` rows; assignment, radii and index
cover all rows. A round visits the cells up to a number of rows; its scores raise the lower
ends of the windows, and the next round skips the cells under them. Neighbouring cells are
put together into bins of at most `PART_ROWS` rows, larger cells are cut into parts of that many;
an anchor goes once to each bin with a cell that it visits, with a mark for each such cell. The
anchors that ask for a bin are cut into parts of `PART_ANCHORS`, so a task holds one of each, also
if one vector is a third of all rows. Askings leave a task `ASKS` at a time, however many cells an
anchor visits.

Components become floor(256 x) and are held to +-2^25, so that scores fit a long. Defined
cases: rows with null label, null vector or a null or non-finite component take no part;
shorter vectors count as filled up with zeros; a null id is no anchor and comes last among
equal scores; repeated rows are rows of their own, each other's positives if the label is
the same; an empty table, or one without anchors, gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from cashweave.llm.common import Batches, discard, in_tasks, partitions, restage

SAMPLE, LLOYD = 8192, 8
ROWS_PER_CELL, MOST_CODEWORDS = 256, 64
PART_ROWS, PART_ANCHORS, CHUNK, ASKS = 4096, 16_384, 256, 2048
# A round ends before the cell that the rows of the cells before it reach this many.
ROUNDS = (0, 4096, 65_536, math.inf)
LARGEST = 1 << 25
FAR = 1 << 62
K, ANCHOR_STEP = 5, 100


def prepared(rows: DataFrame) -> DataFrame:
    """(_row, vec_id, label, v) of the rows that take part; staged, so that `_row` stays."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    held = F.transform(
        "embedding",
        lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x.cast("double") * 256))).cast("int"),
    )
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    kept = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~odd)
    kept = kept.select(F.monotonically_increasing_id().alias("_row"), F.col("vec_id").cast("long"), label.alias("label"), held.alias("v"))
    return restage(kept, "vectors")[0]


# --- codebooks --------------------------------------------------------------


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows, filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int32)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def packed(x: np.ndarray) -> pa.Array:
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * 4)
    data = np.ascontiguousarray(x, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def unpacked(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.int32).reshape(len(column), width)


def codebook(points: np.ndarray, size: int) -> np.ndarray:
    """Lloyd's k-means from evenly spread distinct rows; a codeword that loses all rows stays where it is."""
    points = points.astype(np.float64)
    distinct = np.unique(points, axis=0)
    distinct = distinct[np.random.default_rng(0).permutation(len(distinct))]
    book = distinct[:size].copy()
    for _ in range(LLOYD):
        near = nearest(points, book)[0]
        counts = np.bincount(near, minlength=len(book))
        sums = np.zeros_like(book)
        np.add.at(sums, near, points)
        book[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return book


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword of each row, and the exact distance to it."""
    code = (np.einsum("ij,ij->i", book, book) / 2 - points @ book.T).argmin(axis=1)
    return code, np.linalg.norm(points - book[code], axis=1)


@dataclass(frozen=True)
class Cells:
    """What the heap needs: books and radii by half, rows by cell. Its size is bounded by `MOST_CODEWORDS`."""

    width: int
    books: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray  # by cell: first half's codeword * codewords of the second half + second's


@dataclass(frozen=True)
class Bins:
    """Runs of cells, by their numbers."""

    of: np.ndarray  # by cell: its bin
    first: np.ndarray  # by bin: its first cell
    parts: np.ndarray  # by bin: its parts; several where one cell is a bin by itself

    def number(self, cell: Column) -> Column:
        return F.element_at(F.lit(self.of.tolist()), (cell + 1).cast("int")).cast("long")

    def part(self, row: Column, number: Column) -> Column:
        return F.pmod(F.xxhash64(row), F.element_at(F.lit(self.parts.tolist()), (number + 1).cast("int")).cast("long"))

    def marks(self, cells: list[int]) -> list[tuple[int, bytes]]:
        """(bin, a bit for each of its cells) of the bins that hold one of these cells."""
        cells = np.sort(np.array(cells, np.int64))
        numbers, starts = np.unique(self.of[cells], return_index=True)
        return [(int(b), np.packbits(np.bincount(own - self.first[b]) > 0).tobytes()) for b, own in zip(numbers, np.split(cells, starts[1:]))]


def bins(counts: np.ndarray) -> Bins:
    of, first, held = np.zeros(len(counts), np.int64), [], []
    for cell, n in enumerate(counts.tolist()):
        if not held or held[-1] + n > PART_ROWS:
            first.append(cell)
            held.append(0)
        held[-1] += n
        of[cell] = len(first) - 1
    return Bins(of, np.array(first, np.int64), np.maximum(1, -(-np.array(held, np.int64) // PART_ROWS)))


@dataclass(frozen=True)
class Index:
    rows: DataFrame  # _row, vec_id, label, v, _cell, _bin, _part
    cells: Cells
    bins: Bins


def build(vectors: DataFrame, seed: int = 0) -> Index | None:
    """The index of all rows; None for an empty table."""
    n, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if n == 0:
        return None
    width = max(width, 1)
    cut = width // 2
    # a hash decides on the sample, so its size is about SAMPLE and its rows do not depend on partitions
    drawn = vectors.where(F.pmod(F.xxhash64("vec_id", "v", F.lit(seed)), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, SAMPLE / n)) + 1))
    sample = drawn.select("v").limit(2 * SAMPLE).toArrow().column("v").combine_chunks()
    points = matrix(sample, width) if len(sample) else np.zeros((1, width), np.int32)
    size = max(1, min(MOST_CODEWORDS, math.isqrt(n // ROWS_PER_CELL)))
    books = codebook(points[:, :cut], size), codebook(points[:, cut:], size)
    others = len(books[1])

    def assign(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = matrix(batch.column("v"), width)
            first, r1 = nearest(x[:, :cut].astype(np.float64), books[0])
            second, r2 = nearest(x[:, cut:].astype(np.float64), books[1])
            own = [batch.column(c) for c in ("_row", "vec_id", "label")]
            yield pa.RecordBatch.from_arrays(
                [*own, packed(x), pa.array(first * others + second), pa.array(r1), pa.array(r2)],
                names=["_row", "vec_id", "label", "v", "_cell", "_r1", "_r2"],
            )

    schema = "_row long, vec_id long, label long, v binary, _cell long, _r1 double, _r2 double"
    placed, _ = restage(in_tasks(vectors, assign, schema), "cells")
    cells = placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_r1").alias("r1"), F.max("_r2").alias("r2")).collect()
    counts = np.zeros(len(books[0]) * others, np.int64)
    radii = np.zeros(len(books[0])), np.zeros(others)
    for c in cells:  # at most MOST_CODEWORDS squared
        counts[c["_cell"]] = c["n"]
        i, j = divmod(c["_cell"], others)
        radii[0][i], radii[1][j] = max(radii[0][i], c["r1"]), max(radii[1][j], c["r2"])
    runs = bins(counts)
    rows = placed.select("_row", "vec_id", "label", "v", "_cell").withColumn("_bin", runs.number(F.col("_cell")))
    return Index(rows.withColumn("_part", runs.part(F.col("_row"), F.col("_bin"))), Cells(width, books, radii, counts), runs)


# --- visits -----------------------------------------------------------------


def multi_sequence(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(sum, i, j) over all pairs by falling sum, from a heap that holds at most one pair a row."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    u, v = first[a].tolist(), second[b].tolist()
    heap = [(-(u[0] + v[0]), 0, 0)]
    while heap:
        least, i, j = heapq.heappop(heap)
        yield -least, int(a[i]), int(b[j])
        if j + 1 < len(v):
            heapq.heappush(heap, (-(u[i] + v[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(u):
            heapq.heappush(heap, (-(u[i + 1] + v[0]), i + 1, 0))


def half_bounds(q: np.ndarray, book: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The highest and the lowest score that a row of each codeword can add, with room for rounding."""
    q = q.astype(np.float64)
    middle, reach = book @ q, np.linalg.norm(q) * radius
    room = 1e-9 * (np.abs(book) @ np.abs(q) + reach) + 1e-6
    return middle + reach + room, middle - reach - room


def visited(cells: Cells, q: np.ndarray, low: int, high: int, start: float, end: float) -> Iterator[int]:
    """Cells of a round that can hold a score from low to high; the rows before a cell decide its round."""
    cut = cells.width // 2
    up1, down1 = half_bounds(q[:cut], cells.books[0], cells.radii[0])
    up2, down2 = half_bounds(q[cut:], cells.books[1], cells.radii[1])
    before = 0
    for most, i, j in multi_sequence(up1, up2):
        if most < low or before >= end:
            return
        cell = i * len(up2) + j
        if cells.counts[cell] and before >= start and down1[i] + down2[j] <= high:
            yield cell
        before += cells.counts[cell]


NOTHING = pa.table({"_anchor": pa.array([], pa.int64()), "_w": pa.array([], pa.int32()), "score": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "_row": pa.array([], pa.int64())})


def best_in_part(rows: pa.Table, asks: pa.Table, width: int, k: int, same: bool, first: int) -> pa.Table:
    """For each ask and window the k best of a part's rows in the cells asked for, of which `first` has the first mark; ties by id, then row."""
    ids = rows.column("vec_id").combine_chunks()
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    order = np.lexsort((rows.column("_row").to_numpy(), ids.fill_null(0).to_numpy(), ~known))
    rows = rows.take(pa.array(order))
    x = unpacked(rows.column("v"), width)
    label, row, cell = (rows.column(c).to_numpy() for c in ("label", "_row", "_cell"))
    asking, asking_label = asks.column("_anchor").to_numpy(), asks.column("label").to_numpy()
    lows, highs = asks.column("lows").to_pylist(), asks.column("highs").to_pylist()
    marks = asks.column("_marks").to_pylist()
    q = unpacked(asks.column("v"), width)
    # sums of whole numbers are exact in any order up to `room`
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * width
    kind, room = (np.float32, 1 << 24) if largest < 1 << 24 else (np.float64, 1 << 53) if largest < 1 << 53 else (np.int64, FAR)
    columns = x.T.astype(kind)
    found = []
    for at in range(0, len(asking), CHUNK):
        part = slice(at, at + CHUNK)
        scores = q[part].astype(kind) @ columns
        marked = np.zeros((len(scores), max(int(cell.max()) - first + 1, 8 * max(map(len, marks[part])))), bool)
        for r, m in enumerate(marks[part]):
            marked[r, : 8 * len(m)] = np.unpackbits(np.frombuffer(m, np.uint8))
        fits = marked[:, cell - first]
        fits &= (asking_label[part, None] == label) == same
        fits &= asking[part, None] != row
        for w in range(max(map(len, lows[part]))):
            low = np.array([max(x[w], -room) if len(x) > w else room for x in lows[part]], kind)[:, None]
            high = np.array([min(x[w], room) if len(x) > w else -room for x in highs[part]], kind)[:, None]
            inside = fits & (scores >= low) & (scores <= high)
            if scores.shape[1] > k and np.count_nonzero(inside) > 4 * k * len(scores):
                kept = np.where(inside, scores, -room)
                inside &= scores >= np.partition(kept, -k, axis=1)[:, -k, None]
            a, b = np.nonzero(inside)
            s = scores[a, b].astype(np.int64)
            order = np.lexsort((b, -s, a))
            a, b, s = a[order], b[order], s[order]
            rank = np.arange(len(a)) - np.searchsorted(a, a)
            a, b, s = a[rank < k], b[rank < k], s[rank < k]
            found.append((asking[part][a], np.full(len(a), w, np.int32), s, b))
    a, w, s, b = (np.concatenate(x) for x in zip(*found))
    taken = pa.array(b)
    return pa.table({"_anchor": a, "_w": w, "score": s, "vec_id": rows.column("vec_id").take(taken), "_row": row[b]})


def asked_for(batch: pa.RecordBatch, cells: Cells, runs: Bins, start: float, end: float) -> Iterator[pa.RecordBatch]:
    """A row for each anchor of a batch and bin that it visits in a round, `ASKS` rows or one anchor's at a time."""
    q = unpacked(batch.column("v"), cells.width)
    lows, highs = batch.column("lows").to_pylist(), batch.column("highs").to_pylist()
    held: list[tuple[int, int, bytes]] = []
    for r in range(len(q)):
        held += [(r, *m) for m in runs.marks(list(visited(cells, q[r], min(lows[r]), max(highs[r]), start, end)))]
        if held and (len(held) >= ASKS or r + 1 == len(q)):
            at, number, marks = zip(*held, strict=True)
            out = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(number, pa.int64()), pa.array(marks, pa.binary())], names=[*batch.schema.names, "_bin", "_marks"])
            held = []


def search(index: Index, anchors: DataFrame, windows: DataFrame, same: bool, k: int = K) -> DataFrame:
    """(_anchor, _w, score, vec_id, _row, _rank): the k best rows of each window, of the anchor's label or of others.

    `anchors` is (_anchor, label, v), `windows` (_anchor, _w, low, high) with _w from 0 for each anchor.
    """
    kept = "_anchor long, _w int, score long, vec_id long, _row long"
    order = Window.partitionBy("_anchor", "_w").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "_row")
    spark, cells, runs, best = anchors.sparkSession, index.cells, index.bins, None
    for start, end in zip(ROUNDS, ROUNDS[1:]):
        now = windows
        if best is not None:
            reached = best.where(F.col("_rank") == k).select("_anchor", "_w", F.col("score").alias("_kth"))
            now = windows.join(reached, ["_anchor", "_w"], "left").withColumn("low", F.greatest("low", "_kth"))
        wide = now.groupBy("_anchor").agg(F.sort_array(F.collect_list(F.struct("_w", "low", "high"))).alias("_s"))
        wide = wide.select("_anchor", F.col("_s.low").alias("lows"), F.col("_s.high").alias("highs"))

        def visits(batches: Batches) -> Batches:
            for batch in batches:
                yield from asked_for(batch, cells, runs, start, end)

        # dealt out by number: few bytes, but each row is a search
        wide = anchors.join(wide, "_anchor").select("_anchor", "label", "v", "lows", "highs").repartition(partitions(spark), "_anchor")
        schema = StructType([*wide.schema.fields, StructField("_bin", LongType()), StructField("_marks", BinaryType())])
        asks, path = restage(in_tasks(wide, visits, schema), "asks")
        asked = np.zeros(len(runs.first), np.int64)
        for r in asks.groupBy("_bin").count().collect():  # at most one row a bin
            asked[r["_bin"]] = -(-r["count"] // PART_ANCHORS)
        if not asked.any():  # a round's rows may be all before the next one starts
            discard(spark, path)
            continue
        at = (F.col("_bin") + 1).cast("int")
        groups = F.element_at(F.lit(asked.tolist()), at)
        parts = F.element_at(F.lit(runs.parts.tolist()), at)
        none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
        left = index.rows.where(groups > 0).withColumn("_group", F.explode(F.sequence(none, groups - one)))
        right = asks.withColumn("_group", F.pmod(F.xxhash64("_anchor"), groups)).withColumn("_part", F.explode(F.sequence(none, parts - one)))
        key = ["_bin", "_part", "_group"]
        width = cells.width

        def meet(rows: pa.Table, some: pa.Table) -> pa.Table:
            if not rows.num_rows or not some.num_rows:
                return NOTHING
            return best_in_part(rows, some, width, k, same, int(runs.first[some.column("_bin")[0].as_py()]))

        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, kept)
        before = None
        if best is not None:
            found, before = found.unionByName(best.drop("_rank")), best_path
        best, best_path = restage(found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k), "best")
        for done in (path, before):
            if done:
                discard(spark, done)
    if best is None:
        best = spark.createDataFrame([], kept + ", _rank int")
    return best


def hard_negatives(rows: DataFrame, step: int = ANCHOR_STEP, k: int = K) -> DataFrame:
    """(vec_id, embedding, label) to anchors, positives and their negatives in the window of 80 to 100 % of the positive's score."""
    spark = rows.sparkSession
    vectors = prepared(rows)
    index = build(vectors)
    if index is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    anchors, _ = restage(
        index.rows.where(F.col("vec_id") % step == 0).select(F.col("_row").alias("_anchor"), F.col("vec_id").alias("anchor_id"), "label", "v"),
        "anchors",
    )
    whole = anchors.select("_anchor", F.lit(0).alias("_w"), F.lit(-FAR).alias("low"), F.lit(FAR).alias("high"))
    positives = search(index, anchors.drop("anchor_id"), whole, same=True, k=k).select(
        "_anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # equal scores of positives share a window; under 0 none is open
    scores = positives.where("positive_score >= 0").select("_anchor", "positive_score").distinct()
    number = F.row_number().over(Window.partitionBy("_anchor").orderBy("positive_score")) - 1
    windows, _ = restage(
        scores.select("_anchor", number.alias("_w"), F.expr("(80 * positive_score + 99) div 100").alias("low"), F.col("positive_score").alias("high")),
        "windows",
    )
    found = search(index, anchors.drop("anchor_id"), windows, same=False, k=k)
    found = found.join(windows.select("_anchor", "_w", F.col("high").alias("positive_score")), ["_anchor", "_w"])
    return (
        positives.join(found.withColumnRenamed("vec_id", "negative_id"), ["_anchor", "positive_score"])
        .join(anchors.select("_anchor", "anchor_id"), "_anchor")
        .select("anchor_id", "positive_id", F.col("_rank").alias("rank"), "negative_id", "positive_score", F.col("score").alias("negative_score"))
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


OP11_SQL = """
WITH rows AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same,
         list_dot_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.r <> b.r
), positives AS (
  SELECT a, anchor_id, r AS p, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST, r) <= 5
)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY p.a, p ORDER BY score DESC, vec_id NULLS LAST, r)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s USING (a, anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
