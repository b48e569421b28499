"""Document fingerprints by a randomised edit embedding, with bit-sampled banding and verification.

A walk over the characters of a text emits one character in each step; a random bit, the
same for all texts and fixed by the step and the character, says whether it moves on. After
an insertion or deletion two walks soon run together again, so that a small edit distance
becomes a small Hamming distance between what the walks emit. The fingerprint
samples that: level L keeps the steps whose hash ends in L zero bits, of which 256 to 512 are
expected in a text; a higher level's steps are among a lower one's, so fingerprints of
texts of different lengths are compared on the steps that both have. A sampled character
is written as four bits of its hash, one hex digit.

Whole texts are walked: many side by side in numpy, the longest ones' ends in a plain loop.

Defined cases: a null text is empty; an empty text's fingerprint has no digits and is equal
only to another such one. Rows without id come last in the order of ids; rows of one id are
ordered by text. A single row is its own next document. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cashweave.llm.common import discard, documents, groups, in_tasks, mix, partitions, restage, stage
from cashweave.llm.components import components
from cashweave.llm.tokens import code_points

SAMPLES, PERIOD, CLASSES, FEW = 256, 4096, 256, 64
CHUNK_POINTS = 1 << 21
BAND_DIGITS, LIKE, BUCKET = 8, 0.75, 2048
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


@lru_cache(1)
def _moves() -> np.ndarray:
    """For a character class and a step: the number of steps until the walk has moved on."""
    bits = np.random.default_rng(5).random((CLASSES, PERIOD)) < 0.5
    out = np.empty((CLASSES, PERIOD), np.int32)
    wait = np.argmax(bits, axis=1).astype(np.int32) + 1  # beyond the end the steps begin again
    for step in range(PERIOD - 1, -1, -1):
        wait = np.where(bits[:, step], 1, wait + 1)
        out[:, step] = wait
    return out.reshape(-1)


def _class_rows(points: np.ndarray) -> np.ndarray:
    return ((mix(points.astype(np.uint64)) & np.uint64(CLASSES - 1)) * np.uint64(PERIOD)).astype(np.int32)


def walk(rows: np.ndarray, starts: np.ndarray, lengths: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the step at which each character is first emitted, the step after the last) of texts rows[start:start+length]."""
    moves, out = _moves(), np.zeros(len(rows), np.int32)
    order = np.argsort(-lengths, kind="stable")
    at, size, step = starts[order], lengths[order], begin[order].astype(np.int32)
    many = int(size[FEW]) if len(size) > FEW else 0
    active = np.searchsorted(-size, -np.arange(many), side="left")
    for i in range(many):
        n = active[i]
        index = at[:n] + i
        now = step[:n]
        out[index] = now
        now += moves[rows[index] + (now & (PERIOD - 1))]
    if len(size):
        table = None
        for lane in np.flatnonzero(size > many):
            table = moves.tolist() if table is None and size[lane] - many > 2000 else table
            look = table if table is not None else moves
            now, mask, first = int(step[lane]), PERIOD - 1, int(at[lane]) + many
            steps = []
            for row in rows[first : at[lane] + size[lane]].tolist():
                steps.append(now)
                now += look[row + (now & mask)]
            out[first : at[lane] + size[lane]] = steps
            step[lane] = now
    end = np.empty(len(step), np.int64)
    end[order] = step
    return out, end


@lru_cache(64)
def _steps(level: int, bits: int) -> np.ndarray:
    """The sampled steps of a level below 2**bits."""
    step = np.arange(1 << bits, dtype=np.uint64)
    return step[(mix(step + np.uint64(0x1234567)) & np.uint64((1 << level) - 1)) == 0].astype(np.int64)


def level_of(characters: int) -> int:
    return max(0, int(np.log2(max(1, 2 * characters / SAMPLES))))


def written(points: np.ndarray, first: np.ndarray, end: int) -> str:
    """The fingerprint of a text from its characters, the steps at which they come first, and the end of the walk."""
    level = level_of(len(points))
    steps = _steps(level, max(10, int(end).bit_length()))
    steps = steps[: np.searchsorted(steps, end)]
    chosen = points[np.searchsorted(first, steps, side="right") - 1] if len(points) else points
    digits = _HEX[(mix(chosen.astype(np.uint64) ^ np.uint64(0xABCDEF)) >> np.uint64(60)).astype(np.int64)]
    return f"{level:02x}" + digits.tobytes().decode()


def likeness(a: str, b: str) -> float:
    """Share of equal digits on the steps that both have, less what chance makes equal; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    level = max(int(a[:2], 16), int(b[:2], 16))
    x, y = _at_level(a, level), _at_level(b, level)
    n = min(len(x), len(y))
    if not n:
        return 0.0
    share = np.count_nonzero(x[:n] == y[:n]) / max(len(x), len(y))
    return float(max(0.0, (share - 1 / 16) / (15 / 16)))


def _at_level(a: str, level: int) -> np.ndarray:
    own, digits = int(a[:2], 16), np.frombuffer(a[2:].encode(), np.uint8)
    if own == level:
        return digits
    bits = 10
    while len(_steps(own, bits)) < len(digits):
        bits += 1
    return digits[(mix(_steps(own, bits)[: len(digits)].astype(np.uint64) + np.uint64(0x1234567)) & np.uint64((1 << level) - 1)) == 0]


def fingerprints(texts: list[str]) -> list[str]:
    points, bounds = code_points(texts)
    first, end = walk(_class_rows(points), bounds[:-1], np.diff(bounds), np.zeros(len(texts), np.int64))
    return [written(points[a:b], first[a:b], e) for a, b, e in zip(bounds[:-1], bounds[1:], end, strict=True)]


def with_edited(texts: list[str]) -> list[tuple]:
    """For each text but the last: characters, digest of the edited text, both fingerprints, likeness to edited and next."""
    points, bounds = code_points(texts)
    rows, n = _class_rows(points), len(texts) - 1
    starts, sizes = bounds[:-1], np.diff(bounds)
    first, end = walk(rows, starts, sizes, np.zeros(len(texts), np.int64))
    half = sizes[:n] // 2
    kept, taken = sizes[:n] - half, np.minimum(half, sizes[1:])
    # the walk over the edited text goes on where the kept half of the text ends
    at = starts[:n] + kept
    begin = np.where(half > 0, first[np.minimum(at, max(0, len(first) - 1))] if len(first) else 0, end[:n])
    other, other_end = walk(rows, starts[1:], taken, begin)
    own = [written(points[a : a + s], first[a : a + s], e) for a, s, e in zip(starts, sizes, end, strict=True)]
    out = []
    for i in range(n):
        a, k, b, t = starts[i], kept[i], starts[i + 1], taken[i]
        edited = written(
            np.concatenate((points[a : a + k], points[b : b + t])), np.concatenate((first[a : a + k], other[b : b + t])), other_end[i]
        )
        text = texts[i][:k] + texts[i + 1][:t]
        sha = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        out.append((int(sizes[i]), sha, own[i], edited, likeness(own[i], edited), likeness(own[i], own[i + 1])))
    return out


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, which ends in the beginning of the next document.

    Documents go once to ranges of ids; the first text of each range is also sent to the
    range before it. Only the bounds of the ranges pass through the driver.
    """
    spark = docs.sparkSession
    lowest = -(1 << 63)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(lowest)).alias("_order"))
    ranges = 2 * partitions(spark)
    cuts = sorted(set(docs.stat.approxQuantile("_order", [i / ranges for i in range(1, ranges)], 0.2 / ranges)))
    edges = np.array(cuts, np.float64).astype(np.int64)

    @F.pandas_udf("int")
    def range_of(order: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, order.to_numpy(), side="right").astype(np.int32))

    dealt = docs.withColumn("_range", range_of("_order"))
    heads = {r["_range"]: r["top"] for r in dealt.select("_range", "_order").groupBy("_range").agg(F.max("_order").alias("top")).collect()}
    if not heads:
        return spark.createDataFrame([], _RESULT)
    filled = sorted(heads, reverse=True)
    # the head of each range ends the range before it in descending order; the first ends the last
    after = {heads[r]: filled[i - 1] if i else filled[-1] for i, r in enumerate(filled)}
    target = spark.createDataFrame([(k, v) for k, v in after.items()], "_top long, _to int")
    tails = docs.join(F.broadcast(target), F.col("_order") == F.col("_top"))
    tails = tails.groupBy("_order", "_to").agg(F.min("text").alias("text"))
    tails = tails.select(F.lit(None).cast("long").alias("doc_id"), "text", "_order", F.col("_to").alias("_range"), F.lit(1).alias("_tail"))
    rows = dealt.withColumn("_tail", F.lit(0)).unionByName(tails).repartition(partitions(spark), "_range")
    rows = rows.sortWithinPartitions("_range", "_tail", F.desc("_order"), "text").select("doc_id", "text", "_range", "_tail")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size, current = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            if len(texts) > 1:
                found = [(i, *row) for i, row in zip(ids, with_edited(texts), strict=False)]
                names = [c.split()[0] for c in _RESULT.split(", ")]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                columns = (part.column(c).to_pylist() for c in ("doc_id", "text", "_range"))
                for doc_id, text, place in zip(*columns, strict=True):
                    if place != current:
                        yield from flush()
                        ids, texts, size, current = [], [], 0, place
                    ids.append(doc_id)
                    texts.append(text)
                    size += len(text)
                    if size > CHUNK_POINTS and len(texts) > 1:
                        yield from flush()
                        ids, texts, size = ids[-1:], texts[-1:], len(text)
        yield from flush()

    return in_tasks(rows, run, _RESULT)


# --- near documents ---------------------------------------------------------------


def band_cells(fingerprint: str, digits: int = BAND_DIGITS) -> Iterator[tuple[int, int, str]]:
    """(level, place, digits): runs of sampled steps, and the last such run, at the fingerprint's level and the next one."""
    for level in (int(fingerprint[:2], 16), int(fingerprint[:2], 16) + 1):
        cells = _at_level(fingerprint, level).tobytes().decode()
        places = {*range(0, len(cells) - digits + 1, digits), max(0, len(cells) - digits)}
        yield from ((level, k, cells[k : k + digits]) for k in sorted(places) if cells)


def _bands(nodes: DataFrame, digits: int) -> DataFrame:
    """(node, key): the bands of each fingerprint, a key is a 64-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("node").to_pylist(), batch.column("fingerprint").to_pylist(), strict=True)
            out = [(node, *band) for node, a in both for band in band_cells(a, digits)]
            columns = zip(*out, strict=True) if out else ([], [], [], [])
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["node", "level", "place", "cells"])

    bands = in_tasks(nodes, run, "node long, level int, place int, cells string")
    return bands.select("node", F.xxhash64("level", "place", "cells").alias("key"))


def _verified(pairs: DataFrame, nodes: DataFrame, like: float) -> DataFrame:
    """The pairs (a, b) of nodes whose fingerprints are alike."""
    one, two = (nodes.select(F.col("node").alias(x), F.col("fingerprint").alias(f"_{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("_a").to_pylist(), batch.column("_b").to_pylist(), strict=True)
            yield batch.filter(pa.array([likeness(a, b) >= like for a, b in both], pa.bool_())).select(["a", "b"])

    return in_tasks(pairs.join(one, "a").join(two, "b").select("a", "b", "_a", "_b"), run, "a long, b long")


class _Alike:
    """Likeness of one fingerprint to many, by rows of digits for each level that occurs."""

    def __init__(self, prints: list[str]):
        self.levels = np.array([int(p[:2], 16) for p in prints])
        self.rows: dict[int, np.ndarray] = {}
        self.sizes: dict[int, np.ndarray] = {}
        for level in np.unique(self.levels):
            cells = [_at_level(p, level) if own <= level else _NONE for p, own in zip(prints, self.levels, strict=True)]
            self.sizes[level] = np.array([len(c) for c in cells])
            self.rows[level] = np.zeros((len(cells), max(1, self.sizes[level].max())), np.uint8)
            for row, c in zip(self.rows[level], cells, strict=True):
                row[: len(c)] = c

    def to(self, one: int, others: np.ndarray) -> np.ndarray:
        out = np.zeros(len(others))
        common = np.maximum(self.levels[one], self.levels[others])
        for level in np.unique(common):
            at = np.flatnonzero(common == level)
            rows, sizes = self.rows[level], self.sizes[level]
            n = sizes[one]
            equal = (rows[others[at], :n] == rows[one, :n]).sum(axis=1)
            longest = np.maximum(n, sizes[others[at]])
            out[at] = np.where(np.minimum(n, sizes[others[at]]) > 0, (equal / np.maximum(1, longest) - 1 / 16) / (15 / 16), 0)
        return np.maximum(out, 0)


_NONE = np.empty(0, np.uint8)


def links_among(nodes: np.ndarray, roots: np.ndarray, side: np.ndarray, prints: list[str], like: float) -> list[tuple[int, int]]:
    """Links that join different classes of one bucket: each fingerprint meets all later ones that are not yet in its class.

    With two sides, those of the first meet those of the second. Every pair that is alike ends in one class.
    """
    label, alike, out = np.unique(roots, return_inverse=True)[1], _Alike(prints), []
    order = np.argsort(side, kind="stable")
    first_of_second = int(np.searchsorted(side[order], 1))
    two = 0 < first_of_second < len(order)
    for place, i in enumerate(order[:first_of_second] if two else order):
        others = order[first_of_second if two else place + 1 :]
        others = others[label[others] != label[i]]
        if not len(others):
            continue
        found = others[alike.to(i, others) >= like]
        for j in found:
            if label[j] != label[i]:
                out.append((int(nodes[i]), int(nodes[j])))
                label[label == label[j]] = label[i]
    return out


def _late_links(buckets: DataFrame, nodes: DataFrame, links: DataFrame, like: float) -> DataFrame:
    """Links within the buckets whose members are not all in one class yet.

    A bucket of more than `BUCKET` members is cut into blocks by hash; a task holds two of its blocks.
    """
    spark = buckets.sparkSession
    root = components(links).withColumnRenamed("node", "_node")
    rooted = buckets.join(root, F.col("node") == F.col("_node"), "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    rooted, rooted_path = restage(rooted, "rooted")
    open_ = rooted.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("root").alias("least"), F.max("root").alias("most"))
    open_ = open_.where("least <> most").select("key", F.ceil(F.col("members") / BUCKET).cast("int").alias("blocks"))
    meet = rooted.join(open_, "key").withColumn("own", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    # a block meets itself and every other one: the lower of both numbers is the first side
    meet = meet.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    meet = meet.select("key", low, high, (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "root")
    meet = meet.join(nodes, "node").repartition(partitions(spark), "key", "low", "high").sortWithinPartitions("key", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["key", "low", "high"]):
            found = links_among(*(group[c].to_numpy() for c in ("node", "root", "side")), group["fingerprint"].tolist(), like)
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    out = stage(in_tasks(meet, run, "a long, b long"), "late-near")
    discard(spark, rooted_path)
    return out


def near_documents(docs: DataFrame, like: float = LIKE, digits: int = BAND_DIGITS) -> DataFrame:
    """(doc_id, class_id): one row for each row with an id; a class is what links of alike fingerprints reach, named by its smallest id.

    Two texts are compared if their fingerprints share a band, and every such pair that is alike ends in
    one class. Equal fingerprints are one node. First every node of a band is compared with the band's
    smallest one, which settles bands of near copies in linear work; in the bands that still hold several
    classes the nodes of different classes meet in blocks. Rows without id are left out.
    """
    spark = docs.sparkSession
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints(part.column("text").to_pylist()))], ["doc_id", "fingerprint"])

    prints = in_tasks(docs, run, "doc_id long, fingerprint string").withColumn("node", F.xxhash64("fingerprint"))
    prints, _ = restage(prints, "prints")
    nodes, nodes_path = restage(prints.groupBy("node").agg(F.min("fingerprint").alias("fingerprint"), F.min("doc_id").alias("least")), "nodes")
    known = nodes.select("node", "fingerprint")
    bands, bands_path = restage(_bands(known, digits), "bands")
    center = bands.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("last")).where("center <> last")
    buckets, buckets_path = restage(bands.join(center.drop("last"), "key").distinct(), "buckets")
    discard(spark, bands_path)
    stars = buckets.where("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    links, links_path = restage(_verified(stars, known, like), "near")
    late = _late_links(buckets.select("key", "node"), known, links, like)
    classes = components(links.unionByName(late))
    for path in (buckets_path, links_path):
        discard(spark, path)
    class_of = nodes.join(classes, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = class_of.groupBy("root").agg(F.min("least").alias("class_id"))
    named, _ = restage(class_of.join(least, "root").select("node", "class_id"), "classes")
    discard(spark, nodes_path)
    return prints.join(named, "node").select("doc_id", "class_id")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))
