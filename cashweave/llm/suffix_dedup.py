"""Removal of repeated byte strings by external induced suffix sorting.

A byte is removed if a string of `length` bytes that covers it also starts anywhere
else, in the same document or another; strings are judged on the input.

Sorting every suffix of the corpus is not needed to know which share `length` bytes.
1. Sample: of each `length` consecutive bytes, the place whose `GRAM`-byte hash is smallest
   (the first of equals) is an anchor. It depends on those bytes alone, so equal
   strings have their anchors at the same place. Every start of a string belongs to one
   anchor; an anchor's starts are a run. Only anchors whose hash stands at least twice go on.
2. Sort: the suffixes at the anchors are put in order by Spark's external sort, which
   spills to disk, and carry their common prefix with the suffix before them.
3. Induce: the order of the suffixes that start one byte earlier follows from the order
   known and from that byte: suffixes stay sorted within each value of it, and the common
   prefix of new neighbours is the least of those between them. Step by step this gives
   all suffixes of the anchors' runs; neighbours that share `length` bytes mark their strings.
   A text's equal slices are one suffix, marked at once, so periodic texts stay small.
An anchor that stands more than `HOT` times would be too much for one task: the strings of its runs
are counted by 128 bits of hash instead, in a partial aggregate that no single string can fill.

Equal texts are one text from the start: of at least `length` bytes they are removed whole.

Defined cases: a null text is empty and keeps nothing; texts shorter than `length` stay
whole. Repeated rows are copies, each one elsewhere than the other. A row without id is
reported whole and compared with nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cashweave.llm.common import chunks, discard, documents, in_tasks, partitions, prefix_sums, restage, segment_hash

LENGTH, GRAM, HOT = 400, 32, 100_000
SEGMENT = 1 << 21
_PLACE = 26  # bits of a key that hold a place within a segment
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(anchor, first start, last start, hash of its gram) of every anchor, in order of starts."""
    found = []
    width = length - gram + 1
    for low in range(0, max(0, len(data) - length + 1), SEGMENT):
        part = data[low : low + SEGMENT + length - 1]
        n = len(part) - gram + 1
        at = np.arange(n)
        hashes = segment_hash(prefix_sums(part), at, at + gram)
        key = (hashes >> np.uint64(_PLACE) << np.uint64(_PLACE)) | at.astype(np.uint64)
        span = 1
        while 2 * span <= width:
            key = np.minimum(key[: len(key) - span], key[span:])
            span *= 2
        if span < width:
            key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
        anchor = (key & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        start = np.arange(low, low + len(anchor))
        end = offsets[np.searchsorted(offsets, start, side="right")]
        whole = start + length <= end
        start, anchor = start[whole], anchor[whole]
        if not len(start):
            continue
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        found.append((anchor[first] + low, start[first], start[last], hashes[anchor[first]]))
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def describe(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, n_bytes, sha, prints, counts): the distinct anchor hashes of each text and how often each stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for low, high, data, offsets in chunks(batch.column("text")):
                _, first, _, hashes = anchors(data, offsets, length, gram)
                cut = np.searchsorted(first, offsets)
                raw = memoryview(data)
                shas, prints, counts = [], [], []
                for row in range(high - low):
                    shas.append(hashlib.sha256(raw[offsets[row] : offsets[row + 1]]).digest())
                    own, count = np.unique(hashes[cut[row] : cut[row + 1]].view(np.int64), return_counts=True)
                    prints.append(own)
                    counts.append(count.astype(np.int32))
                edges = pa.array(np.concatenate(([0], np.cumsum([len(p) for p in prints]))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(low, high - low),
                        pa.array(np.diff(offsets)),
                        pa.array(shas, pa.binary()),
                        pa.ListArray.from_arrays(edges, pa.array(np.concatenate([np.empty(0, np.int64), *prints]))),
                        pa.ListArray.from_arrays(edges, pa.array(np.concatenate([np.empty(0, np.int32), *counts]))),
                    ],
                    ["doc_id", "n_bytes", "sha", "prints", "counts"],
                )

    return in_tasks(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, sha binary, prints array<long>, counts array<int>")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching intervals joined."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return starts[first], reach[np.append(first[1:], len(starts)) - 1]


def slices(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Of texts (ref, text, wanted): each wanted anchor's suffix and what is before it, as far as its strings reach.

    Rows without `suffix` are marks: bytes a to b of ref are repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            refs = batch.column("ref").to_numpy(zero_copy_only=False)
            wanted = batch.column("wanted")
            for low, high, data, offsets in chunks(batch.column("text")):
                place, first, last, hashes = anchors(data, offsets, length, gram)
                cut = np.searchsorted(first, offsets)
                keep = np.zeros(len(place), bool)
                for row in range(high - low):
                    own = wanted[low + row].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    keep[cut[row] : cut[row + 1]] = np.isin(hashes[cut[row] : cut[row + 1]], own)
                row = np.repeat(np.arange(high - low), np.diff(cut))[keep]
                place, first, last, hashes = place[keep], first[keep], last[keep], hashes[keep]
                whole = segment_hash(prefix_sums(data), first, last + length) ^ (place - first).astype(np.uint64)
                _, one, inverse, count = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
                again = count[inverse] > 1
                out: dict[str, list] = {"print": [], "ref": [], "a": [], "b": [], "least": [], "suffix": [], "before": []}
                for r in np.unique(row[again]):
                    of = again & (row == r)
                    a, b = merged(first[of] - offsets[r], last[of] + length - offsets[r])
                    out["print"] += [int(hashes[of][0].view(np.int64))] * len(a)
                    out["ref"] += [refs[low + r]] * len(a)
                    out["a"] += a.tolist()
                    out["b"] += b.tolist()
                    out["least"] += [None] * len(a)
                    out["suffix"] += [None] * len(a)
                    out["before"] += [None] * len(a)
                raw = data.tobytes()
                for i in one.tolist():
                    p, s, e, r = int(place[i]), int(first[i]), int(last[i]), row[i]
                    out["print"].append(int(hashes[i].view(np.int64)))
                    out["ref"].append(refs[low + r])
                    out["a"].append(p - int(offsets[r]))
                    out["b"].append(p - s)
                    out["least"].append(p - e)
                    out["suffix"].append(raw[p : e + length])
                    out["before"].append(raw[s:p][::-1])
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    return in_tasks(texts.select("ref", "text", "wanted"), run, "print long, ref long, a long, b long, least int, suffix binary, before binary")


def _matrix(cells: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes, padded with zeros, and their lengths."""
    _, offsets, data = cells.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(cells) + 1, cells.offset * 4).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    lengths = np.diff(offsets)
    out = np.zeros((len(cells), width), np.uint8)
    inside = np.arange(width) < lengths[:, None]
    out[inside] = data[offsets[0] : offsets[-1]]
    return out, lengths


def _common(left: np.ndarray, right: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Length of the common beginning of rows, at most limit."""
    differ = left != right
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), left.shape[1])
    return np.minimum(first, limit)


def repeated(group: np.ndarray, suffix: pa.Array, before: pa.Array, least: np.ndarray, most: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the smallest and largest distance back at which a string that starts there is repeated; -1: none.

    Rows come sorted by group and suffix; an anchor's strings start `least` to `most` bytes before it.
    """
    m = len(group)
    low, high = np.full(m, -1), np.full(m, -1)
    suffixes, sizes = _matrix(suffix, length)
    common = np.full(m, -1, np.int64)  # with the row before, of the same group
    same = np.flatnonzero(group[1:] == group[:-1]) + 1
    common[same] = _common(suffixes[same - 1], suffixes[same], np.minimum(sizes[same - 1], sizes[same]))
    del suffixes
    befores, _ = _matrix(before, max(1, int(most.max(initial=0))))

    def following(c: np.ndarray) -> np.ndarray:
        return np.append(c[1:], -1)

    best = np.maximum(common, following(common))
    live = np.flatnonzero(best + most >= length)  # others share too little with any
    common = _between(common, live, group[live])
    cls = group[live].copy()
    back = 0
    while len(live):
        hit = common + back >= length
        hit[:-1] |= hit[1:]
        rows = live[hit]
        rows = rows[(least[rows] <= back) & (most[rows] >= back)]
        low[rows] = np.where(low[rows] < 0, back, low[rows])
        high[rows] = back
        back += 1
        stays = (most[live] >= back) & (np.maximum(common, following(common)) + most[live] >= length)
        at = np.flatnonzero(stays)
        if not len(at):
            break
        byte = befores[live[at], back - 1].astype(np.int64)
        part = cls[at]
        if len(at) < len(live) or ((byte[1:] != byte[:-1]) & (part[1:] == part[:-1])).any():
            order = np.lexsort((at, byte, part))
            at, byte, part = at[order], byte[order], part[order]
            new = np.ones(len(at), bool)
            new[1:] = (part[1:] != part[:-1]) | (byte[1:] != byte[:-1])
            common = _between(common, at, np.cumsum(new))
            cls = np.cumsum(new)
            live = live[at]
    return low, high


def _between(common: np.ndarray, at: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Common prefixes of the rows `at` with the row before of the same class: the least of those passed over."""
    out = np.full(len(at), -1, np.int64)
    same = np.flatnonzero(cls[1:] == cls[:-1]) + 1
    if len(same):
        pairs = np.empty(2 * len(same), np.int64)
        pairs[0::2], pairs[1::2] = at[same - 1] + 1, at[same] + 1
        out[same] = np.minimum.reduceat(np.append(common, -1), pairs)[0::2]
    return out


def hot_marks(cut: DataFrame, length: int) -> DataFrame:
    """(ref, a, b) as `marks` gives them, for anchors that stand too often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            refs, places, back, least = (batch.column(c).to_pylist() for c in ("ref", "a", "b", "least"))
            out: dict[str, list[np.ndarray]] = {"ref": [], "start": [], "h": [], "g": []}
            for i, (suffix, before) in enumerate(zip(batch.column("suffix").to_pylist(), batch.column("before").to_pylist(), strict=True)):
                data = np.frombuffer(before[::-1] + suffix, np.uint8)
                at = np.arange(back[i] - least[i] + 1)
                out["ref"].append(np.full(len(at), refs[i]))
                out["start"].append(places[i] - back[i] + at)
                out["h"].append(segment_hash(prefix_sums(data), at, at + length).view(np.int64))
                out["g"].append(segment_hash(prefix_sums(data ^ 0x5A), at, at + length).view(np.int64))
            if refs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out.values()], list(out))

    strings, _ = restage(in_tasks(cut.where(F.col("suffix").isNotNull()), run, "ref long, start long, h long, g long"), "hot-strings")
    again = strings.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "g")
    again, _ = restage(again, "hot-again")
    found = strings.join(again, ["h", "g"]).select("ref", F.col("start").alias("a"), (F.col("start") + length).alias("b"))
    return found.unionByName(cut.where(F.col("suffix").isNull()).select("ref", "a", "b"))


def marks(cut: DataFrame, length: int) -> DataFrame:
    """(ref, a, b): the repeated bytes of each text, from its slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            ready = part.filter(part["suffix"].is_null())
            yield from ready.select(["ref", "a", "b"]).to_batches()
            part = part.filter(part["suffix"].is_valid())
            rest = part if rest is None else pa.concat_tables([rest, part])
            prints = rest["print"].to_numpy()
            whole = int(np.searchsorted(prints, prints[-1])) if len(prints) else 0  # the last group may go on
            if whole:
                yield from solve(rest.slice(0, whole))
                rest = rest.slice(whole).combine_chunks()
        if rest is not None and rest.num_rows:
            yield from solve(rest)

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        prints = rows["print"].to_numpy()
        most, least, a = rows["b"].to_numpy(), rows["least"].to_numpy().astype(np.int64), rows["a"].to_numpy()
        cells = [rows[c].combine_chunks() for c in ("suffix", "before")]
        cells = [pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in cells]
        low, high = repeated(prints, *cells, least, most, length)
        hit = np.flatnonzero(low >= 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows["ref"].to_numpy()[hit]), pa.array(a[hit] - high[hit]), pa.array(a[hit] - low[hit] + length)], ["ref", "a", "b"]
        )

    dealt = cut.repartition(partitions(cut.sparkSession), "print").sortWithinPartitions("print", "suffix")
    return in_tasks(dealt, run, "ref long, a long, b long")


def remove(texts: DataFrame) -> DataFrame:
    """Of rows (sha, text, a, b: lists of intervals) the kept text as bytes, with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, kept = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                data = np.frombuffer((text or "").encode(), np.uint8)
                a, b = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("a", "b"))
                a, b = merged(a, b)
                gone = np.zeros(len(data) + 1, np.int8)
                gone[a] += 1
                gone[b] -= 1
                stays = np.cumsum(gone[:-1]) == 0
                removed.append(len(data) - int(stays.sum()))
                spans.append(len(a))
                kept.append(data[stays].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("sha"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                ["sha", "n_removed", "n_spans", "kept"],
            )

    return in_tasks(texts.select("sha", "text", "a", "b"), run, "sha binary, n_removed long, n_spans long, kept binary")


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """The described rows (doc_id, n_bytes, sha, copies) and, by sha, n_removed, n_spans and the kept bytes of texts that lose some.

    A text with copies and of at least `length` bytes is removed whole and not listed.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    described, _ = restage(describe(docs, length, gram), "described")
    known = described.where(F.col("doc_id").isNotNull())
    classes = known.groupBy("sha").agg(F.min("doc_id").alias("ref"), F.count(F.lit(1)).alias("copies"))
    classes, _ = restage(classes, "classes")

    one = known.where(F.size("prints") > 0).join(classes.select("sha", "ref"), "sha").where(F.col("doc_id") == F.col("ref"))
    one = one.select("ref", "sha", F.explode(F.arrays_zip("prints", "counts")).alias("p")).select("ref", "sha", F.col("p.prints").alias("print"), "p.counts")
    # rows of one id and one text are listed twice in `one`; that only adds candidates
    often = one.groupBy("print").agg(F.sum("counts").alias("n")).where("n > 1")
    often, often_path = restage(often, "often")
    hot, _ = restage(often.where(F.col("n") > HOT).select("print"), "hot")
    wanted = one.join(often, "print", "left_semi").groupBy("ref", "sha").agg(F.collect_set("print").alias("wanted"))
    wanted, wanted_path = restage(wanted, "wanted")
    texts = docs.where(F.length("text") > 0).join(wanted, F.col("doc_id") == F.col("ref"))
    texts = texts.where(F.unhex(F.sha2("text", 256)) == F.col("sha")).drop("doc_id").dropDuplicates(["sha"])
    # two texts of one id are told apart by a number of their own
    texts, _ = restage(texts.withColumn("ref", F.xxhash64("sha")), "suspects")
    discard(spark, often_path)
    discard(spark, wanted_path)

    cut = slices(texts, length, gram)
    if hot.isEmpty():
        found = marks(cut, length)
    else:
        cut, _ = restage(cut, "slices")
        found = marks(cut.join(hot, "print", "left_anti"), length).unionByName(hot_marks(cut.join(hot, "print", "left_semi"), length))
    found = found.groupBy("ref").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    lost = texts.join(classes.where("copies = 1").select("sha"), "sha", "left_semi").join(found, "ref")
    return described.select("doc_id", "n_bytes", "sha").join(classes.select("sha", "copies"), "sha", "left"), remove(lost)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, lost = deduplicate(documents(spark, sf_dir))
    lost, _ = restage(lost.select("sha", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept")), "kept")
    all_gone = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH) & F.col("doc_id").isNotNull()
    partly = F.col("kept").isNotNull() & F.col("doc_id").isNotNull()
    return rows.join(lost, "sha", "left").select(
        "doc_id",
        "n_bytes",
        F.when(all_gone, F.col("n_bytes")).when(partly, F.col("n_removed")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(all_gone, F.lit(1)).when(partly, F.col("n_spans")).otherwise(F.lit(0)).cast("long").alias("n_spans"),
        F.when(all_gone, F.lit(EMPTY_SHA)).when(partly, F.col("kept")).otherwise(F.lower(F.hex("sha"))).alias("kept_sha256"),
    )
