"""N-gram Jaccard join: globally ordered shingle sets, stored in prefix trees, traversed with length bounds.

A document's set holds its distinct `size`-word shingles; with fewer words the whole
sequence is one shingle; without words it is empty and linked with nothing. Two documents
link when 100 * |A and B| >= `percent` * |A or B|. The result is each document's
connected component.

1. Sets are identified by a 64-bit digest, so exact copies are one set from here on.
2. All shingles are ordered by frequency, rare first, then by hash. The frequencies are
   counts over all documents in counters whose number grows with the root of the input; any
   order gives the same result, a rare-first one gives few candidates.
3. Linked sets share a shingle among their first n - ceil(n * percent / 100) + 1. Those
   prefixes are grouped by shingle. Where few sets hold it, pairs of compatible sizes are
   counted, and pairs whose count, or whose places of the last shingle in common, leave too
   small an overlap go. Where many do, neighbours
   in size are chained; of such a shingle a batch sends one row on for each size class, so
   one that a third of all documents hold leaves each task as a few rows. What remains
   makes candidate families.
4. The sets of a family are stored in a prefix tree, most frequent shingle of the family
   first. Overlaps with all sets are summed along the tree, so that common beginnings are
   counted once; where the remaining lengths leave too small an overlap, what is below is
   not read. Sets that have joined a component leave the tree. Large families are cut into
   blocks: a block joins its own sets first; then the sets outside its main component, and
   one of those in it, meet the other blocks; last, so do main components still apart from
   the family's largest one. A set meets the blocks where a shingle of its prefix stands so
   early in a set of fitting size that the overlap can suffice; what meets a block comes in
   blocks too, so that no task holds more than two.

Defined cases: null and empty texts give n_shingles 0 and their own id as component.
Repeated rows are copies of each other; rows without id are reported without a
component and link nothing. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cashweave.llm.common import (
    SPACE,
    chunks,
    discard,
    documents,
    groups,
    in_tasks,
    mix,
    partitions,
    restage,
    table,
    word_hashes,
)
from cashweave.llm.components import components

SIZE, PERCENT = 5, 75
COUNTERS, MOST_COUNTERS, BLOCK_COUNTERS, COUNTED_BYTES = 1 << 20, 1 << 24, 1 << 12, 1 << 30
BLOCK_SETS, RUN, POSTINGS = 4096, 128, 500_000
LEVELS = 192
_LONG = (1 << 32) - 1  # stands for a size: the shingle's run is long
_WORD = table(outside=SPACE)
_STEP = np.uint64(0xD1342543DE82EF95)


# --- sets ---------------------------------------------------------------------


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every distinct shingle, sorted."""
    words, first = word_hashes(data, offsets, _WORD)
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    n = len(words) - size + 1
    owners, hashes = [], []
    if n > 0:
        total = np.zeros(n, np.uint64)
        for k in range(size):
            total = total * _STEP + words[k : k + n]
        whole = text[:n] == text[size - 1 :]
        owners.append(text[:n][whole])
        hashes.append(mix(total[whole]))
    short = np.flatnonzero((count > 0) & (count < size))
    total = np.zeros(len(short), np.uint64)
    for k in range(size - 1):
        has = count[short] > k
        total[has] = total[has] * _STEP + words[first[short[has]] + k]
    owners.append(short)
    hashes.append(mix(total + count[short].astype(np.uint64)))
    owner, value = np.concatenate(owners), np.concatenate(hashes)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


def digests(owner: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and 64-bit digests of the sets of n texts."""
    sizes = np.bincount(owner, minlength=n)
    edges = np.concatenate(([0], np.cumsum(sizes)))
    sums = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(mix(value ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
    return sizes, mix(sums[edges[1:]] - sums[edges[:-1]] + sizes.astype(np.uint64) * _STEP).view(np.int64)


def counters_for(size: int) -> int:
    """`COUNTERS` up to `COUNTED_BYTES` of input, twice as many for each four times as much.

    What other shingles add to a counter, and every task's counters together, then both grow with the root.
    """
    more = max(0, (max(1, -(-size // COUNTED_BYTES)) - 1).bit_length() + 1) // 2
    return min(MOST_COUNTERS, COUNTERS << more)


def _bytes(docs: DataFrame) -> int:
    """Size of the input as the plan knows it; 0 where it does not (a table without statistics counts as 2^63)."""
    known = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < 1 << 60 else 0


def describe(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """For each row doc_id, n, sid (null: no shingle); and rows with block, counts: this task's shingle counters."""
    wide = counters_for(_bytes(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(wide, np.int32)
        names = ["doc_id", "n", "sid", "block", "counts"]
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for low, high, data, offsets in chunks(batch.column("text")):
                owner, value = shingle_sets(data, offsets, size)
                sizes, sid = digests(owner, value, high - low)
                np.add.at(counters, (value & np.uint64(wide - 1)).astype(np.int64), 1)
                rows = high - low
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(low, rows),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(sid, mask=sizes == 0),
                        pa.nulls(rows, pa.int32()),
                        pa.nulls(rows, pa.binary()),
                    ],
                    names,
                )
        if counters.any():
            blocks = wide // BLOCK_COUNTERS
            cells = [row.astype("<i8").tobytes() for row in counters.reshape(blocks, -1)]
            empty = pa.nulls(blocks, pa.int64())
            yield pa.RecordBatch.from_arrays([empty, empty, empty, pa.array(np.arange(blocks, dtype=np.int32)), pa.array(cells, pa.binary())], names)

    return in_tasks(docs.select("doc_id", "text"), run, "doc_id long, n long, sid long, block int, counts binary")


def _add(rows: DataFrame, *keys: str) -> DataFrame:
    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, "<i8") for c in part["counts"])
        return part.head(1).assign(counts=[total.tobytes()])[["salt", "block", "counts"]]

    return rows.groupBy(*keys).applyInPandas(add, "salt int, block int, counts binary")


def frequency_ranks(described: DataFrame) -> np.ndarray:
    """The order of the counters in one byte each, see `levels`."""
    rows = described.where(F.col("block").isNotNull()).select((F.monotonically_increasing_id() % 64).cast("int").alias("salt"), "block", "counts")
    cells = {row["block"]: row["counts"] for row in _add(_add(rows, "salt", "block"), "block").collect()}
    totals = np.zeros((max(cells, default=0) + 1, BLOCK_COUNTERS), np.int64)
    for block, counts in cells.items():
        totals[block] = np.frombuffer(counts, "<i8")
    return levels(totals.reshape(-1))


def levels(totals: np.ndarray) -> np.ndarray:
    """Counters as `LEVELS` quantiles, then quarters of an octave.

    Each counter holds many rare shingles, so the totals lie close together, and what a shingle of some
    hundred documents adds is a few hundredths. Quantiles tell it from the rare ones, however large the totals.
    """
    low = np.sort(totals)[np.arange(1, LEVELS) * len(totals) // LEVELS]
    high = max(1, int(low[-1])) * 2.0 ** (np.arange(1, 257 - LEVELS) / 4)
    return np.searchsorted(np.concatenate((low, high)), totals).astype(np.uint8)


def ordered(owner: np.ndarray, value: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets with each hash replaced by a key whose natural order is the global order."""
    rank = ranks[(value & np.uint64(len(ranks) - 1)).astype(np.int64)].astype(np.uint64)
    key = (rank << np.uint64(56)) | (value >> np.uint64(8))
    order = np.lexsort((key, owner))
    return owner[order], key[order]


# --- candidate families ---------------------------------------------------------


class Union:
    """Disjoint sets of hashable items; the smallest item is the root."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def join(self, x, y) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.parent.setdefault(min(x, y), min(x, y))

    def stars(self) -> tuple[list, list]:
        nodes = list(self.parent)
        return nodes, [self.find(x) for x in nodes]


def _class(n: np.ndarray, percent: int) -> np.ndarray:
    """Size classes: sets that can be linked are in the same one or in neighbours."""
    return (np.log(np.maximum(n, 1)) / np.log(100 / percent)).astype(np.int64)


def _runs(key: np.ndarray, n: np.ndarray, sid: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Postings sorted by shingle, size, set, each once, with the number and the length of each one's run."""
    order = np.lexsort((sid, n, key))
    key, n, sid, at = key[order], n[order], sid[order], at[order]
    once = np.ones(len(key), bool)
    once[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
    key, n, sid, at = key[once], n[once], sid[once], at[once]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    return key, n, sid, at, run, np.diff(np.append(first, len(key)))


def _prefix(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (n * percent + 99) // 100 + 1


def _pairs(n: np.ndarray, sid: np.ndarray, place: np.ndarray, run: np.ndarray, length: np.ndarray, percent: int) -> np.ndarray:
    """Rows of a, b, their sizes, how many of the runs hold both, and the last place of such a run in each."""
    out = [np.empty((6, 0), np.int64)]
    d, most = 1, int(length.max(initial=0))
    while d < most:
        if d & (d - 1) == 0:  # shorter runs have no two sets that far apart
            on = length[run] > d
            n, sid, place, run = n[on], sid[on], place[on], run[on]
        i = np.flatnonzero((run[d:] == run[:-d]) & (n[:-d] * 100 >= n[d:] * percent))
        out.append(np.stack([sid[i], sid[i + d], n[i], n[i + d], place[i], place[i + d]]))
        d += 1
    rows = np.concatenate(out, 1)
    rows = rows[:, np.lexsort((rows[1], rows[0]))]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
    first = np.flatnonzero(new)
    last = np.maximum.reduceat(rows[4:], first, axis=1) if len(first) else rows[4:]
    return np.concatenate((rows[:4, first], np.diff(np.append(first, rows.shape[1]))[None], last))


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, Union]:
    """Stars of the components that the pairs make, and the components."""
    union = Union()
    pairs = np.unique(np.stack([a, b], 1), axis=0)
    for x, y in pairs[pairs[:, 0] != pairs[:, 1]].tolist():
        union.join(x, y)
    nodes, roots = union.stars()
    stars = np.array([nodes, roots], np.int64).reshape(2, -1)
    return stars[:, stars[0] != stars[1]], union


def _chained(run: np.ndarray, n: np.ndarray, of: np.ndarray, percent: int) -> np.ndarray:
    """Places that continue the run before them in the same or the next size class, in the runs `of`."""
    cls = _class(n, percent)
    return np.flatnonzero((run[1:] == run[:-1]) & of[1:] & (cls[1:] - cls[:-1] <= 1)) + 1


def families(docs: DataFrame, described: DataFrame, ranks: np.ndarray, size: int, percent: int) -> DataFrame:
    """(node, root): sets that may be linked, directly or not, have the same root.

    A pair of sets with c shingles in common in their prefixes has at most
    c + max(prefix rest of the smaller, prefix rest of the larger or the smaller whole) in common
    altogether; and of the shingles up to the last common one, all but c stand in one set alone.
    Places are sent as 256ths of the prefix, rounded down. Pairs are counted in the runs of at most
    `RUN` sets, with at most RUN / 2 rows for a posting; the sets of a longer run are chained whatever they share.
    """
    spark = docs.sparkSession
    total = described.agg(F.sum("n")).first()[0] or 0
    buckets = max(4 * partitions(spark), int(total * (100 - percent) / 100 / 2_000_000))
    shared = spark.sparkContext.broadcast(ranks)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[np.ndarray, ...]] = []
            size_held = 0
            for low, high, data, offsets in chunks(batch.column("text")):
                owner, value = shingle_sets(data, offsets, size)
                sizes, sid = digests(owner, value, high - low)
                owner, key = ordered(owner, value, shared.value)
                start = np.concatenate(([0], np.cumsum(sizes)))
                prefix = _prefix(sizes, percent)
                place = np.arange(len(owner)) - start[owner]
                first = place < prefix[owner]
                owner, key, place = owner[first], key[first], place[first]
                held.append((key, sizes[owner], sid[owner], (place * 256 // prefix[owner]).astype(np.uint8)))
                size_held += len(key)
                if size_held > POSTINGS:
                    yield flush(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, size_held = [], 0
            if held:
                yield flush(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def flush(key: np.ndarray, n: np.ndarray, sid: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        key, n, sid, at, run, length = _runs(key, n, sid, at)
        long = length[run] > RUN
        next_ = _chained(run, n, long, percent)
        stars, _ = _stars(sid[next_ - 1], sid[next_])
        # of a long run one posting for each size class goes on, and a mark that it is long
        cls = _class(n, percent)
        stays = np.ones(len(key), bool)
        stays[1:] = ~long[1:] | (run[1:] != run[:-1]) | (cls[1:] != cls[:-1])
        marks = np.unique(key[long])
        key = np.concatenate((key[stays], marks))
        n = np.concatenate((n[stays], np.full(len(marks), _LONG)))
        sid = np.concatenate((sid[stays], np.zeros(len(marks), np.int64)))
        at = np.concatenate((at[stays], np.zeros(len(marks), np.uint8)))
        bucket = (mix(key) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        key, n, sid, at, bucket = key[order], n[order], sid[order], at[order], bucket[order]
        star_bucket = (stars[0].view(np.uint64) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(star_bucket, kind="stable")
        stars, star_bucket = stars[:, order], star_bucket[order]
        every = np.union1d(bucket, star_bucket)
        low, high = np.searchsorted(bucket, every), np.searchsorted(bucket, every, "right")
        slow, shigh = np.searchsorted(star_bucket, every), np.searchsorted(star_bucket, every, "right")
        cells = [
            [key[a:b].astype("<u8").tobytes() for a, b in zip(low, high, strict=True)],
            [n[a:b].astype("<u4").tobytes() for a, b in zip(low, high, strict=True)],
            [sid[a:b].astype("<i8").tobytes() for a, b in zip(low, high, strict=True)],
            [at[a:b].tobytes() for a, b in zip(low, high, strict=True)],
            [np.ascontiguousarray(stars[:, a:b]).astype("<i8").tobytes() for a, b in zip(slow, shigh, strict=True)],
        ]
        return pa.RecordBatch.from_arrays([pa.array(every.astype(np.int32)), *(pa.array(c, pa.binary()) for c in cells)], ["bucket", "key", "n", "sid", "at", "stars"])

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        key = np.concatenate([np.frombuffer(x, "<u8") for x in part["key"]])
        n = np.concatenate([np.frombuffer(x, "<u4") for x in part["n"]]).astype(np.int64)
        sid = np.concatenate([np.frombuffer(x, "<i8") for x in part["sid"]])
        at = np.concatenate([np.frombuffer(x, np.uint8) for x in part["at"]]).astype(np.int64)
        given = np.concatenate([np.frombuffer(x, "<i8").reshape(2, -1) for x in part["stars"]], axis=1)
        marked, own = np.unique(key[n == _LONG]), n != _LONG
        key, n, sid, at, run, length = _runs(key[own], n[own], sid[own], at[own])
        long = (length[run] > RUN) | np.isin(key, marked)
        next_ = _chained(run, n, long, percent)
        stars, _ = _stars(np.concatenate((given[0], sid[next_ - 1])), np.concatenate((given[1], sid[next_])))
        keep = ~long & (length[run] > 1)
        place = -(-at[keep] * _prefix(n[keep], percent) // 256)
        pairs = _pairs(n[keep], sid[keep], place, run[keep], length, percent)
        linked = np.zeros((7, stars.shape[1]), np.int64)
        linked[:2], linked[4] = stars, _LONG
        return pd.DataFrame(dict(zip(["a", "b", "na", "nb", "c", "ia", "ib"], np.concatenate((pairs, linked), 1), strict=True)))

    sent = in_tasks(docs.select("text"), send, "bucket int, key binary, n binary, sid binary, at binary, stars binary")
    met = sent.groupBy("bucket").applyInPandas(meet, "a long, b long, na long, nb long, c long, ia long, ib long")
    # of a pair the smaller set comes first; equal sizes in the order of their ids
    met = met.groupBy("a", "b").agg(*(F.max(x).alias(x) for x in ("na", "nb", "ia", "ib")), F.sum("c").alias("c"))
    rest_a, rest_b = (F.ceil(F.col(x) * percent / 100) - 1 for x in ("na", "nb"))
    alone_a, alone_b = (F.col(x) + 1 - F.col("c") for x in ("ia", "ib"))
    most = F.least(F.col("c") + F.greatest(rest_a, F.least(rest_b, F.col("na"))), F.col("na") - alone_a, F.col("nb") - alone_b)
    return components(met.where((F.col("c") >= _LONG) | (most * (100 + percent) >= percent * (F.col("na") + F.col("nb")))).select("a", "b"))


# --- the prefix tree --------------------------------------------------------------


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start, so many of each."""
    edge = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - edge, sizes)


class PrefixTree:
    """Sets as ascending arrays of small integers, in a trie whose edges hold EDGE, then twice as many elements, and so on.

    Sets with a common beginning share its nodes, and the overlap with it is summed once for all
    of them. A search goes down level by level with all nodes that are still open; a subtree is
    left when even the rest of its longest set, or of the searched one, cannot make up the
    overlap that its shortest set needs. `visited` counts the elements read, `size` those stored.
    """

    EDGE = 8

    def __init__(self, sets: list[np.ndarray], items: np.ndarray, percent: int, vocabulary: int):
        self.percent = percent
        order = sorted(range(len(items)), key=lambda k: sets[items[k]].astype(">u4").tobytes())
        self.items = items[order]
        members = [sets[i] for i in self.items]
        self.sizes = np.array([len(m) for m in members])
        self.alive = np.ones(len(items), bool)
        self.seen = np.zeros(vocabulary, np.int32)
        flat = np.concatenate(members).astype(np.int32)
        begins = np.cumsum(self.sizes) - self.sizes
        common = np.zeros(len(members), np.int64)  # with the set before
        for k in range(1, len(members)):
            limit = min(len(members[k]), len(members[k - 1]))
            differ = np.flatnonzero(members[k][:limit] != members[k - 1][:limit])
            common[k] = differ[0] if len(differ) else limit
        self.levels: list[dict[str, np.ndarray]] = []
        low, width, self.visited, self.size = 0, self.EDGE, 0, 0
        while low < self.sizes.max():
            high = low + width
            reach = np.minimum(self.sizes, high)
            goes = self.sizes > low
            before = np.concatenate(([-1], np.where(goes, reach, -1)[:-1]))
            first = np.flatnonzero(goes & ~((before == reach) & (common >= reach)))
            # the sets of a node follow each other; those that end in it come first
            node = np.searchsorted(first, np.flatnonzero(goes), side="right") - 1
            sizes = self.sizes[goes]
            edges = np.searchsorted(node, np.arange(len(first)))
            level = {
                "first": first,
                "sets": np.bincount(node, minlength=len(first)),
                "ended": np.bincount(node[sizes <= high], minlength=len(first)),
                "length": reach[first] - low,
                "last": flat[begins[first] + reach[first] - 1],
                "shortest": np.minimum.reduceat(sizes, edges),
                "longest": np.maximum.reduceat(sizes, edges),
            }
            if self.levels:
                above = self.levels[-1]
                above["child"] = np.searchsorted(first, above["first"])
                above["children"] = np.searchsorted(first, above["first"] + above["sets"]) - above["child"]
            level["flat"] = flat[_ranges(begins[first] + low, level["length"])]
            level["start"] = np.cumsum(level["length"]) - level["length"]
            self.levels.append(level)
            self.size += len(level["flat"])
            low, width = high, 2 * width
        self.levels[-1]["child"] = self.levels[-1]["children"] = np.zeros(len(self.levels[-1]["first"]), np.int64)

    def similar(self, members: np.ndarray) -> np.ndarray:
        """Places of the live sets that are similar enough to `members`."""
        n, percent, seen = len(members), self.percent, self.seen
        seen[members] = 1
        node = np.arange(len(self.levels[0]["first"]))
        shared, behind, low, width = np.zeros(len(node), np.int64), np.full(len(node), n), 0, self.EDGE
        found = [np.empty(0, np.int64)]
        for level in self.levels:
            # what may still come: the rest of the longest set, or of members
            most = shared + np.minimum(level["longest"][node] - low, behind)
            open_ = most * (100 + percent) >= percent * (n + level["shortest"][node])
            node, shared = node[open_], shared[open_]
            if not len(node):
                break
            length = level["length"][node]
            read = int(length.sum())
            if 2 * read > len(level["flat"]):  # most of the level: in one run
                read = len(level["flat"])
                shared = shared + np.add.reduceat(seen[level["flat"]], level["start"])[node]
            else:
                at = _ranges(level["start"][node], length)
                shared = shared + np.add.reduceat(seen[level["flat"][at]], np.cumsum(length) - length)
            self.visited += read
            ended = level["ended"][node]
            place = _ranges(level["first"][node], ended)
            enough = np.repeat(shared, ended) * (100 + percent) >= percent * (n + self.sizes[place])
            found.append(place[enough & self.alive[place]])
            behind = n - np.searchsorted(members, level["last"][node], side="right")
            children = level["children"][node]
            node = _ranges(level["child"][node], children)
            shared, behind = np.repeat(shared, children), np.repeat(behind, children)
            low, width = low + width, 2 * width
        seen[members] = 0
        return np.sort(np.concatenate(found))


def link_family(sets: list[np.ndarray], sids: list[int], queries: int | None, percent: int) -> Union:
    """Joins the ids of similar sets; with `queries`, the last sets of that number only meet the ones before them.

    A component grows from one set: what is similar to a set of it joins it and leaves the
    tree, which is built anew when half of its sets have left.
    """
    union = Union()
    flat = np.concatenate(sets)
    values, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(values))  # most frequent first
    ranked, edges = rank[inverse], np.cumsum([0, *map(len, sets)])
    small = [np.sort(ranked[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    if queries is not None:
        stored = len(sets) - queries
        if stored:
            tree = PrefixTree(small, np.arange(stored), percent, len(values))
            for i in range(stored, len(sets)):
                for k in tree.similar(small[i]):
                    union.join(sids[i], sids[tree.items[k]])
        return union
    if len(sets) == 2:
        shared = len(np.intersect1d(small[0], small[1], assume_unique=True))
        if shared * (100 + percent) >= percent * (len(small[0]) + len(small[1])):
            union.join(sids[0], sids[1])
        return union
    tree, alive, grown = PrefixTree(small, np.arange(len(sets)), percent, len(values)), len(sets), []
    while alive:
        if grown:
            i = grown.pop()
        else:
            k = int(np.argmax(tree.alive))
            i, tree.alive[k] = tree.items[k], False
            alive -= 1
        found = tree.similar(small[i])
        tree.alive[found] = False
        alive -= len(found)
        for k in found:
            union.join(sids[i], sids[tree.items[k]])
        grown += tree.items[found].tolist()
        if alive and alive <= len(tree.items) // 2:
            tree = PrefixTree(small, tree.items[tree.alive], percent, len(values))
    return union


def _latest(hot: DataFrame, percent: int) -> DataFrame:
    """(family, part, sid, key, n, most): the prefix shingles of stored sets.

    `most` is the largest size of a set that can be linked if this shingle is the first in common:
    of a set of n, what stands before the shingle is not shared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["family", "part", "sid", "key", "n", "most"]
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                sets = [np.frombuffer(m, "<u8") for m in part.column("members").to_pylist()]
                n = np.array([len(x) for x in sets], np.int64)
                prefix = n - (n * percent + 99) // 100 + 1
                row = np.repeat(np.arange(len(n)), prefix)
                place = np.arange(len(row)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
                key = np.concatenate([x[:k] for x, k in zip(sets, prefix, strict=True)]).view(np.int64)
                most = (n[row] - place) * (100 + percent) // percent - n[row]
                which = pa.array(row)
                same = [part.column(c).take(which) for c in ("family", "part", "sid")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(key), pa.array(n[row]), pa.array(most)], names)

    return in_tasks(hot.select("family", "part", "sid", "members"), run, "family long, part int, sid long, key long, n long, most long")


def meetings(hot: DataFrame, asking: DataFrame, percent: int) -> DataFrame:
    """(family, part, turn, asks, sid, members): of each turn at a block its sets, and at most about `BLOCK_SETS` that meet them.

    An asking set goes to the other blocks of its family that hold a set whose first shingle in common
    with it can be one of both prefixes; sizes and places are compared once for each different one.
    """
    post = _latest(hot, percent)
    asks, _ = restage(_latest(hot.join(asking, "sid", "left_semi"), percent), "asks")
    mine = asks.groupBy("family", "key", F.col("n").alias("an"), F.col("most").alias("amost")).agg(F.count(F.lit(1)).alias("_asks")).drop("_asks")
    theirs = post.join(asks.select("family", "key").distinct(), ["family", "key"], "left_semi").select("family", "key", "part", "n", "most").distinct()
    fits = F.expr(f"n <= amost and an <= most and 100 * n >= {percent} * an and 100 * an >= {percent} * n")
    fitting = mine.join(theirs, ["family", "key"]).where(fits)
    fitting = fitting.select("family", "key", F.col("an").alias("n"), F.col("amost").alias("most"), F.col("part").alias("_to")).distinct()
    goes = asks.join(fitting, ["family", "key", "n", "most"]).where("_to <> part").select("family", "sid", "_to").distinct()
    goes, _ = restage(goes, "goes")
    turns = goes.groupBy("family", F.col("_to").alias("part")).agg(F.ceil(F.count(F.lit(1)) / BLOCK_SETS).cast("int").alias("turns"))
    turns, _ = restage(turns, "turns")
    stored = hot.join(turns, ["family", "part"]).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    sent = goes.join(hot.select("sid", "members"), "sid").withColumnRenamed("_to", "part").join(turns, ["family", "part"])
    sent = sent.withColumn("turn", F.pmod(F.xxhash64("sid"), F.col("turns")).cast("int"))
    columns = ["family", "part", "turn", "asks", "sid", "members"]
    return stored.withColumn("asks", F.lit(0)).select(columns).unionByName(sent.withColumn("asks", F.lit(1)).select(columns))


def verified_links(docs: DataFrame, described: DataFrame, family: DataFrame, ranks: np.ndarray, size: int, percent: int) -> DataFrame:
    """(a, b): stars over the truly linked sets of each family."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)
    one = described.where(F.col("sid").isNotNull()).groupBy("sid").agg(F.min("doc_id").alias("_doc"))
    # only families of several blocks are listed: few rows, so that the join does not gather a family in one task
    count = family.groupBy("root").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > BLOCK_SETS)
    count, _ = restage(count, "large-families")
    blocks = F.coalesce(F.ceil(F.col("members") / BLOCK_SETS), F.lit(1)).cast("int")
    member = family.join(count, "root", "left").select(F.col("node").alias("sid"), F.col("root").alias("_family"), blocks.alias("_blocks"))
    wanted = one.join(member, "sid").select("_doc", "_family", "_blocks", "sid")
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("_doc")).drop("_doc")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column("text")):
                owner, value = shingle_sets(data, offsets, size)
                sizes, sid = digests(owner, value, high - low)
                owner, key = ordered(owner, value, shared.value)
                edges = np.concatenate(([0], np.cumsum(sizes))) * 8
                raw = pa.py_buffer(key.astype("<u8").tobytes())
                members = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(edges.astype(np.int32)), raw])
                family, blocks = (batch.column(c).slice(low, high - low) for c in ("_family", "_blocks"))
                part = np.asarray(sid.view(np.uint64) % np.asarray(blocks.to_numpy(), np.uint64), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [family, blocks, pa.array(part), pa.array(sid), members], ["family", "blocks", "part", "sid", "members"]
                )

    sets = in_tasks(texts.select("text", "_family", "_blocks"), keys, "family long, blocks int, part int, sid long, members binary")
    # rows of one id may have several texts: only the sets asked for
    sets = sets.join(member.select(F.col("sid").alias("_sid")), F.col("sid") == F.col("_sid"), "left_semi").dropDuplicates(["sid"])
    sets, path = restage(sets, "family-sets")

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block's own links; of a block among several also what has to meet the others."""
        for group in groups(batches, ["family", "part"]):
            sids = group["sid"].tolist()
            members = [np.frombuffer(m, "<u8") for m in group["members"]]
            if len(sids) == 1 and group["blocks"].iloc[0] == 1:
                continue
            union = link_family(members, sids, None, percent) if len(sids) > 1 else Union()
            roots = [union.find(s) for s in sids]
            links = [(s, r, False) for s, r in zip(sids, roots, strict=True) if s != r]
            if group["blocks"].iloc[0] > 1:
                main = int(pd.Series(roots).mode()[0])
                links += [(s, r, True) for s, r in zip(sids, roots, strict=True) if r != main or s == main]
            a, b, meets = zip(*links, strict=True) if links else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(meets, pa.bool_())], ["a", "b", "meets"])

    def dealt(rows: DataFrame, *by: str) -> DataFrame:
        return rows.repartition(partitions(spark), *by).sortWithinPartitions(*by)

    links, _ = restage(in_tasks(dealt(sets, "family", "part"), inside, "a long, b long, meets boolean"), "links")
    found = links.where("not meets").select("a", "b")
    hot = sets.where("blocks > 1")
    if not hot.isEmpty():
        hot = hot.select("family", "blocks", "part", "sid", "members")
        outside = links.where("meets").select(F.col("a").alias("sid"))

        def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in groups(batches, ["family", "part", "turn"]):
                group = group.sort_values("asks", kind="stable")
                sids = group["sid"].tolist()
                members = [np.frombuffer(m, "<u8") for m in group["members"]]
                nodes, roots = link_family(members, sids, int(group["asks"].sum()), percent).stars()
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["a", "b"])

        def asked(which: DataFrame) -> DataFrame:
            """Links of these sets with the sets of the other blocks of their family."""
            return in_tasks(dealt(meetings(hot, which, percent), "family", "part", "turn"), across, "a long, b long").where("a <> b")

        found, _ = restage(found.unionByName(asked(outside)), "across")
        # a block's main component that its one set did not bring into the family's largest meets all the others too;
        # then every set outside the largest component has been compared with all
        root = components(found).withColumnRenamed("node", "sid")
        now = hot.select("family", "sid").join(root, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        now, _ = restage(now, "roots")
        sizes = now.groupBy("family", "root").agg(F.count(F.lit(1)).alias("n"))
        largest = sizes.groupBy("family").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
        late = now.join(largest, "family").where("root <> main").join(outside, "sid", "left_anti").select("sid")
        late, _ = restage(late, "late")
        if not late.isEmpty():
            found = found.unionByName(asked(late))
    found, _ = restage(found.where("a <> b"), "found")
    discard(spark, path)
    return found


def similar_documents(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """For each row doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    spark = docs.sparkSession
    counted, path = restage(describe(docs, size), "counted-sets")
    ranks = frequency_ranks(counted)
    described, _ = restage(counted.where(F.col("block").isNull()).select("doc_id", "n", "sid"), "sets")
    discard(spark, path)  # each task's counters are far larger than the sets' names
    family = families(docs, described, ranks, size, percent)
    family, path = restage(family, "families")
    links = verified_links(docs, described, family, ranks, size, percent)
    discard(spark, path)
    linked, _ = restage(components(links), "linked")
    # copies, then links: the smallest document of each set, of each component, and back
    one = described.where(F.col("sid").isNotNull()).groupBy("sid").agg(F.min("doc_id").alias("least"))
    one = one.join(linked.withColumnRenamed("node", "sid"), "sid", "left").withColumn("class", F.coalesce("root", "sid"))
    least, _ = restage(one.groupBy("class").agg(F.min("least").alias("component")), "least")
    one, _ = restage(one.select("sid", "class").join(least, "class").select("sid", "component"), "set-components")
    return described.join(one, "sid", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    )


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(documents(spark, sf_dir).select("doc_id", "text"))


OP1_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m.b AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = d.doc_id
"""
