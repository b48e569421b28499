"""Order-preserving packing of token streams by dynamic programming with a monotone queue.

The documents of a shard (a run of documents in input order) form one stream of ids. The
stream is cut into windows of at most `capacity` ids; a window shorter than that costs
its padding, unless its length is a power of two, and a cut costs nothing between
documents, `SENTENCE_COST` after a sentence and `INSIDE_COST` inside one. With
f(c) = cost(c) + capacity - c + min over c - capacity <= b < c of (f(b) + b), the best
earlier cut is the front of a queue kept in rising order of f(b) + b.

Shards are made inside each input partition, so nothing is shuffled, a lost task repeats
the same shards, and memory is bounded by `CHUNK_BYTES` of text or one document.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each;
a null doc_id stays null; an empty table gives no rows; a document longer than a window
spans several. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from cashweave.llm.common import chunks, documents, in_tasks
from cashweave.llm.tokens import Encoder

CAPACITY, END_ID = 1024, 0
SENTENCE_COST, INSIDE_COST = 4, 16
STEP = 32  # the longest run of ids without a place where a cut is considered
TOKENIZER = "byte_bpe_50k.json"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def free_lengths(capacity: int) -> tuple[int, int]:
    """The two largest powers of two below the capacity: windows of these lengths are not padded."""
    largest = 1 << ((capacity - 1).bit_length() - 1)
    return largest, largest // 2


def best_cuts(places: np.ndarray, costs: np.ndarray, capacity: int = CAPACITY) -> list[int]:
    """The chosen cuts, in order, from 0 to the last place.

    `places` rise from 0 with gaps of at most `capacity`; costs[i] is paid for a cut at places[i].
    """
    place, cost = places.tolist(), costs.tolist()
    total = [0.0] * len(place)
    before = [0] * len(place)
    index, unpadded = {0: 0}, free_lengths(capacity)
    queue = deque([(0.0, 0, 0)])  # (f(b) + b, b, index), rising
    for i in range(1, len(place)):
        c = place[i]
        while queue[0][1] < c - capacity:
            queue.popleft()
        least, _, at = queue[0]
        best = least + capacity - c
        for free in unpadded:
            j = index.get(c - free)
            if j is not None and total[j] < best:
                best, at = total[j], j
        best += cost[i]
        total[i], before[i], index[c] = best, at, i
        key = best + c
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, c, i))
    cuts, i = [], len(place) - 1
    while i:
        cuts.append(place[i])
        i = before[i]
    return [0, *reversed(cuts)]


def cut_places(ends: np.ndarray, sentences: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Places where a cut is considered, with its cost: document ends, sentence ends, and a grid where both are rare."""
    step = min(STEP, capacity)
    known = np.unique(np.concatenate(([0], ends, sentences)))
    gaps = np.diff(known)
    extra = np.maximum(0, (gaps - 1) // step)
    grid = np.repeat(known[:-1], extra) + step * (1 + np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra))
    places = np.unique(np.concatenate((known, grid)))
    costs = np.full(len(places), float(INSIDE_COST))
    costs[np.searchsorted(places, sentences)] = SENTENCE_COST
    costs[np.searchsorted(places, ends)] = 0
    return places, costs


def pack_texts(encoder: Encoder, texts: list[str], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Pieces of one shard; `row` is the place of the piece's text in the list, `sequence` counts from 0."""
    points, bounds, ids, firsts, starts, edges = encoder.encode_texts(texts)
    n = len(texts)
    ids = np.insert(ids, firsts[1:], END_ID).astype("<u4")
    doc_start = firsts + np.arange(n + 1)
    # after a piece that ends in a full stop or a line break, if another piece of the text follows
    last = points[np.append(starts[1:], len(points))[: len(starts)] - 1] if len(starts) else points[:0]
    closing = np.flatnonzero(np.isin(last, [10, 33, 46, 63]))
    text_of = np.searchsorted(bounds, starts[closing], side="right") - 1
    sentences = edges[closing + 1] + text_of
    places, costs = cut_places(doc_start[1:], sentences, capacity)
    cuts = np.asarray(best_cuts(places, costs, capacity))
    begin = np.unique(np.concatenate((cuts[:-1], doc_start[:-1])))
    end = np.append(begin[1:], doc_start[-1])
    row = np.searchsorted(doc_start, begin, side="right") - 1
    sequence = np.searchsorted(cuts, begin, side="right") - 1
    raw = memoryview(ids.tobytes())
    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
    return {
        "row": row,
        "start": begin - doc_start[row],
        "length": end - begin,
        "ids_crc32": np.asarray(crc, np.int64),
        "doc_tokens": np.diff(doc_start)[row],
        "sequence": sequence,
        "offset": begin - cuts[sequence],
        "ids": ids,
        "begin": begin,
    }


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row for each piece; `tokenizer` is the path of a file that every executor has (the public one by default)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encoder = Encoder(tokenizer or public_tokenizers.path(TOKENIZER))
        sequence = TaskContext.get().partitionId() << 36
        for batch in batches:
            for low, high, _, _ in chunks(batch.column("text")):
                texts = pc.fill_null(batch.column("text").slice(low, high - low), "").to_pylist()
                p = pack_texts(encoder, texts, capacity)
                ids = batch.column("doc_id").slice(low, high - low).cast(pa.int64()).take(pa.array(p["row"]))
                columns = [ids, *(pa.array(p[c].astype(np.int64)) for c in ("start", "length", "ids_crc32", "doc_tokens"))]
                columns += [pa.array(p["sequence"] + sequence), pa.array(p["offset"])]
                names = [c.split()[0] for c in SCHEMA.split(", ")]
                if with_ids:
                    edges = np.append(p["begin"], len(p["ids"])).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(p["ids"].astype(np.int32))))
                    names.append("ids")
                sequence += int(p["sequence"][-1]) + 1
                yield pa.RecordBatch.from_arrays(columns, names)

    return in_tasks(docs.select("doc_id", "text"), run, SCHEMA + (", ids array<int>" if with_ids else ""))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
