"""Hashed features of the distinct words of each text: the word, its first 5, 6 and 7 bytes, its last 2 and 3."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cashweave.llm.common import LOWERED, SPACE, chunks, in_tasks, prefix_sums, segment_hash, spans, table

BITS = 18
BUCKETS = 1 << BITS
PREFIXES, SUFFIXES = (5, 6, 7), (2, 3)
_LETTERS = np.zeros(256, bool)
_LETTERS[48:58] = _LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True
_TOKEN = table(outside=SPACE)


def distinct_words(data: np.ndarray, offsets: np.ndarray, letters: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, starts, ends, hash sums, words of each text): one place of each distinct lower-cased word."""
    data = LOWERED[data]
    starts, ends = spans((_LETTERS if letters else _TOKEN)[data], offsets)
    sums = prefix_sums(data)
    words = segment_hash(sums, starts, ends)
    first = np.searchsorted(starts, offsets)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((words, text))
    new = np.ones(len(order), bool)
    new[1:] = (text[order][1:] != text[order][:-1]) | (words[order][1:] != words[order][:-1])
    at = order[new]
    return text[at], starts[at], ends[at], sums, np.diff(first)


def features(data: np.ndarray, offsets: np.ndarray, suffixes: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, buckets of its distinct words: one row for each word, distinct words of each text)."""
    text, starts, ends, sums, total = distinct_words(data, offsets, letters=not suffixes)
    kinds = [segment_hash(sums, starts, ends)]
    kinds += [segment_hash(sums, starts, np.minimum(starts + n, ends)) + np.uint64(n) for n in PREFIXES]
    if suffixes:
        kinds += [segment_hash(sums, np.maximum(starts, ends - n), ends) + np.uint64(16 + n) for n in SUFFIXES]
    count = np.bincount(text, minlength=len(total))
    if suffixes:  # how often words repeat, in tenths, as a feature of every word
        share = (10 * count / np.maximum(total, 1)).astype(np.uint64)
        kinds.append(share[text] * np.uint64(0xA0761D6478BD642F) + np.uint64(77))
    buckets = np.stack([(k >> np.uint64(64 - BITS)).astype(np.int64) for k in kinds], 1) if len(text) else np.empty((0, len(kinds)), np.int64)
    return text, buckets, count


def sums_by_text(weights: np.ndarray, data: np.ndarray, offsets: np.ndarray, suffixes: bool) -> np.ndarray:
    """For each text the sum of the weights of its features, over the square root of its number of distinct words."""
    text, buckets, count = features(data, offsets, suffixes)
    total = np.bincount(text, weights[buckets].sum(axis=1), minlength=len(count)) if len(text) else np.zeros(len(count))
    return total / np.sqrt(np.maximum(count, 1))


def collected(rows: DataFrame, suffixes: bool) -> list[tuple[int, np.ndarray]]:
    """(label, buckets) of a sample whose size the caller has bounded; columns text, label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column("text")):
                text, buckets, count = features(data, offsets, suffixes)
                edges = np.concatenate(([0], np.cumsum(count)))
                cells = [buckets[a:b].astype("<u4").tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(low, high - low), pa.array(cells, pa.binary())], ["label", "f"])

    found = in_tasks(rows.select("text", "label"), run, "label int, f binary").collect()
    width = 1 + len(PREFIXES) + (len(SUFFIXES) + 1 if suffixes else 0)
    return [(r["label"], np.frombuffer(r["f"], "<u4").reshape(-1, width)) for r in found]


def usable(cells: list[np.ndarray], least: int) -> np.ndarray:
    """The features that at least so many texts of a sample have; others keep the weight 0."""
    held = np.zeros(BUCKETS, np.int64)
    for c in cells:
        held[np.unique(c)] += 1
    return held >= least


class Rows:
    """Sparse rows of a sample: the sum of a weight vector over each row's features, and the gradient of such sums."""

    def __init__(self, cells: list[np.ndarray], usable: np.ndarray):
        self.scale = 1 / np.sqrt(np.maximum([len(c) for c in cells], 1))
        cells = [c[usable[c]] for c in cells]
        self.size = np.array([c.size for c in cells])
        self.edges = np.concatenate(([0], np.cumsum(self.size)))
        self.flat = np.concatenate([c.reshape(-1) for c in cells]).astype(np.uint32) if cells else np.empty(0, np.uint32)

    def __len__(self) -> int:
        return len(self.size)

    def pick(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(features of the rows one after the other, place of its row for each)."""
        size = self.size[rows]
        edges = np.concatenate(([0], np.cumsum(size)))
        at = np.arange(edges[-1]) + np.repeat(self.edges[rows] - edges[:-1], size)
        return self.flat[at], np.repeat(np.arange(len(rows)), size)

    def score(self, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
        flat, place = self.pick(rows)
        return np.bincount(place, weights[flat], minlength=len(rows)) * self.scale[rows]

    def gradient(self, by_row: np.ndarray, rows: np.ndarray) -> np.ndarray:
        flat, place = self.pick(rows)
        return np.bincount(flat, (by_row * self.scale[rows])[place], minlength=BUCKETS)


class Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, weights: np.ndarray, gradient: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.01 * (gradient * gradient - self.v)
        weights -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)
