"""Secret scans: candidate strings, and a random forest that removes false positives.

A candidate is a run of at least 14 letters, digits and `_-+/=`, without the name in
`name=value`; of what is assigned to a name of `NAMES`, `LEAST_NAMED` are enough. The forest
sees its length, character classes and the transitions between them, how much of it
dictionary words cover, the path (the document's source) and the words around it other than
those names; it is trained in numpy on labelled findings, at most `SAMPLE` of each label, and decides
on every candidate, also on what is assigned to a name.

A name counts whole or as a part of a longer one: `DB_PASSWORD`, `--api-key`, `accessKey`.
A rule says what some values are: words of frequent letter pieces, no letter or digit at all, or a card
number with its check digit. Such a value is a false finding if no name is near, or if it is assigned to
one (a placeholder). Any other value with a name right before it is a true finding. The rest has no label.

The dictionary is learned too: word pieces of `PIECE` letters, counted over all documents; the
`DICTIONARY` most frequent ones.

Defined cases: null and empty texts have no candidates; a null source is an empty path. Repeated
rows are scanned each. Without findings of both labels every candidate is kept. An empty
table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cashweave.llm.common import documents, in_tasks, restage
from cashweave.llm.language_id import fold

CANDIDATE = re.compile(r"(?<![A-Za-z0-9_\-+/=])[A-Za-z0-9_\-+/=]{14,}(?![A-Za-z0-9_\-+/=])")
SAMPLE, TREES, DEPTH, LEAST_LEAF = 2000, 24, 8, 4
PIECE, DICTIONARY, WORD_BITS, PATH_BITS = 3, 500, 5, 3
NAMES = ("token", "secret", "password", "passwd", "apikey", "api_key", "access_key", "private_key")
LEAST_NAMED, COVERED, COVERED_AT = 6, 0.25, 3
IS_NAME = f"(^|_)({'|'.join(NAMES)})[0-9]*(_|$)"


@dataclass
class Forest:
    """Trees as arrays over nodes: feature (-1: leaf), cut, left child, right child, value."""

    trees: list[tuple[np.ndarray, ...]]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.ones(len(x))
        total = np.zeros(len(x))
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                rows = np.flatnonzero(inner)
                node = at[rows]
                at[rows] = np.where(x[rows, feature[node]] <= cut[node], left[node], right[node])
            total += value[at]
        return total / len(self.trees)


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> Forest:
    """Trees on bootstrap samples, the best Gini cut among a random square root of the features at each node."""
    rng = np.random.default_rng(seed)
    if len(np.unique(y)) < 2:
        return Forest([])
    tries = max(1, int(np.ceil(np.sqrt(x.shape[1]))))
    out = []
    for _ in range(trees):
        nodes: list[list] = []
        pick = rng.integers(0, len(y), len(y))

        def build(rows: np.ndarray, left_depth: int) -> int:
            here = len(nodes)
            nodes.append([-1, 0.0, 0, 0, float(y[rows].mean())])
            if left_depth == 0 or len(rows) < 2 * LEAST_LEAF or y[rows].min() == y[rows].max():
                return here
            best = (np.inf, -1, 0.0)
            for f in rng.choice(x.shape[1], tries, replace=False):
                order = np.argsort(x[rows, f], kind="stable")
                v, t = x[rows[order], f], np.cumsum(y[rows[order]])
                n = np.arange(1, len(v) + 1)
                ok = np.flatnonzero((v[:-1] < v[1:]) & (n[:-1] >= LEAST_LEAF) & (len(v) - n[:-1] >= LEAST_LEAF))
                if not len(ok):
                    continue
                a, b = t[ok] / n[ok], (t[-1] - t[ok]) / (len(v) - n[ok])
                gini = n[ok] * a * (1 - a) + (len(v) - n[ok]) * b * (1 - b)
                i = int(gini.argmin())
                if gini[i] < best[0]:
                    best = (gini[i], f, (v[ok[i]] + v[ok[i] + 1]) / 2)
            if best[1] < 0:
                return here
            go = x[rows, best[1]] <= best[2]
            nodes[here][:2] = [int(best[1]), float(best[2])]
            nodes[here][2] = build(rows[go], left_depth - 1)
            nodes[here][3] = build(rows[~go], left_depth - 1)
            return here

        build(pick, depth)
        feature, cut, left, right, value = zip(*nodes, strict=True)
        out.append((np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(value)))
    return Forest(out)


def _kinds(text: str) -> np.ndarray:
    b = np.frombuffer(text.encode(), np.uint8)
    return np.where((b >= 48) & (b <= 57), 0, np.where((b >= 97) & (b <= 122), 1, np.where((b >= 65) & (b <= 90), 2, 3)))


def describe(value: str, path: str, around: list[str], dictionary: set[str]) -> list[float]:
    kinds = _kinds(value)
    share = np.bincount(kinds, minlength=4) / len(kinds)
    steps = np.bincount(kinds[:-1] * 4 + kinds[1:], minlength=16) / max(1, len(kinds) - 1)
    counts = np.unique(np.frombuffer(value.encode(), np.uint8), return_counts=True)[1] / len(value)
    low = value.lower()
    pieces = [low[i : i + PIECE] for i in range(len(low) - PIECE + 1)]
    covered = sum(p in dictionary for p in pieces) / max(1, len(pieces))
    hex_share = sum(c in "0123456789abcdef" for c in low) / len(low)
    words = np.zeros(1 << WORD_BITS)
    for word in around:
        words[zlib.crc32(word.lower().encode()) & ((1 << WORD_BITS) - 1)] += 1
    where = np.zeros(1 << PATH_BITS)
    where[zlib.crc32(path.encode()) & ((1 << PATH_BITS) - 1)] = 1
    return [len(value), len(value) % 4, -float((counts * np.log2(counts)).sum()), covered, hex_share, *share, *steps, *words, *where]


def _spellings(value: str, x: np.ndarray) -> Iterator[np.ndarray]:
    """The features of a finding as it is, and of its value in capitals and in small letters where they differ."""
    yield x
    for other in sorted({value.upper(), value.lower()} - {value}):
        own = np.array(describe(other, "", [], set())[: -(1 << WORD_BITS) - (1 << PATH_BITS)], "<f4")
        own[COVERED_AT] = x[COVERED_AT]  # the dictionary ignores case
        yield np.concatenate((own, x[len(own) :]))


_PART = re.compile(r"""[^\s"'`=:,;.(){}\[\]<>]+""")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_NAME = re.compile(IS_NAME)
_BEFORE = re.compile(r"[A-Za-z0-9_\-]*\Z")
_ASSIGNED = re.compile(
    "(?:" + "|".join(n.replace("_", "[_-]?") for n in NAMES) + r""")[A-Za-z0-9_\-]{0,40}["'`]?\s{0,4}(=>|:=|=|:)\s{0,4}(["'`]?)"""
    + r"([A-Za-z0-9_\-+/][A-Za-z0-9_\-+/=]{%d,})" % (LEAST_NAMED - 1),
    re.IGNORECASE,
)
_WORDS = re.compile(r"[-_/+=]*(?:(?:[a-z]+|[A-Z]+|[A-Z][a-z]+)(?:[-_/+=]+|\Z))*")
_SIGNS = re.compile(r"[-_/+=]*")


def _name(part: str) -> str:
    return _HUMP.sub("_", part).replace("-", "_").strip("_").lower()


def _card(value: str) -> bool:
    """A number of 13 to 19 digits whose last one is its check digit."""
    if not (13 <= len(value) <= 19 and value.isascii() and value.isdigit()):
        return False
    digits = [int(c) for c in reversed(value)]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def harmless(value: str, covered: float) -> bool:
    """A rule says what the value is: words, signs only, or a card number."""
    return _SIGNS.fullmatch(value) is not None or (covered >= COVERED and _WORDS.fullmatch(value) is not None) or _card(value)


def _assigned(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, by = or in quotes) of the values assigned to names."""
    out = []
    for m in _ASSIGNED.finditer(text):
        first = _BEFORE.search(text[max(0, m.start() - 40) : m.start()])[0]
        if _NAME.search(_name(first + _PART.match(text, m.start())[0])) and not _SIGNS.fullmatch(m[3]):
            out.append((m.start(3), m.end(3), bool(m[2]) or "=" in m[1]))
    return out


def candidates(text: str) -> Iterator[tuple[int, int, str, list[str], bool]]:
    """(start, end, value, around, surely assigned): around has up to three names before and one after, "" for none."""
    given = _assigned(text)
    starts = [a for a, _, _ in given]
    found = list(given)
    for m in CANDIDATE.finditer(text):
        i = bisect_left(starts, m.start())
        if i < len(starts) and starts[i] < m.end():
            continue
        left, _, right = m[0].partition("=")
        value = right.lstrip("=")
        cut = left and len(value) >= 14
        found.append((m.end() - len(value) if cut else m.start(), m.end(), False))
    for a, b, sure in sorted(found):
        before = [_name(p) for p in _PART.findall(text[max(0, a - 60) : a])]
        after = [_name(p) for p in _PART.findall(text[b : b + 30])]
        yield a, b, text[a:b], ([p for p in before if p] or [""])[-3:] + ([p for p in after if p] or [""])[:1], sure


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> set[str]:
    """The most frequent letter pieces of all documents; each task sends one row for each piece that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27**PIECE, np.int64)
        letters = np.full(256, 0, np.int64)
        letters[97:123] = letters[65:91] = np.arange(1, 27)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                text = "\n".join(t or "" for t in batch.column("text").slice(low, 256).to_pylist())
                x = letters[np.frombuffer(text.encode(), np.uint8)]
                n = len(x) - PIECE + 1
                if n > 0:
                    total += np.bincount(sum(x[k : k + n] * 27 ** (PIECE - 1 - k) for k in range(PIECE)), minlength=27**PIECE)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["code", "n"])

    counts = in_tasks(docs.select("text"), run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    out = set()
    for row in counts.orderBy(F.desc("n"), "code").limit(4 * size).collect():
        digits = [row["code"] // 27 ** (PIECE - 1 - k) % 27 for k in range(PIECE)]
        if all(digits) and len(out) < size:
            out.add("".join(chr(96 + d) for d in digits))
    return out


def findings(docs: DataFrame, words: set[str]) -> DataFrame:
    """(doc_id, start, end, value, around, named, harmless, x): every candidate with its features.

    `named`: surely assigned to a name of `NAMES`, or one stands right before what no rule takes for harmless.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "end", "value", "around", "named", "harmless", "x"]
        for batch in batches:
            out: list[tuple] = []
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                for doc_id, text, path in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "source")), strict=True):
                    for a, b, value, around, sure in candidates(text or ""):
                        x = describe(value, path or "", [w for w in around if w and not _NAME.search(w)], shared.value)
                        plain = harmless(value, x[COVERED_AT])
                        named = sure or (not plain and _NAME.search(around[-2]) is not None)
                        out.append((doc_id, a, b, value, around, named, plain, np.array(x, "<f4").tobytes()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.bool_(), pa.binary()]
            columns = zip(*out, strict=True) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "doc_id long, start long, end long, value string, around array<string>, named boolean, harmless boolean, x binary"
    return in_tasks(docs.select("doc_id", "text", "source"), run, schema)


def fit(found: DataFrame, label: Column, per_label: int = SAMPLE) -> Forest:
    """A forest from labelled findings: `label` is 1, 0, or null where unknown; a bounded sample of each.

    Each is also shown in capitals and in small letters, which do not change what a value is.
    """
    known = found.withColumn("label", label.cast("int")).where(F.col("label").isin(0, 1)).select("label", "x", "value")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = F.create_map(*(F.lit(v) for k in (0, 1) for v in (k, int(min(1.0, per_label / counts.get(k, 1)) * (1 << 30)))))
    rows = known.where(F.pmod(F.xxhash64("value", "x"), F.lit(1 << 30)) < F.element_at(share, F.col("label"))).collect()
    rows = sorted(rows, key=lambda r: (r["value"], bytes(r["x"])))  # about `per_label` of each label
    if not rows:
        return Forest([])
    forms = [(x, r["label"]) for r in rows for x in _spellings(r["value"], np.frombuffer(r["x"], "<f4"))]
    return grow(np.stack([x for x, _ in forms]), np.array([label for _, label in forms], float))


def scan(found: DataFrame, forest: Forest) -> DataFrame:
    """The findings with _secret, the share of the forest that takes them for secrets."""
    shared = found.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.stack([np.frombuffer(c, "<f4") for c in x])) if len(x) else [], dtype=float)

    return found.withColumn("_secret", score("x"))


def weak_label(around: Column, harmless: Column | None = None) -> Column:
    """1: a name of `NAMES` is right before what no rule takes for harmless; 0: harmless, and no name near or assigned to one; null: not known."""
    plain = F.col("harmless") if harmless is None else harmless
    near = F.exists(around, lambda w: w.rlike(IS_NAME))
    return F.when(F.element_at(around, -2).rlike(IS_NAME) & ~plain, 1).when(plain & (~near | F.col("named")), 0)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document; findings of the rows whose fold of 5 is not 0, labelled by name or rule, train the forest, which decides on all."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    found = restage(findings(docs, dictionary(docs)), "findings")[0]  # read for the counts, the sample and the scores
    forest = fit(found.where(~held_out), weak_label(F.col("around")))
    secret = F.col("_secret") >= 0.5
    kept = scan(found, forest).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.count_if(F.col("named") & ~secret).alias("n_named_removed"),
        F.sort_array(F.collect_list(F.when(secret, F.struct("start", "end", F.sha2("value", 256).alias("value_sha256"))))).alias("findings"),
    )
    return docs.select("doc_id", held_out.alias("held_out")).join(kept, "doc_id", "left").select(
        "doc_id",
        "held_out",
        F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"),
        F.coalesce(F.size("findings"), F.lit(0)).cast("long").alias("n_secrets"),
        F.coalesce("n_named_removed", F.lit(0)).cast("long").alias("n_named_removed"),
        "findings",
    )
