"""Hard negatives, prefix tries and mixes against brute force, and their odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cashweave.llm import hard_negatives, mixing, prefix_trie
from cashweave.llm.ordered import sums_before

FOLDER = "/root/testdata/sf0.001"

# --- hard negatives ------------------------------------------------------------


def plain_negatives(rows):
    """(vec_id, embedding, label) rows to the result, all pairs."""
    kept = []
    for i, (vec_id, x, label) in enumerate(rows):
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        kept.append((vec_id, label, [max(-(1 << 25), min(1 << 25, math.floor(256 * float(np.float32(c))))) for c in x], i))
    out = []
    for vec_id, label, x, i in kept:
        if vec_id is None or vec_id % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(x, y)), v is None, v or 0, j, same == label, v) for v, same, y, j in kept if j != i]
        scored.sort(key=lambda s: s[:4])
        for p in [s for s in scored if s[4]][:5]:
            fits = [s for s in scored if not s[4] and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0]][:5]
            out += [(vec_id, p[5], rank, n[5], -p[0], -n[0]) for rank, n in enumerate(fits, 1)]
    return sorted(out, key=repr)


def mined(spark, rows, **limits):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = hard_negatives.hard_negatives(df, **limits)
    return sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=repr)


def cloud(rng, n, centers=12, width=16):
    middle = rng.normal(size=(centers, width))
    at = rng.integers(0, centers, n)
    x = middle[at] + 0.05 * rng.normal(size=(n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, [float(c) for c in v], int(a % 10)) for i, (v, a) in enumerate(zip(x, at))]


def test_negatives_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROUNDS", (0, 50, 400, math.inf))
    monkeypatch.setattr(hard_negatives, "ROWS_PER_CELL", 16)
    monkeypatch.setattr(hard_negatives, "PART_ROWS", 40)
    monkeypatch.setattr(hard_negatives, "PART_ANCHORS", 3)
    rows = cloud(np.random.default_rng(3), 1500)
    # a third of all rows is one vector of one label, so its anchors tie with hundreds of rows
    rows += [(i, rows[0][1], 4) for i in range(1500, 2200)]
    want = plain_negatives(rows)
    assert len(want) > 200 and mined(spark, rows) == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (100, [0.5, 0.5], 1), (None, [1.0, 0.1], 1), (None, [1.0, 0.0], 2), (5, [1.0, 0.0], None),
        (6, None, 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 2), (10, [1.0, None], 2), (11, [0.9, 0.0], 3), (12, [0.9, 0.0], 3), (13, [], 4),
        (15, [0.9], 2), (16, [1.0, 0.0, 3.0], 5), (200, [0.0, 0.0], 6), (17, [0.0, 0.0], 6), (300, [-1.0, -1.0], 8), (18, [1.0, 1.0], 8),
        (19, [3e38, -3e38], 9), (-100, [0.7, 0.1], 3),
    ]
    assert mined(spark, rows) == plain_negatives(rows)
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(100, None, None)]) == []


def test_cells_are_visited_by_falling_bounds_and_left_when_certified():
    rng = np.random.default_rng(1)
    first, second = rng.normal(size=9), rng.normal(size=7)
    sums = [(s, i, j) for s, i, j in hard_negatives.multi_sequence(first, second)]
    assert len({(i, j) for _, i, j in sums}) == 63
    assert all(a[0] >= b[0] for a, b in zip(sums, sums[1:])) and all(s == first[i] + second[j] for s, i, j in sums)
    points = np.array([v for _, v, _ in cloud(rng, 800)]) * 256
    books = tuple(hard_negatives.codebook(points[:, h], 6) for h in (slice(0, 8), slice(8, 16)))
    placed = [hard_negatives.nearest(points[:, h], b) for h, b in zip((slice(0, 8), slice(8, 16)), books)]
    radii = tuple(np.array([d[c == k].max(initial=0) for k in range(len(b))]) for (c, d), b in zip(placed, books))
    counts = np.bincount(placed[0][0] * 6 + placed[1][0], minlength=36)
    cells = hard_negatives.Cells(16, books, radii, counts)
    scores = points @ points[0]
    low = int(np.sort(scores)[-20])
    goes = list(hard_negatives.visited(cells, points[0], low, 1 << 62, 0, math.inf))
    held = placed[0][0] * 6 + placed[1][0]
    assert set(held[scores >= low]) <= set(goes) and len(goes) < np.count_nonzero(counts)


def test_askings_leave_a_task_in_small_batches():
    rng = np.random.default_rng(6)
    side, width = 40, 8
    books = rng.normal(size=(2, side, width // 2)) * 256
    counts = rng.integers(0, 400, side * side)
    cells = hard_negatives.Cells(width, tuple(books), tuple(np.full(side, 1e4) for _ in range(2)), counts)  # no bound excludes a cell
    runs = hard_negatives.bins(counts)
    held = np.bincount(runs.of, counts, len(runs.first))
    assert held.max() <= hard_negatives.PART_ROWS and len(runs.first) < side * side / 10
    q = rng.integers(-200, 200, (900, width))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(900)), pa.array(np.zeros(900, np.int64)), hard_negatives.packed(q), pa.array([[-(1 << 62)]] * 900), pa.array([[1 << 62]] * 900)],
        names=["_anchor", "label", "v", "lows", "highs"],
    )
    seen = Counter()
    for out in hard_negatives.asked_for(batch, cells, runs, 0, math.inf):
        assert out.num_rows <= hard_negatives.ASKS + len(runs.first) and out.nbytes < 1_000_000
        for anchor, number, marks in zip(*(out.column(c).to_pylist() for c in ("_anchor", "_bin", "_marks"))):
            asked = np.flatnonzero(np.unpackbits(np.frombuffer(marks, np.uint8))) + runs.first[number]
            assert (counts[asked] > 0).all() and (runs.of[asked] == number).all()
            seen[anchor] += len(asked)
    assert seen == {a: np.count_nonzero(counts) for a in range(900)}


# --- prefix trie -----------------------------------------------------------------


def plain_trie(turns):
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own[conv].append(((turn is not None, turn or 0), role, digest, text))
    own = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        built[c] = tuple(own.get(base, [])[:h] + v[h:])
    nodes = defaultdict(set)
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes[v[:d]].add(c)
    out = []
    for p, members in nodes.items():
        lower = [q for q in nodes if q[: len(p)] == p]
        kids = {q for q in lower if len(q) == len(p) + 1}
        leaves = [q for q in lower if not any(r[: len(q)] == q and len(r) > len(q) for r in lower)]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in lower if q)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(built[c]) == len(p)))
        up = min(nodes[p[:-1]]) if p else None
        out.append((min(members), len(p), up, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(spark, turns, blocks=None):
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    return sorted(map(tuple, prefix_trie.prefix_trie(prefix_trie.rebuilt(df), blocks).collect()), key=repr)


def talk(rng, n, words=2, most=12):
    turns = []
    for c in rng.sample(range(-n, 3 * n), n):
        turns += [(c, t, rng.choice("ua"), "x" * rng.randint(0, words)) for t in range(rng.randint(1, most))]
    return turns


@pytest.mark.parametrize("blocks", [1, 2, 9])
def test_tries_are_those_of_all_prefixes(spark, blocks):
    rng = random.Random(blocks)
    turns = talk(rng, 60)
    copy = [(t, "u", "same é") for t in range(14)]  # a third of all conversations, over several blocks
    turns += [(1000 + c, *row) for c in range(30) for row in copy]
    assert trie(spark, turns, blocks) == plain_trie(turns)


def test_long_ends_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 7)
    turns = [(c, 0, "u", "a") for c in range(0, 900, 5)] + [(c, 1, "u", "b") for c in range(0, 300, 5)]
    assert trie(spark, turns, 6) == plain_trie(turns)


def test_odd_conversations(spark):
    turns = [
        (None, 0, "u", "a"), (5, None, "u", "first"), (5, 1, None, "b"), (5, 1, "u", None), (5, 1, "u", None), (6, 0, "", ""), (6, 0, None, None),
        (7, 0, "u", "x" * 50_000), (8, 0, "u:", "x"), (9, 0, "u", ":x"), (-3, 0, "u", "a"), (0, 0, "u", "a"), (10, 2, "u", "漢"),
    ] + [(11, t, "u", "long") for t in range(300)]
    want = plain_trie(turns)
    assert trie(spark, turns) == want and trie(spark, turns, 3) == want
    assert trie(spark, []) == [] and trie(spark, [(None, 1, "u", "a")]) == []


def test_range_minima():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 17, 64):
        a = rng.integers(0, 5, n)
        table = prefix_trie.RangeMin(a)
        at, least = np.repeat(np.arange(n), 6), np.tile(np.arange(6), n)
        right, left = table.right(at, least), table.left(at, least)
        for i, d, r, l in zip(at, least, right, left):
            assert r == next((k for k in range(i, n) if k + 1 == n or a[k + 1] < d), n - 1)
            assert l == next((k for k in range(i, -1, -1) if k == 0 or a[k] < d), 0)
        first = rng.integers(0, n, 50)
        last = np.maximum(first, rng.integers(0, n, 50))
        assert table.least(first, last).tolist() == [a[x : y + 1].min() for x, y in zip(first, last)]


def test_common_turns():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.choice("ab") * prefix_trie.DIGEST for _ in range(rng.randint(0, 9))] for _ in range(2))
        want = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert prefix_trie.common("".join(a), "".join(b)) == want


# --- mixes -------------------------------------------------------------------------


def plain_targets(sizes, most=3):
    """Shares out in rounds, in exact fractions."""
    from fractions import Fraction

    share = dict(zip(sorted(sizes, key=lambda s: (s is None, (s or "").encode())), [5, 2, 1] * len(sizes)))
    goal = {s: Fraction(0) for s in sizes}
    left, open_ = Fraction(sum(sizes.values())), [s for s in sizes if sizes[s]]
    while left and open_:
        weight = sum(share[s] for s in open_)
        for s in open_:
            goal[s] += left * share[s] / weight
        left = sum((goal[s] - most * sizes[s] for s in open_ if goal[s] > most * sizes[s]), Fraction(0))
        goal.update({s: Fraction(most * sizes[s]) for s in open_ if goal[s] > most * sizes[s]})
        open_ = [s for s in open_ if goal[s] < most * sizes[s]]
    return {s: float(g) for s, g in goal.items()}


DOCS = "doc_id long, text string, source string"


@pytest.mark.parametrize("sizes", [
    {"a": 1, "b": 1000, "c": 50, None: 10}, {"a": 7}, {"a": 0, "b": 3}, {"a": 0, None: 0},
    {f"s{i:03}": (i * 37) % 101 for i in range(120)}, {"é": 5, "z": 100, "Z": 1},
])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(3)
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], rel=1e-12) for s in want)


def test_mix_takes_whole_epochs_and_then_a_weighted_sample(spark):
    rng = random.Random(6)
    # the hot source has over a third of all rows, many of them copies of one row
    rows = [(i, "w " * rng.randint(0, 40), "a") for i in range(500)] + [(7, "copy of one", "a")] * 400
    rows += [(1000 + i, "w " * rng.randint(1, 9), rng.choice(["b", "c", None])) for i in range(600)]
    weights = spark.createDataFrame([(i, 50.0) for i in range(0, 500, 10)], "doc_id long, weight double")
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs.repartition(5), weights).collect()
    again = mixing.mix(docs.repartition(2), weights).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    for own in by.values():
        target, size = own[0]["target"], own[0]["source_size"]
        assert size == sum(r["size"] for r in own) and sum(r["taken"] for r in own) == math.floor(target)
        epochs = math.floor(target) // size if size else 0
        assert all(epochs * r["size"] <= r["taken"] <= min(3, epochs + 1) * r["size"] for r in own)
        assert sum(epochs * r["size"] < r["taken"] < (epochs + 1) * r["size"] for r in own) <= 1  # one document is cut
    # in source c or b, whichever is drawn from, the order does not follow ids; heavy documents of a come first if a is drawn from
    heavy = [r["taken"] / r["size"] for r in by["a"] if r["size"] and r["doc_id"] < 500 and r["doc_id"] % 10 == 0]
    light = [r["taken"] / r["size"] for r in by["a"] if r["size"] and r["doc_id"] < 500 and r["doc_id"] % 10]
    assert np.mean(heavy) > np.mean(light)


def test_odd_documents_and_their_copies(spark):
    rows = [(None, "a b", "x"), (1, None, "x"), (2, "", None), (3, " \t\x0b\n", "y"), (4, "a b c", "y"), (5, "a b", None), (5, "a b", None), (6, "w " * 60_000, "z")]
    got = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in got) == [(0, 2), (1, 0), (2, 0), (3, 0), (4, 2), (5, 2), (5, 2), (6, 60_000)]
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    # weights that are no weights come last; other columns may be called like ours
    docs = spark.createDataFrame([(i, "one two three ", "s" if i else "t", i) for i in range(9)], DOCS + ", taken long")
    odd = spark.createDataFrame([(1, float("nan")), (2, 0.0), (3, -1.0), (4, None)], "doc_id long, weight double")
    plan = mixing.mix(docs, odd)
    assert plan.count() == 9 and plan.agg(F.sum("taken")).first()[0] == 26  # of 27, without two fractions
    copies = mixing.copies(docs, plan).collect()
    assert sum(len(r["text"].split()) for r in copies) == 26 and {tuple(r["text"].split()) for r in copies} <= {("one", "two", "three")[:k] for k in (1, 2, 3)}
    assert docs.columns + ["_mix_copy"] == mixing.copies(docs, plan).columns


def test_sums_along_a_global_order(spark):
    rng = random.Random(8)
    rows = [(rng.choice([0, 0, 0, 1, 2]), rng.randint(0, 9), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g long, v long, i long").repartition(4)
    got = {r["i"]: r["_before"] for r in sums_before(df, "g", "v", ["v", "i"], 7).collect()}
    sums = defaultdict(int)
    for g, v, i in sorted(rows):
        assert got[i] == sums[g]
        sums[g] += v
