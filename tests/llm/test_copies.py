"""Shingle join, repeated byte strings and components, against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from cashweave.llm import components, ngram_join, suffix_dedup
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n long, sid string").repartition(3)


def words(rng, n):
    return " ".join("".join(rng.choice("abcde") for _ in range(4)) for _ in range(n))


def copies(seed):
    """Texts with near copies of several degrees, a common tail, exact copies and odd rows."""
    rng = random.Random(seed)
    tail, rows = words(rng, 30), []
    for base in range(8):
        text = words(rng, 40).split()
        for k in range(5):
            new = list(text)
            for _ in range(k):
                new[rng.randrange(len(new))] = words(rng, 1)
            rows.append(" ".join(new) + (" " + tail if base % 3 == 0 else ""))
    drift = words(rng, 60).split()  # each links with the next one only
    for k in range(14):
        rows.append(" ".join(drift))
        drift[(5 * k) % 60] = words(rng, 1)
    rows += [rows[0], rows[0].upper(), None, "", " \t", "one two", "ONE  two", "one two three", "x " * 9000, "x " * 100, words(rng, 20_000)]
    rng.shuffle(rows)
    return [(3 * i + 5, t, i, "s") for i, t in enumerate(rows)] + [(5, rows[0], 1, None), (None, rows[0], 1, None)]


def plain_components(rows):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").translate(LOWER).replace("\t", " ").split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    known = [i for i, r in enumerate(rows) if r[0] is not None]
    least = {i: rows[i][0] for i in known}
    changed = True
    while changed:
        changed = False
        for i in known:
            for j in known:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and least[j] < least[i]:
                    least[i], changed = least[j], True
    return sorted(((r[0], len(sets[i]), least.get(i)) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("block", [4096, 3])
def test_join(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    rows = copies(block)
    got = [tuple(r) for r in ngram_join.similar_documents(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == plain_components(rows)


def test_join_of_empty_tables(spark):
    assert ngram_join.similar_documents(frame(spark, [])).count() == 0
    assert [tuple(r) for r in ngram_join.similar_documents(frame(spark, [(4, None, 1, "")])).collect()] == [(4, 0, 4)]


@pytest.mark.parametrize("seed", range(6))
def test_family_links_as_pairs_do(seed):
    rng = np.random.default_rng(seed)
    base = [np.sort(rng.choice(200, 40, replace=False)) for _ in range(3)]
    sets = [np.unique(np.concatenate((rng.choice(b, rng.integers(28, 41), replace=False), rng.integers(200, 260, rng.integers(0, 6))))) for b in base for _ in range(15)]
    union = ngram_join.link_family([s.astype(np.uint64) for s in sets], list(range(len(sets))), None, 75)
    plain = ngram_join.Union()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            c = len(np.intersect1d(a, b))
            if 100 * c >= 75 * (len(a) + len(b) - c):
                plain.join(i, j)
    assert [union.find(i) for i in range(len(sets))] == [plain.find(i) for i in range(len(sets))]


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)]
    union = ngram_join.Union()
    for a, b in pairs:
        union.join(a, b)
    rows = [*pairs, *pairs[:9], (7, None), (None, 7), (500, 500)]
    got = dict(components.components(spark.createDataFrame(rows, "a long, b long")).collect())
    assert got == {x: union.find(x) for x in union.parent if any(x != y and union.find(x) == union.find(y) for y in union.parent)}


def byte_rows(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    a, b, c = text(400), text(700), text(396)
    rows = [text(50) + a + text(60), a, text(10) + a[1:] + text(30), b + text(5) + b[100:], text(300) + b[:650], "ab" * 900, "abab" * 300, "z" * 399, "z" * 401]
    rows += [text(1200), c + "12", c + "123", "q" + c + "1234", None, "", text(3000) + "abc", a[:399], b[10:420] + a[:390]]
    near = text(900)
    for _ in range(6):
        i = rng.randrange(900)
        rows.append(near[:i] + text(3) + near[i:])
    return [(i, t, i, "x") for i, t in enumerate(rows)] + [(40, b, 1, None), (41, b, 1, None), (41, b, 1, None), (0, text(800), 1, None)]


def plain_bytes(rows, length):
    seen = {}
    raw = [(t or "").encode() for _, t, *_ in rows]
    for d in raw:
        for s in range(len(d) - length + 1):
            seen[d[s : s + length]] = seen.get(d[s : s + length], 0) + 1
    out = []
    for (i, *_), d in zip(rows, raw, strict=True):
        gone = bytearray(len(d))
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [100_000, 1])
def test_repeated_bytes(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = byte_rows(1)
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in suffix_dedup.op8_suffix_dedup(spark, str(tmp_path)).collect())
    assert got == plain_bytes(rows, 400)


def test_repeated_bytes_of_long_texts_and_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    rows = byte_rows(5)
    frame(spark, [*rows, (None, rows[0][1], 1, None)]).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in suffix_dedup.op8_suffix_dedup(spark, str(tmp_path)).collect()]
    assert sorted(r for r in got if r[0] is not None) == plain_bytes(rows, 400)
    assert [r[1:4] for r in got if r[0] is None] == [(len(rows[0][1].encode()), 0, 0)]
    frame(spark, []).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert suffix_dedup.op8_suffix_dedup(spark, str(tmp_path / "none")).count() == 0


def test_join_of_a_template(spark, monkeypatch):
    """Texts that share prefix shingles of a template and are not alike meet no other block; likes do, a few at a time."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 12)
    dealt, meetings = [], ngram_join.meetings

    def seen(hot, asking, percent):
        out = meetings(hot, asking, percent)
        dealt.append((hot.count(), out.drop("members").toPandas()))
        return out

    monkeypatch.setattr(ngram_join, "meetings", seen)
    rng = random.Random(4)
    common = words(rng, 80)
    texts = [f"{common} {words(rng, 24)}" for _ in range(150)]
    near = [t.rsplit(" ", 2)[0] + " " + words(rng, 2) for t in texts[:6]]
    rows = [(i, t, 1, "") for i, t in enumerate(texts + near)]
    got = [tuple(r) for r in ngram_join.similar_documents(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == plain_components(rows)
    stored, met = dealt[0]
    assert stored > 10 * ngram_join.BLOCK_SETS
    assert met[met.asks == 1].sid.nunique() <= 2 * len(near)
    assert met.groupby(["family", "part", "turn"]).size().max() <= 4 * ngram_join.BLOCK_SETS


def test_meetings_in_turns(spark, monkeypatch):
    """All sets of a family ask: a task still holds two blocks, and every pair of likes in different blocks meets."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 10)
    rng = np.random.default_rng(3)
    sets = [np.sort(np.concatenate((rng.choice(40, 32, replace=False), rng.integers(100, 10**6, 3)))).astype("<u8") for _ in range(120)]
    rows = [(7, 12, i % 12, i, s.tobytes()) for i, s in enumerate(sets)]
    hot = spark.createDataFrame(rows, "family long, blocks int, part int, sid long, members binary")
    met = ngram_join.meetings(hot, hot.select("sid"), 75).toPandas()
    sizes = met.groupby(["part", "turn", "asks"]).size()
    assert sizes.max() <= 25 and met.turn.max() > 4 and set(sizes.xs(0, level="asks")) == {10}
    goes = set(met[met.asks == 1][["sid", "part"]].itertuples(index=False, name=None))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            c = len(np.intersect1d(a, b))
            if i % 12 != j % 12 and 100 * c >= 75 * (len(a) + len(b) - c):
                assert (i, j % 12) in goes


def test_repeated_bytes_of_an_anchor_often_in_few_texts(spark, tmp_path, monkeypatch):
    """Slices, not texts, fill a task: six texts with twenty contexts each of one passage take the path by hash."""
    monkeypatch.setattr(suffix_dedup, "HOT", 60)
    called, marks = [], suffix_dedup.hot_marks
    monkeypatch.setattr(suffix_dedup, "hot_marks", lambda *a: called.append(1) or marks(*a))
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(300)
    texts = ["".join(passage + text(120) for _ in range(20)) for _ in range(6)]
    texts[3] = texts[3][:2000] + texts[1][700:1300] + texts[3][2000:]
    rows = [(i, t, i, "x") for i, t in enumerate(texts)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in suffix_dedup.op8_suffix_dedup(spark, str(tmp_path)).collect())
    assert called and got == plain_bytes(rows, 400) and any(r[2] for r in got)


def test_prefix_tree_finds_all_similar_sets_and_leaves_subtrees():
    """Families around templates, cut and changed to all degrees: the same sets as by comparing all, from a part of the nodes."""
    rng = np.random.default_rng(8)
    sets = []
    for start in range(0, 3000, 300):
        for _ in range(40):
            kept = rng.random(100) < rng.choice([0.5, 0.8, 0.97])
            sets.append(np.sort(np.concatenate((start + np.flatnonzero(kept), 4000 + rng.choice(500, rng.integers(0, 30), replace=False)))))
    sets += [np.array([1]), np.array([1, 2]), np.arange(7), np.arange(8), np.arange(9), np.arange(24), np.arange(25), np.arange(3000)]
    sets = [np.unique(s) for s in sets]
    tree = ngram_join.PrefixTree(sets, np.arange(len(sets)), 75, 5000)
    for i, members in enumerate(sets):
        want = {j for j, other in enumerate(sets) if 100 * len(np.intersect1d(members, other)) >= 75 * len(np.union1d(members, other))}
        assert set(tree.items[tree.similar(members)].tolist()) == want, i
    assert tree.size <= sum(map(len, sets))
    assert tree.visited < tree.size * len(sets) / 4


def test_prefix_tree_reads_a_shared_beginning_once():
    sets = [np.append(np.arange(24), 100 + i) for i in range(50)]
    tree = ngram_join.PrefixTree(sets, np.arange(50), 75, 200)
    assert tree.size == 24 + 50
    assert len(tree.similar(sets[0])) == 50 and tree.visited == tree.size
    tree.alive[:49] = False
    assert tree.items[tree.similar(sets[0])].tolist() == [tree.items[49]]


def test_families_leave_out_sets_that_share_too_little(spark):
    """A common shingle makes no family, neither if many sets hold it nor if its place says that too much stands before it."""
    rng = random.Random(8)
    common = words(rng, 5)
    hub = [f"{words(rng, 60)} {common} {words(rng, 60)}" for _ in range(100)]
    halves = []
    for _ in range(300):  # 75 and 100 shingles, one in common: the smaller set would have to be all in the larger one
        passage = words(rng, 5)
        halves += [f"{words(rng, 37)} {passage} {words(rng, 37)}", f"{words(rng, 49)} {passage} {words(rng, 50)}"]
    near = words(rng, 80).split()
    texts = [*hub, *halves, " ".join(near), " ".join([*near[:-1], "zzzz"])]
    docs = frame(spark, [(i, t, 1, "s") for i, t in enumerate(texts)])
    described = ngram_join.describe(docs).where("block is null").select("doc_id", "n", "sid").cache()
    at = 1 << 16
    ranks = np.ones(at, np.uint8)  # the hub's shingle first, all others by their hashes
    raw = common.encode()
    _, value = ngram_join.shingle_sets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    ranks[int(value[0]) & (at - 1)] = 0
    found = {r["node"] for r in ngram_join.families(docs, described, ranks, 5, 75).collect()}
    ids = {r["sid"]: r["doc_id"] for r in described.collect()}
    held = {ids[x] for x in found}
    assert {len(texts) - 2, len(texts) - 1} <= held
    assert not held & set(range(len(hub)))
    assert len(held) < 30  # 152 by counts alone; a passage right at the smaller set's start can still be of a whole copy


def test_order_tells_common_shingles_from_rare_ones_however_many_share_a_counter():
    rng = np.random.default_rng(4)
    totals = rng.poisson(4000, 1 << 16)
    totals[:500] += 400  # less than an eighth of an octave
    ranks = ngram_join.levels(totals)
    assert ranks[:500].min() > np.quantile(ranks[500:], 0.9)
    order = np.argsort(totals, kind="stable")
    assert (np.diff(ranks[order].astype(int)) >= 0).all()
    assert len(np.unique(ngram_join.levels(np.arange(40)))) > 20


def test_staged_results_give_their_shuffles_back(spark):
    import time

    def shuffled():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {x for x in blocks.mkString(" ").split() if x.startswith("shuffle_")}

    before = shuffled()
    staged = ngram_join.restage(spark.range(2000).repartition(7, "id").groupBy((F.col("id") % 100).alias("k")).count(), "shuffles")[0]
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    assert staged.count() == 100


def test_stage_of_near_copies_leaves_no_counters_and_classes(spark, tmp_path, monkeypatch):
    import os

    import corpus_pipeline
    from cashweave.llm import common

    monkeypatch.setattr(common, "shared_folder", lambda spark: str(tmp_path))
    rows = copies(9)
    kept = corpus_pipeline.drop_near_copies(spark, frame(spark, rows), "")
    staged = {name.rpartition("-")[0] for name in os.listdir(tmp_path)}
    assert {"copies", "repeated"} <= staged
    assert not staged & {"classes", "linked-rows", "counted-sets", "families", "family-sets"}
    assert not any("counts" in spark.read.parquet(str(tmp_path / name)).columns for name in os.listdir(tmp_path) if name.startswith("sets"))
    got = [r["text"] for r in kept.collect()]
    first = {}  # of each component the smallest id, null ids last; of rows equal in id and text one
    numbered = [(i, *r[1:]) for i, r in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)))]
    texts = {i: t for i, t, *_ in numbered}
    for i, _, component in plain_components(numbered):
        first[component] = min(first.get(component, i), i)
    blank = [t for t in texts.values() if not (t or "").split()]
    assert sorted(map(str, got)) == sorted([str(texts[i]) for c, i in first.items() if (texts[i] or "").split()] + list(map(str, blank)))
