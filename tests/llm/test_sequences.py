"""Packing and fingerprints against plain versions; the pipeline from end to end."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cashweave.llm import fingerprints, packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = " \n\t'strevlmd.,!19aZéß漢😀́-ñ \u0085"


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, start long, length string").repartition(3)


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("seed", range(4))
def test_ids_are_the_tokenizers(tokenizer, seed):
    some = [*texts(seed, 400), "", "it's'll", "a''s", "  'll", " \n ", "x  ", "<|endoftext|> x", "a<|endoftext|>b", "x  <|endoftext|><|endoftext|>", "<|endoftext|", "'<|endoftext|>s <|endoftext|>", "<|endoftext|>"]
    encoder = tokens.Encoder(PATH)
    for part in (some, some[::-1], [some[5]], ["", ""]):
        _, _, ids, first, _, _ = encoder.encode_texts(part)
        expected = [e.ids for e in tokenizer.encode_batch(part, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == expected


@pytest.mark.parametrize("seed", range(5))
def test_cuts_cost_the_least(seed):
    rng = np.random.default_rng(seed)
    places = np.unique(np.concatenate(([0], np.cumsum(rng.integers(1, 16, 60)))))
    costs = rng.choice([0.0, 4.0, 16.0], len(places))
    capacity = 20
    best = [0.0]
    for i in range(1, len(places)):
        options = [best[j] + (0 if places[i] - places[j] in packing.free_lengths(capacity) else capacity - (places[i] - places[j])) for j in range(i) if places[i] - places[j] <= capacity]
        best.append(min(options) + costs[i])
    cuts = packing.best_cuts(places, costs, capacity)
    sizes = np.diff(cuts)
    cost = sum(capacity - n for n in sizes if n not in packing.free_lengths(capacity)) + sum(costs[np.searchsorted(places, c)] for c in cuts[1:])
    assert cuts[0] == 0 and cuts[-1] == places[-1] and cost == pytest.approx(best[-1])


def test_packing(spark, tokenizer):
    rng = random.Random(6)
    rows = [(i, t, 1, "x") for i, t in enumerate(texts(9, 200))] + [(500, None, 1, "x"), (501, "", 1, "x"), (502, "word " * 40_000, 1, "x"), (None, "x", 1, "x"), (900, "again", 1, "x"), (900, "again", 1, "x")]
    rng.shuffle(rows)
    got = packing.pack(frame(spark, rows), with_ids=True).toPandas()
    sequences = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    for _, s in sequences:
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 1024
    for r in got.itertuples():
        assert r.length == len(r.ids) > 0 and r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes())
    for i, text, *_ in rows:
        if i is not None and i != 900:
            own = got[got.doc_id == i].sort_values("start")
            ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
            assert np.concatenate(own.ids.tolist()).tolist() == ids and set(own.doc_tokens) == {len(ids)}
            assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
    assert got[got.doc_id == 900].length.sum() == 2 * (len(tokenizer.encode("again").ids) + 1)
    total = sequences.length.sum()
    assert (1024 - total)[np.log2(total) % 1 > 0].sum() < 0.06 * total.sum()
    assert packing.pack(frame(spark, [])).count() == 0


# --- fingerprints ------------------------------------------------------------------


def plain_print(text):
    points, _ = tokens.code_points([text])
    moves, step, first = fingerprints._moves(), 0, []
    for row in fingerprints._class_rows(points).tolist():
        first.append(step)
        step += int(moves[row + (step & (fingerprints.PERIOD - 1))])
    return fingerprints.written(points, np.array(first, np.int64), step)


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "CHUNK_POINTS", 3000)
    rng = random.Random(8)
    some = [*texts(3, 150), "", "", "a", "word " * 4000, "long text " * 700]
    rows = [(7 * i, t, 1, "x") for i, t in enumerate(some)] + [(3, None, 1, "x")]
    rng.shuffle(rows)
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(frame(spark, rows)).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for (i, text, *_), (_, after, *_) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (plain_print(text), plain_print(edited))
        assert r["near_edited"] == fingerprints.likeness(plain_print(text), plain_print(edited))
        assert r["near_next"] == fingerprints.likeness(plain_print(text), plain_print(after))


def test_fingerprints_of_odd_tables(spark):
    assert fingerprints.edited_fingerprints(frame(spark, [])).count() == 0
    one = fingerprints.edited_fingerprints(frame(spark, [(1, "abcd", 1, "x")])).collect()
    assert [(r["n_chars"], r["edited_sha256"]) for r in one] == [(4, hashlib.sha256(b"abab").hexdigest())]
    same = fingerprints.edited_fingerprints(frame(spark, [(1, "abcd", 1, "x"), (1, "abcd", 1, "x"), (None, "ab", 1, "x")])).collect()
    assert sorted((r["n_chars"], r["fingerprint"]) for r in same) == sorted([(4, plain_print("abcd"))] * 2 + [(2, plain_print("ab"))])


def test_small_edits_stay_near():
    rng = random.Random(11)
    base = "".join(rng.choice("abcdefghij ") for _ in range(3000))
    edited = base[:700] + "x" + base[700:1500] + base[1502:]
    other = "".join(rng.choice("abcdefghij ") for _ in range(3000))
    a, b, c = fingerprints.fingerprints([base, edited, other])
    assert fingerprints.likeness(a, b) > 0.5 > fingerprints.likeness(a, c) + 0.2
    assert fingerprints.likeness(a, a) == 1 and fingerprints.likeness(a, "00") == 0


def test_near_documents(spark):
    rng = random.Random(12)
    base = ["".join(rng.choice("abcdefghij ") for _ in range(900)) for _ in range(4)]
    rows = [(10 * k + j, t if j < 2 else t[:880] + "changed at the end", 1, "x") for k, t in enumerate(base) for j in range(3)]
    rows += [(100, None, 1, "x"), (None, base[0], 1, "x")]
    got = fingerprints.near_documents(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in got) == sorted((i, 10 * (i // 10)) for i, *_ in rows if i is not None)


def template_rows(seed):
    """Families with a common head or tail and several degrees of edits, chains, copies and odd rows."""
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    head, tail, rows = text(120), text(120), []
    for family in range(6):
        base = text(rng.randrange(150, 900))
        for edits in (0, 1, 3, 8, 20):
            new = list(base)
            for _ in range(edits):
                new[rng.randrange(len(new))] = text(rng.randrange(3))
            rows.append((head if family % 2 else "") + "".join(new) + (tail if family % 3 == 0 else ""))
    rows += [head + text(200) for _ in range(8)] + [text(300) + tail for _ in range(6)]
    drift = text(700)
    for k in range(10):
        rows.append(drift)
        drift = drift[: 60 * k] + text(30) + drift[60 * k + 30 :]
    rows += [rows[0], rows[0], "", "", "a", "ab", text(20_000)]
    rng.shuffle(rows)
    return [(5 * i + 3, t, 1, "x") for i, t in enumerate(rows)] + [(3, "other text of a used id " * 9, 1, "x"), (900, None, 1, "x"), (None, rows[0], 1, "x")]


def plain_classes(rows, reachable):
    """The smallest id of what each row reaches by `reachable` pairs of fingerprints."""
    prints = [fingerprints.fingerprints([t or ""])[0] for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if prints[i] == prints[j] or reachable(prints[i], prints[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], least[find(i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize("bucket", [2048, 3])
def test_near_documents_lose_no_pair_that_shares_a_band(spark, monkeypatch, bucket):
    monkeypatch.setattr(fingerprints, "BUCKET", bucket)
    rows = template_rows(bucket)
    known = [r for r in rows if r[0] is not None]
    bands = {p: set(fingerprints.band_cells(p)) for _, t, *_ in known for p in fingerprints.fingerprints([t or ""])}

    def linked(a, b):
        return bool(bands[a] & bands[b]) and fingerprints.likeness(a, b) >= fingerprints.LIKE

    got = sorted((r["doc_id"], r["class_id"]) for r in fingerprints.near_documents(frame(spark, rows)).collect())
    assert got == plain_classes(known, linked)


def test_recall_of_near_documents(spark):
    rows = [r for r in template_rows(77) if r[0] is not None]
    print_of = [fingerprints.fingerprints([t or ""])[0] for _, t, *_ in rows]
    docs = [(i, t, 1, "x") for i, (_, t, *_) in enumerate(rows)]
    class_of = dict(map(tuple, fingerprints.near_documents(frame(spark, docs)).collect()))
    alike = [(i, j) for i in range(len(rows)) for j in range(i) if fingerprints.likeness(print_of[i], print_of[j]) >= fingerprints.LIKE]
    found = sum(class_of[i] == class_of[j] for i, j in alike)
    assert len(alike) > 20 and found >= 0.98 * len(alike)


def test_links_among_join_all_alike_classes():
    prints = fingerprints.fingerprints([t for _, t, *_ in template_rows(5) if t])
    nodes = np.arange(len(prints)) + 100
    pairs = {(i, j) for i in range(len(prints)) for j in range(i) if fingerprints.likeness(prints[i], prints[j]) >= 0.75}
    for side in (np.zeros(len(prints), int), np.arange(len(prints)) % 2):
        root = list(range(len(prints)))
        for a, b in fingerprints.links_among(nodes, nodes, side, prints, 0.75):
            assert (max(a, b) - 100, min(a, b) - 100) in pairs
            root = [root[b - 100] if r == root[a - 100] else r for r in root]
        assert all(root[i] == root[j] for i, j in pairs if not side.any() or side[i] != side[j])


def test_near_documents_of_odd_tables(spark):
    assert fingerprints.near_documents(frame(spark, [])).count() == 0
    assert fingerprints.near_documents(frame(spark, [(None, "abc", 1, "x")])).count() == 0
    rows = [(4, None, 1, "x"), (2, "", 1, "x"), (9, "q", 1, "x"), (9, "q", 1, "x")]
    assert sorted(map(tuple, fingerprints.near_documents(frame(spark, rows)).collect())) == [(2, 2), (4, 2), (9, 9), (9, 9)]


# --- pipeline -----------------------------------------------------------------------


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.stage(stage(spark, before, folder), name)
        assert after.columns == names
        kept, had = after.toPandas().set_index("doc_id"), before.toPandas().set_index("doc_id")
        assert kept.index.is_unique and set(kept.index) <= set(had.index) and len(kept) > 0.7 * len(had)
        assert (kept.n_chars == kept.text.str.len()).all()
        if name == "line_dedup":
            assert len(kept) == len(had) and all(len(t) <= len(had.text[i]) for i, t in kept.text.items())
        else:
            assert kept.text.to_dict() == had.text.loc[kept.index].to_dict()
        before = after
    packed = corpus_pipeline.run(spark, folder)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == set(kept.index)


def plain_near_copies(rows):
    """Indexes of the rows that stay: by components over all pairs of shingle sets, the smallest id of each."""
    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i] == rows[j] or both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return sorted((rows[min(own, key=lambda i: (rows[i][0] is None, rows[i][0] or 0))] for own in groups.values()), key=repr)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n))


def test_stages_decide_on_rows_not_on_ids(spark, tmp_path):
    rng = random.Random(21)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    near = a + " " + prose(rng, 3)
    leak = prose(rng, 12)
    rows = [
        (1, a), (2, near), (2, b), (3, c), (3, c), (3, d), (None, near), (None, prose(rng, 30)), (None, prose(rng, 30)),
        (4, ""), (5, ""), (None, None), (6, prose(rng, 20) + " " + leak + " " + prose(rng, 9)), (None, leak + " " + prose(rng, 40)), (6, prose(rng, 30)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()]
    assert sorted(kept, key=repr) == plain_near_copies(rows)
    assert (2, b) in kept and (3, d) in kept and (1, a) in kept and (None, near) not in kept
    clean = [tuple(r) for r in corpus_pipeline.decontaminate_benchmark(spark, docs, str(tmp_path)).collect()]
    assert sorted(clean, key=repr) == sorted((r for r in rows if leak not in (r[1] or "")), key=repr)


def test_stages_keep_what_plain_versions_keep(spark):
    """On the smallest tables: near copies against all pairs, benchmark windows word for word."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    near = corpus_pipeline.drop_near_copies(spark, docs, folder)
    assert sorted(((r["doc_id"], r["text"]) for r in near.collect()), key=repr) == plain_near_copies(rows)

    import re

    def words(text):
        return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))

    items = [words(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    hit = {i for i, t in rows for w in [words(t)] for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows}
    clean = corpus_pipeline.decontaminate_benchmark(spark, docs, folder)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - hit and hit
