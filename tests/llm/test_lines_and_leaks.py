"""Line deduplication and decontamination on hand-made rows, against plain versions."""

import hashlib
import random
import re

import pytest

from cashweave.llm import decontaminate, line_dedup

LONG = "this line is long enough to be counted as a common one"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def plain_lines(rows):
    held = {}
    for i, text in rows:
        for k in {x.strip(" \t\n\x0b\x0c\r").translate(LOWER) for x in (text or "").split("\n")}:
            if len(k) >= 40:
                held.setdefault(k, []).append(i)
    common = {k: max(i for i in v if i is not None) for k, v in held.items() if len(v) >= 5}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (i is not None and i < common.get(x.strip(" \t\n\x0b\x0c\r").translate(LOWER), -1))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


LINE_ROWS = [
    *((i, f"only {i}\n  {LONG.upper() if i % 2 else LONG}\t\nend\n") for i in range(6)),
    (6, f"{LONG}\n{LONG}"),
    (7, None),
    (8, ""),
    (9, "ä" * 40),
    (9, "ä" * 40),
    *((i, "ä" * 39 + "\n" + "ä" * 40) for i in range(10, 14)),
    (14, "x" * 200_000 + "\n" + LONG),
    (None, LONG),
]


def test_lines(spark):
    got = line_dedup.dedup_lines(frame(spark, LINE_ROWS)).collect()
    got = [(r["doc_id"], r["_line_total"], r["_line_dropped"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in got]
    assert sorted(got, key=str) == plain_lines(LINE_ROWS)


def test_lines_keep_other_columns_and_empty_tables(spark):
    rows = [(i, LONG, "x", i) for i in range(5)]
    got = line_dedup.dedup_lines(frame(spark, rows, "doc_id long, text string, h string, n long")).collect()
    assert sorted((r["doc_id"], r["text"], r["h"], r["n"]) for r in got) == [(i, LONG if i == 4 else "", "x", i) for i in range(5)]
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_leaks(docs, items):
    words = lambda t: WORD.findall((t or "").translate(LOWER))
    windows = {}
    for item, text in items:
        w = words(text)
        if item is not None and w:
            n = min(10, len(w))
            windows.setdefault(item, set()).update(tuple(w[j : j + n]) for j in range(len(w) - n + 1))
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, known in windows.items():
            n = len(next(iter(known)))
            for s in range(len(w) - n + 1):
                if i is not None and tuple(w[s : s + n]) in known:
                    hit.update(range(s, s + n))
                    found.add(str(item))
        out.append((i, len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit)))
    return sorted(out, key=str)


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog while twelve more words follow here"),
    (10, "a b a b a b a b a b a b a b"),
    (2, "Short Item here"),
    (3, None),
    (4, " ... "),
    (None, "the quick brown fox jumps over the lazy dog while twelve more words follow here"),
    (1, "The quick brown fox jumps over the lazy dog while twelve more words follow here"),
    (5, "élan vital 42 über-alles naïve café ñandú one two three four"),
]
DOCS = [
    (1, "before: the QUICK brown fox, jumps over the lazy dog - while twelve! after"),
    (2, "the quick brown fox jumps over the lazy dog while"),
    (3, "quick brown fox jumps over the lazy dog"),
    (4, "b a b a b a b a b a b a b a b a"),
    (5, "a short item Here, and a short item there"),
    (6, None),
    (7, ""),
    (8, "élan vital 42 über alles naïve café ñandú one two three"),
    (8, "élan vital 42 über alles naïve café ñandú one two three"),
    (9, "ÉLAN vital 42 über alles naïve café ñandú one two three"),
    (None, "short item here"),
    (11, "w " * 30_000 + "brown fox jumps over the lazy dog while twelve more words follow here"),
]


def test_leaks(spark):
    got = decontaminate.contamination(frame(spark, DOCS), frame(spark, ITEMS, "item_id long, text string")).collect()
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], ",".join(r["items"]), r["contaminated"]) for r in got]
    assert sorted(got, key=str) == plain_leaks(DOCS, ITEMS)


def test_leaks_of_items_of_all_lengths_and_of_passages_that_many_items_hold(spark):
    """Few different words, so that places, items and lengths overlap in every way."""
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choices("abc", k=n))
    items = [(i, text(1 + i % 16)) for i in range(4, 60)] + [(100 + i, "z y x w v u t s r q " + text(i)) for i in range(30)]
    docs = [(i, text(rng.randrange(25))) for i in range(40)] + [(90, "z y x w v u t s r q"), (91, "y x w v u t s r q d")]
    got = decontaminate.contamination(frame(spark, docs), frame(spark, items, "item_id long, text string")).collect()
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], ",".join(r["items"]), r["contaminated"]) for r in got]
    assert sorted(got, key=str) == plain_leaks(docs, items)
    found = decontaminate.occurrences(frame(spark, docs), frame(spark, items, "item_id long, text string"))
    assert found.where("doc_id = 90").count() == 30 and found.where("doc_id = 91 and n = 10").isEmpty()


@pytest.mark.parametrize("docs, items", [([], ITEMS), (DOCS, [])])
def test_leaks_of_empty_tables(spark, docs, items):
    got = decontaminate.contamination(frame(spark, docs), frame(spark, items, "item_id long, text string"))
    assert [r for r in got.collect() if r["contaminated"]] == [] and got.count() == len(docs)


def test_decontamination_runs_no_python(spark):
    df = decontaminate.contamination(frame(spark, DOCS), frame(spark, ITEMS, "item_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
