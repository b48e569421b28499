"""Language identification, toxicity, quality and secret scans: held-out accuracy and odd rows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cashweave.llm import language_id, quality, secret_scan, toxicity
from cashweave.llm.word_features import BUCKETS, features

FOLDER = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " 12 -- 34 "), (4, "漢字"), (5, "a"), (5, "a"), (6, "the " * 60_000), (None, "the und for")]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).repartition(3)


# --- languages -------------------------------------------------------------------


def speech(rng, vocabulary, n=30):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


VOICES = {"xx": ["kalo", "mira", "tupe", "lokra", "sun"], "yy": ["schtz", "wrrg", "ompf", "grntz", "üff"], "zz": ["éaé", "oué", "iaô", "ouia", "eau"]}


def test_languages_held_out(spark):
    rng = random.Random(1)
    rows = [(i, speech(rng, VOICES[v], rng.randint(2, 60)), v) for i, v in enumerate(rng.choices(sorted(VOICES), k=300))]
    docs = frame(spark, rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs.where("doc_id < 200"))
    got = language_id.identify(docs.where("doc_id >= 200"), model).collect()
    assert np.mean([r["lang"] == r["_lang_pred"] for r in got]) > 0.97
    assert np.mean([r["_lang_rejected"] for r in got]) < 0.05


def test_languages_of_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, speech(rng, VOICES[v]), v) for i, v in enumerate(sorted(VOICES) * 20)] + [(900, None, "xx"), (901, "kalo", None), (None, "kalo", "qq")]
    model = language_id.fit(frame(spark, rows, "doc_id long, text string, lang string"))
    assert model.languages == ["xx", "yy", "zz"]
    got = language_id.identify(frame(spark, ODD), model).collect()
    assert len(got) == len(ODD)
    for r in got:
        und = not any(c.isalpha() for c in r["text"] or "")
        assert (r["_lang_pred"] == "und") == und and (r["_lang_score"] == 0) == und and r["_lang_rejected"] >= und
        assert 0 <= r["_lang_score"] <= 1
    assert len({(r["_lang_pred"], r["_lang_score"]) for r in got if r["doc_id"] == 5}) == 1


def test_languages_without_labels(spark):
    model = language_id.fit(frame(spark, [], "doc_id long, text string, lang string"))
    got = language_id.identify(frame(spark, ODD), model).collect()
    assert {(r["_lang_pred"], r["_lang_score"], r["_lang_rejected"]) for r in got} == {("und", 0.0, True)}
    assert language_id.identify(frame(spark, []), model).count() == 0


def test_folded_scores_are_the_models():
    texts = pa.array(["Kalo mira", "x", None, "éaé oué"])
    rng = np.random.default_rng(0)
    scores = np.vstack([rng.normal(size=(language_id.BUCKETS, 2)), np.zeros((1, 2))]).astype(np.float32)
    model = language_id.Model(["a", "b"], scores, np.array([0.1, -0.1], np.float32), 1.0, 0.0)
    best, sure = language_id.predict(model, texts)
    for row, buckets, counts in language_id.counted(texts):
        if len(buckets):
            z = counts @ scores[buckets] / counts.sum() + model.bias
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            assert best[row] == p.argmax() and sure[row] == pytest.approx(p.max(), abs=1e-5)


# --- toxicity and quality ----------------------------------------------------------


def test_toxicity_held_out(spark):
    rows = toxicity.op3_toxicity(spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    got = rows.join(labels, "doc_id").where("toxic is not null").toPandas()
    assert rows.count() == 1000 and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    rank = got.score.rank()
    one = got.toxic == 1
    auc = (rank[one].sum() - one.sum() * (one.sum() + 1) / 2) / one.sum() / (~one).sum()
    assert auc > 0.85  # training rows too: fifty toxic documents are too few to judge held-out ones alone


def test_toxicity_learns_from_positives_and_unlabelled(spark):
    rng = random.Random(3)
    clean = ["stone", "river", "cloud", "meadow", "lantern", "harvest", "window", "bridge"]
    rows = []
    for i in range(600):
        bad = i % 5 == 0
        rows.append((i, " ".join(rng.choice(clean) for _ in range(30)) + (" grimble vexnar" if bad else "")))
    docs = frame(spark, rows)
    model = toxicity.fit(docs.where("doc_id < 400"), docs.where("doc_id < 400 and doc_id % 5 = 0").select("doc_id"), 0.2)
    got = toxicity.score(docs.where("doc_id >= 400"), model).collect()
    assert all((r["_toxic_score"] >= 0.5) == (r["doc_id"] % 5 == 0) for r in got)
    odd = toxicity.score(frame(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["_toxic_score"] <= 1 for r in odd)
    none = toxicity.fit(docs, docs.where("false").select("doc_id"), 0.1)
    assert {round(r["_toxic_score"], 6) for r in toxicity.score(frame(spark, ODD), none).collect()} == {0.1}


def test_quality_orders_grades(spark):
    rng = random.Random(4)
    words = [["###", "!!"], ["stone", "river"], ["meadow", "lantern"]]
    rows = [(i, " ".join(rng.choice(words[i % 3]) for _ in range(20)) + " and the", i % 3) for i in range(300)]
    docs, known = frame(spark, [r[:2] for r in rows]), frame(spark, [(r[0], r[2]) for r in rows[:200]] + [(None, 1), (1, None)], "doc_id long, grade int")
    model = quality.fit(docs, known)
    assert list(np.diff(model.thresholds) > 0) == [True] and model.grades == [0, 1, 2]
    got = quality.rate(docs.where("doc_id >= 200"), model).collect()
    assert np.mean([round(r["_grade"]) == r["doc_id"] % 3 for r in got]) > 0.95
    assert all(0 <= r["_tail"] <= 1 for r in quality.rate(frame(spark, ODD), model).collect())
    assert quality.rate(frame(spark, []), model).count() == 0
    one = quality.fit(docs, known.where("grade = 1"))
    assert {(r["_grade"], r["_tail"]) for r in quality.rate(frame(spark, ODD), one).collect()} == {(1.0, 0.0)}


def test_features_of_texts_do_not_depend_on_their_neighbours():
    def cells(texts):
        raw = [t.encode() for t in texts]
        offsets = np.cumsum([0, *map(len, raw)])
        text, buckets, count = features(np.frombuffer(b"".join(raw), np.uint8), offsets, True)
        return [sorted(map(tuple, buckets[text == i])) for i in range(len(texts))], count

    texts = ["One two one", "", "two ONE", "één  twéé", "x"]
    together, count = cells(texts)
    assert together == [cells([t])[0][0] for t in texts] and count.tolist() == [2, 0, 2, 2, 1]
    assert all(b < BUCKETS for c in together for r in c for b in r)


# --- secrets -------------------------------------------------------------------------


def test_secrets(spark):
    rng = random.Random(5)
    rows = []
    for i in range(200):
        text = " ".join(rng.choice(["antidisestablishment", "river", "stone"]) for _ in range(10))
        if i % 4 == 0:
            text += ' token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '" end'
        rows.append((i, text, f"src{i % 3}"))
    rows += [(300, None, "a"), (301, "", None), (302, "x1" * 5000, None), (None, "token = 0123456789abcdef0123", None)]
    docs = frame(spark, rows, "doc_id long, text string, source string")
    found = secret_scan.findings(docs, secret_scan.dictionary(docs))
    forest = secret_scan.fit(found.where("doc_id < 100"), secret_scan.weak_label(F.col("around")))
    got = secret_scan.scan(found, forest).where("doc_id between 100 and 199").collect()
    assert got and all((r["_secret"] >= 0.5) == (len(r["value"]) == 40) for r in got)
    assert secret_scan.scan(found, secret_scan.Forest([])).where("_secret < 1").count() == 0
    assert secret_scan.findings(frame(spark, [], "doc_id long, text string, source string"), set()).count() == 0


def test_forest_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6))
    y = ((x[:, 2] > 0) & (x[:, 4] < 0.5)).astype(float)
    forest = secret_scan.grow(x[:300], y[:300])
    assert np.mean((forest.score(x[300:]) >= 0.5) == y[300:]) > 0.9


FORMS = ['{} = "{}"', "{}={}", "export {}={}", '{{"{}": "{}"}}', "--{}={}", "{}: '{}'", "DB_{}={}"]


@pytest.mark.parametrize("name", secret_scan.NAMES)
def test_secrets_of_every_name(name):
    names = {name, name.upper(), name.replace("_", "-"), name.split("_")[0] + "".join(p.title() for p in name.split("_")[1:])}
    for form in FORMS:
        for spelled in names:
            for value in ("04dbebab91ab85687d33eeaaf9ac", "hunter2hunter", "s3cret"):
                text = f"river {form.format(spelled, value)} stone"
                a, b, got, around, _ = next(secret_scan.candidates(text))
                assert (got, text[a:b]) == (value, value) and name in around[-2], (text, got, around)


def test_secrets_without_a_name_are_not_negatives(spark):
    rng = random.Random(8)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    prose = " ".join(["antidisestablishment river stone"] * 3)
    rows = [(i, f'{prose} {secret_scan.NAMES[i % 8].upper()}={key(40)} {prose}', "s") for i in range(60)]
    rows += [(100 + i, f"{prose} {key(40)} {prose}", "s") for i in range(10)]  # no name: not known
    rows += [(200, f'{prose} password="hunter2hunter" x', "s"), (201, "4111111111111111 ================", "s"), (202, "token antidisestablishment", "s")]
    docs = frame(spark, rows, "doc_id long, text string, source string")
    found = secret_scan.findings(docs, secret_scan.dictionary(docs)).withColumn("label", secret_scan.weak_label(F.col("around")))
    forest = secret_scan.fit(found, F.col("label"))
    got = [r for r in secret_scan.scan(found, forest).collect() if r["value"] != "antidisestablishment"]
    label = {(r["doc_id"], r["value"]): r["label"] for r in got}
    assert all(v == 1 for (i, _), v in label.items() if i < 60) and label[200, "hunter2hunter"] == 1
    assert all(v is None for (i, _), v in label.items() if 100 <= i < 200)
    assert label[201, "4111111111111111"] == 0 and label[201, "=" * 16] == 0
    assert found.where("value = 'antidisestablishment' and doc_id = 202 and label is not null").count() == 0
    assert all((r["named"] or r["_secret"] >= 0.5) == (r["doc_id"] <= 200) for r in got)


def secret_corpus(n, seed=31):
    """Rows of documents, and for each id the planted values by kind: (named, secret) -> values."""
    rng = random.Random(seed)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    common = ["antidisestablishment", "river", "stone", "configuration", "environment", "placeholder", "documentation"]
    rows, planted = [], {}
    for i in range(n):
        prose = lambda k: " ".join(rng.choice(common) for _ in range(k))
        secret = rng.choice([draw("0123456789abcdef", 40), draw("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 32)])
        plain = rng.choice(["_", "-"]).join(rng.choice(common) for _ in range(3))
        name = rng.choice(secret_scan.NAMES)
        kind = i % 4  # 0: named secret, 1: named placeholder, 2: secret without a name, 3: a long plain string without one
        value = secret if kind in (0, 2) else plain
        text = f'{prose(8)} {name} = "{value}" {prose(4)}' if kind < 2 else f"{prose(8)} {value} {prose(4)}"
        rows.append((i, text, f"src{i % 3}"))
        planted[i] = (kind < 2, kind in (0, 2), value)
    return rows, planted


def test_secret_scan_held_out_precision_and_recall_with_and_without_a_name(spark, tmp_path):
    rows, planted = secret_corpus(600)
    rows += [(900, None, None), (None, 'token = "0123456789abcdef0123"', "a"), (901, "", "a")]
    frame(spark, rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in secret_scan.op7_secret_scan(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and got[900]["n_candidates"] == got[901]["n_candidates"] == 0
    for named in (True, False):
        own = [(got[i], secret, value) for i, (n, secret, value) in planted.items() if n == named and got[i]["held_out"]]
        kept = [hashlib.sha256(value.encode()).hexdigest() in {f["value_sha256"] for f in r["findings"] or ()} for r, _, value in own]
        caught = sum(k and secret for k, (_, secret, _) in zip(kept, own, strict=True))
        assert len(own) > 30 and caught >= 0.95 * sum(secret for _, secret, _ in own) and caught >= 0.95 * sum(kept)
        assert named == any(r["n_named_removed"] for r, *_ in own)  # placeholders are removed in spite of their name


def test_secrets_in_capitals_are_caught_if_small_ones_were_learned(spark):
    rows, planted = secret_corpus(240, 32)
    shouted = [(i + 1000, text.upper(), source) for i, text, source in rows if i % 4 == 0]
    docs = frame(spark, rows + shouted, "doc_id long, text string, source string")
    found = secret_scan.findings(docs, secret_scan.dictionary(docs))
    forest = secret_scan.fit(found.where("doc_id < 1000"), secret_scan.weak_label(F.col("around")))
    got = secret_scan.scan(found.where("doc_id >= 1000"), forest).collect()
    score = {r["value"]: r["_secret"] for r in got}
    values = [planted[i - 1000][2].upper() for i, *_ in shouted]
    assert sum(score[v] >= 0.5 for v in values) >= 0.95 * len(values)
    x = np.arange(5 + 4 + 16 + (1 << secret_scan.WORD_BITS) + (1 << secret_scan.PATH_BITS), dtype="<f4")
    forms = list(secret_scan._spellings("aB1", x))
    assert len(forms) == 3 and all(len(f) == len(x) and f[3] == x[3] and (f[25:] == x[25:]).all() for f in forms)
