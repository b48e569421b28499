"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text's subwords are the byte 3- and 4-grams of its lower-cased letters, with anything
else as a word boundary, hashed to `BUCKETS` embeddings. Their average feeds a linear
softmax; both are trained by stochastic gradient descent in numpy, on about
`SAMPLE` documents of each of the `LANGUAGES` most frequent languages, picked by the hash
of their id. A fifth of them is set aside: it fits the temperature of the softmax
and the smallest confidence at which `ACCURACY` of the accepted texts are right; a text is also
rejected below 0.5 if all but `LEAST_USUAL` of the known texts are more confident.
As the model is linear, embeddings and softmax fold into one table of scores for each bucket,
so a text of any length is scored in one pass.

Defined cases: a text that is null or has no letter is `und` with score 0 and rejected.
Rows without lang or id train nothing; without any training row every text is `und`.
Repeated rows count as often as they stand. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cashweave.llm.common import LOWERED, chunks, documents, in_tasks

BUCKETS, DIMENSIONS, GRAMS = 1 << 16, 16, (3, 4)
SAMPLE, LANGUAGES, ACCURACY, LEAST_USUAL, EPOCHS, RATE = 500, 200, 0.99, 0.001, 5, 0.5
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_NORMAL = np.where(_LETTER, LOWERED, 32).astype(np.uint32) + np.uint32(1)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # (BUCKETS + 1) x languages; the last row is 0
    bias: np.ndarray
    temperature: float
    threshold: float


def subwords(data: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram at each byte; BUCKETS where it would leave the text."""
    x = _NORMAL[data]
    h = np.zeros(len(x), np.uint32)
    for k in range(n):
        h[: len(x) - k] = (h[: len(x) - k] + x[k:]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    out = ((h * np.uint32(0x85EBCA6B) + np.uint32(n)) >> np.uint32(16)).astype(np.int64)
    for k in range(1, n):
        ends = offsets[1:] - k
        out[ends[ends >= offsets[:-1]]] = BUCKETS
    return out


def counted(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, buckets, counts) of each text."""
    for low, high, data, offsets in chunks(texts):
        grams = [subwords(data, offsets, n) for n in GRAMS]
        for row in range(high - low):
            own = np.concatenate([g[offsets[row] : offsets[row + 1]] for g in grams])
            buckets, counts = np.unique(own[own < BUCKETS], return_counts=True)
            yield low + row, buckets, counts


def _sample(docs: DataFrame, per_language: int) -> DataFrame:
    """About `per_language` documents of each language: those whose hashed id is below the share that gives as many."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return known.limit(0)
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], int(min(1.0, per_language / r["count"]) * (1 << 30)))))
    return known.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) < F.try_element_at(share, F.col("lang")))


def fit(docs: DataFrame, per_language: int = SAMPLE, epochs: int = EPOCHS, seed: int = 9) -> Model:
    """A model from the text and lang of a bounded sample of `docs`."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, counts = [], []
            for _, b, c in counted(batch.column("text")):
                buckets.append(b.astype("<u2").tobytes())
                counts.append(c.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("place"), batch.column("lang"), pa.array(buckets, pa.binary()), pa.array(counts, pa.binary())],
                ["place", "lang", "buckets", "counts"],
            )

    rows = _sample(docs, per_language).select(F.xxhash64("doc_id", F.lit(3)).alias("place"), "text", "lang")
    rows = in_tasks(rows, features, "place long, lang string, buckets binary, counts binary").collect()
    rows.sort(key=lambda r: (r["place"], r["buckets"]))
    rows = [(r["lang"], np.frombuffer(r["buckets"], "<u2"), np.frombuffer(r["counts"], "<f4")) for r in rows]
    rows = [(lang, b, c / c.sum()) for lang, b, c in rows if len(b)]
    languages = sorted({lang for lang, _, _ in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    at = {lang: i for i, lang in enumerate(languages)}
    aside = rows[::5] if len(rows) >= 5 * len(languages) else []
    learn = [r for i, r in enumerate(rows) if not aside or i % 5]
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.3, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = np.zeros((len(languages), DIMENSIONS), np.float32)
    bias = np.zeros(len(languages), np.float32)
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for i in rng.permutation(len(learn)):
            lang, b, share = learn[i]
            hidden = share @ embed[b]
            z = weights @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[at[lang]] -= 1
            back = p @ weights
            weights -= rate * np.outer(p, hidden)
            bias -= rate * p
            # many buckets share the step: each moves by its share, scaled to the text's vocabulary
            embed[b] -= (rate * np.sqrt(len(b)) * share)[:, None] * back
    scores = np.vstack([embed @ weights.T, np.zeros((1, len(languages)), np.float32)]).astype(np.float32)
    model = Model(languages, scores, bias, 1.0, 0.0)
    if aside:
        z = np.array([share @ scores[b] + bias for _, b, share in aside])
        truth = np.array([at[lang] for lang, _, _ in aside])
        grid = 2.0 ** np.arange(-2, 4.25, 0.25)
        model.temperature = float(min(grid, key=lambda t: -np.mean(np.log(_softmax(z / t)[np.arange(len(z)), truth] + 1e-9))))
        p = _softmax(z / model.temperature)
        right, sure = p.argmax(1) == truth, p.max(1)
        enough = next((t for t in np.arange(0, 1, 0.05) if (sure >= t).any() and right[sure >= t].mean() >= ACCURACY), 0.0)
        usual = np.quantile(sure[right], LEAST_USUAL) if right.any() else 0.0
        model.threshold = float(max(enough, min(usual, 0.5)))
    return model


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True)) if z.shape[1] else z
    return p / p.sum(axis=1, keepdims=True) if z.shape[1] else p


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a text has a letter of any alphabet."""
    ascii_letter = np.zeros(len(data) + 1, np.int32)
    np.cumsum(_LETTER[data] & (data < 128), out=ascii_letter[1:])
    out = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode())
    return out


def predict(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(language index, calibrated probability) of each text; -1 where there is no letter or no model."""
    n = len(texts)
    best, sure = np.full(n, -1), np.zeros(n)
    if not model.languages:
        return best, sure
    for low, high, data, offsets in chunks(texts):
        lengths = np.diff(offsets)
        total = np.zeros((high - low, len(model.languages)))
        count = np.zeros(high - low)
        full = np.flatnonzero(lengths)
        for g in GRAMS if len(full) else ():
            total[full] += np.add.reduceat(model.scores[subwords(data, offsets, g)], offsets[full], axis=0)
            count += np.maximum(0, lengths - g + 1)
        p = _softmax((total / np.maximum(count, 1)[:, None] + model.bias) / model.temperature)
        letter = has_letter(data, offsets)
        best[low:high], sure[low:high] = np.where(letter, p.argmax(1), -1), np.where(letter, p.max(1), 0.0)
    return best, sure


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs with _lang_pred, _lang_score and _lang_rejected (not confident enough, or no letter)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = pa.array([*model.languages, UNKNOWN])
        for batch in batches:
            best, sure = predict(model, batch.column("text"))
            known = best >= 0
            columns = [
                names.take(pa.array(np.where(known, best, len(model.languages)))),
                pa.array(sure),
                pa.array(~known | (sure < model.threshold)),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "_lang_pred", "_lang_score", "_lang_rejected"])

    added = T.StructType().add("_lang_pred", "string").add("_lang_score", "double").add("_lang_rejected", "boolean")
    kind = T.StructType([*docs.schema.fields, *added.fields])
    return in_tasks(docs, run, kind)


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    model = fit(docs.where(~held_out))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("_lang_pred").alias("lang_pred"),
        F.col("_lang_score").alias("score"),
        F.col("_lang_rejected").alias("rejected"),
    )
