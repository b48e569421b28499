"""Toxicity by non-negative positive-unlabelled learning.

Linear classifiers on hashed words are trained in numpy from confirmed toxic texts
and unlabelled ones, whose labels are never looked at. With the class prior p, the risk is
p * R+(positive) + max(0, R-(unlabelled) - p * R-(positive)); when a batch drives the
second term below zero, the step goes the other way. The scores of `MODELS` classifiers are
averaged, and their offset is set so that a share p of the unlabelled sample is over 0.5.

The samples are bounded: `POSITIVES` and `UNLABELLED` documents, those with the smallest
hashes of their ids. The prior is the share of toxic rows among the labelled ones that
may be learned from. Scoring reads every text whole, in one pass, without a shuffle.

Defined cases: a null or empty text has no word and gets the offset's score. Without
positive examples every score is the prior. Rows without id, or with a null label, train
nothing. Repeated rows count as often as they stand; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from cashweave.llm.common import chunks, documents, in_tasks
from cashweave.llm.language_id import fold
from cashweave.llm.word_features import BUCKETS, Adam, Rows, collected, sums_by_text, usable

POSITIVES, UNLABELLED, LEAST_TEXTS, MODELS, EPOCHS, BATCH, RATE, DECAY = 4000, 8000, 20, 3, 15, 256, 0.02, 1e-3


@dataclass
class Model:
    weights: np.ndarray
    offset: float


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def nnpu(positive: Rows, unlabelled: Rows, prior: float, seed: int, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and offset that minimise the non-negative risk with the logistic loss."""
    rng = np.random.default_rng(seed)
    both = np.zeros(BUCKETS + 1)  # the last one is the offset
    both[-1] = np.log(prior / (1 - prior))
    adam = Adam(BUCKETS + 1, RATE)
    steps = max(1, len(unlabelled) // BATCH)
    for _ in range(epochs):
        u_order = np.array_split(rng.permutation(len(unlabelled)), steps)
        for u in u_order:
            p = rng.integers(0, len(positive), max(32, BATCH // 4))
            weights, offset = both[:-1], both[-1]
            zp, zu = positive.score(weights, p) + offset, unlabelled.score(weights, u) + offset
            # losses log(1 + exp(-z)) for +1 and log(1 + exp(z)) for -1
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            dp_plus, dp_minus, du = -_sigmoid(-zp) / len(p), _sigmoid(zp) / len(p), _sigmoid(zu) / len(u)
            if negative >= 0:
                gp, gu = prior * (dp_plus - dp_minus), du
            else:
                gp, gu = prior * dp_minus, -du
            gradient = np.empty(BUCKETS + 1)
            gradient[:-1] = positive.gradient(gp, p) + unlabelled.gradient(gu, u) + DECAY * weights
            gradient[-1] = gp.sum() + gu.sum()
            adam.step(both, gradient)
    return both[:-1], float(both[-1])


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """At most about `most` rows, picked by the hash of the id."""
    share = min(1.0, most / max(1, rows.count()))
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))


def fit(docs: DataFrame, toxic: DataFrame, prior: float, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """A model from docs (doc_id, text), the ids of confirmed toxic ones, and the share of toxic texts."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    ids = _sample(toxic.select("doc_id").distinct(), positives)
    # about `positives` ids at most: small enough to broadcast whatever the corpus is
    hit = [c for _, c in collected(known.join(F.broadcast(ids), "doc_id", "left_semi").withColumn("label", F.lit(1)), False)]
    rest = [c for _, c in collected(_sample(known, unlabelled).withColumn("label", F.lit(0)), False)]
    prior = min(max(prior, 1e-4), 0.99)
    if not hit or not rest:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(prior / (1 - prior))))
    least = min(LEAST_TEXTS, max(1, (len(hit) + len(rest)) // 100))
    known_features = usable(hit + rest, least)
    positive, other = Rows(hit, known_features), Rows(rest, known_features)
    del hit, rest
    models = [nnpu(positive, other, prior, seed) for seed in range(MODELS)]
    weights, offset = np.mean([w for w, _ in models], axis=0), float(np.mean([b for _, b in models]))
    z = other.score(weights, np.arange(len(other))) + offset
    offset -= float(np.quantile(z, 1 - prior))
    return Model(weights.astype(np.float32), offset)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs with _toxic_score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            z = [sums_by_text(model.weights, data, offsets, False) for _, _, data, offsets in chunks(batch.column("text"))]
            p = _sigmoid(np.concatenate([np.empty(0), *z]) + model.offset)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, "_toxic_score"])

    return in_tasks(docs, run, T.StructType([*docs.schema.fields, T.StructField("_toxic_score", T.DoubleType())]))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out & F.col("toxic").isNotNull())
    prior = labels.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    model = fit(docs.where(~held_out), labels.where("toxic = 1"), prior if prior is not None else 0.0)
    return score(docs, model).select(
        "doc_id", held_out.alias("held_out"), F.col("_toxic_score").alias("score"), (F.col("_toxic_score") >= 0.5).cast("int").alias("predicted")
    )
