"""Quality by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed words is shared by all grades; ordered thresholds cut its
score z: P(grade > k) = sigmoid(z - t_k) with t_0 < t_1 < ... The thresholds are kept in order
as a first one and positive steps. The expected grade is the sum of these tail
probabilities; a text is selected if the tail beyond the lowest grade is likely.
Training is gradient descent in numpy on at most `SAMPLE` rated documents of each grade.

Defined cases: a null or empty text has no word and gets the thresholds' own probabilities.
Rows without id or rating train nothing; with fewer than two grades every text has the
known grade (0 without any). Repeated rows count as often as they stand; an empty table
gives an empty result.
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

SAMPLE, LEAST_TEXTS, EPOCHS, BATCH, RATE, DECAY = 3000, 5, 12, 256, 0.02, 1e-3
MOST_GRADES = 20


@dataclass
class Model:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def tails(z: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade above the k-th), one column for each threshold."""
    return _sigmoid(np.asarray(z)[:, None] - thresholds[None, :])


def descend(rows: Rows, grade: np.ndarray, levels: int, seed: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the largest likelihood; grade counts from 0."""
    rng = np.random.default_rng(seed)
    every = np.zeros(BUCKETS + levels - 1)  # weights, first threshold, logarithms of the steps
    above = np.array([np.mean(grade > k) for k in range(levels - 1)])
    start = -np.log(np.clip(above, 1e-3, 1 - 1e-3) / np.clip(1 - above, 1e-3, 1))
    every[BUCKETS] = start[0]
    every[BUCKETS + 1 :] = np.log(np.maximum(np.diff(start), 0.1))
    adam = Adam(len(every), RATE)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // BATCH)):
            steps = np.exp(every[BUCKETS + 1 :])
            t = every[BUCKETS] + np.concatenate(([0.0], np.cumsum(steps)))
            p = tails(rows.score(every[:BUCKETS], part), t)
            edge = np.column_stack((np.ones(len(part)), p, np.zeros(len(part))))
            at = np.arange(len(part))
            share = np.maximum(edge[at, grade[part]] - edge[at, grade[part] + 1], 1e-9)
            slope = np.column_stack((np.zeros(len(part)), p * (1 - p), np.zeros(len(part))))
            up, down = slope[at, grade[part]] / share, slope[at, grade[part] + 1] / share
            dz = -(up - down) / len(part)
            dt = np.zeros(levels + 1)
            np.add.at(dt, grade[part], up / len(part))
            np.add.at(dt, grade[part] + 1, -down / len(part))
            dt = dt[1:-1]
            gradient = np.empty(len(every))
            gradient[:BUCKETS] = rows.gradient(dz, part) + DECAY * every[:BUCKETS]
            gradient[BUCKETS] = dt.sum()
            gradient[BUCKETS + 1 :] = (np.cumsum(dt[::-1])[::-1])[1:] * steps
            adam.step(every, gradient)
    return every[:BUCKETS].astype(np.float32), every[BUCKETS] + np.concatenate(([0.0], np.cumsum(np.exp(every[BUCKETS + 1 :]))))


def fit(docs: DataFrame, ratings: DataFrame, per_grade: int = SAMPLE) -> Model:
    """A model from docs (doc_id, text) and ratings (doc_id, grade), a bounded sample of each grade."""
    ratings = ratings.where(F.col("doc_id").isNotNull() & F.col("grade").isNotNull()).select("doc_id", F.col("grade").cast("int").alias("grade"))
    counts = {r["grade"]: r["count"] for r in ratings.groupBy("grade").count().orderBy(F.desc("count")).limit(MOST_GRADES).collect()}
    grades = sorted(counts)
    if len(grades) < 2:
        return Model(grades or [0], np.zeros(BUCKETS, np.float32), np.empty(0))
    share = F.create_map(*(F.lit(x) for g in grades for x in (g, int(min(1.0, per_grade / counts[g]) * (1 << 30)))))
    picked = ratings.where(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 30)) < F.element_at(share, F.col("grade")))
    # at most about MOST_GRADES * per_grade ids and grades: small enough to broadcast whatever the corpus is
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(picked), "doc_id").withColumnRenamed("grade", "label")
    found = collected(rows, True)
    grade = np.searchsorted(grades, [g for g, _ in found])
    # thresholds see each grade as often as it is rated, not as often as it is sampled: one weight for all
    cells = [c for _, c in found]
    weights, thresholds = descend(Rows(cells, usable(cells, min(LEAST_TEXTS, max(1, len(cells) // 100)))), grade, len(grades))
    return Model(grades, weights, thresholds)


def rate(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs with _grade (expected) and _tail (probability of more than the lowest grade)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        grades = np.array(model.grades, float)
        for batch in batches:
            z = [sums_by_text(model.weights, data, offsets, True) for _, _, data, offsets in chunks(batch.column("text"))]
            z = np.concatenate([np.empty(0), *z])
            p = tails(z, model.thresholds)
            expected = grades[0] + p @ np.diff(grades) if len(model.thresholds) else np.full(len(z), grades[0])
            tail = p[:, 0] if len(model.thresholds) else np.zeros(len(z))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(expected), pa.array(tail)], [*batch.schema.names, "_grade", "_tail"])

    added = [T.StructField("_grade", T.DoubleType()), T.StructField("_tail", T.DoubleType())]
    return in_tasks(docs, run, T.StructType([*docs.schema.fields, *added]))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades from the labels: 0 low quality, 1 good but toxic, 2 good. Learned from rows whose fold of 5 is not 0."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    grade = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when(F.col("quality") == 1, 2)
    model = fit(docs.where(~held_out), labels.select("doc_id", grade.alias("grade")))
    return rate(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("_grade").alias("expected_grade"),
        F.col("_tail").alias("tail_probability"),
        (F.col("_tail") >= 0.5).alias("selected"),
    )
