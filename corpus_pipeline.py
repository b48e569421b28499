"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

All stages but the last return the columns of documents; `n_chars` follows the text.
Filters decide on rows, named by a hash of id and text, so clashing or null ids neither lose a
clean text nor let a copy or a contaminated one through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cashweave.llm import decontaminate, language_id, line_dedup, ngram_join, packing
from cashweave.llm.common import discard, restage, stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; without a letter, or with too little confidence, they go."""
    model = language_id.fit(docs)
    return language_id.identify(docs, model).where(~F.col("_lang_rejected")).select(*docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least five documents hold stay in one of them."""
    columns = [F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return line_dedup.dedup_lines(docs).select(*columns)


def row_key() -> Column:
    """Names a row by its id and text: rows of one id, or without id, are told apart by their texts."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(0), F.coalesce("text", F.lit("")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by common shingles the one with the smallest id stays, null ids last; of rows equal in id and text one."""
    keyed = docs.withColumn("_row_key", row_key())
    rows = keyed.select(F.col("_row_key").alias("doc_id"), "text")
    classes, classes_path = restage(ngram_join.similar_documents(rows).select("doc_id", "component_id"), "classes")
    classes = classes.groupBy("doc_id", "component_id").agg(F.count(F.lit(1)).alias("rows"))
    groups = classes.groupBy("component_id").agg(F.count(F.lit(1)).alias("keys")).where("keys > 1")
    linked, linked_path = restage(classes.join(groups, "component_id").select(F.col("doc_id").alias("_row_key"), "component_id"), "linked-rows")
    named = keyed.select("_row_key", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row_key").alias("place"))
    first = named.join(linked, "_row_key").groupBy("component_id").agg(F.min("place").alias("place"))
    stays = first.select(F.col("place._row_key").alias("_row_key"))
    gone, _ = restage(linked.select("_row_key").join(stays, "_row_key", "left_anti"), "copies")
    kept = keyed.join(gone, "_row_key", "left_anti")
    repeated, _ = restage(classes.where("rows > 1").select(F.col("doc_id").alias("_row_key")), "repeated")
    for path in (classes_path, linked_path):
        discard(spark, path)
    if not repeated.isEmpty():
        once = kept.join(repeated, "_row_key", "left_semi").dropDuplicates(["_row_key"])
        kept = kept.join(repeated, "_row_key", "left_anti").unionByName(once)
    return kept.select(*docs.columns)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, whatever their id."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = docs.withColumn("_row_key", row_key())
    found = decontaminate.occurrences(keyed.select(F.col("_row_key").alias("doc_id"), "text"), benchmark)
    hit = stage(found.select(F.col("doc_id").alias("_row_key")).distinct(), "contaminated")
    return keyed.join(hit, "_row_key", "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_common_lines),
    ("ngram_join", drop_near_copies),
    ("decontaminate", decontaminate_benchmark),
    ("packing", pack_sequences),
]

# Language identification and tokenizing are not expressible in SQL; tests/llm compares what each stage keeps with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
