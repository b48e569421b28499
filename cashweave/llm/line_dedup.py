"""Line deduplication: explode normalised lines, hash, count documents per hash, drop, reassemble by position.

A line's key is the line without white space at both ends, A-Z lower-cased. Keys of
at least `min_chars` code points that stand in at least `min_documents` documents lose
all their lines except in the document with the largest id. Keys are compared by 96
bits of hash.

Defined cases: a null or empty text is one empty line. Every row is a document, so
repeated rows count; rows of one id all keep or all lose a line. A row without id keeps
its lines, though they count. An empty table gives an empty table. Other columns pass
through untouched, also when they are called like ours (ours carry a `_line_` prefix).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cashweave.llm.common import SPACE, documents, lower_ascii, restage

MIN_CHARS, MIN_DOCUMENTS = 40, 5


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def key_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h"), F.hash(key).alias("g"))


def common_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(doc_id, _line_drop): the hashes of the lines that a document loses; documents that lose none have no row.

    Counting is a partial aggregate, so a line that a third of all documents hold
    leaves each task as one row. Only hashes are shuffled.
    """
    keys = F.filter(F.transform(split_lines(F.col("text")), line_key), lambda k: F.length(k) >= min_chars)
    held = docs.select("doc_id", F.array_distinct(F.transform(keys, key_hash)).alias("k"))
    held, _ = restage(held, "line-hashes")
    held = held.select("doc_id", F.explode("k").alias("k")).select("doc_id", "k.h", "k.g")
    common = held.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
    # staged, so that the join has a plain exchange on both sides and a hot line's rows can be split
    common, _ = restage(common.where(F.col("n") >= min_documents).select("h", "g", "keeper"), "common-lines")
    lost = held.join(common, ["h", "g"]).where(F.col("doc_id") < F.col("keeper"))
    return lost.groupBy("doc_id").agg(F.collect_set(F.struct("h", "g")).alias("_line_drop"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """The documents with `text` reassembled, plus _line_total and _line_dropped."""
    drop = common_lines(docs, min_chars, min_documents).withColumnRenamed("doc_id", "_line_doc")
    joined = docs.join(drop, docs["doc_id"] == drop["_line_doc"], "left")
    lines = split_lines(F.col("text"))
    kept = F.filter(
        lines,
        lambda line: (F.length(line_key(line)) < min_chars) | ~F.array_contains(F.col("_line_drop"), key_hash(line_key(line))),
    )
    joined = joined.withColumn("_line_total", F.size(lines).cast("long"))
    joined = joined.withColumn("_line_kept", F.when(F.col("_line_drop").isNotNull(), kept))
    return (
        joined.withColumn("_line_dropped", F.coalesce(F.col("_line_total") - F.size("_line_kept"), F.lit(0)).cast("long"))
        .withColumn("text", F.when(F.col("_line_drop").isNull(), F.col("text")).otherwise(F.array_join("_line_kept", "\n")))
        .drop("_line_doc", "_line_drop", "_line_kept")
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id",
        F.col("_line_total").alias("n_lines"),
        F.col("_line_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


OP2_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT keyed.doc_id, pos, line, common.k IS NOT NULL AND keyed.doc_id <> keeper AS lost
  FROM keyed LEFT JOIN common USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
