"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's size is its number of words. Every source gets a share of all words by its
weight, but at most `most` times its own words; what is left over is shared again by
weight. A target of e whole epochs and a rest takes each document e times, and fills the
rest with documents in the order of exponential keys -ln(u) / quality: the documents with
the smallest keys are a sample without replacement weighted by quality. Sizes are summed
along that order; the document at the budget's end gives its first words only, so the
words taken from a source are its target without the fraction of a word.

u is a hash of seed, id, size and text, so a rerun draws the same sample on any number of
partitions. Defined cases: null or empty text has size 0 and gives no word; null sources are one
source, the last; null ids are like any other id; equal rows have equal keys and are
interchangeable; a quality that is null counts 1, one that is not above 0 comes last;
an empty table gives an empty table. Only the columns asked for are kept, ours start with `_mix_`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cashweave.llm.common import documents, partitions, restage
from cashweave.llm.ordered import block_count, sums_before

WORD = r"[^\x20\x09-\x0D]+"
SHARES, MOST, SEED = (5, 2, 1), 3, 20240229
# Quality weights of labelled documents; all others have weight 1.
GOOD, POOR = 2.0, 0.5
# A table of sources up to this long is broadcast; a longer one is joined by a shuffle.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def exponential(doc_id: Column, size: Column, text: Column, seed: int = SEED) -> Column:
    """-ln(u), u in (0, 1) from 52 bits of a hash."""
    marks = [F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string"), F.md5(F.coalesce(text, F.lit("")))]
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *marks)), 1, 13), 16, 10).cast("long")
    return -F.log((bits.cast("double") + 0.5) / float(1 << 52))


def targets(sizes: DataFrame, shares: Sequence[int] = SHARES, most: int = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, _mix_source, _mix_share, target, _mix_words).

    `shares` repeat over the sources in code point order, null last. A round shares what
    the sources at their limit leave to the others; a round is one sum over the table of
    sources, and the limits only grow in number, so the rounds end. `target` is an exact
    quotient; `_mix_words` is it without the fraction of a word.
    """
    spark = sizes.sparkSession
    sizes = sizes.select("source", "source_size", F.col("source").isNull().cast("int").alias("_null"))
    sizes, _ = restage(sizes.withColumns({"_all": F.lit(0).cast("long"), "_one": F.lit(1).cast("long")}), "sources")
    blocks = block_count(sizes.count(), partitions(spark))
    ranked = sums_before(sizes, "_all", "_one", ["_null", "source"], blocks)
    share = F.element_at(F.array(*[F.lit(s).cast("long") for s in shares]), (F.col("_before") % len(shares) + 1).cast("int"))
    ranked, _ = restage(ranked.select("source", "source_size", F.col("_before").alias("_mix_source"), share.alias("_mix_share")), "shares")
    words, weight = (int(x or 0) for x in ranked.agg(F.sum("source_size"), F.sum("_mix_share")).first())
    limit = (most * F.col("source_size")).cast("decimal(38,0)")
    free = F.lit(False)
    if words:
        last = None
        while (words, weight) != last:
            last = words, weight
            free = limit * F.lit(weight).cast("decimal(19,0)") > F.col("_mix_share").cast("decimal(38,0)") * F.lit(words).cast("decimal(19,0)")
            whole = F.sum(F.col("source_size")), F.sum(F.when(~free, limit)), F.sum(F.when(free, F.col("_mix_share")))
            total, held, weight = (int(x or 0) for x in ranked.agg(*whole).first())
            words = total - held
    part = F.col("_mix_share") * F.lit(words).cast("long")
    full = most * F.col("source_size")
    return ranked.withColumns({
        "target": F.when(free, part.cast("double") / F.lit(float(weight or 1))).otherwise(full.cast("double")),
        "_mix_words": F.when(free, F.expr(f"(_mix_share * {words}L) div {weight or 1}L")).otherwise(full),
    })


def mix(
    docs: DataFrame,
    quality: DataFrame | None = None,
    columns: Sequence[str] = ("doc_id",),
    shares: Sequence[int] = SHARES,
    most: int = MOST,
    seed: int = SEED,
) -> DataFrame:
    """`columns` of each document, then size, source, source_size, target and taken (its words in the mix, repeats counted).

    `quality` is a table of unique doc_id and weight; without it, or for ids not in it, the weight is 1.
    The texts are read once and not shuffled; what is joined and sorted is a row of a few
    numbers for each document. A hot source is cut into as many blocks as its rows need.
    """
    spark = docs.sparkSession
    size = word_count(F.col("text"))
    slim, _ = restage(
        docs.select(
            *[F.col(c).alias(f"_mix_own_{i}") for i, c in enumerate(columns)],
            F.col("source").alias("_mix_name"), size.alias("_mix_size"), F.col("doc_id").alias("_mix_id"),
            exponential(F.col("doc_id"), size, F.col("text"), seed).alias("_mix_draw"),
            # tells equal rows apart, so that any number of them can be cut into blocks
            F.monotonically_increasing_id().alias("_mix_row"),
        ),
        "sizes",
    )
    sizes = slim.groupBy(F.col("_mix_name").alias("source")).agg(F.sum("_mix_size").alias("source_size"))
    goals, _ = restage(targets(sizes, shares, most), "targets")
    few = goals.count() <= BROADCAST_SOURCES
    epochs = F.when(F.col("source_size") > 0, F.expr("_mix_words div source_size")).otherwise(F.lit(0)).cast("long")
    goals = goals.withColumns({"_mix_epochs": epochs, "_mix_rest": F.col("_mix_words") - epochs * F.col("source_size")})
    rows = slim.join(F.broadcast(goals) if few else goals, F.col("_mix_name").eqNullSafe(F.col("source")))
    weight = F.lit(1.0)
    if quality is not None:
        graded = quality.select(F.col("doc_id").alias("_mix_doc"), F.col("weight").cast("double").alias("_mix_weight"))
        rows = rows.join(graded, F.col("_mix_id") == F.col("_mix_doc"), "left")
        weight = F.coalesce("_mix_weight", F.lit(1.0))
    key = F.when((weight > 0) & ~F.isnan(weight), F.col("_mix_draw") / weight).otherwise(F.lit(float("inf")))
    rows = rows.withColumn("_mix_key", key)
    rows = rows.select(*slim.columns, "source_size", "target", "_mix_source", "_mix_epochs", "_mix_rest", "_mix_key")
    blocks = block_count(slim.count(), partitions(spark))
    ordered = sums_before(rows, "_mix_source", "_mix_size", ["_mix_key", "_mix_row"], blocks)
    rest = F.greatest(F.lit(0), F.least(F.col("_mix_size"), F.col("_mix_rest") - F.col("_before")))
    return ordered.select(
        *[F.col(f"_mix_own_{i}").alias(c) for i, c in enumerate(columns)],
        F.col("_mix_size").alias("size"), F.col("_mix_name").alias("source"), "source_size", "target",
        (F.col("_mix_epochs") * F.col("_mix_size") + rest).cast("long").alias("taken"),
    )


def copies(docs: DataFrame, plan: DataFrame, key: str = "doc_id") -> DataFrame:
    """The mix itself: a row with the columns of `docs` for each whole or partial copy that `plan` takes.

    `key` is unique in both. `_mix_copy` counts from 0; a partial copy's text ends after its last word taken.
    """
    planned = plan.where("taken > 0").select(F.col(key).alias("_mix_id"), F.col("size").alias("_mix_size"), F.col("taken").alias("_mix_taken"))
    joined = docs.join(planned, docs[key] == F.col("_mix_id"))
    last = F.expr("(_mix_taken + _mix_size - 1) div _mix_size - 1")
    joined = joined.withColumn("_mix_copy", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    words = F.least(F.col("_mix_size"), F.col("_mix_taken") - F.col("_mix_copy") * F.col("_mix_size"))
    # the text up to the end of that many words: all words, or a prefix of the words with what stands before each
    pieces = F.regexp_extract_all(F.col("text"), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"))
    cut = F.array_join(F.slice(pieces, 1, words.cast("int")), "")
    text = F.when(words == F.col("_mix_size"), F.col("text")).otherwise(cut)
    return joined.withColumn("text", text).select(*docs.columns, "_mix_copy")


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents; labelled ones weigh more or less in the draw by their quality."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.col("doc_id").isNotNull())
    graded = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    weight = F.when(F.col("quality") >= 1, F.lit(GOOD)).when(F.col("quality") < 1, F.lit(POOR))
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return mix(docs, graded.select("doc_id", weight.alias("weight"))).select("doc_id", "size", "source_size", "target", "taken")


OP13_SQL = f"""
WITH graded AS (
  SELECT doc_id, CASE WHEN min(quality) >= 1 THEN {GOOD} WHEN min(quality) < 1 THEN {POOR} ELSE 1.0 END AS w
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), sized AS (
  SELECT d.doc_id, source, text, coalesce(w, 1.0)::DOUBLE AS w,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents d LEFT JOIN graded g ON d.doc_id = g.doc_id
), keyed AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(md5(concat_ws(':', '{SEED}', coalesce(doc_id::VARCHAR, ''), size::VARCHAR,
              md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / w AS key
  FROM sized
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS share
  FROM keyed GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER o AS k,
         (sum(source_size) OVER () - coalesce(3 * sum(source_size) OVER before, 0))::BIGINT AS words,
         (sum(share) OVER () - coalesce(sum(share) OVER before, 0))::BIGINT AS weight
  FROM sources
  WINDOW o AS (ORDER BY source_size / share, source NULLS LAST),
         before AS (ORDER BY source_size / share, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), first_free AS (
  SELECT k, words, weight FROM ranked WHERE 3 * source_size::HUGEINT * weight > share::HUGEINT * words ORDER BY k LIMIT 1
), goals AS (
  SELECT r.source, source_size,
         CASE WHEN r.k >= f.k THEN (share * f.words)::DOUBLE / f.weight::DOUBLE ELSE 3.0 * source_size END AS target,
         CASE WHEN r.k >= f.k THEN (share * f.words) // f.weight ELSE 3 * source_size END AS budget
  FROM ranked r LEFT JOIN first_free f ON true
), drawn AS (
  SELECT doc_id, size, source_size, target, budget,
         coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN goals g ON k.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END::BIGINT AS taken
FROM drawn
"""
