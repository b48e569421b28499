"""Benchmark decontamination by winnowing: minimum k-gram hash per sliding window, join, extend the hits.

Words are runs of ASCII letters and digits and of other non-ASCII characters, A-Z
lower-cased. A window is `window` consecutive words of an item; an item with fewer
words, but not none, is one window. Both sides keep, of each run of `window - k + 1`
k-grams, the k-gram with the smallest hash; a shared window therefore shares at least
one kept fingerprint at the same place in it. Joined fingerprints name the windows that
may occur there; each is then compared word for word. Only DataFrame functions are used.

Defined cases: null and empty texts have no words. Repeated rows are separate documents
with the same result; repeated or null item ids count once (null is left out). Rows
without a document id are reported with their words only. Empty tables give empty
results, or no hits. Only the columns named here are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cashweave.llm.common import documents, lower_ascii, restage

WINDOW, K = 10, 6
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words in order; null has none."""
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), _BETWEEN, -1)
    return F.filter(parts, lambda w: w != "")


def computed_once(df: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """The kept columns and new ones that later expressions read as values.

    Without the generator between them, the optimiser would copy an array expression
    into every lambda over it and compute it again for each element.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def _from(array: str, i: Column, n: int) -> list[Column]:
    return [F.get(F.col(array), i + o) for o in range(n)]


def _places(array: str, run: int) -> Column:
    """The starts of all runs of `run` elements, from 0."""
    last = F.size(array) - run
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def hashed(tokens: DataFrame, key: str, k: int, window: int) -> DataFrame:
    """(key, h, g, m): hashes of words, of all k-grams, and the smallest of each window's; texts of fewer words have no g and m."""
    run = window - k + 1
    tokens = computed_once(tokens, key, h=F.transform("w", lambda x: F.xxhash64(x)))
    grams = F.transform(_places("h", k), lambda i: F.xxhash64(*_from("h", i, k)))
    none = F.array().cast("array<bigint>")
    tokens = computed_once(tokens, key, "h", g=F.when(F.size("h") >= window, grams).otherwise(none))
    least = (lambda i: F.least(*_from("g", i, run))) if run > 1 else (lambda i: F.get("g", i))
    return computed_once(tokens, key, "h", "g", m=F.transform(_places("g", run), least))


def placed(prints: DataFrame, key: str, run: int) -> DataFrame:
    """(key, x, p): each distinct kept fingerprint with its first place in its run."""
    at = prints.select(key, "g", F.posexplode("m").alias("i", "x"))
    return at.select(key, "x", (F.col("i") + F.array_position(F.slice("g", F.col("i") + 1, run), F.col("x")) - 1).cast("int").alias("p")).distinct()


def _whole(n: int, i: Column) -> Column:
    """Hash of the n words from word i, told apart from those of other lengths."""
    return F.xxhash64(F.lit(n), *_from("h", i, n))


def _wholes(n: int) -> Column:
    """(x, p) of every run of n words."""
    return F.transform(_places("h", n), lambda i: F.struct(_whole(n, i).alias("x"), i.alias("p")))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, w): one row for each item with words."""
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", words(F.col("text")).alias("w"))
    return items.where(F.size("w") > 0).distinct()


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(n, t, item_id): each window of an item as its number of words and its text."""
    n = F.least(F.size("w"), F.lit(window))
    items = items.select("item_id", "w", n.alias("n"))
    at = items.select("item_id", "n", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("n"))).alias("j"))
    return at.select("n", F.array_join(F.slice("w", F.col("j") + 1, F.col("n")), " ").alias("t"), "item_id").distinct()


def benchmark_prints(items: DataFrame, k: int, window: int, lengths: list[int]) -> DataFrame:
    """(x, n, back): a fingerprint of the benchmark, and how many words before its place a window of n words may begin.

    A kept k-gram stands at most window - k words into a window, however many items hold it; a short
    item is its own fingerprint.
    """
    prints = hashed(items, "item_id", k, window)
    kept = placed(prints, "item_id", window - k + 1).join(items.select("item_id", F.size("w").alias("size")), "item_id")
    first, last = F.greatest(F.lit(0), F.col("p") + k - window), F.least(F.col("p"), F.col("size") - window)
    long = kept.select("x", F.lit(window).alias("n"), F.explode(F.sequence(F.col("p") - last, F.col("p") - first)).alias("back"))
    for n in lengths:
        short = prints.where(F.size("h") == n).select(_whole(n, F.lit(0)).alias("x"), F.lit(n).alias("n"), F.lit(0).alias("back"))
        long = long.unionByName(short)
    return long.distinct()


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(doc_id, s, n, item_id): the n words from word s of the document are a window of the item.

    One pass over the corpus names the documents that hold a fingerprint of the benchmark; the join
    is broadcast only if the staged benchmark side is small by its file size. Only those are read
    again. Each place where a window may begin is found once, whatever the number of items that
    hold it, and its own words, not the document's, meet the windows of the items.
    """
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    items, _ = restage(benchmark_items(benchmark), "items")
    lengths = sorted(r[0] for r in items.where(F.size("w") < window).select(F.size("w")).distinct().collect())
    theirs, _ = restage(benchmark_prints(items, k, window, lengths), "item-prints")

    ours = hashed(computed_once(docs, "doc_id", w=words(F.col("text"))), "doc_id", k, window)
    short = [F.transform(_wholes(n), lambda run: run["x"]) for n in lengths]
    ours = computed_once(ours, "doc_id", x=F.array_distinct(F.concat("m", *short)))
    met = ours.select("doc_id", F.explode("x").alias("x")).join(theirs.select("x").distinct(), "x")
    met, _ = restage(met.select("doc_id").distinct(), "suspects")

    suspects = computed_once(docs.join(met, "doc_id", "left_semi"), "doc_id", w=words(F.col("text")))
    suspects, _ = restage(suspects.distinct(), "suspect-words")
    prints = hashed(suspects, "doc_id", k, window)
    at = placed(prints, "doc_id", window - k + 1)
    if lengths:
        at = at.unionByName(prints.select("doc_id", F.inline(F.concat(*map(_wholes, lengths)))))
    begins = at.join(theirs, "x").select("doc_id", "n", (F.col("p") - F.col("back")).alias("s")).where("s >= 0")
    # a document's places are at most one for each of its words and lengths: no longer than its text
    begins = begins.groupBy("doc_id").agg(F.collect_set(F.struct("n", "s")).alias("at"))
    begins = begins.join(suspects, "doc_id").select("doc_id", "w", F.inline("at"))
    begins = begins.select("doc_id", "s", "n", F.array_join(F.slice("w", F.col("s") + 1, F.col("n")), " ").alias("t"))
    return begins.join(item_windows(items, window), ["n", "t"]).select("doc_id", "s", "n", "item_id").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_hit, n_items, items (sorted ids as strings), contaminated."""
    found, _ = restage(occurrences(docs, benchmark, window, k), "windows")
    at = found.select("doc_id", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("n") - 1)).alias("i"))
    hit = at.distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hit"))
    named = found.select("doc_id", F.col("item_id").cast("string").alias("item")).distinct()
    named = named.groupBy("doc_id").agg(F.sort_array(F.collect_set("item")).alias("items"))
    report = hit.join(named, "doc_id")
    counted = docs.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    return counted.join(report, "doc_id", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    report = contamination(documents(spark, sf_dir).select("doc_id", "text"), benchmark)
    return report.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


_SQL_WORDS = (
    "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
)
OP10_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, j, j + least(10, len(w)) - 1), ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS j FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM win),
places AS (
  SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)
),
hits AS (SELECT doc_id, s, places.n, item_id FROM places JOIN win ON win.t = places.t AND win.n = places.n),
words_hit AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
