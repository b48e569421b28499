"""Vocabulary terms in free questions: the longest phrase at each word, left to right, without overlaps.

A question is cut into words; at the first word not yet covered the longest phrase of the vocabulary
that starts there is taken, and the search goes on after it. The phrases are one map in
the plan, so every look-up is an expression on the row: no join, no exchange, no Python.
Case, punctuation and a plural s do not matter ("At-risk customers?" holds "at-risk customer").
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cashweave.operators.kpis import VOCABULARY

WORD = r"[\p{L}\p{N}]+(?:['-][\p{L}\p{N}]+)*"
PLURAL = r"(?<=[a-z]{3})s$"


def words(text: Column) -> Column:
    """Lower-cased words without a plural s; of a null text none."""
    plain = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("’"), F.lit("'"))
    return F.transform(F.regexp_extract_all(plain, F.lit(f"({WORD})")), lambda w: F.regexp_replace(w, PLURAL, ""))


def normal(term: str) -> str:
    """A term as `words` would cut it."""
    found = re.findall(r"\w+(?:['-]\w+)*", term.lower())
    return " ".join(re.sub(PLURAL, "", w) for w in found)


def terms_in(text: Column, vocabulary: Sequence[str]) -> Column:
    """Array of (place, term): the terms found, with the number of the word that each starts at, from 1.

    The words are bound to a lambda variable, so they are cut once a row and not at each look-up;
    only words that begin a phrase are looked up.
    """
    phrases = {normal(t): t for t in reversed(vocabulary)}  # of equal phrases the first term
    longest = max(len(p.split()) for p in phrases)
    firsts = sorted({p.split()[0] for p in phrases if p})
    known = F.create_map(*[
        x for p, t in phrases.items() for x in (F.lit(p), F.struct(F.lit(t).alias("term"), F.lit(len(p.split())).alias("size")))
    ])

    def found(tokens: Column, at: Column) -> Column:
        # a slice cut off by the end is a shorter phrase, whose own size counts
        hit = F.coalesce(*[F.try_element_at(known, F.array_join(F.slice(tokens, at, F.lit(n)), " ")) for n in range(longest, 0, -1)])
        return F.transform(F.array(hit), lambda h: F.when(h.isNotNull(), F.struct(at.alias("place"), h["term"].alias("term"), (at + h["size"]).alias("next"))))[0]

    def starts(tokens: Column) -> Column:
        hits = F.transform(tokens, lambda word, i: F.when(word.isin(firsts), found(tokens, i + 1)))
        return F.filter(hits, lambda h: h.isNotNull())

    def take(state: Column, hit: Column) -> Column:
        taken = F.struct(hit["next"].alias("next"), F.array_append(state["found"], F.struct(hit["place"].alias("place"), hit["term"].alias("term"))).alias("found"))
        return F.when(hit["place"] < state["next"], state).otherwise(taken)

    empty = F.struct(F.lit(1).alias("next"), F.lit([]).cast("array<struct<place:int,term:string>>").alias("found"))
    return F.transform(F.array(words(text)), lambda tokens: F.aggregate(starts(tokens), empty, take, lambda s: s["found"]))[0]


def question_metrics(questions: DataFrame, text: str = "question") -> DataFrame:
    """A row for each term found in a question: its columns, `place`, `term`, `metric` and the column that holds it."""
    terms = [t for t, _, _ in VOCABULARY]
    metric = F.create_map(*[F.lit(x) for t, m, _ in VOCABULARY for x in (t, m)])
    source = F.create_map(*[F.lit(x) for t, _, c in VOCABULARY for x in (t, c)])
    rows = questions.select(*questions.columns, F.inline(terms_in(F.col(text), terms)))
    return rows.withColumns({"metric": F.element_at(metric, F.col("term")), "source_column": F.element_at(source, F.col("term"))})
