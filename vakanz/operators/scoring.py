"""Weighted search over headings.

Exact terms score BM25, fuzzy terms their weight once per query term; headings that match more
of the terms found at all gain (coordination). The collection is postings plus paragraphs.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vakanz.functions.text import term_counts, tokens
from vakanz.operators.expand import expand
from vakanz.operators.index import heading_vocabulary
from vakanz.runtime import durable

# The usual BM25 constants, and the precision scores are compared at.
K1, B = 1.2, 0.75
MICRO = 1_000_000
# Ranges of terms that a search reads.
RANGES = 64


@dataclass(frozen=True)
class Collection:
    """Sizes the score needs: documents of either kind, and mean heading length over them."""

    documents: int
    mean_length: float


def collection(headings: DataFrame, postings: int) -> Collection:
    """``headings`` has a ``tokens`` column; one aggregate over that column only."""
    row = headings.agg(F.count("*").alias("n"), F.sum(F.size("tokens")).alias("len")).first()
    documents = row["n"] + postings
    return Collection(documents, (row["len"] or 0) / documents if documents else 0.0)


def tokenised(paragraphs: DataFrame, heading: str, stop: Sequence[str]) -> DataFrame:
    return paragraphs.withColumn("tokens", tokens(F.col(heading), stop))


def expanded_terms(
    headings: DataFrame, terms: DataFrame, stop: Sequence[str], documents: int
) -> DataFrame:
    """``weighed_terms`` of the vocabulary of tokenised headings."""
    return weighed_terms(heading_vocabulary(headings, "tokens"), terms, stop, documents)


def weighed_terms(
    vocabulary: DataFrame, terms: DataFrame, stop: Sequence[str], documents: int
) -> DataFrame:
    """Expanded vocabulary with ``s``: weight times idf for exact terms, weight for fuzzy ones."""
    found = expand(vocabulary, terms, stop)
    idf = F.log(F.lit(float(documents)) / (F.col("df") + 1)) + 1
    return found.withColumn("s", F.when(F.col("exact"), F.col("w") * idf).otherwise(F.col("w")))


def _bm25(s: Column, tf: Column, length: Column, size: Collection) -> Column:
    relative = length / F.lit(size.mean_length or 1.0)
    return s * tf * (K1 + 1) / (tf + K1 * (1 - B + B * relative))


def _coordinated(total: Column, matched: Column, found: Column) -> Column:
    """Score in millionths, never NULL; ``found`` is at least two."""
    others = (found - 1).cast("double")
    value = (total + (matched - 1) / (others * others)) * others / found
    return F.coalesce(F.round(value * MICRO).cast("bigint"), F.lit(0).cast("bigint"))


def score(
    headings: DataFrame, keys: Sequence[str], expanded: DataFrame, size: Collection
) -> DataFrame:
    """``score_terms`` of tokenised headings, whose tokens are counted in their row."""
    rows = headings.select(*keys, F.size("tokens").alias("length"), F.inline(term_counts(F.col("tokens"))))
    return score_terms(rows, keys, expanded, size)


def score_terms(
    index: DataFrame, keys: Sequence[str], expanded: DataFrame, size: Collection
) -> DataFrame:
    """``(keys, intent, score_micro)`` of the headings that match.

    ``index(term, keys, tf, length)`` is joined with the (written) expanded vocabulary and
    aggregated per heading; contents take no part. ``keys`` identify a heading: rows of equal
    keys are one heading. Intents for which a single vocabulary term matches have no scores.
    """
    found = expanded.groupBy("intent").agg(F.countDistinct("term").alias("found"))
    found = found.where("found > 1")
    scored = (
        index.join(expanded, "term")
        .groupBy(*keys, "intent")
        .agg(
            F.sum(
                F.when(F.col("exact"), _bm25(F.col("s"), F.col("tf"), F.col("length"), size))
            ).alias("exact"),
            F.collect_set(F.when(~F.col("exact"), F.struct("query_term", "s"))).alias("fuzzy"),
            F.size(F.collect_set("term")).alias("hits"),
        )
        .join(F.broadcast(found), "intent")  # one row per intent of the vocabulary
    )
    fuzzy = F.aggregate("fuzzy", F.lit(0.0), lambda acc, e: acc + e["s"])
    total = F.coalesce("exact", F.lit(0.0)) + fuzzy
    return scored.select(
        *keys, "intent", _coordinated(total, F.col("hits"), F.col("found")).alias("score_micro")
    )


def search(
    paragraphs: DataFrame,
    keys: Sequence[str],
    heading: str,
    postings: int,
    terms: DataFrame,
    stop: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """``(keys, intent, score_micro)`` of scored paragraphs, and one status row per intent.

    Headings are tokenised once; the tokens are written with their keys.

    ``status`` is ``ok``, ``insufficient`` (a single vocabulary term matches anything, so the
    coordination is undefined) or ``empty``.
    """
    headings = durable(tokenised(paragraphs, heading, stop).select(*keys, "tokens"))
    return search_tokens(headings, keys, postings, terms, stop)


def search_tokens(
    headings: DataFrame, keys: Sequence[str], postings: int, terms: DataFrame, stop: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """``search`` over stored ``(keys, tokens)``."""
    size = collection(headings, postings)
    expanded = durable(expanded_terms(headings, terms, stop, size.documents))
    return score(headings, keys, expanded, size), search_status(expanded, terms)


def search_status(expanded: DataFrame, terms: DataFrame) -> DataFrame:
    """``(intent, status)`` of all intents of ``terms``."""
    found = expanded.groupBy("intent").agg(F.countDistinct("term").alias("found"))
    return (
        terms.select("intent")
        .distinct()
        .join(found, "intent", "left")
        .select(
            "intent",
            F.when(F.col("found").isNull(), "empty")
            .when(F.col("found") == 1, "insufficient")
            .otherwise("ok")
            .alias("status"),
        )
    )


def term_ranges(expanded: DataFrame) -> list[tuple[str, str]]:
    """Least and greatest term of at most ``RANGES`` ranges that hold all expanded terms.

    Terms that begin alike are one range; one row for each two first letters reaches the driver.
    """
    found = expanded.groupBy(F.substring("term", 1, 2)).agg(F.min("term").alias("low"), F.max("term").alias("high"))
    rows = sorted((row["low"], row["high"]) for row in found.collect())
    step = -(-len(rows) // RANGES) or 1
    return [(rows[i][0], rows[min(i + step, len(rows)) - 1][1]) for i in range(0, len(rows), step)]


def in_ranges(term: str, ranges: Sequence[tuple[str, str]]) -> Column:
    """A condition that file statistics can decide."""
    within = [(F.col(term) >= low) & (F.col(term) <= high) for low, high in ranges]
    return reduce(operator.or_, within, F.lit(False))


def search_index(
    index: DataFrame, vocabulary: DataFrame, keys: Sequence[str], size: Collection, terms: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """``search`` over a stored ``index(term, keys, tf, length)`` without stop words, sorted by term.

    Nothing is tokenised; of the index the ranges of the expanded terms are read.
    """
    expanded = durable(weighed_terms(vocabulary, terms, (), size.documents))
    wanted = index.where(in_ranges("term", term_ranges(expanded)))
    return score_terms(wanted, keys, expanded, size), search_status(expanded, terms)
