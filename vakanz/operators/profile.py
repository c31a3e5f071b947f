"""Typical terms of the sections found for each intent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vakanz.functions.text import bucketed_words, ranked_words
from vakanz.operators.index import drop_stop_words
from vakanz.operators.ranking import TERM_TO, global_rank, head, keep_from_cutoff, rank_slice
from vakanz.runtime import broadcast_if_small, durable

# A word's place: rank of its hit (BIGINT), then its place in the hit (INT, up to ten digits).
_PLACES = "1" + "0" * 10


def ranked_hits(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``scored`` with ``rnk``, the exact place of a hit: highest score first, then its keys."""
    order = [F.col("score_micro").desc(), *map(F.col, keys)]
    return global_rank(scored, "intent", order).drop("entries")


def term_frequency(
    hits: DataFrame,
    content: str,
    order: Column,
    stop: Sequence[str] = (),
    keep_null_bucket: bool = False,
) -> DataFrame:
    """``(intent, term, cnt, first_seen)`` over the contents of all hits.

    ``order`` is a BIGINT that orders the hits of an intent. Words that do not qualify are
    dropped in the row. With ``keep_null_bucket`` they are counted together under a NULL term.
    """
    text = F.col(content)
    words = bucketed_words(text, stop) if keep_null_bucket else ranked_words(text, stop)
    place = F.col("_at").cast("decimal(19,0)") * F.lit(_PLACES).cast("decimal(11,0)")
    seen = (place + F.col("_pos").cast("decimal(10,0)")).cast("decimal(32,0)")
    return (
        hits.select("intent", order.alias("_at"), F.posexplode(words).alias("_pos", "term"))
        .groupBy("intent", "term")
        .agg(F.count("*").alias("cnt"), F.min(seen).alias("first_seen"))
    )


def drop_stop_terms(counts: DataFrame, stop_words: DataFrame, keep_null_bucket: bool = False) -> DataFrame:
    """``term_frequency`` without the words of a table of any length, which meets the counts only.

    With ``keep_null_bucket`` they are counted with the NULL term of their intent.
    """
    if not keep_null_bucket:
        return drop_stop_words(counts, "term", stop_words)
    stop = broadcast_if_small(stop_words.select("term", F.lit(True).alias("_stop")))
    kept = counts.join(stop, "term", "left").withColumn("term", F.when(F.col("_stop").isNull(), F.col("term")))
    return kept.groupBy("intent", "term").agg(F.sum("cnt").alias("cnt"), F.min("first_seen").alias("first_seen"))


def rank_terms(counts: DataFrame) -> DataFrame:
    """Terms by count, ties in first-seen order: adds ``rnk`` and ``entries``."""
    return global_rank(
        counts, "intent", [F.col("cnt").desc(), F.col("first_seen"), F.col("term")]
    )


def sliced_terms(counts: DataFrame) -> DataFrame:
    """``(intent, term, cnt, rnk)``: the middle ranks of the terms by count, ties in first-seen order.

    Only terms that can reach the last of these ranks are sorted.
    """
    kept = head(durable(counts), "intent", "cnt", TERM_TO)
    sizes = kept.select("intent", "term", "cnt", "first_seen", F.col("entries").alias("_all"))
    order = [F.col("cnt").desc(), F.col("first_seen"), F.col("term")]
    ranked = global_rank(sizes, "intent", order).withColumn("entries", F.col("_all"))
    return rank_slice(ranked).select("intent", "term", "cnt", "rnk")


def kept_contents(scored: DataFrame, paragraphs: DataFrame, keys: Sequence[str], content: str) -> DataFrame:
    """The better half of the hits in their exact order, with their contents.

    Only the keys are ranked; contents are read for the hits that are kept.
    """
    kept = ranked_hits(keep_from_cutoff(scored, "intent"), keys)
    return kept.join(paragraphs.select(*keys, content), list(keys))


def term_profile(
    scored: DataFrame,
    paragraphs: DataFrame,
    keys: Sequence[str],
    content: str,
    stop: Sequence[str] | DataFrame = (),
    keep_null_bucket: bool = False,
) -> DataFrame:
    """``(intent, term, cnt, rnk)``: the middle ranks of the terms in the better half of the hits.

    ``stop`` is a list that becomes part of the plan, or a table of any length.
    """
    hits = kept_contents(scored, paragraphs, keys, content)
    table = isinstance(stop, DataFrame)
    counts = term_frequency(hits, content, F.col("rnk"), () if table else stop, keep_null_bucket)
    if table:
        counts = drop_stop_terms(counts, stop, keep_null_bucket)
    return sliced_terms(counts)
