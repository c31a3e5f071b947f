"""Query terms matched against the heading vocabulary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vakanz.functions.text import not_stop_word


def _shape(term: Column, edits: Column, prefix: Column) -> Column:
    """A way of matching: edits, length of the fixed prefix, and the prefix itself, the whole term without edits."""
    return F.concat_ws("/", edits, prefix, F.when(edits == 0, term).otherwise(F.substring(term, 1, prefix)))


def _with_rests(words: DataFrame, term: str, most: int) -> DataFrame:
    """``rest``: what is left of the term behind its prefix ``p`` when up to ``d`` letters are deleted.

    One row for each choice of letters, from left to right; ``most`` bounds ``d``.
    """
    found = words.withColumn("rest", F.expr(f"substring({term}, p + 1, length({term}))")).withColumn("at", F.lit(1))
    for n in range(most):
        # Place 0 deletes no further letter.
        places = f"d > {n} AND at BETWEEN 1 AND length(rest)"
        found = found.withColumn("at", F.explode(F.expr(
            f"CASE WHEN {places} THEN concat(array(0), sequence(at, length(rest))) ELSE array(0) END"
        )))
        found = found.withColumn("rest", F.expr(
            "CASE WHEN at > 0 THEN concat(substring(rest, 1, at - 1), substring(rest, at + 1, length(rest))) ELSE rest END"
        ))
    return found.drop("at")


def expand(vocabulary: DataFrame, terms: DataFrame, stop: Sequence[str] = ()) -> DataFrame:
    """``(intent, query_term, term, df, exact, w)`` of all vocabulary terms a query term matches.

    ``vocabulary(term, df)`` may be large, ``terms(intent, term, d, p, w)`` is a short table, of
    which the driver reads the different pairs of edits ``d`` and prefix length ``p``. Two words
    within d edits of each other have a common rest after d deletions or fewer in each, and letters
    that are equal in front need none. So both sides list such rests and are joined on prefix and
    rest; candidates are those that share one, and the edit distance confirms them. Vocabulary
    terms list nothing if no query term of their prefix is of a length that d edits can reach.
    Exact query terms (no edits) pass the stop list first, as the headings did.
    """
    name = F.concat_ws("~", "q", F.concat_ws("/", "d", "p"))
    shapes = sorted({(row["d"], row["p"]) for row in terms.select("d", "p").collect()})
    most = max((d for d, _ in shapes), default=0)
    query = (
        terms.select("intent", F.col("term").alias("q"), "d", "p", "w")
        .withColumn("query_term", name)
        .where((F.col("d") > 0) | F.expr(not_stop_word(stop, "q")))
        .withColumn("shape", _shape(F.col("q"), F.col("d"), F.col("p")))
    )
    lengths = F.sequence(F.length("q") - F.col("d"), F.length("q") + F.col("d"))
    reach = query.select(F.explode(F.transform(lengths, lambda n: F.concat_ws("/", "shape", n))).alias("reach"))
    ways = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(p).alias("p")) for d, p in shapes])
    # Ways and rests are many times the terms, which may lie in few partitions.
    cores = vocabulary.sparkSession.sparkContext.defaultParallelism
    reachable = (
        vocabulary.repartition(cores, "term").withColumn("way", F.explode(ways))
        .select("term", "df", "way.d", "way.p")
        .withColumn("shape", _shape(F.col("term"), F.col("d"), F.col("p")))
        .join(reach, F.concat_ws("/", "shape", F.length("term")) == F.col("reach"), "left_semi")
    )
    rests = _with_rests(reachable, "term", most).select("term", "df", "shape", "rest")
    sought = _with_rests(query, "q", most)
    candidates = rests.join(sought, ["shape", "rest"]).select("intent", "query_term", "q", "d", "w", "term", "df").distinct()
    return candidates.where("levenshtein(term, q, d) >= 0").select(
        "intent", "query_term", "term", "df", (F.col("d") == 0).alias("exact"), "w"
    )
