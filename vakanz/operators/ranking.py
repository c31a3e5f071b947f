"""Exact ranks and rank cuts that no single task has to hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vakanz.runtime import broadcast_if_small, durable

# Shares of the ranking that are kept.
SCORE_SHARE = 0.50
TERM_FROM, TERM_TO = 0.0025, 0.20


def cutoff(
    scored: DataFrame, group: str, value: str = "score_micro", share: float = SCORE_SHARE
) -> DataFrame:
    """``(group, cutoff)``: the value at 0-based rank ``int(n * share)``, highest first.

    ``value`` is BIGINT and takes some million distinct values a group at most, as scores do. Values are counted per group first (partial aggregation) and the counts
    written once; the rank is then located in two steps over histograms: by the upper bits of
    the value, and within the one bucket found by the value itself, which has at most 65,536
    rows per group.
    """
    counts = durable(scored.groupBy(group, value).agg(F.count("*").alias("n")))
    high = F.shiftright(F.col(value), 16)
    coarse = counts.groupBy(group, high.alias("_high")).agg(F.sum("n").alias("n"))
    bucket = _at_rank(coarse, group, "_high", F.floor(F.col("_total") * F.lit(share)))
    bucket = bucket.select(group, "_high", (F.col("_rank") - F.col("_before")).alias("_rest"))
    inside = counts.withColumn("_high", high).join(bucket, [group, "_high"])  # one row a group
    return _at_rank(inside, group, value, F.col("_rest")).select(group, F.col(value).alias("cutoff"))


def _at_rank(counts: DataFrame, group: str, value: str, rank: Column) -> DataFrame:
    """The row of a descending histogram that holds a 0-based rank."""
    descending = Window.partitionBy(group).orderBy(F.col(value).desc())
    return (
        counts.withColumn("_before", F.sum("n").over(descending) - F.col("n"))
        .withColumn("_total", F.sum("n").over(Window.partitionBy(group)))
        .withColumn("_rank", rank)
        .where("_before <= _rank AND _rank < _before + n")
    )


def keep_from_cutoff(scored: DataFrame, group: str, value: str = "score_micro") -> DataFrame:
    """Hits at or above the cutoff of their group; ties at the cutoff stay.

    ``scored`` is read twice, for the cutoff and for the hits, so it is written first.
    """
    scored = durable(scored)
    # One row per group.
    limits = broadcast_if_small(durable(cutoff(scored, group, value)))
    return scored.join(limits, group).where(F.col(value) >= F.col("cutoff")).drop("cutoff")


def head(counts: DataFrame, group: str, value: str, share: float) -> DataFrame:
    """(Written) rows up to 0-based rank ``int(n * share)`` of their group, highest first, and their ties.

    ``entries`` is the size of the whole group. What lies behind is found in the histogram of the
    values and takes no part in any sort.
    """
    sizes = counts.groupBy(group).agg(F.count("*").alias("entries"))
    limits = durable(cutoff(counts, group, value, share).join(sizes, group))
    return counts.join(broadcast_if_small(limits), group).where(F.col(value) >= F.col("cutoff")).drop("cutoff")


def global_rank(df: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """Add the 0-based rank ``rnk`` within ``group`` and the group size ``entries``.

    One range-partitioned sort. Rows are numbered within their partition, the sorted rows are
    written once, and each partition's offset (one row per partition and group) is joined back.
    """
    row_id = F.monotonically_increasing_id()
    ordered = durable(df.orderBy(F.col(group), *order).withColumn("_id", row_id))
    placed = ordered.withColumn("_part", F.shiftright(F.col("_id"), 33))
    sizes = durable(
        placed.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    )
    before = Window.partitionBy(group).orderBy("_part")
    # At most one row per partition and one per group.
    small = broadcast_if_small(sizes)
    offsets = small.select(
        group,
        "_part",
        "_first",
        (F.sum("_n").over(before) - F.col("_n")).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(group)).alias("entries"),
    )
    return (
        placed.join(offsets, [group, "_part"])
        .withColumn("rnk", F.col("_offset") + F.col("_id") - F.col("_first"))
        .drop("_id", "_part", "_first", "_offset")
    )


def rank_slice(ranked: DataFrame, low: float = TERM_FROM, high: float = TERM_TO) -> DataFrame:
    """Entries from rank ``int(N * low)`` up to, not including, rank ``int(N * high)``."""
    return ranked.where(
        (F.col("rnk") >= F.floor(F.col("entries") * F.lit(low)))
        & (F.col("rnk") < F.floor(F.col("entries") * F.lit(high)))
    )
