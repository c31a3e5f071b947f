"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep one row.

Texts are equal if they are identical without the white space ``[\\x20\\x09-\\x0D]``. Of equal
texts the row with the most code points stays, then the smallest id (null last), then the first
read; so of repeated rows exactly one stays. A null text is an empty one, and all empty texts
are equal. An empty table gives an empty result. Extra columns, whatever their names, are carried
by ``kept_documents`` and not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vakanz.llm.common import counted_broadcast, free_name, staged, without_keys, words_of


def squeezed(text: Column | str) -> Column:
    """The text without white space, by which texts are compared."""
    return F.regexp_replace(words_of(text), "[\\x20\\x09-\\x0D]+", "")


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _grouped(
    docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]
) -> DataFrame:
    """Written rows: id, hash, words (the text where hashes collide), sha, members, keep, row."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = source.select("id", F.length(words_of("text")).alias("points"), squeezed("text").alias("norm"))
    narrow = staged(
        rows.select(
            F.monotonically_increasing_id().alias("row"), "id", "points",
            digest(F.col("norm")).alias("hash"), F.unhex(F.sha2("norm", 256)).alias("sha"),
        )
    )
    shared = staged(narrow.groupBy("hash").count().filter("count > 1").select("hash"))
    # Copies meet in the partial aggregate of each task: the shuffle gets one text a group and task.
    variants = (
        source.select(squeezed("text").alias("norm"))
        .select(digest(F.col("norm")).alias("hash"), "norm")
        .join(counted_broadcast(shared), "hash", "left_semi")
        .groupBy("hash", "norm").agg(F.count("*").alias("n"))
    )
    collided = staged(variants.groupBy("hash").count().filter("count > 1").select("hash"))
    if collided.isEmpty():
        keyed = narrow.withColumn("words", F.lit(None).cast("string"))
    else:
        own = rows.select("id", "points", digest(F.col("norm")).alias("hash"), "norm", F.unhex(F.sha2("norm", 256)).alias("sha"))
        apart = own.join(collided, "hash", "left_semi").select(
            (-1 - F.monotonically_increasing_id()).alias("row"), "id", "points", "hash", "sha", F.col("norm").alias("words")
        )
        keyed = narrow.join(collided, "hash", "left_anti").withColumn("words", F.lit(None).cast("string"))
        keyed = staged(keyed.unionByName(apart))
    groups = (
        keyed.groupBy("hash", "words")
        .agg(
            F.count("*").alias("members"),
            F.min(F.struct((-F.col("points")).alias("points"), F.col("id").isNull().alias("none"), "id", "row")).alias("keep"),
        )
        .filter("members > 1")
    )
    left, right = keyed.alias("l"), groups.alias("r")
    same = F.col("l.hash").eqNullSafe(F.col("r.hash")) & F.col("l.words").eqNullSafe(F.col("r.words"))
    return left.join(right, same, "left").select("l.id", "l.hash", "l.words", "l.sha", "l.row", "r.members", "r.keep")


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = md5_128,
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    The texts of groups are compared byte by byte; texts that share a hash only are kept apart.
    Hot groups: counts, the row to keep and the comparison are aggregated before their shuffle.
    """
    found = _grouped(docs, id_col, text_col, digest)
    alone = F.col("members").isNull()
    return found.select(
        F.col("id").alias("doc_id"),
        F.when(alone, F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("members", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("keep.row") == F.col("row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def kept_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = md5_128,
) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns.

    The keys of rows that go are joined, not those that stay: they are few, and broadcast if counted so.
    """
    found = _grouped(docs, id_col, text_col, digest)
    stays = F.col("members").isNull() | (F.col("keep.row") == F.col("row"))
    keys = (
        found.groupBy("id", "hash", "words").agg(F.count("*").alias("rows"), F.max(stays).alias("stays"))
        .filter("NOT stays OR rows > 1").select(F.col("id").alias("key_id"), "hash", "words", "stays")
    )
    name = free_name(docs, "content")
    marked = docs.withColumn(name, squeezed(text_col))

    def same(keys: DataFrame) -> Column:
        return (
            marked[id_col].eqNullSafe(keys["key_id"])
            & digest(marked[name]).eqNullSafe(keys["hash"])
            & (keys["words"].isNull() | (keys["words"] == marked[name]))
        )

    return without_keys(marked, staged(keys), same, [id_col, name]).select(*docs.columns)
