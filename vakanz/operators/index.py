"""Section index: posting and paragraph tables, token statistics, index information."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vakanz.functions.render import mean2
from vakanz.functions.text import term_counts, tokens
from vakanz.runtime import broadcast_if_small

INDEXED = (
    "posting_id", "url", "title", "organization", "educational_requirements", "employment_type",
    "industry", "experience_requirements",
)


def posting_table(postings: DataFrame) -> DataFrame:
    return postings.select(*INDEXED)


def paragraph_table(postings: DataFrame) -> DataFrame:
    """One row per section, numbered by its place in the posting."""
    return postings.select(
        "posting_id", F.posexplode("sections").alias("paragraph_number", "_section")
    ).select(
        "posting_id",
        "paragraph_number",
        F.col("_section.heading").alias("paragraph_heading"),
        F.col("_section.content").alias("paragraph_content"),
    )


def with_field(df: DataFrame, field: str) -> DataFrame:
    """Rows in which a field is filled."""
    return df.where(F.col(field).isNotNull())


def headings_by_posting(postings: DataFrame, paragraphs: DataFrame, key: str) -> DataFrame:
    """Every posting with its paragraphs; a posting without any is kept once."""
    return postings.join(paragraphs, key, "left")


def inverted_index(
    df: DataFrame, keys: Sequence[str], text: str, stop: Sequence[str] = ()
) -> DataFrame:
    """``(term, keys, tf)``; counted inside the row, so no shuffle is needed."""
    found = tokens(F.col(text), stop)
    return df.select(*keys, F.inline(term_counts(found))).select("term", *keys, "tf")


def heading_terms(
    paragraphs: DataFrame, keys: Sequence[str], heading: str, stop_words: DataFrame | None = None
) -> DataFrame:
    """``(term, keys, tf, length)``: the inverted index of headings, with the tokens of each heading.

    Stop words, a table of any length, are dropped after counting and before lengths are taken.
    """
    found = inverted_index(paragraphs, keys, heading)
    if stop_words is not None:
        found = drop_stop_words(found, "term", stop_words)
    length = F.sum("tf").over(Window.partitionBy(*keys)).cast("int")
    return found.withColumn("tf", F.col("tf").cast("int")).withColumn("length", length)


def term_stats(index: DataFrame) -> DataFrame:
    """Documents and occurrences per term."""
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def heading_vocabulary(df: DataFrame, tokens_column: str) -> DataFrame:
    """``(term, df)`` of tokenised headings; repeats are dropped in the row, before the shuffle."""
    return (
        df.select(F.explode(F.array_distinct(tokens_column)).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("df"))
    )


def drop_stop_words(df: DataFrame, column: str, stop_words: DataFrame) -> DataFrame:
    """Rows whose word is not in a stop-word table."""
    stop = broadcast_if_small(stop_words.select(F.col("term").alias(column)))
    return df.join(stop, column, "left_anti")


def index_counts(postings: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """One row: postings, paragraphs and the average number of paragraphs per posting."""
    both = postings.select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(
        paragraphs.select(F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    counts = both.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("postings"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("paragraphs"),
    )
    return counts.withColumn("avg_paragraphs", mean2(F.col("paragraphs"), F.col("postings")))


def index_info(counts: DataFrame) -> DataFrame:
    """The index information as report lines."""
    lines = F.array(
        F.format_string("The Index contains %d Documents", "postings"),
        F.concat(
            F.lit("On Average every Document contains "),
            F.coalesce(F.col("avg_paragraphs").cast("string"), F.lit("no")),
            F.lit(" Paragraphs"),
        ),
    )
    return counts.select(F.posexplode(lines).alias("line_no", "value"))
