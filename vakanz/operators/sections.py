"""Headed sections of a description, assembled inside the row by sorting: no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vakanz.functions import html as H
from vakanz.functions.arrays import matching_ends, running_maxima
from vakanz.functions.text import sanitize

# What counts as a heading, and the size rules of sections.
HEADING_TAGS = ("strong", "b", "h2", "h3", "h4", "h5", "h6")
HEADING_STYLE = "font-weight|font-size: 14"
MIN_TEXT = 4
MIN_HEADING, MAX_HEADING = 6, 39
LAST_SECTION_ROWS = 11
MIN_LONGEST_LINE = 21


def flat_description(description: Column) -> Column:
    """Description without line breaks, comments and code."""
    one_line = F.replace(F.replace(F.trim(description), F.lit("\n")), F.lit("\r"))
    return H.strip_code(one_line)


def with_text_nodes(df: DataFrame, flat: str, into: str) -> DataFrame:
    """Add the elements that carry text. Where the first text follows a child, ``text`` is NULL.

    Everything about late text is NULL, and not computed, for pages that cannot have any.
    """
    return (
        df.withColumn("_tags", F.when(H.may_have_late_text(F.col(flat)), H.tags(F.col(flat))))
        .withColumn("_pairs", H.tag_pairs(F.col("_tags")))
        .withColumn("_steps", H.pair_steps(F.col("_pairs")))
        .withColumn("_nested", matching_ends(F.col("_steps")))
        .withColumn("_depths", H.tag_depths(F.col("_tags"), F.col("_steps")))
        .withColumn(
            "_late",
            F.when(H.crossing(F.col("_pairs"), F.col("_nested")), H.late_in_turn(F.col("_tags"), MIN_TEXT))
            .otherwise(H.late_by_depth(F.col("_tags"), F.col("_depths"), MIN_TEXT)),
        )
        .withColumn(into, _text_nodes(F.col(flat), F.col("_late")))
        .drop("_tags", "_pairs", "_steps", "_nested", "_depths", "_late")
    )


def _text_nodes(flat: Column, late: Column) -> Column:
    lead = F.when(F.startswith(flat, F.lit("<")), 0).otherwise(1)
    known = F.transform(
        H.nodes(flat),
        lambda n, i: F.struct(
            n["tag"].alias("tag"), F.when(~F.coalesce(F.get(late, i - lead), F.lit(False)), n["text"]).alias("text")
        ),
    )
    found = F.when(F.coalesce(F.exists(late, lambda x: x), F.lit(False)), known).otherwise(H.nodes(flat))
    return F.filter(found, lambda n: n["text"].isNull() | (F.length(n["text"]) >= MIN_TEXT))


def heading_texts(
    nodes: Column, flat: Column, tags: Sequence[str] = HEADING_TAGS
) -> Column:
    """Texts of heading elements, or of elements styled as headings when there are none.

    Attributes are read from the description only in the second case.
    """
    by_tag = F.filter(nodes, lambda n: n["tag"].isin(*tags))
    styled = F.filter(
        H.nodes(flat, with_attrs=True),
        lambda n: (F.length(n["text"]) >= MIN_TEXT)
        & F.regexp_like(
            F.coalesce(H.attribute(n["attrs"], "style"), F.lit("")), F.lit(HEADING_STYLE)
        ),
    )
    chosen = H.let(
        by_tag,
        lambda found: F.when(F.size(found) > 0, F.transform(found, lambda n: n["text"])),
    )
    return F.coalesce(chosen, F.transform(styled, lambda n: n["text"]))


def _key(text: Column, kind: int, at: Column) -> Column:
    return F.struct(text.alias("text"), F.lit(kind).alias("kind"), at.alias("at"))


def first_places(headings: Column, rows: Column) -> Column:
    """For each heading the index of the first row equal to it, NULL when there is none.

    Rows and headings are sorted together, so that a heading follows the rows equal to it; the
    begin of its run is carried along.
    """
    both = F.concat(
        F.transform(rows, lambda r, i: _key(r, 0, i)), F.transform(headings, lambda h, i: _key(h, 1, i))
    )

    def bound(ordered: Column) -> Column:
        begins = F.transform(
            ordered,
            lambda e, k: F.when(
                (k == 0) | ~F.get(ordered, k - 1)["text"].eqNullSafe(e["text"]), k.cast("bigint")
            ).otherwise(F.lit(0).cast("bigint")),
        )
        placed = F.zip_with(
            ordered,
            running_maxima(begins),
            lambda e, begin: F.when(
                e["kind"] == 1,
                F.struct(
                    e["at"].alias("heading"),
                    H.let(
                        F.get(ordered, begin.cast("int")),
                        lambda first: F.when((first["kind"] == 0) & first["text"].isNotNull(), first["at"]),
                    ).alias("row"),
                ),
            ),
        )
        return F.transform(F.array_sort(F.filter(placed, lambda p: p.isNotNull())), lambda p: p["row"])

    return H.let(F.array_sort(both), bound)


def raw_sections(headings: Column, rows: Column) -> Column:
    """``array<array<string>>``: the rows of each heading's section, in heading order.

    A section runs from the first row equal to its heading up to the first row equal to the next
    heading; the last one is cut to a fixed number of rows. A heading without text of its own
    has no section and ends the one before at the first row without text.
    """
    without_text = F.array_position(F.transform(rows, F.isnull), True).cast("int") - 1

    def cut(places: Column) -> Column:
        def section(start: Column, index: Column) -> Column:
            heading, last = F.get(headings, index), index + 1 >= F.size(headings)
            following = F.when(F.get(headings, index + 1).isNull(), without_text).otherwise(
                F.coalesce(F.get(places, index + 1), F.lit(-1))
            )
            length = F.when(last, F.lit(LAST_SECTION_ROWS)).otherwise(F.greatest(following - start, F.lit(0)))
            proper = F.length(heading).between(MIN_HEADING, MAX_HEADING) & start.isNotNull()
            return F.when(proper, F.slice(rows, start + 1, length)).otherwise(F.array().cast("array<string>"))

        return F.transform(places, section)

    return H.let(first_places(headings, rows), cut)


def finish_sections(raw: Column) -> Column:
    """``array<struct<heading,content>>``, longest section first.

    Sections without a line over twenty characters are dropped. Of sections with the same
    heading the later content stays, at the place of the first.
    """
    by_size = F.transform(
        F.sort_array(
            F.transform(
                raw, lambda rows, i: F.struct((-F.size(rows)).alias("k"), i.alias("i"), rows.alias("rows"))
            )
        ),
        lambda s: s["rows"],
    )
    clean = F.filter(
        F.transform(by_size, sanitize),
        lambda lines: F.coalesce(
            F.array_max(F.transform(lines, F.length)) >= MIN_LONGEST_LINE, F.lit(False)
        ),
    )
    pairs = F.transform(
        clean,
        lambda lines: F.struct(
            F.get(lines, F.lit(0)).alias("heading"),
            F.array_join(F.slice(lines, F.lit(2), F.size(lines)), " ").alias("content"),
        ),
    )
    return H.let(pairs, _latest_per_heading)


def _latest_per_heading(pairs: Column) -> Column:
    """The last content of each heading, in the order of their first ones."""
    numbered = F.transform(pairs, lambda p, i: F.struct(p["heading"].alias("heading"), i.alias("at"), p["content"].alias("content")))

    def merged(ordered: Column) -> Column:
        begins = F.transform(
            ordered,
            lambda p, k: F.when((k == 0) | ~F.get(ordered, k - 1)["heading"].eqNullSafe(p["heading"]), k.cast("bigint"))
            .otherwise(F.lit(0).cast("bigint")),
        )
        runs = F.zip_with(running_maxima(begins), F.sequence(F.lit(0), F.size(ordered) - 1), lambda b, k: F.struct(b.alias("begin"), k.alias("k")))
        ends = F.filter(
            runs,
            lambda r: (r["k"] + 1 == F.size(ordered))
            | ~F.get(ordered, r["k"] + 1)["heading"].eqNullSafe(F.get(ordered, r["k"])["heading"]),
        )
        kept = F.transform(
            ends,
            lambda r: F.struct(
                F.get(ordered, r["begin"].cast("int"))["at"].alias("at"),
                F.get(ordered, r["k"])["heading"].alias("heading"),
                F.get(ordered, r["k"])["content"].alias("content"),
            ),
        )
        by_first = F.transform(
            F.array_sort(kept), lambda p: F.struct(p["heading"].alias("heading"), p["content"].alias("content"))
        )
        return F.when(F.size(ordered) > 0, by_first).otherwise(pairs)

    return H.let(F.array_sort(numbered), merged)


def with_sections(df, description: str, tags: Sequence[str] = HEADING_TAGS):
    """Add ``sections`` to a frame; the steps are columns of their own, so each runs once."""
    return (
        with_text_nodes(df.withColumn("_flat", flat_description(F.col(description))), "_flat", "_nodes")
        .withColumn("_headings", heading_texts(F.col("_nodes"), F.col("_flat"), tags))
        .withColumn("_rows", F.transform("_nodes", lambda n: n["text"]))
        .withColumn("sections", finish_sections(raw_sections(F.col("_headings"), F.col("_rows"))))
        .drop("_flat", "_nodes", "_headings", "_rows")
    )
