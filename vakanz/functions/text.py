"""Line cleaning, tokens and words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vakanz.functions.html import let

# Thresholds and patterns the results depend on.
MIN_LINE = 4
MIN_WORD = 6
TOKEN = r"\p{L}{2,}"


def clean_line(line: Column) -> Column:
    """Letters and single spaces only, not trimmed, case kept."""
    # Runs of other characters become a space; a run that is one already is passed over.
    return F.regexp_replace(line, r"[^\p{L} ]\P{L}*| \P{L}+", " ")


def sanitize(lines: Column) -> Column:
    """Cleaned, trimmed, lowercased lines longer than three characters.

    Empty when the first line is missing or empty, or when only one line survives.
    """
    trimmed = F.transform(lines, lambda line: F.trim(clean_line(line)))
    kept = F.transform(F.filter(trimmed, lambda line: F.length(line) >= MIN_LINE), F.lower)
    first = F.get(lines, F.lit(0))
    none = F.array().cast("array<string>")
    checked = let(kept, lambda k: F.when(F.size(k) > 1, k).otherwise(none))
    return F.when(first != "", checked).otherwise(none)


def term_counts(words: Column) -> Column:
    """``array<struct<term,tf>>`` of an array of words, sorted by term.

    Counts are the lengths of the runs in the sorted array: no shuffle, n log n in the row.
    """

    def runs(ordered: Column) -> Column:
        heads = F.filter(
            F.transform(ordered, lambda t, i: F.struct(t.alias("term"), i.alias("at"))),
            lambda x: (x["at"] == 0) | (F.get(ordered, x["at"] - 1) != x["term"]),
        )
        return let(
            heads,
            lambda h: F.transform(
                h,
                lambda x, k: F.struct(
                    x["term"].alias("term"),
                    (F.coalesce(F.get(h, k + 1)["at"], F.size(ordered)) - x["at"]).alias("tf"),
                ),
            ),
        )

    return let(F.sort_array(words), runs)


def in_list(stop: Sequence[str]) -> str:
    quoted = ",".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in stop)
    return f"IN ({quoted})"


def where_words(words: Column, condition: str) -> Column:
    """Elements ``w`` of an array that meet an SQL condition.

    Long word lists are written as SQL, which becomes one hash-set lookup per element.
    """
    return F.call_function("filter", words, F.expr(f"w -> {condition}"))


def not_stop_word(stop: Sequence[str], word: str = "w") -> str:
    """SQL condition on the column or lambda variable ``word``."""
    return f"{word} NOT {in_list(stop)}" if stop else "true"


def tokens(text: Column, stop: Sequence[str] = ()) -> Column:
    """Runs of two or more letters, lowercased, without stop words, in text order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)
    return where_words(found, not_stop_word(stop)) if stop else found


def split_words(text: Column) -> Column:
    """Split at every single space; empty strings are kept."""
    return F.split(text, " ", -1)


def is_term(stop: Sequence[str] = ()) -> str:
    """SQL condition on a word ``w``: long enough for the frequency ranking and no stop word."""
    return f"length(w) >= {MIN_WORD} AND w <> 'None' AND {not_stop_word(stop)}"


def ranked_words(text: Column, stop: Sequence[str] = ()) -> Column:
    """Words of a text that take part in the ranking, in text order, repeats kept."""
    return where_words(split_words(text), is_term(stop))


def bucketed_words(text: Column, stop: Sequence[str] = ()) -> Column:
    """All words of a text, NULL in place of those that do not take part in the ranking."""
    mask = F.expr(f"w -> CASE WHEN {is_term(stop)} THEN w END")
    return F.call_function("transform", split_words(text), mask)
