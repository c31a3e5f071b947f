"""Readable output: posting text, file names, report lines, rounding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels of the readable posting, in output order.
POSTING_LABELS = (
    ("URL", "url"),
    ("Titel", "title"),
    ("Unternehmen", "organization"),
    ("Veröffentlichung", "date_posted"),
    ("Bildungs-Voraussetzungen", "educational_requirements"),
    ("Branche", "industry"),
    ("Beschäftigungsverhältnis", "employment_type"),
    ("Berufserhfarung", "experience_requirements"),
)
FILE_NAME_CHARS = 20


def fingerprint(columns: Sequence[Column]) -> Column:
    """md5 over the given string columns; missing and empty values differ."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]
    return F.md5(F.concat_ws("\x1f", *parts))


def sections_text(sections: Column) -> Column:
    """Each heading, its content on the next line, blank lines between sections."""
    return F.array_join(
        F.transform(sections, lambda s: F.concat(s["heading"], F.lit("\n"), s["content"])), "\n\n"
    )


def posting_text(sections: str = "sections") -> Column:
    """A posting as labelled lines followed by its sections."""
    lines = [
        F.concat(F.lit(f"{label}: "), F.coalesce(F.col(name).cast("string"), F.lit("None")))
        for label, name in POSTING_LABELS
    ]
    body = F.concat(F.lit("Anzeigentext:\n"), sections_text(F.col(sections)), F.lit("\n"))
    return F.concat_ws("\n", *lines, body)


def file_name(title: Column, posting_id: Column) -> Column:
    """Letters, digits and underscores of the title, at most twenty, then the posting id."""
    short = F.substring(F.regexp_replace(title, r"(?U)\W", ""), 1, FILE_NAME_CHARS)
    return F.concat(F.coalesce(short, F.lit("unknown")), posting_id)


def report_line(term: Column, count: Column) -> Column:
    return F.concat_ws(",", term, count.cast("string"))


def mean2(total: Column, count: Column) -> Column:
    """Mean with two decimals, half to even; NULL without rows."""
    return F.bround(F.try_divide(total.cast("double"), count.cast("double")), 2)
