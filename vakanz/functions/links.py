"""Result-page and link expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats and limits of the result pages.
RESULT_COUNT = r"(?<=\()[0-9]{2,4}(?= Jobs gefunden\))"
JOB_ID = "[0-9A-Fa-f-]{9,}"
PER_PAGE = 25
FIRST_PAGE_LIMIT = 10
LAST_PAGE = 40


def result_count(page: Column) -> Column:
    """Number of postings announced on a result page; NULL when the page names none."""
    return F.regexp_extract(page, RESULT_COUNT, 0).try_cast("int")


def job_id(link: Column, pattern: str = JOB_ID) -> Column:
    """First id-like run of a link, case kept; NULL when there is none."""
    return F.nullif(F.regexp_extract(link, pattern, 0), F.lit(""))


def result_url(base: Column, term: Column, start: Column, page: Column) -> Column:
    """Address of a result page; the search term is not escaped."""
    return F.concat(
        base, F.lit("q="), term, F.lit("&stpage="), start.cast("string"),
        F.lit("&page="), page.cast("string"),
    )


def page_numbers(count: Column) -> Column:
    """Result pages to request: the first one holds up to 250 postings, later ones 25."""
    first = F.least(F.floor(count / PER_PAGE), F.lit(FIRST_PAGE_LIMIT))
    last = F.least(F.ceil(count / PER_PAGE), F.lit(LAST_PAGE))
    return F.sequence(first.cast("int"), last.cast("int"))
