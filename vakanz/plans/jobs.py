"""Jobs: gather links, parse postings, build the index, write reports."""

from __future__ import annotations

from collections.abc import Collection as Options
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vakanz.functions.links import job_id, result_count, result_url
from vakanz.functions.render import report_line
from vakanz.operators import index as I
from vakanz.operators import links as L
from vakanz.operators import postings as P
from vakanz.operators.profile import term_profile
from vakanz.operators.scoring import Collection, search_index
from vakanz.plans.vocabulary import BENEFITS, REQUIREMENTS, TASKS, intent_terms
from vakanz.runtime import accepted, broadcast_if_small, durable, rejects
from vakanz.sources.store import Store, read_stop_words, slice_of, term_column

# Report numbers and names, and the line written when there is too little data.
REPORTS = {
    0: "index_info",
    1: "task_frequency",
    2: "requirements_frequency",
    3: "benefits_frequency",
}
INTENT_REPORT = {TASKS: 1, REQUIREMENTS: 2, BENEFITS: 3}
TOO_LITTLE = "Für diese Anfrage waren zu wenig Dokumente vorhanden,0"

PARSE, INDEX = 1, 2


KEYS = ["posting_id", "paragraph_number"]


def plan_requests(store: Store, search_term: str, first_pages: DataFrame, base: str) -> None:
    """From first result pages ``(search_term, html)`` to the result pages to request.

    A page that names no count of results is a reject.
    """
    wanted = first_pages.where(F.lower(F.trim("search_term")) == search_term.strip().lower())
    counts = wanted.select(result_count(F.col("html")).cast("bigint").alias("count"))
    tagged = durable(L.page_plan(counts))
    url = result_url(F.lit(base), F.lit(search_term.strip()), F.lit(1), F.col("page_no"))
    store.write(accepted(tagged).withColumn("url", url), search_term, "requests")
    bad = tagged.withColumn("key", F.lit(search_term.strip().lower()))
    store.write(rejects(bad, "counts", "key"), search_term, "rejects/counts")


def gather_links(result_pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unique links of all result pages, and the rejected ones."""
    tagged = L.listing_links(result_pages)
    unique = L.first_per_id(accepted(tagged), ["search_term"], ["page_no", "pos"])
    return unique, rejects(tagged, "links", "page_no")


def parse_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unique usable postings, and the rejected pages. Pages are parsed once."""
    tagged = durable(P.parse_postings(pages))
    return P.distinct_postings(accepted(tagged)), rejects(tagged, "postings", "page_id")


def add_links(store: Store, search_term: str, links: DataFrame, *order: str) -> DataFrame:
    """Add the links whose job id the term has not stored yet, and return them.

    ``links`` are unique, as ``gather_links`` gives them.
    """
    known = store.read_links(search_term).select(job_id(F.col("url")).alias("job_id")).distinct()
    new = durable(links.join(known, "job_id", "left_anti"))
    if not new.isEmpty():
        store.write_links(new, search_term, *order, adds=True)
    return new


def add_postings(store: Store, search_term: str, found: DataFrame) -> DataFrame:
    """Add the postings that the term has not stored yet, and return them.

    Of what is stored only the fingerprints are read, in the ranges that those of ``found`` (unique,
    as ``parse_pages`` gives them) fall into. Fingerprints are columns of the postings themselves, so
    one commit adds both.
    """
    found = durable(found)
    touched = found.select(slice_of("postings").alias("slice")).distinct().collect()  # a fixed number of ranges
    known = store.known("postings", search_term, [row["slice"] for row in touched])
    new = durable(found.join(known, "posting_id", "left_anti"))
    if not new.isEmpty():
        store.write(new, search_term, "postings", adds=True)
    return new


def run_terms(
    store: Store,
    terms: DataFrame,
    result_pages: DataFrame,
    pages: DataFrame,
) -> None:
    """Gather links and parse postings of all ``terms(search_term)``, each stage in one plan.

    Pages are parsed once, whatever the number of terms that link to them.
    """
    wanted = durable(terms.select(term_column("search_term").alias("term")).distinct())
    own = result_pages.withColumn("search_term", term_column("search_term"))
    own = own.join(broadcast_if_small(wanted.withColumnRenamed("term", "search_term")), "search_term", "left_semi")
    links, _ = gather_links(own)
    store.write_links_of(links, wanted, "page_no", "pos")
    linked = durable(store.read_links_of(wanted).distinct())
    urls = broadcast_if_small(durable(linked.select("url").distinct()))
    parsed = durable(P.parse_postings(pages.join(urls, "url", "left_semi")).join(pages.select("page_id", F.col("url").alias("page_url")), "page_id"))
    of_terms = accepted(parsed).join(linked.withColumnRenamed("url", "page_url"), "page_url")
    first = of_terms.groupBy("search_term", "posting_id").agg(F.min("page_id").alias("page_id"))
    kept = of_terms.join(first, ["search_term", "posting_id", "page_id"], "left_semi")
    store.write_terms(kept, wanted, "postings")


def run(
    store: Store,
    search_term: str,
    options: Options[int],
    result_pages: DataFrame | None = None,
    pages: DataFrame | None = None,
    use_stored_links: bool = False,
    use_stored_postings: bool = False,
    re_index: bool = True,
    stop: DataFrame | None = None,
    accumulate: bool = False,
) -> None:
    """Run the chosen stages for a search term, reusing stored results where asked to.

    Links are always gathered. Option 1 parses postings, options 1 and 2 build the index.
    ``result_pages(search_term, page_no, html)`` and ``pages(page_id, url, html)`` hold the
    landed pages; ``stop(term)`` are words that headings are not indexed by, the built-in ones if
    not given. What was stored is replaced, or with ``accumulate`` added to: links of new job ids and
    postings of new content.
    """
    if not use_stored_links:
        wanted = result_pages.where(F.lower(F.trim("search_term")) == search_term.strip().lower())
        links, bad_links = gather_links(wanted)
        if accumulate:
            add_links(store, search_term, links, "page_no", "pos")
        else:
            store.write_links(links, search_term, "page_no", "pos")
        store.write(bad_links, search_term, "rejects/links", adds=accumulate)
    if PARSE not in options:
        return
    if not use_stored_postings:
        links = broadcast_if_small(durable(store.read_links(search_term).select("url").distinct()))
        found, bad_pages = parse_pages(pages.join(links, "url", "left_semi"))
        if accumulate:
            add_postings(store, search_term, found)
        else:
            store.write(found, search_term, "postings")
        store.write(bad_pages, search_term, "rejects/postings", adds=accumulate)
    postings = store.read("postings", search_term)
    store.export_postings(postings, search_term)
    if INDEX in options and (re_index or not store.available("index/postings", search_term)):
        stop = stop if stop is not None else read_stop_words(store.spark)
        store.write_index(I.posting_table(postings), I.paragraph_table(postings), search_term, stop)


def search_stored(store: Store, search_term: str, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores and status of the stored headings of a search term."""
    sizes = store.read("index/statistics", search_term).first()
    documents = sizes["postings"] + sizes["paragraphs"]
    size = Collection(documents, sizes["tokens"] / documents if documents else 0.0)
    index, vocabulary = store.read("index/terms", search_term), store.read("index/vocabulary", search_term)
    return search_index(index, vocabulary, KEYS, size, terms)


def frequency_lines(
    store: Store,
    search_term: str,
    stop: Sequence[str] | DataFrame,
    terms: DataFrame | None = None,
    keep_null_bucket: bool = False,
) -> DataFrame:
    """``(report, line_no, value)`` of the three term reports."""
    scored, status = search_stored(store, search_term, terms if terms is not None else intent_terms())
    paragraphs = store.read("index/paragraphs", search_term)
    profile = term_profile(scored, paragraphs, KEYS, "paragraph_content", stop, keep_null_bucket)
    return report_lines(profile, status)


def report_name(intent: Column) -> Column:
    pairs = [(F.lit(i), F.lit(REPORTS[n])) for i, n in INTENT_REPORT.items()]
    return F.element_at(F.create_map(*[c for pair in pairs for c in pair]), intent)


def report_lines(profile: DataFrame, status: DataFrame) -> DataFrame:
    """Ranked terms as ``term,count`` lines; one message line where there was too little data."""
    lines = profile.select(
        report_name(F.col("intent")).alias("report"),
        F.col("rnk").alias("line_no"),
        report_line(F.coalesce("term", F.lit("None")), F.col("cnt")).alias("value"),
    )
    message = status.where("status = 'insufficient'").select(
        report_name(F.col("intent")).alias("report"),
        F.lit(0).cast("bigint").alias("line_no"),
        F.lit(TOO_LITTLE).alias("value"),
    )
    return lines.unionAll(message)


def present(
    store: Store,
    search_term: str,
    options: Options[int],
    stop: Sequence[str] | DataFrame = (),
    terms: DataFrame | None = None,
    keep_null_bucket: bool = False,
) -> str:
    """Write the chosen reports (0 index information, 1 tasks, 2 requirements, 3 benefits).

    ``stop`` are words that no report counts: a list, or a table ``(term)`` of any length, as
    ``read_stop_words`` gives it. Headings are searched as they were indexed.
    """
    postings, paragraphs = store.open_index(search_term)
    frames = []
    if 0 in options:
        info = I.index_info(I.index_counts(postings, paragraphs))
        frames.append(info.select(F.lit(REPORTS[0]).alias("report"), "line_no", "value"))
    wanted = [i for i, n in INTENT_REPORT.items() if n in options]
    if wanted:
        chosen = (terms if terms is not None else intent_terms()).where(F.col("intent").isin(wanted))
        frames.append(frequency_lines(store, search_term, stop, chosen, keep_null_bucket))
    reports = frames[0]
    for frame in frames[1:]:
        reports = reports.unionByName(frame)
    names = [REPORTS[n] for n in sorted(options) if n in REPORTS]
    return store.write_reports(durable(reports), search_term, names)
