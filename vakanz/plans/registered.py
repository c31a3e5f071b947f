"""Named queries over the given tables; each runs over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vakanz.functions import fields as V
from vakanz.functions import html as H
from vakanz.functions import links as L
from vakanz.functions import render as R
from vakanz.functions import text as X
from vakanz.functions.stopwords import BUILT_IN
from vakanz.operators import index as I
from vakanz.operators import links as LK
from vakanz.operators import postings as P
from vakanz.operators import profile as PR
from vakanz.operators import ranking as RK
from vakanz.operators import scoring as SC
from vakanz.operators import sections as S
from vakanz.operators.expand import expand
from vakanz.plans import derived as D
from vakanz.plans import jobs
from vakanz.plans.vocabulary import intent_terms
from vakanz.runtime import accepted, durable, items, rejects, stage_folder
from vakanz.sources.store import Store, export_name, read_stop_words, term_column

STOP = BUILT_IN
PAGE_TAGS = ("h1", "b")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return _table(spark, folder, "documents").select("doc_id", *columns)


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "pages")


def _headed(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as paragraphs: the first line is the heading, the rest the content."""
    lines = F.split("text", "\n", 2)
    return _documents(spark, folder, "text").select(
        "doc_id",
        F.get(lines, F.lit(0)).alias("heading"),
        F.coalesce(F.get(lines, F.lit(1)), F.lit("")).alias("content"),
    )


def _score() -> Column:
    return (F.col("score_micro") / F.lit(1e6)).alias("score")


def _search(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    headed = _headed(spark, folder)
    postings = _table(spark, folder, "documents").count()
    return SC.search(headed, ["doc_id"], "heading", postings, intent_terms(), STOP)


# Links


def link_extract(spark: SparkSession, folder: str) -> DataFrame:
    found = LK.anchor_links(_pages(spark, folder), "page_id", id_pattern="[0-9a-z]{5,}")
    return found.select("page_id", "pos", "url", "job_id")


def link_rejects(spark: SparkSession, folder: str) -> DataFrame:
    found = LK.anchor_links(_pages(spark, folder), "page_id", id_pattern="[0-9a-z]{5,}")
    return rejects(found, "links", "page_id").groupBy("stage", "key", "reason").agg(
        F.count("*").alias("n")
    )


def link_first_per_id(spark: SparkSession, folder: str) -> DataFrame:
    found = accepted(LK.anchor_links(_pages(spark, folder), "page_id", id_pattern="[0-9a-z]{5,}"))
    return LK.first_per_id(found, [], ["page_id", "pos"])


def page_url_ids(spark: SparkSession, folder: str) -> DataFrame:
    urls = _table(spark, folder, "pages").select("page_id", "url")
    with_id = urls.withColumn("job_id", L.job_id(F.col("url"), "[0-9]+"))
    return LK.first_per_id(with_id.where("job_id IS NOT NULL"), [], ["page_id"])


def listing_links(spark: SparkSession, folder: str) -> DataFrame:
    pages = D.result_pages(_documents(spark, folder, "text", "lang"))
    return LK.listing_links(pages)


def listing_first_links(spark: SparkSession, folder: str) -> DataFrame:
    pages = D.result_pages(_documents(spark, folder, "text", "lang"))
    unique, _ = jobs.gather_links(pages)
    return unique


def _announced(n: Column) -> Column:
    """The count that a result page names in its text."""
    page = F.concat(F.lit("<p>(7) Stellen</p><b>Treffer ("), n.cast("string"), F.lit(" Jobs gefunden)</b>"))
    return L.result_count(page)


def result_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = _table(spark, folder, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return counts.select("o_custkey", _announced(F.col("n")).alias("found"))


def result_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Result pages that name no usable count."""
    counts = result_counts(spark, folder).withColumn("count", F.col("found").cast("bigint"))
    return rejects(LK.page_plan(counts, "o_custkey"), "counts", "o_custkey")


def page_plan(spark: SparkSession, folder: str) -> DataFrame:
    counts = _table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    counts = counts.select("l_suppkey", _announced(F.col("n")).cast("bigint").alias("count"))
    term = F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string"))
    url = L.result_url(F.lit("https://jobs.example.org/?"), term, F.lit(1), F.col("page_no"))
    return accepted(LK.page_plan(counts, "l_suppkey")).select(
        "l_suppkey", F.col("count").alias("n"), "page_no", url.alias("url")
    )


# Pages


def page_nodes(spark: SparkSession, folder: str) -> DataFrame:
    flat = _pages(spark, folder).withColumn("flat", S.flat_description(F.col("html")))
    nodes = S.with_text_nodes(flat, "flat", "nodes").select("page_id", F.posexplode(items("nodes")).alias("pos", "n"))
    return nodes.select("page_id", "pos", "n.tag", "n.text")


def page_headings(spark: SparkSession, folder: str) -> DataFrame:
    flat = _pages(spark, folder).withColumn("flat", S.flat_description(F.col("html")))
    nodes = S.with_text_nodes(flat, "flat", "nodes")
    found = S.heading_texts(F.col("nodes"), F.col("flat"), PAGE_TAGS)
    return nodes.select("page_id", F.posexplode(found).alias("pos", "heading"))


def page_sections(spark: SparkSession, folder: str) -> DataFrame:
    found = S.with_sections(_pages(spark, folder).select("page_id", "html"), "html", PAGE_TAGS)
    return found.select("page_id", F.posexplode(items("sections")).alias("section_no", "s")).select(
        "page_id", "section_no", "s.heading", "s.content"
    )


def styled_headings(spark: SparkSession, folder: str) -> DataFrame:
    """Headings known by their style alone, in pages made from the documents."""
    pages = D.styled_pages(_documents(spark, folder, "text"))
    flat = pages.withColumn("flat", S.flat_description(F.col("html")))
    nodes = S.with_text_nodes(flat, "flat", "nodes")
    found = S.heading_texts(F.col("nodes"), F.col("flat"))
    return nodes.select("page_id", F.posexplode(found).alias("pos", "heading"))


# Postings


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    pages = D.posting_pages(_documents(spark, folder, "text", "lang", "source"))
    return P.parse_postings(pages)


def postings_parsed(spark: SparkSession, folder: str) -> DataFrame:
    fields = [c for c in P.CONTENT if c not in ("location", "sections")]
    return accepted(_parsed(spark, folder)).select(
        "page_id", *fields, "location.latitude", "location.longitude"
    )


def posting_sections(spark: SparkSession, folder: str) -> DataFrame:
    found = accepted(_parsed(spark, folder))
    return found.select("page_id", F.posexplode(items("sections")).alias("section_no", "s")).select(
        "page_id", "section_no", "s.heading", "s.content"
    )


def posting_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return rejects(_parsed(spark, folder), "postings", "page_id")


def paragraph_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraph table of the postings, under their page ids."""
    found = accepted(_parsed(spark, folder))
    return I.paragraph_table(found.withColumn("posting_id", F.col("page_id").cast("string")))


def posting_dedup(spark: SparkSession, folder: str) -> DataFrame:
    unique = P.distinct_postings(accepted(durable(_parsed(spark, folder))))
    return unique.select("page_id", "url", "title", F.size("sections").alias("n_sections"))


def posting_export(spark: SparkSession, folder: str) -> DataFrame:
    name = F.regexp_replace(export_name(), "[0-9a-f]{32}$", "")
    return accepted(_parsed(spark, folder)).select(
        "page_id", name.alias("file_stem"), R.posting_text().alias("value")
    )


def content_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return P.first_copy(_documents(spark, folder, "text"), "doc_id", [F.col("text")])


def json_fields(spark: SparkSession, folder: str) -> DataFrame:
    record = V.parse_json(F.col("props"))
    return (
        _table(spark, folder, "events")
        .withColumn("v", record)
        .select(
            "event_id",
            V.string_field(F.col("v"), "$.k").alias("k_text"),
            V.number_field(F.col("v"), "$.k").alias("k_number"),
            V.joined_field(F.col("v"), "$.k").alias("k_joined"),
            V.string_field(F.col("v"), "$.absent").alias("absent"),
        )
    )


# Text


def line_sanitize(spark: SparkSession, folder: str) -> DataFrame:
    lines = X.sanitize(F.split("text", "\n", -1))
    return _documents(spark, folder, "text").select(
        "doc_id", F.posexplode(lines).alias("pos", "line")
    )


def analyzer_tokens(spark: SparkSession, folder: str) -> DataFrame:
    found = X.tokens(F.col("text"), STOP)
    return _documents(spark, folder, "text").select(
        "doc_id", F.posexplode(found).alias("pos", "token")
    )


def word_filter(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder, "text").select(
        "doc_id",
        F.size(X.split_words(F.col("text"))).alias("words"),
        F.size(X.ranked_words(F.col("text"), STOP)).alias("terms"),
    )


def stop_word_join(spark: SparkSession, folder: str) -> DataFrame:
    words = _documents(spark, folder, "text").select(
        F.explode(X.tokens(F.col("text"))).alias("token")
    )
    counts = words.groupBy("token").agg(F.count("*").alias("n"))
    return I.drop_stop_words(counts, "token", read_stop_words(spark))


def inverted_index(spark: SparkSession, folder: str) -> DataFrame:
    return I.inverted_index(_documents(spark, folder, "text"), ["doc_id"], "text", STOP)


def term_stats(spark: SparkSession, folder: str) -> DataFrame:
    return I.term_stats(inverted_index(spark, folder))


# Index


def _line_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of a document as its paragraphs."""
    lines = F.split("text", "\n", -1)
    return _documents(spark, folder, "text").select(
        "doc_id", F.posexplode(lines).alias("paragraph_number", "paragraph_heading")
    )


def headings_by_doc(spark: SparkSession, folder: str) -> DataFrame:
    parents = _documents(spark, folder, "source")
    return I.headings_by_posting(parents, _line_paragraphs(spark, folder), "doc_id")


def field_exists(spark: SparkSession, folder: str) -> DataFrame:
    joined = _documents(spark, folder, "lang").join(
        _table(spark, folder, "labels"), "doc_id", "left"
    )
    return I.with_field(joined, "quality").groupBy("lang").agg(F.count("*").alias("n"))


def index_counts(spark: SparkSession, folder: str) -> DataFrame:
    return I.index_counts(_table(spark, folder, "documents"), _line_paragraphs(spark, folder))


def index_info(spark: SparkSession, folder: str) -> DataFrame:
    return I.index_info(index_counts(spark, folder))


# Retrieval


def fuzzy_expand(spark: SparkSession, folder: str) -> DataFrame:
    headings = SC.tokenised(_headed(spark, folder).select("heading"), "heading", STOP)
    return expand(I.heading_vocabulary(headings, "tokens"), intent_terms(), STOP)


def ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    scored, _ = _search(spark, folder)
    return scored.select("doc_id", "intent", _score())


def search_status(spark: SparkSession, folder: str) -> DataFrame:
    _, status = _search(spark, folder)
    return status


def score_cutoff(spark: SparkSession, folder: str) -> DataFrame:
    scored, _ = _search(spark, folder)
    limits = RK.cutoff(scored, "intent")
    return limits.select("intent", (F.col("cutoff") / F.lit(1e6)).alias("cutoff"))


def median_cut(spark: SparkSession, folder: str) -> DataFrame:
    scored, _ = _search(spark, folder)
    return RK.keep_from_cutoff(scored, "intent").select("doc_id", "intent", _score())


def _term_counts(spark: SparkSession, folder: str, keep_null_bucket: bool) -> DataFrame:
    scored, _ = _search(spark, folder)
    hits = PR.kept_contents(scored, _headed(spark, folder), ["doc_id"], "content")
    return PR.term_frequency(hits, "content", F.col("rnk"), STOP, keep_null_bucket)


def term_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _term_counts(spark, folder, False).select("intent", "term", "cnt")


def term_counts_null_bucket(spark: SparkSession, folder: str) -> DataFrame:
    return _term_counts(spark, folder, True).select("intent", "term", "cnt")


def term_profile(spark: SparkSession, folder: str) -> DataFrame:
    scored, _ = _search(spark, folder)
    return PR.term_profile(scored, _headed(spark, folder), ["doc_id"], "content", STOP)


def _one_intent(intent: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        headed = _headed(spark, folder)
        postings = _table(spark, folder, "documents").count()
        terms = intent_terms().where(F.col("intent") == intent)
        scored, _ = SC.search(headed, ["doc_id"], "heading", postings, terms, STOP)
        return PR.term_profile(scored, headed, ["doc_id"], "content", STOP).drop("intent")

    return query


def rank_slice(spark: SparkSession, folder: str) -> DataFrame:
    """Rank slice over the words of all documents of a language."""
    hits = _documents(spark, folder, "text", "lang").withColumnRenamed("lang", "intent")
    found = PR.sliced_terms(PR.term_frequency(hits, "text", F.col("doc_id"), STOP))
    return found.withColumnRenamed("intent", "lang")


def report_lines(spark: SparkSession, folder: str) -> DataFrame:
    scored, status = _search(spark, folder)
    profile = PR.term_profile(scored, _headed(spark, folder), ["doc_id"], "content", STOP)
    return jobs.report_lines(profile, status)


# Stored stages: written to a fresh folder of the shared one and read back


def _store(spark: SparkSession) -> Store:
    return Store(spark, stage_folder(spark))


def stored_links(spark: SparkSession, folder: str) -> DataFrame:
    """Unique links of all search terms, written and read in one plan each; terms look like anything."""
    store, found = _store(spark), durable(listing_first_links(spark, folder))
    names = F.create_map(*[F.lit(x) for x in ("de", "007", "en", "a/b", "es", "2024-01-01", "fr", " Koch ")])
    found = found.withColumn("search_term", F.element_at(names, F.col("search_term")))
    terms = found.select(term_column("search_term").alias("term")).distinct()
    store.write_links_of(found, terms, "page_no", "pos")
    return store.read_links_of(terms)


def stored_postings(spark: SparkSession, folder: str) -> DataFrame:
    """Postings stored twice under one term, the second time fewer, and read back."""
    store = _store(spark)
    found, bad = jobs.parse_pages(D.posting_pages(_documents(spark, folder, "text", "lang", "source")))
    store.write(found, "007", "postings")
    store.write(found.where("educational_requirements <> 'de'"), "007", "postings")
    store.write(bad.where("false"), "007", "rejects/postings")
    assert not store.available("rejects/postings", "007")
    return store.read("postings", "007").select("url", "title")


def added_postings(spark: SparkSession, folder: str) -> DataFrame:
    """Postings gathered in three runs that overlap, and the run that added each."""
    store = _store(spark)
    found, _ = jobs.parse_pages(D.posting_pages(_documents(spark, folder, "text", "lang", "source")))
    found = durable(found)
    runs = (found.where("educational_requirements <> 'de'"), found, found)
    added = [jobs.add_postings(store, "koch", run).select("posting_id", F.lit(n).alias("run")) for n, run in enumerate(runs)]
    by_run = added[0].unionAll(added[1]).unionAll(added[2])
    return store.read("postings", "koch").join(by_run, "posting_id").select("url", "title", "run")


def stage_reuse(spark: SparkSession, folder: str) -> DataFrame:
    """What a job finds stored of each stage, after runs that leave some stages out."""
    store, documents = _store(spark), _documents(spark, folder, "text", "lang", "source")
    pages = D.posting_pages(documents).withColumn("url", F.col("page_id").cast("string"))
    results = D.result_pages(documents).where("search_term = 'de'")
    jobs.run(store, "de", set(), results, None)
    store.write_links(pages.join(documents.where("lang = 'de'"), F.col("page_id") == F.col("doc_id")), "de", "page_id")
    jobs.run(store, "de", {jobs.PARSE}, None, pages, use_stored_links=True)
    jobs.run(store, "de", {jobs.PARSE, jobs.INDEX}, None, None, use_stored_links=True, use_stored_postings=True)
    postings, paragraphs = store.open_index("de")
    sizes = [("links", store.read_links("de").count()), ("postings", postings.count()), ("paragraphs", paragraphs.count())]
    return spark.createDataFrame(sizes, "stage string, n long")


def stored_index(spark: SparkSession, folder: str) -> DataFrame:
    store = _store(spark)
    found, _ = jobs.parse_pages(D.posting_pages(_documents(spark, folder, "text", "lang", "source")))
    store.write_index(I.posting_table(found), I.paragraph_table(found), "koch")
    return I.index_counts(*store.open_index("koch"))


def _indexed(spark: SparkSession, folder: str) -> Store:
    """A store whose index holds each document as a posting of one paragraph."""
    store, key = _store(spark), F.lpad(F.col("doc_id").cast("string"), 19, "0").alias("posting_id")
    paragraphs = _headed(spark, folder).select(
        key, F.lit(0).alias("paragraph_number"), F.col("heading").alias("paragraph_heading"), F.col("content").alias("paragraph_content")
    )
    others = [F.lit(None).alias(c) for c in I.INDEXED if c != "posting_id"]
    store.write_index(_documents(spark, folder).select(key, *others), paragraphs, "koch", read_stop_words(spark))
    return store


def stored_search(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of the headings as a stored index has them; nothing is tokenised again."""
    scored, _ = jobs.search_stored(_indexed(spark, folder), "koch", intent_terms())
    return scored.select(F.col("posting_id").cast("bigint").alias("doc_id"), "intent", _score())


def stored_headings(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their lines, stored by document: the join moves no rows."""
    store, key = _store(spark), F.col("doc_id").cast("string").alias("posting_id")
    others = [F.lit(None).alias(c) for c in I.INDEXED if c not in ("posting_id", "organization")]
    parents = _documents(spark, folder, "source").select(key, F.col("source").alias("organization"), *others)
    lines = _line_paragraphs(spark, folder).select(key, "paragraph_number", "paragraph_heading", F.lit(None).alias("paragraph_content"))
    stages = ("index/postings", "index/paragraphs")
    store.write_family(parents, lines, "koch", stages, "posting_id")
    parents, lines = store.read_family("koch", stages, "posting_id")
    found = I.headings_by_posting(parents, lines.hint("merge"), "posting_id")
    return found.select(F.col("posting_id").cast("bigint").alias("doc_id"), F.col("organization").alias("source"), "paragraph_number", "paragraph_heading")


def job_reports(spark: SparkSession, folder: str) -> DataFrame:
    """The reports that a job writes from a stored index, with stop words as a table."""
    path = jobs.present(_indexed(spark, folder), "koch", {1, 2, 3}, read_stop_words(spark))
    return spark.read.text(path).select("report", "value")


def stored_reports(spark: SparkSession, folder: str) -> DataFrame:
    store = _store(spark)
    lines = durable(report_lines(spark, folder))
    path = store.write_reports(lines, "koch", [jobs.REPORTS[n] for n in (1, 2, 3)])
    return spark.read.text(path).select("report", "value")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        link_extract, link_rejects, link_first_per_id, page_url_ids, listing_links,
        listing_first_links, result_counts, result_rejects, page_plan, page_nodes, page_headings,
        styled_headings, page_sections, paragraph_rows,
        postings_parsed, posting_sections, posting_rejects, posting_dedup, posting_export,
        content_dedup, json_fields, line_sanitize, analyzer_tokens, word_filter, stop_word_join,
        inverted_index, term_stats, headings_by_doc, field_exists, index_counts, index_info,
        fuzzy_expand, ranked_search, search_status, score_cutoff, median_cut, term_counts,
        term_counts_null_bucket, term_profile, rank_slice, report_lines, stored_links,
        stored_postings, stored_index, stored_reports,
        stored_search, stored_headings, job_reports, added_postings, stage_reuse,
    ]
    found = {query.__name__: query for query in named}
    for intent in ("tasks", "requirements", "benefits"):
        found[f"{intent}_profile"] = _one_intent(intent)
    return found
