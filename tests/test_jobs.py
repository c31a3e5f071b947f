import re

import pytest
from pyspark.sql import functions as F

from vakanz.operators import index as I
from vakanz.operators.scoring import search
from vakanz.plans import jobs
from vakanz.sources.store import Store, read_pages, read_stop_words, stop_word_list

TASK_TEXT = "entwicklung planung beratung entwicklung kunden projekte leitung"


def landed(spark, n=12):
    """Result pages and posting pages of one search term."""
    urls = [f"https://jobs.example.org/aaaaaaaa{i:02d}" for i in range(n)]
    listing = "".join(f"<section data-jobid='{i}'><a href='{u}'>x</a></section>" for i, u in enumerate(urls))
    results = spark.createDataFrame(
        [("Data Engineer", 10, listing), ("Data Engineer", 11, listing), ("koch", 10, listing)],
        "search_term string, page_no int, html string",
    )
    import json

    pages = []
    for i, url in enumerate(urls):
        description = (
            f"<b>Ihre Aufgaben</b><p>{TASK_TEXT} nummer {'abcdefghijkl'[i] * 6}</p>"
            f"<b>Ihre Verantwortung</b><p>{TASK_TEXT} fuehrung</p>"
            "<b>Dein Profil</b><p>studium der informatik und erfahrung mit datenbanken</p>"
            "<b>Was wir bieten</b><p>flexible arbeitszeiten und ein gutes gehalt dazu</p>"
        )
        record = json.dumps({"pad": "x" * 2100, "title": f"Stelle {i}", "url": url, "description": description})
        pages.append((i, url, f'<script type="application/ld+json">{record}</script>'))
    pages.append((99, "https://jobs.example.org/unlinked", pages[0][2]))
    return results, spark.createDataFrame(pages, "page_id long, url string, html string")


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path))


def test_whole_run(spark, store):
    results, pages = landed(spark)
    jobs.run(store, " Data Engineer ", {1, 2}, results, pages)
    assert store.read_links("data engineer").count() == 12
    assert store.read("postings", "DATA ENGINEER").count() == 12
    assert not store.available("postings", "koch") and store.available("links", "data engineer")
    postings, paragraphs = store.open_index("data engineer")
    assert (postings.count(), paragraphs.count()) == (12, 48)
    text = "\n".join(r["value"] for r in spark.read.text(store.path("exports", "data engineer")).collect())
    assert text.count("Anzeigentext:") == 12 and "Titel: stelle 3" in text

    path = jobs.present(store, "data engineer", {0, 1, 2, 3}, ["und", "der", "mit", "ein"])
    lines = spark.read.text(path)
    info = [r["value"] for r in lines.where("report = 'index_info'").collect()]
    assert info == ["The Index contains 12 Documents", "On Average every Document contains 4.0 Paragraphs"]
    tasks = [r["value"] for r in lines.where("report = 'task_frequency'").collect()]
    assert tasks and tasks[0].startswith("entwicklung,")
    again = jobs.present(store, "data engineer", {0}, [])
    assert spark.read.text(again).where("report = 'task_frequency'").count() == len(tasks)


def test_stored_stages_are_reused(spark, store):
    results, pages = landed(spark, 4)
    jobs.run(store, "koch", set(), results, None)
    assert store.available("links", "koch") and not store.available("postings", "koch")
    jobs.run(store, "koch", {1}, None, pages, use_stored_links=True)
    jobs.run(store, "koch", {1, 2}, None, None, True, True, re_index=False)
    assert store.open_index("koch")[0].count() == 4
    results, pages = landed(spark, 3)
    jobs.run(store, "data engineer", {1}, results, pages)
    jobs.run(store, "data engineer", {1}, results, pages)
    assert store.read("postings", "data engineer").count() == 3
    assert store.read("postings", "koch").count() == 4
    with pytest.raises(FileNotFoundError):
        store.open_index("data engineer")


def test_stop_word_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" und \nder\n\nund\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("the\nder\n", encoding="utf-8")
    words = read_stop_words(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")])
    assert stop_word_list(words) == ["der", "the", "und"]
    assert "meine" in stop_word_list(read_stop_words(spark))


def test_read_pages(spark, tmp_path):
    _, pages = landed(spark, 2)
    pages.write.parquet(str(tmp_path / "pages"))
    found = read_pages(spark, str(tmp_path / "pages"))
    assert found.columns == ["page_id", "url", "html"] and found.count() == 3


def test_result_does_not_depend_on_partitions(spark, store):
    results, pages = landed(spark)
    postings, bad = jobs.parse_pages(pages.repartition(5))
    assert bad.count() == 0
    ids = {r["posting_id"] for r in postings.collect()}
    other, _ = jobs.parse_pages(pages.orderBy(F.desc("page_id")).coalesce(1))
    assert ids == {r["posting_id"] for r in other.collect()} and len(ids) == 12


def test_empty_results_replace_stored_ones(spark, store):
    results, pages = landed(spark, 3)
    broken = pages.withColumn("html", F.lit("<p>nichts</p>"))
    # the first run finds no posting at all, then some, then none again
    for found, count, bad in ((broken, 0, 3), (pages, 3, 0), (broken, 0, 3)):
        jobs.run(store, "koch", {1, 2}, results.withColumn("search_term", F.lit("koch")), found)
        assert store.read("postings", "koch").count() == count
        assert store.read("rejects/postings", "koch").count() == bad
        assert store.available("index/postings", "koch") == bool(count)
        assert len(spark.read.text(store.path("exports", "koch")).head(1)) == bool(count)
    jobs.run(store, "koch", set(), results.where("false"))
    assert not store.available("links", "koch") and store.read_links("koch").count() == 0
    jobs.run(store, "koch", {1}, None, pages, use_stored_links=True)
    assert store.read("postings", "koch").count() == 0
    lines = spark.createDataFrame([("task_frequency", 0, "a,1")], "report string, line_no long, value string")
    for rows in (1, 0):
        path = store.write_reports(lines.limit(rows), "koch", ["task_frequency"])
        assert spark.read.text(path).count() == rows


@pytest.mark.parametrize("term", ["007", "2024-01-01", "a/b", "1e5", "true", "ä ö=%"])
def test_any_search_term(spark, store, term):
    results, pages = landed(spark, 2)
    assert not store.available("postings", term) and not store.available("links", term)
    jobs.run(store, term, {1, 2}, results.withColumn("search_term", F.lit(term.upper())), pages)
    assert not store.available("postings", "koch")
    assert store.read("postings", term).count() == 2 and store.open_index(term)[1].count() == 8
    assert {r["search_term"] for r in store.read_links(term).collect()} == {term}
    assert dict(store.read("postings", term).dtypes)["posting_id"] == "string"


def test_plan_of_requests(spark, store):
    page = "<b>Treffer ({} Jobs gefunden)</b>"
    first = spark.createDataFrame([("Koch ", page.format(260))], "search_term string, html string")
    jobs.plan_requests(store, "koch", first, "https://jobs.example.org/?")
    rows = store.read("requests", "koch").orderBy("page_no").collect()
    assert [(r["count"], r["page_no"]) for r in rows] == [(260, 10), (260, 11)]
    assert rows[0]["url"] == "https://jobs.example.org/?q=koch&stpage=1&page=10"
    assert store.read("rejects/counts", "koch").count() == 0
    jobs.plan_requests(store, "koch", first.withColumn("html", F.lit("<b>nichts</b>")), "x")
    assert store.read("requests", "koch").count() == 0
    assert [tuple(r) for r in store.read("rejects/counts", "koch").collect()] == [("counts", "koch", "no result count")]


def test_a_write_that_dies_leaves_what_was_there(spark, store):
    results, pages = landed(spark, 3)
    jobs.run(store, "koch", {1, 2}, results.withColumn("search_term", F.lit("koch")), pages)
    before = sorted(map(tuple, store.read("index/paragraphs", "koch").collect()))
    dying = store.read("index/paragraphs", "koch").repartition(4).withColumn(
        "paragraph_heading", F.when(F.col("paragraph_number") == 3, F.raise_error(F.lit("lost"))).otherwise(F.lit("new"))
    )
    versions = store.versions("index/paragraphs")
    with pytest.raises(Exception, match="lost"):
        store.write(dying, "koch", "index/paragraphs")
    with pytest.raises(Exception, match="lost"):
        store.write_terms(dying.withColumn("search_term", F.lit("koch")), spark.createDataFrame([("koch",)], "term string"), "index/paragraphs")
    assert store.versions("index/paragraphs") == versions
    assert sorted(map(tuple, store.read("index/paragraphs", "koch").collect())) == before
    lines = spark.createDataFrame([("task_frequency", 0, "a,1")], "report string, line_no long, value string")
    path = store.write_reports(lines, "koch", ["task_frequency"])
    with pytest.raises(Exception, match="lost"):
        store.write_reports(lines.withColumn("value", F.raise_error(F.lit("lost"))), "koch", ["task_frequency"])
    assert store.path("reports", "koch") == path and spark.read.text(path).count() == 1


def test_old_versions_are_removed(spark, store):
    rows = spark.createDataFrame([("links", "k", "r")], "stage string, key string, reason string")
    for term in ("a", "b", "a", "a"):
        store.write(rows, term, "rejects/links")
    store.write(rows, "b", "rejects/links", adds=True)
    assert len(store.versions("rejects/links")) == 5
    store.clean("rejects/links")
    assert len(store.versions("rejects/links")) == 3
    assert store.read("rejects/links", "a").count() == 1 and store.read("rejects/links", "b").count() == 2


def test_many_terms_in_one_plan(spark, store):
    results, pages = landed(spark, 6)
    names = ["007", "2024-01-01", "a/b", " Ä ö "]
    listings = results.where("page_no = 10").limit(1)
    listings = listings.withColumn("search_term", F.explode(F.array(*map(F.lit, names))))
    terms = spark.createDataFrame([(n,) for n in [*names, "none"]], "search_term string")
    jobs.run_terms(store, terms, listings, pages)
    for name in names:
        assert store.read("postings", name).count() == 6 and store.read_links(name).count() == 6
    assert store.read("postings", "none").count() == 0 and not store.available("links", "none")
    wanted = spark.createDataFrame([("007",), ("ä ö",)], "term string")
    rows = store.read_terms("postings", wanted)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert {(r["search_term"], r["count"]) for r in rows.groupBy("search_term").count().collect()} == {("007", 6), ("ä ö", 6)}
    links = store.read_links_of(wanted)
    assert "dynamicpruning" in links._jdf.queryExecution().executedPlan().toString() and links.count() == 12
    # A later run replaces one of the terms only.
    jobs.run_terms(store, terms.limit(1), listings.where("false"), pages)
    assert store.read("postings", "007").count() == 0 and store.read("postings", "a/b").count() == 6


def test_later_runs_add_what_is_new(spark, store):
    results, pages = landed(spark, 8)
    few, some = pages.where("page_id < 5"), pages.where("page_id < 8")
    links, _ = jobs.gather_links(results.where("page_no = 10").withColumn("search_term", F.lit("koch")).limit(1))
    assert jobs.add_links(store, "koch", links.limit(3), "pos").count() == 3
    assert jobs.add_links(store, "koch", links, "pos").count() == 5 and store.read_links("koch").count() == 8
    assert jobs.add_links(store, "koch", links, "pos").count() == 0 and len(store.versions("links")) == 2
    assert jobs.add_postings(store, "koch", jobs.parse_pages(few)[0]).count() == 5
    assert jobs.add_postings(store, "koch", jobs.parse_pages(some)[0]).count() == 3
    assert jobs.add_postings(store, "koch", jobs.parse_pages(some)[0]).count() == 0
    rows = store.read("postings", "koch")
    assert rows.count() == 8 and rows.select("posting_id").distinct().count() == 8
    known = store.known("postings", "koch", ["0", "1", "2"])
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[slice#\d+ IN \(0,1,2\)", plan) and known.count() <= 8


def test_reports_read_the_stored_index_only(spark, store):
    results, pages = landed(spark)
    stop = read_stop_words(spark)
    jobs.run(store, "koch", {1, 2}, results.withColumn("search_term", F.lit("koch")), pages, stop=stop)
    scored, status = jobs.search_stored(store, "koch", jobs.intent_terms())
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and "GreaterThanOrEqual(term" in plan
    headings = store.read("index/paragraphs", "koch")
    again, expected = search(headings, jobs.KEYS, "paragraph_heading", 12, jobs.intent_terms(), stop_word_list(stop))
    assert sorted(map(tuple, scored.collect())) == sorted(map(tuple, again.collect())) and scored.count()
    assert sorted(map(tuple, status.collect())) == sorted(map(tuple, expected.collect()))
    lines = []
    for words in (stop, stop_word_list(stop)):
        path = jobs.present(store, "koch", {1, 2, 3}, words)
        lines.append(sorted(spark.read.text(path).collect(), key=lambda r: r["report"]))
    assert lines[0] == lines[1] and lines[0]
    buckets = [jobs.present(store, "koch", {1}, words, keep_null_bucket=True) for words in (stop, stop_word_list(stop))]
    one, other = ([r["value"] for r in spark.read.text(b).where("report = 'task_frequency'").collect()] for b in buckets)
    assert one == other


def test_a_stored_family_is_joined_where_it_lies(spark, store, monkeypatch):
    monkeypatch.setattr("vakanz.sources.store.BUCKET_BYTES", 2000)
    results, pages = landed(spark)
    postings, _ = jobs.parse_pages(pages)
    stages = ("index/postings", "index/paragraphs")
    parents, children = I.posting_table(postings), I.paragraph_table(postings).where("paragraph_number < 2")
    store.write_family(parents, children, "k'och", stages, "posting_id")
    parents, children = store.read_family("k'och", stages, "posting_id")
    found = I.headings_by_posting(parents, children.hint("merge"), "posting_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan and re.search(r"SelectedBucketsCount: (\d+) out of \1", plan)
    assert found.count() == 24 and store.read_family("k'och", stages, "posting_id")[0].count() == 12


def test_runs_accumulate_where_asked_to(spark, store):
    results, pages = landed(spark)
    results = results.where("page_no = 10").limit(1).withColumn("search_term", F.lit("koch"))
    some = pages.where("page_id < 4")
    jobs.run(store, "koch", {1, 2}, results, some, accumulate=True)
    assert store.open_index("koch")[0].count() == 4
    jobs.run(store, "koch", {1, 2}, results, pages, accumulate=True)
    assert store.read_links("koch").count() == 12 and store.open_index("koch")[0].count() == 12
    jobs.run(store, "koch", {1, 2}, results, some)
    assert store.open_index("koch")[0].count() == 4
