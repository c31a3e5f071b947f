"""Result pages to unique posting links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vakanz.functions import html as H
from vakanz.functions import links as L
from vakanz.functions.arrays import following, matching_ends, running_sums
from vakanz.runtime import items


def _is_start(t: Column, name: str) -> Column:
    return (t["step"] > 0) & (t["tag"] == name)


def _depth_step(t: Column) -> Column:
    """Paragraphs cannot hold each other, one ends where the next starts: they have no depth."""
    flat = (t["tag"] == "p") | ((t["step"] > 0) & F.endswith(t["attrs"], F.lit("/")))
    return F.when(flat, 0).otherwise(t["step"]).cast("bigint")


def _href(t: Column) -> Column:
    return F.when((t["step"] >= 0) & F.contains(F.lower(t["attrs"]), F.lit("href")), H.attribute(t["attrs"], "href"))


def _mark(x: Column, links: Column) -> Column:
    return F.struct(x["depths"].alias("depth"), x["tags"]["place"].alias("place"), links.alias("links"))


def _next_entries(both: Column) -> Column:
    """From sections and entries (without ``links``), by depth and place, each section's next entry at its depth."""
    is_entry = lambda x: x["links"].isNull()
    passed = running_sums(F.transform(both, lambda x: is_entry(x).cast("bigint")))

    def found(entries: Column) -> Column:
        def section(x: Column, n: Column) -> Column:
            entry = F.get(entries, n.cast("int"))
            at = F.when(entry["depth"] == x["depth"], entry["place"])
            return F.when(~is_entry(x), F.struct(x["place"].alias("place"), F.lit(0).alias("kind"), at.alias("at"), x["links"].alias("links")))

        return F.filter(F.zip_with(both, passed, section), lambda x: x.isNotNull())

    return H.let(F.filter(both, is_entry), found)


def _first_links(sections: Column, ends: Column, urls: Column) -> Column:
    """The first URL (or NULL) in each section, without adverts: those whose entry lies before their end."""
    closed = F.transform(
        ends, lambda e: F.struct(e["place"].alias("place"), F.lit(1).alias("kind"), e["end"].alias("at"), F.lit(None).cast("bigint").alias("links"))
    )

    def link(x: Column, y: Column) -> Column:
        # Behind each section stands its start among those of all sections, with its end.
        within = lambda place: F.coalesce(place < y["at"], place.isNotNull())
        url = F.get(urls, x["links"].cast("int"))
        return F.when((x["kind"] == 0) & ~within(x["at"]), F.struct(F.when(within(url["place"]), url["url"]).alias("url")))

    found = H.let(F.array_sort(F.concat(sections, closed)), lambda rows: following(rows, link))
    return F.transform(F.filter(found, lambda x: x.isNotNull()), lambda x: x["url"])


def _with_section_links(pages: DataFrame, html: str, into: str) -> DataFrame:
    """Add the first link (or NULL) of each section with a job id that is no advert, in page order.

    A section reaches to its matching end tag and holds the ones nested in it; one that never closes
    reaches to the end of the page. It is an advert if an entry paragraph is its direct child:
    before its end, at its own depth. Places, depths and ends are found once for a page, by sorting,
    and looked up by section, so nested sections are not read again for those around them.
    """
    place = lambda x: F.struct(x["tags"]["place"].alias("place"), x["hrefs"].alias("url"))
    event = lambda t: F.struct(F.lit("").alias("name"), t["place"].alias("place"), t["step"].alias("step"))
    with_id = lambda x: _is_start(x["tags"], "section") & H.attribute(x["tags"]["attrs"], "data-jobid").isNotNull()
    entry = lambda x: _is_start(x["tags"], "p") & F.coalesce(H.attribute(x["tags"]["attrs"], "class") == "entry", F.lit(False))
    return (
        pages.withColumn("tags", H.tags(H.strip_code(F.col(html))))
        .withColumn("hrefs", F.transform("tags", _href))
        .withColumn("before", running_sums(F.transform("hrefs", lambda h: h.isNotNull().cast("bigint"))))
        .withColumn("depths", running_sums(F.transform("tags", _depth_step)))
        .withColumn("placed", F.arrays_zip("tags", "hrefs", "before", "depths"))
        .withColumn("urls", F.transform(F.filter("placed", lambda x: x["hrefs"].isNotNull()), place))
        .withColumn("ends", matching_ends(F.transform(F.filter("tags", lambda t: t["tag"] == "section"), event)))
        .withColumn("both", F.array_sort(F.concat(
            F.transform(F.filter("placed", with_id), lambda x: _mark(x, x["before"])),
            F.transform(F.filter("placed", entry), lambda x: _mark(x, F.lit(None).cast("bigint"))),
        )))
        .withColumn("sections", _next_entries(F.col("both")))
        .withColumn(into, _first_links(F.col("sections"), F.col("ends"), F.col("urls")))
    )


def listing_links(pages: DataFrame) -> DataFrame:
    """Links of result pages, one per section that names a job id and is no advert.

    ``pages(search_term, page_no, html)`` -> ``(search_term, page_no, pos, url, job_id, reason)``;
    ``reason`` is set where a section has no link or the link has no id.
    """
    found = _with_section_links(pages.select("search_term", "page_no", "html"), "html", "found")
    return _with_ids(found.select("search_term", "page_no", F.posexplode(items("found")).alias("pos", "url")))


def anchor_links(pages: DataFrame, *keys: str, id_pattern: str = L.JOB_ID) -> DataFrame:
    """All links of a page in document order: ``(keys, pos, url, job_id, reason)``."""
    tags = H.nodes(H.strip_code(F.col("html")), with_attrs=True)
    anchors = F.filter(tags, lambda n: n["tag"] == "a")
    hrefs = F.filter(
        F.transform(anchors, lambda n: H.attribute(n["attrs"], "href")), lambda h: h.isNotNull()
    )
    return _with_ids(pages.select(*keys, F.posexplode(hrefs).alias("pos", "url")), id_pattern)


def _with_ids(links: DataFrame, id_pattern: str = L.JOB_ID) -> DataFrame:
    return links.withColumn("job_id", L.job_id(F.col("url"), id_pattern)).withColumn(
        "reason",
        F.when(F.col("url").isNull(), "no link in section").when(
            F.col("job_id").isNull(), "no job id in link"
        ),
    )


def first_per_id(links: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The first link of each job id; one aggregate with partial results before the shuffle."""
    first = F.min(F.struct(*order, "url")).alias("first")
    return links.groupBy(*group, "job_id").agg(first).select(*group, "job_id", "first.*")


def page_plan(counts: DataFrame, *keys: str) -> DataFrame:
    """One row per result page to request, from ``count`` announced postings.

    ``(keys, count, page_no, reason)``: a missing count gives one row without page and a reason.
    """
    known = F.col("count").isNotNull()
    pages = F.when(known, L.page_numbers(F.col("count"))).otherwise(F.array(F.lit(None).cast("int")))
    return counts.select(
        *keys,
        "count",
        F.explode(pages).alias("page_no"),
        F.when(~known, "no result count").alias("reason"),
    )
