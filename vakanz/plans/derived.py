"""Posting and result pages derived from a table of plain documents.

No given table holds job postings, so these expressions wrap each document, whole, into the
page layouts the parsers read. Everything happens in the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# One document in five is laid out as a plain body, one in twenty without usable data.
PLAIN_EVERY, BROKEN_EVERY = 5, 20
HEADING_CHARS = 30


def escape(text: Column) -> Column:
    amp = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(amp, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _inner(record: Column) -> Column:
    """A JSON object without its braces, to be joined with others."""
    return F.substring(record, F.lit(2), F.length(record) - 2)


def _script(body: Column) -> Column:
    return F.concat(
        F.lit("<script async type='application/ld+json' id=1>"), body, F.lit("</script>")
    )


def posting_pages(documents: DataFrame) -> DataFrame:
    """Posting pages: structured data, or for one document in five a plain body.

    The description holds a bold heading and a paragraph per line. German documents carry two
    scripts, French ones a plain string as industry. A comment before the data holds a script, a
    script before it comment signs. One structured document in twenty is malformed, one has
    no description and one has no usable data.
    """
    text = F.col("text")
    size = F.length(text)
    description = F.transform(
        lines(text),
        lambda line: F.concat(
            F.lit("<b>"), escape(F.substring(line, 1, HEADING_CHARS)),
            F.lit("</b>\n<p class='line'>"), escape(line), F.lit("</p>"),
        ),
    )
    geo = F.struct(
        F.lit("GeoCoordinates").alias("@type"),
        (size / 8.0).cast("double").alias("latitude"),
        (-size / 16.0).cast("double").alias("longitude"),
    )
    month = F.lpad((size % 14).cast("string"), 2, "0")
    record = F.struct(
        F.concat(F.lit("https://Jobs.example.org/"), F.md5(text)).alias("url"),
        F.substring(F.get(lines(text), F.lit(0)), 1, 40).alias("title"),
        F.concat(F.lit("2018-"), month, F.lit("-15")).alias("datePosted"),
        F.col("lang").alias("educationRequirements"),
        F.when(F.col("lang") == "en", F.lit("Two Years")).alias("experienceRequirements"),
        F.array(F.lit("FULL_TIME"), F.upper("lang")).alias("employmentType"),
        F.struct(F.col("source").alias("name")).alias("hiringOrganization"),
        F.array(F.struct(geo.alias("geo"))).alias("jobLocation"),
        F.array_join(description, "").alias("description"),
    )
    one = F.to_json(F.struct(F.col("source").alias("industry")))
    many = F.to_json(F.struct(F.array("source", F.lit("IT/Software")).alias("industry")))
    body = F.concat(
        F.lit('<div class="page maincontent wide"><div>'), escape(text),
        F.lit("</div></div><div>footer</div>"),
    )
    padding = '"pad":"' + "x" * 2000 + '"'
    json = F.concat(
        F.lit("{" + padding + ","), _inner(F.col("_industry")), F.lit(","),
        _inner(F.col("_record")), F.lit("}"),
    )
    at = F.coalesce(F.col("doc_id") % BROKEN_EVERY, F.lit(1))
    data = (
        F.when(at == 6, F.concat(F.lit("{broken "), F.lit("x" * 2000)))
        .when(at == 7, F.lit("{" + padding + "}"))
        .when(at == 8, F.lit('{"pad":"' + "x" * 1990 + '"}'))
        .otherwise(json)
    )
    other = F.when(F.col("lang") == "de", _script(F.lit("{" + padding + "}"))).otherwise(F.lit(""))
    return (
        documents.withColumns(
            {
                "_record": F.when(F.coalesce(F.col("doc_id") % PLAIN_EVERY, F.lit(1)) != 0, F.to_json(record)),
                "_industry": F.when(F.col("lang") == "fr", one).otherwise(many),
                "_body": body,
            }
        )
        .withColumn(
            "_inner", F.coalesce(F.concat(other, _script(data)), F.col("_body"))
        )
        .select(
            F.col("doc_id").alias("page_id"),
            F.concat(
                F.lit("<html><head><!-- <script type='application/ld+json'>{}</script> -->"),
                F.lit("<script>var a='<!--';</script></head><body>"),
                "_inner",
                F.lit("<script>var b='-->';</script></body></html>"),
            ).alias("html"),
        )
    )


def styled_pages(documents: DataFrame) -> DataFrame:
    """Pages that mark the heading of each line by its style only."""
    part = lambda line: F.concat(
        F.lit('<div><span style="color:red; font-weight:bold">'), escape(F.substring(line, 1, HEADING_CHARS)),
        F.lit("</span></div><p>"), escape(line), F.lit("</p>"),
    )
    return documents.select(
        F.col("doc_id").alias("page_id"), F.array_join(F.transform(lines(F.col("text")), part), "").alias("html")
    )


def result_page(doc: str = "text") -> Column:
    """A result page with one section per line of the document.

    Short lines become adverts, very short ones sections without link; other lines link to an id
    made from the line, and one in two carries a nested entry paragraph that is no advert. Of five
    sections the fourth holds the fifth.
    """

    def section(line: Column, index: Column) -> Column:
        size = F.length(line)
        entry = F.when(size < 40, F.lit("<p class='entry'>ad</p>")).when(
            index % 2 == 0, F.lit("<div><p class='entry'>no ad</p></div>")
        )
        link = F.when(
            size >= 8, F.concat(F.lit("<a class=x href='/job/"), F.md5(line), F.lit("?a=1&amp;b=2'>go</a>"))
        )
        return F.concat(
            F.lit('<section class="card" data-jobid="'), index.cast("string"), F.lit('"><br>'),
            F.when(size >= 8, F.coalesce(entry, F.lit(""))).otherwise(F.lit("")),
            F.coalesce(link, F.lit("")),
            F.when(index % 5 == 3, F.lit("")).when(index % 5 == 4, F.lit("</section></section>")).otherwise(F.lit("</section>")),
        )

    return F.concat(
        F.lit("<html><body><section class='head'><a href='/job/00000000000'>top</a></section>"),
        F.array_join(F.transform(lines(F.col(doc)), section), "\n"),
        F.lit("</body></html>"),
    )


def result_pages(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("lang").alias("search_term"),
        F.col("doc_id").cast("int").alias("page_no"),
        result_page().alias("html"),
    )
