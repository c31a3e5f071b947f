"""Posting pages to typed, deduplicated postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vakanz.functions import fields as V
from vakanz.functions import html as H
from vakanz.functions.render import fingerprint
from vakanz.operators.sections import with_sections
from vakanz.runtime import broadcast_if_small, durable
from vakanz.schemas import SECTION

# How a page's structured-data script is chosen.
SCRIPT_LENGTH = 2000
SCRIPT_MARK = "GeoCoordinates"
BODY_CLASS = r"\Wmaincontent\W"

CONTENT = (
    "url", "title", "organization", "date_posted", "educational_requirements", "industry",
    "employment_type", "location", "experience_requirements", "sections",
)


def structured_data(scripts: Column) -> Column:
    """``struct<kind,json>`` for the structured-data scripts of a page.

    ``kind`` is ``json``, ``html`` (read the page body instead) or ``none``.
    """
    count, first = F.size(scripts), F.length(F.get(scripts, F.lit(0)))
    marked = F.get(F.filter(scripts, lambda s: F.contains(s, F.lit(SCRIPT_MARK))), F.lit(0))
    json = F.when((count == 1) & (first > SCRIPT_LENGTH), F.get(scripts, F.lit(0))).when(
        (count > 1) & (first > SCRIPT_LENGTH), marked
    )
    use_body = (count == 0) | ((count == 1) & (first < SCRIPT_LENGTH))
    kind = F.when(json.isNotNull(), "json").when(use_body, "html").otherwise("none")
    return F.struct(kind.alias("kind"), json.alias("json"))


def body_description(page: Column) -> Column:
    """Text of the main content block, without backslash-letter sequences for white space."""
    body = H.element_body(page, "div", BODY_CLASS)
    return F.regexp_replace(H.text_content(body), r"\\[rnt]", "")


def parse_postings(pages: DataFrame) -> DataFrame:
    """``pages(page_id, html)`` -> postings with ``page_id``, ``posting_id`` and ``reason``.

    Narrow: one row in, one row out. ``reason`` is set for pages that yield no usable posting.
    """
    chosen = pages.withColumn("_data", H.let(H.json_scripts(F.col("html")), structured_data))
    record = V.parse_json(F.col("_data.json"))
    parsed = chosen.select(
        "page_id",
        F.col("_data.kind").alias("_kind"),
        record.alias("_record"),
        F.when(
            F.col("_data.kind") == "html", body_description(H.strip_code(F.col("html")))
        ).alias("_body"),
    )
    v = F.col("_record")
    typed = parsed.select(
        "page_id",
        "_kind",
        F.when(F.col("_kind") == "json", v.isNull()).alias("_malformed"),
        V.string_field(v, "$.url").alias("url"),
        V.string_field(v, "$.title").alias("title"),
        V.string_field(v, "$.hiringOrganization.name").alias("organization"),
        V.date_field(v, "$.datePosted").alias("date_posted"),
        V.string_field(v, "$.educationRequirements").alias("educational_requirements"),
        F.replace(V.joined_field(v, "$.industry"), F.lit("/"), F.lit(" ")).alias("industry"),
        V.joined_field(v, "$.employmentType").alias("employment_type"),
        V.location_field(v, "$.jobLocation[0].geo").alias("location"),
        V.string_field(v, "$.experienceRequirements").alias("experience_requirements"),
        F.coalesce(F.try_variant_get(v, "$.description", "string"), "_body").alias("_description"),
    )
    found = with_sections(typed, "_description")
    sections = F.coalesce("sections", F.array().cast(f"array<{SECTION.simpleString()}>"))
    reason = (
        F.when(F.col("_kind") == "none", "no usable structured data")
        .when(F.col("_malformed"), "malformed structured data")
        .when(F.col("_description").isNull(), "no description")
        .when(F.size("sections") <= 1, "fewer than two sections")
    )
    return (
        found.withColumn("sections", sections)
        .withColumn("reason", reason)
        .select("page_id", posting_id().alias("posting_id"), *CONTENT, "reason")
    )


def posting_id() -> Column:
    """Content fingerprint: the same posting gets the same id wherever and whenever it is read."""
    parts = [
        F.to_json(F.struct(F.col(c).alias("v"))) if c in ("location", "sections") else F.col(c)
        for c in CONTENT
    ]
    return fingerprint(parts)


def distinct_postings(postings: DataFrame) -> DataFrame:
    """One row per posting content, kept under its smallest ``page_id``.

    ``postings`` should be stored, as it is read more than once: the aggregate is over two narrow
    columns and collapses any number of copies before its shuffle. Only the copies that go, few
    as a rule, are joined with the postings.
    """
    keys = postings.select("posting_id", "page_id")
    copied = keys.groupBy("posting_id").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    copied = copied.where("first < last").select("posting_id", "first")
    going = broadcast_if_small(durable(keys.join(copied, "posting_id").where("page_id > first").drop("first")))
    return postings.where("page_id IS NOT NULL").join(going, ["posting_id", "page_id"], "left_anti")


def first_copy(df: DataFrame, key: str, columns: list[Column]) -> DataFrame:
    """Copies of the same content: ``(fp, key of the first, copies)``."""
    return (
        df.select(key, fingerprint(columns).alias("fp"))
        .groupBy("fp")
        .agg(F.min(key).alias(key), F.count("*").alias("copies"))
    )
