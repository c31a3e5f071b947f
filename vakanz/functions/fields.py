"""Typed fields of a structured-data record (a VARIANT column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_json(text: Column) -> Column:
    """VARIANT, or NULL for malformed input."""
    return F.try_parse_json(text)


def string_field(record: Column, path: str) -> Column:
    """Lowercased string at ``path``; NULL when absent."""
    return F.lower(F.try_variant_get(record, path, "string"))


def joined_field(record: Column, path: str) -> Column:
    """Array of strings joined with commas and lowercased; a plain string counts as one element."""
    many = F.try_variant_get(record, path, "array<string>")
    one = F.array(F.try_variant_get(record, path, "string"))
    return F.lower(F.when(F.try_variant_get(record, path, "variant").isNotNull(),
                          F.array_join(F.coalesce(many, one), ",")))


def number_field(record: Column, path: str) -> Column:
    return F.try_variant_get(record, path, "double")


def date_field(record: Column, path: str) -> Column:
    """ISO date; anything else is NULL."""
    return F.try_to_date(F.try_variant_get(record, path, "string"), "yyyy-MM-dd")


def location_field(record: Column, path: str) -> Column:
    """``struct<latitude,longitude>`` of the geo record at ``path``; NULL when there is none."""
    geo = F.struct(
        number_field(record, f"{path}.latitude").alias("latitude"),
        number_field(record, f"{path}.longitude").alias("longitude"),
    )
    return F.when(F.try_variant_get(record, path, "variant").isNotNull(), geo)
