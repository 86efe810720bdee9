"""Pieces of text that problems 2 to 4 work on: lines of glyphs and form fields, each with its key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.textlines import glyph_lines

UNIT = ("src", "doc_id", "page", "line", "name")


def line_units(glyphs: DataFrame) -> DataFrame:
    """``(src, doc_id, page, line, name, text)`` of all lines of glyphs."""
    return glyph_lines(glyphs).select(F.lit("glyphs").alias("src"), "doc_id", "page", "line", F.lit("").alias("name"), "text")


def field_units(fields: DataFrame, number_elements: bool = False) -> DataFrame:
    """The same of all form fields: every element of ``value`` on its own row, so a key has one row for each element.

    Repeated deliveries count once; a null or empty list and null elements give no row.
    ``number_elements`` puts the position of the element into ``line`` instead of -1.
    """
    f = fields.where(F.col("doc_id").isNotNull() & F.col("name").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "name", "value")
    one = f.select("doc_id", "name", F.posexplode("value").alias("at", "text")).where(F.col("text").isNotNull()).dropDuplicates(["doc_id", "name", "at", "text"])
    return one.select(F.lit("fields").alias("src"), "doc_id", F.lit(-1).alias("page"), (F.col("at") if number_elements else F.lit(-1)).cast("int").alias("line"), "name", "text")
