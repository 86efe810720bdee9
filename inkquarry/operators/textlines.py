"""Lines of page text from glyph rows.

A line reads as its glyphs in ``ord`` order, with one blank before each glyph that has ``space_before``.
Pages may be delivered more than once and out of order: a glyph key ``(doc_id, page, ord)`` counts once.

Defined results: null text reads as the empty string, null ``space_before`` as false, rows without doc_id, page, line or
ord are no glyphs and are left out, extra columns are ignored, an empty table gives no lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("doc_id", "page", "line")


def _glyphs(glyphs: DataFrame) -> DataFrame:
    keep = F.col("doc_id").isNotNull() & F.col("page").isNotNull() & F.col("line").isNotNull() & F.col("ord").isNotNull()
    text = F.coalesce("text", F.lit(""))
    return glyphs.where(keep).select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        *(F.col(c).cast("int").alias(c) for c in ("page", "line", "ord")),
        F.when(F.col("space_before"), F.concat(F.lit(" "), text)).otherwise(text).alias("t"),
    )


def glyph_lines(glyphs: DataFrame) -> DataFrame:
    """``(doc_id, page, line, text)``, one row for each line, with one shuffle.

    Glyphs of a line lie together in the files, so the map side already packs them into one array for each line. The
    grouping key is the single line: a document that holds a third of all glyphs is spread over all tasks. Repeated
    glyphs stand side by side once a line is sorted; only a line whose glyph count exceeds its span of ords is searched.
    """
    lines = _glyphs(glyphs).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("ord", "t"))).alias("g"))
    span = F.element_at("g", -1)["ord"] - F.element_at("g", 1)["ord"] + 1
    first = F.filter("g", lambda x, i: (i == 0) | (x["ord"] != F.col("g")[F.greatest(i - 1, F.lit(0))]["ord"]))
    once = F.when(span != F.size("g"), first["t"]).otherwise(F.col("g.t"))
    return lines.select(*KEYS, F.ltrim(F.array_join(once, "")).alias("text"))


def glyph_lines_two_step(glyphs: DataFrame) -> DataFrame:
    """The same rows by dropping repeats first: a plan with two shuffles, kept to check the one above."""
    once = _glyphs(glyphs).dropDuplicates(["doc_id", "page", "ord"])
    lines = once.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("ord", "t"))).alias("g"))
    return lines.select(*KEYS, F.ltrim(F.array_join(F.col("g.t"), "")).alias("text"))
