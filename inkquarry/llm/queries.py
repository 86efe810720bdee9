"""Queries of problems 2 to 8."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..session import stored
from ..sources.tables import table
from . import encodings, leaks, lookalikes, packing, personal, scans, stuffed, units

R = Registry()


def _lines(spark, d, name: str) -> DataFrame:
    return stored(units.line_units(table(spark, d, "glyphs")), name)


def _suspicious(spark, d) -> DataFrame:
    """Lines and fields with anything a wrong decoding could have made."""
    u = units.line_units(table(spark, d, "glyphs")).unionByName(units.field_units(table(spark, d, "fields")))
    return u.where(encodings.suspicious(F.col("text")))


@R.query("p4_found")
def p4_found(spark, d):
    return encodings.found(_suspicious(spark, d))


@R.query("p4_restored")
def p4_restored(spark, d):
    return encodings.restored(stored(_suspicious(spark, d), "p4-texts"))


def _p2(spark, d) -> DataFrame:
    lines = _lines(spark, d, "p2-lines")
    fields = units.field_units(table(spark, d, "fields"))
    bad = stored(encodings.found(lines.unionByName(fields).where(encodings.suspicious(F.col("text")))), "p2-garbled")
    return lookalikes.consistent(lines.join(bad.where("src = 'glyphs'").hint("merge"), list(units.UNIT), "left_anti"))


@R.query("p2_found")
def p2_found(spark, d):
    return _p2(spark, d).where("consistent <> text").select("doc_id", "page", "line")


@R.query("p2_consistent")
def p2_consistent(spark, d):
    return _p2(spark, d).select("doc_id", "page", "line", "text", "consistent")


def _p3(spark, d):
    lines, fields = _lines(spark, d, "p3-lines"), units.field_units(table(spark, d, "fields"), number_elements=True)
    return lines, fields, personal.detect(lines, fields)


@R.query("p3_found")
def p3_found(spark, d):
    items = _p3(spark, d)[2]
    line = F.when(F.col("src") == "fields", F.lit(-1)).otherwise(F.col("parts")[0]["line"])
    return items.select("src", "doc_id", "page", line.alias("line"), "name", "kind").distinct()


@R.query("p3_redacted")
def p3_redacted(spark, d):
    lines, fields, items = _p3(spark, d)
    return personal.redacted(lines.unionByName(fields), items)


@R.query("p5_found")
def p5_found(spark, d):
    return scans.found(table(spark, d, "words"))


@R.query("p5_paragraphs")
def p5_paragraphs(spark, d):
    return scans.paragraphs(table(spark, d, "words"))


def _p6(spark, d) -> DataFrame:
    return packing.pack(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "pack_specs"))


@R.query(
    "p6_found",
    """SELECT CAST(s.spec_id AS INTEGER) AS spec_id, d.doc_id FROM documents d, pack_specs s
       WHERE strlen(coalesce(d.text, '')) + 1 > s.capacity_tokens""",
)
def p6_found(spark, d):
    return packing.split_documents(_p6(spark, d))


@R.query("p6_packed")
def p6_packed(spark, d):
    return _p6(spark, d)


@R.query("p6_fill")
def p6_fill(spark, d):
    return packing.fill(stored(_p6(spark, d), "p6-packed"), table(spark, d, "pack_specs"))


def _p7(spark, d):
    return table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items").select("item_id", "passage")


@R.query("p7_found")
def p7_found(spark, d):
    return leaks.found(*_p7(spark, d))


@R.query("p7_removal_spans")
def p7_removal_spans(spark, d):
    return leaks.removal_spans(*_p7(spark, d))


@R.query("p7_cleaned")
def p7_cleaned(spark, d):
    docs, items = _p7(spark, d)
    return leaks.cut_out(docs, leaks.removal_spans(docs, items))


@R.query("p8_found")
def p8_found(spark, d):
    return stuffed.found(table(spark, d, "documents"))


@R.query("p8_measures")
def p8_measures(spark, d):
    return stuffed.measures(table(spark, d, "documents"))
