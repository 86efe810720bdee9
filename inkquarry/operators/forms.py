"""Form data over a ``fields`` table: doc_id, name, kind, value array<string>, default_value, options, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXPORTED = ("text", "checkbox", "radio", "list", "combo")


def once(fields: DataFrame) -> DataFrame:
    return fields.where(F.col("name").isNotNull()).dropDuplicates(["doc_id", "name"])


def shown(value: Column, kind: Column) -> Column:
    """One text for a field: several values joined by a comma and a blank, an unset check box ``Off``."""
    text = F.array_join(F.coalesce(value, F.array().cast("array<string>")), ", ")
    return F.when(kind.isin("checkbox", "radio") & (text == ""), "Off").otherwise(text)


def spreadsheet(fields: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each document, one column for each named field; missing ones are empty. Columns are given, so no extra pass."""
    f = once(fields).where(F.col("kind").isin(*EXPORTED) & F.col("name").isin(*columns))
    wide = f.groupBy("doc_id").pivot("name", columns).agg(F.first(shown(F.col("value"), F.col("kind"))))
    return wide.select("doc_id", *(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns))


def first_seen(fields: DataFrame, most: int = 5000, order: str = "ord") -> list[str]:
    """Field names in the order in which they are first seen: by document, then by position in the file where ``order`` is a column, else by name.

    Names are schema: their number is checked.
    """
    at = F.col(order) if order in fields.columns else F.lit(0)
    rows = fields.where(F.col("kind").isin(*EXPORTED)).groupBy("name").agg(F.min(F.struct(F.col("doc_id").alias("d"), at.alias("at"))).alias("x")).orderBy("x", "name").select("name").take(most + 1)
    if len(rows) > most:
        raise ValueError(f"more than {most} field names: export in long form instead")
    return [r[0] for r in rows]


def undescribed(fields: DataFrame) -> DataFrame:
    """``doc_id, name, page``: fields without a description, with their first page."""
    return fields.where(F.trim(F.coalesce("tooltip", F.lit(""))) == "").groupBy("doc_id", "name").agg(F.min("page").alias("page"))


def apply_values(fields: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fields with the given values, rejected values). ``values`` is doc_id, name, value, and ``seq`` where a field has several.

    Choices must be an option, or free text where the field allows it; only lists that allow several values take more than
    one; texts must not be longer than the field. A field is given all its values or none.
    """
    seq = F.col("seq") if "seq" in values.columns else F.lit(0)
    v = values.groupBy("doc_id", "name").agg(F.array_sort(F.collect_set(F.struct(seq.alias("seq"), "value"))).alias("_given"))
    v = v.select("doc_id", "name", F.transform("_given", lambda x: x["value"]).alias("_new"))
    j = once(fields).join(v, ["doc_id", "name"], "left")
    codes = F.transform(F.coalesce("options", F.expr("cast(array() as array<struct<export_value:string,display_text:string>>)")), lambda o: o["export_value"])
    free, many = F.col("flags").bitwiseAND(1 << 18) != 0, (F.col("kind") == "list") & (F.col("flags").bitwiseAND(1 << 21) != 0)
    ok = ~F.col("kind").isin("list", "combo") | free | F.forall("_new", lambda x: F.array_contains(codes, x))
    ok = ok & (F.col("max_len").isNull() | (F.col("max_len") <= 0) | F.forall("_new", lambda x: F.length(x) <= F.col("max_len"))) & ((F.size("_new") < 2) | many)
    ok = F.coalesce(ok, F.lit(False))
    filled = j.withColumn("value", F.when(F.col("_new").isNotNull() & ok, F.col("_new")).otherwise(F.col("value"))).drop("_new")
    unknown = v.join(fields, ["doc_id", "name"], "left_anti").select("doc_id", "name", F.explode("_new").alias("value"), F.lit("no such field").alias("reason"))
    bad = j.where(F.col("_new").isNotNull() & ~ok).select("doc_id", "name", F.explode("_new").alias("value"), F.lit("not allowed").alias("reason"))
    return filled, unknown.unionByName(bad)


def reset(fields: DataFrame) -> DataFrame:
    return fields.withColumn("value", F.coalesce("default_value", F.array().cast("array<string>")))


def display(fields: DataFrame) -> DataFrame:
    """Values of choices by their display text, where there is one: ``doc_id, name, shown array<string>``. Of several options of one value the first counts."""
    options = F.coalesce("options", F.expr("cast(array() as array<struct<export_value:string,display_text:string>>)"))
    first = lambda v: F.get(F.filter(options, lambda o: o["export_value"] == v), F.lit(0))["display_text"]
    return fields.select("doc_id", "name", F.transform(F.coalesce("value", F.array().cast("array<string>")), lambda v: F.coalesce(first(v), v)).alias("shown"))


def _xml(t: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def _body(rows: DataFrame, element: Column, order: list[str], name: str) -> DataFrame:
    """``doc_id`` and the elements of a document one after the other."""
    each = rows.select("doc_id", F.struct(*order, element.alias("x")).alias("s"))
    return each.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["x"]), "").alias(name))


def to_xfdf(fields: DataFrame, annotations: DataFrame | None = None) -> DataFrame:
    """``doc_id, xml``: field values and, if given, comments of every document."""
    v = F.concat(F.lit('<field name="'), _xml(F.col("name")), F.lit('">'), F.array_join(F.transform(F.coalesce("value", F.array().cast("array<string>")), lambda x: F.concat(F.lit("<value>"), _xml(F.coalesce(x, F.lit(""))), F.lit("</value>"))), ""), F.lit("</field>"))
    f = _body(once(fields).where(F.col("kind").isin(*EXPORTED)), v, ["name"], "f")
    head, tail = '<?xml version="1.0" encoding="UTF-8"?><xfdf xmlns="http://ns.adobe.com/xfdf/">', "</xfdf>"
    part = lambda c, tag: F.concat(F.lit(f"<{tag}>"), F.coalesce(F.col(c), F.lit("")), F.lit(f"</{tag}>"))
    if annotations is None:
        return f.select("doc_id", F.concat(F.lit(head), part("f", "fields"), F.lit(tail)).alias("xml"))
    tag = F.lower("subtype")
    attribute = lambda name, c: F.coalesce(F.concat(F.lit(f' {name}="'), _xml(c.cast("string")), F.lit('"')), F.lit(""))
    a = F.concat(
        F.lit("<"), tag, attribute("page", F.col("page") - 1), attribute("rect", F.array_join(F.col("rect").cast("array<string>"), ",")), attribute("name", F.col("name")), attribute("title", F.col("author")),
        attribute("inreplyto", F.col("in_reply_to")), attribute("state", F.col("state")), F.lit("><contents>"), _xml(F.coalesce("contents", F.lit(""))), F.lit("</contents></"), tag, F.lit(">"),
    )
    both = f.join(_body(annotations.where("subtype is not null"), a, ["page", "index"], "a"), "doc_id", "full_outer")
    return both.select("doc_id", F.concat(F.lit(head), part("f", "fields"), part("a", "annots"), F.lit(tail)).alias("xml"))


def to_fdf(fields: DataFrame) -> DataFrame:
    """``doc_id, fdf``: the same in the other exchange syntax."""
    esc = F.regexp_replace(shown(F.col("value"), F.col("kind")), r"([\\()])", r"\\$1")
    f = once(fields).where(F.col("kind").isin(*EXPORTED)).select("doc_id", F.struct("name", F.concat(F.lit("<</T("), F.regexp_replace("name", r"([\\()])", r"\\$1"), F.lit(")/V("), esc, F.lit(")>>")).alias("x")).alias("s"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["x"]), "\n")
    return f.groupBy("doc_id").agg(F.concat(F.lit("%FDF-1.2\n1 0 obj\n<</FDF<</Fields[\n"), body, F.lit("\n]>>>>\nendobj\ntrailer\n<</Root 1 0 R>>\n%%EOF\n")).alias("fdf"))


def properties(fields: DataFrame) -> DataFrame:
    """What scripts ask of a field: ``doc_id, name, type, value_as_string, read_only, required, char_limit, num_items, export_values, current_indices, checked``."""
    none = F.array().cast("array<string>")
    options = F.coalesce("options", F.expr("cast(array() as array<struct<export_value:string,display_text:string>>)"))
    codes = F.transform(options, lambda o: F.coalesce(o["export_value"], o["display_text"]))
    values = F.coalesce("value", none)
    flag = lambda bit: F.coalesce(F.col("flags").bitwiseAND(1 << bit) != 0, F.lit(False))
    at = F.filter(F.transform(values, lambda v: (F.array_position(codes, v) - 1).cast("int")), lambda i: i >= 0)
    boxes = F.col("kind").isin("checkbox", "radio")
    return fields.select(
        "doc_id", "name", F.col("kind").alias("type"), F.array_join(values, ", ").alias("value_as_string"), flag(0).alias("read_only"), flag(1).alias("required"), F.when(F.col("max_len") > 0, F.col("max_len")).alias("char_limit"),
        F.size(options).alias("num_items"), codes.alias("export_values"), at.alias("current_indices"), (boxes & (F.size(values) > 0) & ~F.coalesce(F.get(values, F.lit(0)), F.lit("Off")).isin("Off", "")).alias("checked"),
    )


def item_at(fields: DataFrame, index: int, export: bool = True) -> DataFrame:
    """``doc_id, name, item``: an option of each choice by its position, -1 the last; null past the end."""
    options = F.coalesce("options", F.expr("cast(array() as array<struct<export_value:string,display_text:string>>)"))
    o = F.when(F.lit(index) == -1, F.try_element_at(options, F.lit(-1))).otherwise(F.get(options, F.lit(index)))
    return fields.select("doc_id", "name", (o["export_value"] if export else o["display_text"]).alias("item"))
