"""Comment threads over an ``annotations`` table: doc_id, page, index, subtype, author, contents, modified, name,
in_reply_to, state, intent, color.

A root is no reply. All joins carry doc_id. Names are unique within a page at most; ties go to the smaller index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = {
    "Text": "Sticky note", "Highlight": "Highlight", "Underline": "Underline", "StrikeOut": "Strikethrough", "Squiggly": "Squiggly", "FreeText": "Text box", "Line": "Line", "Square": "Rectangle",
    "Circle": "Oval", "Polygon": "Polygon", "PolyLine": "Connected lines", "Ink": "Pencil", "Stamp": "Stamp", "Caret": "Inserted text", "FileAttachment": "Attachment", "Redact": "Redaction",
}


def kind(df: DataFrame) -> DataFrame:
    names = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    i = F.coalesce("intent", F.lit(""))
    special = F.when((F.col("subtype") == "FreeText") & (i == "FreeTextCallout"), "Callout").when((F.col("subtype") == "FreeText") & (i == "FreeTextTypeWriter"), "Typed text").when((F.col("subtype") == "Line") & (i == "LineArrow"), "Arrow").when((F.col("subtype") == "Polygon") & (i == "PolygonCloud"), "Cloud")
    return df.withColumn("kind", F.coalesce(special, F.try_element_at(names, F.col("subtype")), F.col("subtype")))


def threads(annotations: DataFrame) -> DataFrame:
    """Roots with their replies, latest status and number on the page."""
    roots = annotations.where(F.col("in_reply_to").isNull())
    replies = annotations.where(F.col("in_reply_to").isNotNull())
    # the last one in the order of the file, whatever its date says
    state = F.when(F.col("state").isNotNull() & ~F.col("state").isin("Marked", "Unmarked"), F.struct("page", "index", "state"))
    per = replies.groupBy("doc_id", F.col("in_reply_to").alias("name")).agg(
        F.sum(F.col("state").isNull().cast("int")).alias("replies"), F.max(state)["state"].alias("status"),
        F.max(F.when(F.col("state").isin("Marked", "Unmarked"), F.struct("page", "index", (F.col("state") == "Marked").alias("m"))))["m"].alias("marked"),
    )
    w = Window.partitionBy("doc_id", "page").orderBy("index")
    return roots.withColumn("number", F.row_number().over(w)).join(per, ["doc_id", "name"], "left").fillna({"replies": 0}).withColumn("marked", F.coalesce("marked", F.lit(False)))


def search(annotations: DataFrame, text: str) -> DataFrame:
    """Threads in which the root or a reply holds the text, without case."""
    hit = annotations.where(F.contains(F.lower("contents"), F.lit(text.lower()))).select("doc_id", F.coalesce("in_reply_to", "name").alias("name")).distinct()
    return annotations.where(F.col("in_reply_to").isNull()).join(hit, ["doc_id", "name"], "left_semi")


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` in place of rows with the same key, new ones added. Null keys match nothing."""
    return current.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming, allowMissingColumns=True)


def hide(threads_: DataFrame, kinds: list[str] = (), authors: list[str] = (), statuses: list[str] = (), marked: bool | None = None) -> DataFrame:
    """Threads that none of the given kinds, authors, statuses or marks hides. A null is none of them; no status is ``""``."""
    keep = ~F.coalesce(F.col("kind"), F.lit("")).isin(list(kinds)) & ~F.coalesce(F.col("author"), F.lit("")).isin(list(authors)) & ~F.coalesce(F.col("status"), F.lit("")).isin(list(statuses))
    return threads_.where(keep if marked is None else keep & (F.col("marked") != marked))


def page_counts(annotations: DataFrame) -> DataFrame:
    """``doc_id, page, comments``: threads on each page."""
    return annotations.where(F.col("in_reply_to").isNull()).groupBy("doc_id", "page").agg(F.count("*").alias("comments"))


ORDERS = {
    "page": ("doc_id", "page", "index"), "author": ("doc_id", "_author", "page", "index"), "type": ("doc_id", "kind", "page", "index"), "color": ("doc_id", "color", "page", "index"), "date": ("doc_id", "_date", "page", "index"),
}


def _sort_keys(df: DataFrame, by: str, newest_first: bool) -> tuple[DataFrame, list]:
    d = df.withColumn("_author", F.lower(F.coalesce("author", F.lit("")))).withColumn("_date", F.col("modified") if "modified" in df.columns else F.lit(None).cast("string"))
    return d, [F.desc_nulls_last(k) if k == "_date" and newest_first else F.asc_nulls_first(k) for k in ORDERS[by]]


def sort(df: DataFrame, by: str = "page", newest_first: bool = False) -> DataFrame:
    """Stable orders: the position in the file is always the last key."""
    d, keys = _sort_keys(df, by, newest_first)
    return d.orderBy(*keys).drop("_author", "_date")


def placed(df: DataFrame, by: str = "page", newest_first: bool = False) -> DataFrame:
    """``place``: the position of each row of a document in that order, from 1, without a sort over all documents."""
    d, keys = _sort_keys(df, by, newest_first)
    return d.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(*keys))).drop("_author", "_date")


def summary(annotations: DataFrame) -> DataFrame:
    """Text of every page's comments: ``doc_id, page, text``."""
    t = threads(kind(annotations))
    line = F.concat_ws("", F.col("number").cast("string"), F.lit(". "), F.coalesce("author", F.lit("")), F.lit(" ("), "kind", F.lit("): "), F.coalesce("contents", F.lit("")))
    return t.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", line.alias("t")))), lambda x: x["t"]), "\n").alias("text"))


def group_headers(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``header``: whether the group key differs from that of the row before, within a document."""
    w = Window.partitionBy("doc_id").orderBy(*order)
    return df.withColumn("header", ~F.lag(key).over(w).eqNullSafe(F.col(key)) | (F.row_number().over(w) == 1))
