"""Edits of document tables, each for many documents at once: a table of changes goes in, the changed table comes out.

Every edit is a join on the keys of what it changes, so a hundred edits of a million documents are one pass. Tables are

- ``annotations``: doc_id, page, index, name, in_reply_to, subtype, author, contents, modified, state, rect, color, locked, ...
- ``links``: doc_id, page, index, rect, kind, target_page, uri
- ``outline``: doc_id, path array<int>, title, page
- ``fields``: doc_id, name, kind, value, page, rect, tab, ...
- ``elems``: doc_id, id, type, alt

Defined results: changes whose key is null or names nothing change nothing; a null in a change leaves the old value; of
several changes of one key the greatest counts; positions (``index``, the last part of ``path``) stay without gaps;
locked annotations keep place, text, style and life, only the lock itself can be changed; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .sets import overlap_anti

PLACE = ["doc_id", "page", "index"]


def patch(df: DataFrame, keys: list[str], changes: DataFrame, columns: list[str], allowed: Column | None = None) -> DataFrame:
    """``df`` with the values of ``changes`` in ``columns`` where they are not null. Columns that ``df`` lacks are added."""
    one = changes.groupBy(*keys).agg(F.max(F.struct(*(F.col(c).alias(c) for c in columns))).alias("_new"))
    joined = df.join(one, keys, "left")
    ok = F.lit(True) if allowed is None else F.coalesce(allowed, F.lit(True))
    for c in columns:
        new = F.when(ok, F.col("_new")[c])
        joined = joined.withColumn(c, F.coalesce(new, F.col(c)) if c in df.columns else new)
    return joined.drop("_new").select(*df.columns, *(c for c in columns if c not in df.columns))


def renumber(df: DataFrame, by: tuple[str, ...] = ("doc_id", "page"), order: tuple[str, ...] = ("index",)) -> DataFrame:
    """``index`` without gaps, in order."""
    return df.withColumn("index", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("int"))


def append(df: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    """Rows ``new`` after the last ones of their pages, in the order of ``order``."""
    last = df.groupBy("doc_id", "page").agg((F.max("index") + 1).alias("_next"))
    w = Window.partitionBy("doc_id", "page").orderBy(order)
    numbered = new.withColumn("_k", F.row_number().over(w) - 1).join(last, ["doc_id", "page"], "left")
    numbered = numbered.withColumn("index", (F.coalesce("_next", F.lit(0)) + F.col("_k")).cast("int")).drop("_k", "_next", *([order] if order not in df.columns else []))
    return df.unionByName(numbered, allowMissingColumns=True)


# annotations


def _free() -> Column:
    return ~F.coalesce(F.col("locked"), F.lit(False))



def add_annotations(annotations: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` has the columns of annotations but index, and ``seq``, their order on the page."""
    return append(annotations, new)


def _reply_rows(annotations: DataFrame, replies: DataFrame, *columns: Column) -> DataFrame:
    """Rows that answer the annotations at ``PLACE``: named after the one they answer and their number."""
    targets = annotations.select(*PLACE, F.col("name").alias("in_reply_to"))
    rows = replies.join(targets, PLACE).withColumn("seq", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("index", "author", *[c for c in ("contents", "state") if c in replies.columns])))
    return rows.select("doc_id", "page", "seq", "in_reply_to", F.concat("in_reply_to", F.lit("+"), "seq").alias("name"), F.lit("Text").alias("subtype"), "author", *columns)


def reply(annotations: DataFrame, replies: DataFrame) -> DataFrame:
    """``replies``: doc_id, page, index of what is answered, contents, author."""
    return append(annotations, _reply_rows(annotations, replies, F.col("contents")))


def set_status(annotations: DataFrame, states: DataFrame) -> DataFrame:
    """``states``: doc_id, page, index, state, author. A status is a reply with a state, so older ones stay on record."""
    return append(annotations, _reply_rows(annotations, states, F.col("state")))


def mark(annotations: DataFrame, marks: DataFrame) -> DataFrame:
    """``marks``: doc_id, page, index, marked, author: a check mark set or taken away."""
    return set_status(annotations, marks.select(*PLACE, "author", F.when(F.col("marked"), "Marked").otherwise("Unmarked").alias("state")))


def lock(annotations: DataFrame, locks: DataFrame) -> DataFrame:
    return patch(annotations, PLACE, locks, ["locked"])


def move(annotations: DataFrame, steps: DataFrame) -> DataFrame:
    """``steps``: doc_id, page, index, dx, dy."""
    by = steps.groupBy(*PLACE).agg(F.max(F.struct("dx", "dy")).alias("_by"))
    moved = F.transform("rect", lambda x, i: x + F.when(i % 2 == 0, F.col("_by.dx")).otherwise(F.col("_by.dy")))
    j = annotations.join(by, PLACE, "left")
    return j.withColumn("rect", F.when(F.col("_by").isNotNull() & _free(), moved).otherwise(F.col("rect"))).select(annotations.columns)


def resize(annotations: DataFrame, rects: DataFrame) -> DataFrame:
    return patch(annotations, PLACE, rects, ["rect"], _free())


def style(annotations: DataFrame, styles: DataFrame) -> DataFrame:
    """``styles``: doc_id, page, index and any of color, opacity, width."""
    return patch(annotations, PLACE, styles, [c for c in ("color", "opacity", "width") if c in styles.columns], _free())


def set_annotation_info(annotations: DataFrame, info: DataFrame) -> DataFrame:
    """``info``: doc_id, page, index and any of author, subject, icon, contents."""
    return patch(annotations, PLACE, info, [c for c in ("author", "subject", "icon", "contents") if c in info.columns], _free())


def delete_annotations(annotations: DataFrame, places: DataFrame) -> DataFrame:
    """Without the annotations at ``places`` and, at any depth, what answers them."""
    doomed = stored(annotations.where(_free()).join(places.select(*PLACE).distinct(), PLACE, "left_semi").select("doc_id", "page", "index", "name"), "edits-doomed")
    fresh = doomed
    while not fresh.isEmpty():
        answers = annotations.join(fresh.where("name is not null").select("doc_id", F.col("name").alias("in_reply_to")).distinct(), ["doc_id", "in_reply_to"], "left_semi").select("doc_id", "page", "index", "name")
        fresh = stored(answers.join(doomed, PLACE, "left_anti"), "edits-doomed")
        doomed = stored(doomed.unionByName(fresh), "edits-doomed")
    return renumber(annotations.join(doomed, PLACE, "left_anti")).select(annotations.columns)


# links


def add_links(links: DataFrame, new: DataFrame) -> DataFrame:
    return append(links, new)


def edit_links(links: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes``: doc_id, page, index and any of rect, kind, target_page, uri."""
    return patch(links, PLACE, changes, [c for c in ("rect", "kind", "target_page", "uri") if c in changes.columns])


def delete_links(links: DataFrame, places: DataFrame) -> DataFrame:
    return renumber(links.join(places.select(*PLACE), PLACE, "left_anti")).select(links.columns)


def remove_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Without all links of the pages ``doc_id, page``."""
    return links.join(pages.select("doc_id", "page"), ["doc_id", "page"], "left_anti")


def links_from_urls(links: DataFrame, urls: DataFrame, eps: float = 0.0) -> DataFrame:
    """Links for the addresses ``doc_id, page, rect, uri, seq`` found in the text that no link lies over yet."""
    free = overlap_anti(urls, links, eps)
    return append(links, free.withColumn("kind", F.lit("uri")))


# bookmarks


def _up() -> Column:
    """The path of the bookmark above."""
    return F.expr("slice(path, 1, size(path) - 1)")



def _shift(outline: DataFrame, at: DataFrame, by: int) -> DataFrame:
    """Bookmarks from a place on, with all below them, one place on or back. ``at``: doc_id, parent, position."""
    a = at.select("doc_id", F.col("parent").alias("_p"), F.col("position").alias("_i"))
    depth = F.size("_p")
    below = (F.size("path") > depth) & (F.slice("path", F.lit(1), depth) == F.col("_p")) & (F.get("path", depth) >= F.col("_i"))
    j = outline.join(a, "doc_id", "left")
    path = F.when(F.coalesce(below, F.lit(False)), F.transform("path", lambda x, i: F.when(i == depth, x + by).otherwise(x))).otherwise(F.col("path"))
    return j.withColumn("path", path).select(outline.columns)


def add_bookmarks(outline: DataFrame, new: DataFrame) -> DataFrame:
    """``new``: doc_id, parent array<int>, position, title, page; at most one for a document. Positions past the end are the end."""
    kids = outline.select("doc_id", _up().alias("parent")).groupBy("doc_id", "parent").agg(F.count("*").alias("_n"))
    placed = new.join(kids, ["doc_id", "parent"], "left").withColumn("position", F.least("position", F.coalesce("_n", F.lit(0)).cast("int"))).drop("_n")
    rows = placed.select("doc_id", F.concat("parent", F.array("position")).alias("path"), "title", "page")
    return _shift(outline, placed, 1).unionByName(rows, allowMissingColumns=True)


def rename_bookmarks(outline: DataFrame, titles: DataFrame) -> DataFrame:
    return patch(outline, ["doc_id", "path"], titles, ["title"])


def set_bookmark_pages(outline: DataFrame, pages: DataFrame) -> DataFrame:
    return patch(outline, ["doc_id", "path"], pages, ["page"])


def _below(path: Column, top: Column) -> Column:
    return F.slice(path, F.lit(1), F.size(top)) == top


def delete_bookmarks(outline: DataFrame, paths: DataFrame) -> DataFrame:
    """Without the bookmarks at ``doc_id, path``, one for a document, and all below them."""
    p = outline.select("doc_id", "path").join(paths.select("doc_id", "path").dropDuplicates(["doc_id"]), ["doc_id", "path"])
    kept = outline.join(p.select("doc_id", F.col("path").alias("_top")), "doc_id", "left").where(F.col("_top").isNull() | ~_below(F.col("path"), F.col("_top"))).drop("_top")
    return _shift(kept, p.select("doc_id", _up().alias("parent"), F.element_at("path", -1).alias("position")), -1)


def move_bookmarks(outline: DataFrame, moves: DataFrame) -> DataFrame:
    """``moves``: doc_id, path, parent, position; at most one for a document. The new place is meant after the bookmark is taken out.

    A bookmark cannot go below itself: such a move changes nothing.
    """
    m = moves.dropDuplicates(["doc_id"]).where(~_below(F.col("parent"), F.col("path"))).join(outline.select("doc_id", "path"), ["doc_id", "path"], "left_semi")
    top = m.select("doc_id", F.col("path").alias("_top"), "parent", "position")
    taken = outline.join(top, "doc_id").where(_below(F.col("path"), F.col("_top")))
    rest = delete_bookmarks(outline, m)
    kids = rest.select("doc_id", _up().alias("parent")).groupBy("doc_id", "parent").agg(F.count("*").alias("_n"))
    at = top.join(kids, ["doc_id", "parent"], "left").select("doc_id", "parent", F.least("position", F.coalesce("_n", F.lit(0)).cast("int")).alias("position"))
    new = F.concat("_to", F.expr("slice(path, size(_top) + 1, size(path))"))
    back = taken.drop("parent", "position").join(at.select("doc_id", F.concat("parent", F.array("position")).alias("_to")), "doc_id").withColumn("path", new).select(outline.columns)
    return _shift(rest, at, 1).unionByName(back)


# form fields


def add_fields(fields: DataFrame, new: DataFrame) -> DataFrame:
    """Fields whose name the document doesn't have yet."""
    fresh = new.join(fields.select("doc_id", "name"), ["doc_id", "name"], "left_anti").dropDuplicates(["doc_id", "name"])
    return fields.unionByName(fresh, allowMissingColumns=True)


def set_field_props(fields: DataFrame, props: DataFrame) -> DataFrame:
    """``props``: doc_id, name and any other column of fields."""
    return patch(fields, ["doc_id", "name"], props, [c for c in props.columns if c not in ("doc_id", "name")])


def duplicate_fields(fields: DataFrame, copies: DataFrame) -> DataFrame:
    """``copies``: doc_id, name, page: the same field on another page, under its name and the page."""
    c = copies.select("doc_id", "name", F.col("page").alias("_to")).distinct()
    new = fields.join(c, ["doc_id", "name"]).where(~F.col("page").eqNullSafe(F.col("_to")))
    return add_fields(fields, new.withColumn("name", F.concat("name", F.lit("_p"), "_to")).withColumn("page", F.col("_to")).drop("_to"))


def delete_fields(fields: DataFrame, names: DataFrame) -> DataFrame:
    """Without the fields ``doc_id, name``, and those whose names continue a deleted one after a dot."""
    gone = names.where("name is not null").select("doc_id", F.col("name").alias("_up")).distinct()
    ups = F.transform(F.sequence(F.lit(1), F.size(F.split("name", r"\."))), lambda n: F.array_join(F.slice(F.split("name", r"\."), F.lit(1), n), "."))
    hit = fields.select("doc_id", "name", F.explode(ups).alias("_up")).join(gone, ["doc_id", "_up"], "left_semi").select("doc_id", "name").distinct()
    return fields.join(hit, ["doc_id", "name"], "left_anti")


#: How fields follow each other: along rows, along columns, as in the structure (their order in the file), or as they are.
TAB_ORDERS: dict[str, Callable[[], list[Column]]] = {
    "row": lambda: [F.get("rect", F.lit(1)).asc_nulls_last(), F.get("rect", F.lit(0)).asc_nulls_last(), F.col("name").asc()],
    "column": lambda: [F.get("rect", F.lit(0)).asc_nulls_last(), F.get("rect", F.lit(1)).asc_nulls_last(), F.col("name").asc()],
    "structure": lambda: [F.col("name").asc()],
}


def set_tab_order(fields: DataFrame, order: str) -> DataFrame:
    """``tab``: position of each field on its page, from 0. Rows are read from the top, columns from the left."""
    w = Window.partitionBy("doc_id", "page").orderBy(*TAB_ORDERS[order]())
    return fields.withColumn("tab", (F.row_number().over(w) - 1).cast("int"))


def move_in_tab_order(fields: DataFrame, names: DataFrame, earlier: bool) -> DataFrame:
    """The fields ``doc_id, name`` change places with the one before or after; at most one for a page."""
    step = -1 if earlier else 1
    here = fields.join(names.select("doc_id", "name").distinct(), ["doc_id", "name"], "left_semi").select("doc_id", "page", F.col("tab").alias("_from"))
    ends = fields.groupBy("doc_id", "page").agg(F.max("tab").alias("_last"))
    ok = here.join(ends, ["doc_id", "page"]).where((F.col("_from") + step >= 0) & (F.col("_from") + step <= F.col("_last"))).drop("_last")
    j = fields.join(ok, ["doc_id", "page"], "left")
    tab = F.when(F.col("tab") == F.col("_from"), F.col("tab") + step).when(F.col("tab") == F.col("_from") + step, F.col("tab") - step).otherwise(F.col("tab"))
    return j.withColumn("tab", tab.cast("int")).select(fields.columns)


# metadata, boxes, structure

BOXES = ("media", "crop", "bleed", "trim", "art")


def set_info(files: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes``: doc_id, key, value; an empty value takes the entry away. Keys are columns of ``files``."""
    keys = [c for c in ("title", "author", "subject", "keywords", "creator", "producer") if c in files.columns]
    wide = changes.groupBy("doc_id").pivot("key", keys).agg(F.max("value"))
    j = files.join(wide.select("doc_id", *(F.col(k).alias(f"_{k}") for k in keys)), "doc_id", "left")
    for k in keys:
        j = j.withColumn(k, F.when(F.col(f"_{k}").isNull(), F.col(k)).when(F.col(f"_{k}") != "", F.col(f"_{k}")))
    return j.select(files.columns)


def set_page_box(pages: DataFrame, changes: DataFrame, box: str) -> DataFrame:
    """``changes``: doc_id, page, rect. All boxes but the media box are cut to it where the page has one; an empty cut changes nothing."""
    if box not in BOXES:
        raise ValueError(f"no such box: {box}")
    one = changes.groupBy("doc_id", "page").agg(F.max("rect").alias("_r"))
    j = pages.join(one, ["doc_id", "page"], "left")
    m = F.col("media") if "media" in pages.columns and box != "media" else F.lit(None).cast("array<double>")
    r = F.col("_r")
    cut = F.when(m.isNull(), r).otherwise(F.array(F.greatest(r[0], m[0]), F.greatest(r[1], m[1]), F.least(r[2], m[2]), F.least(r[3], m[3])))
    j = j.withColumn("_cut", cut)
    fits = r.isNotNull() & (F.col("_cut")[0] < F.col("_cut")[2]) & (F.col("_cut")[1] < F.col("_cut")[3])
    old = F.col(box) if box in pages.columns else F.lit(None).cast("array<double>")
    return j.withColumn(box, F.when(fits, F.col("_cut")).otherwise(old)).drop("_r", "_cut")


def set_alt_text(elems: DataFrame, alts: DataFrame) -> DataFrame:
    """``alts``: doc_id, id, alt, of figures."""
    return patch(elems, ["doc_id", "id"], alts, ["alt"], F.col("type") == "Figure")


def mark_decorative(elems: DataFrame, ids: DataFrame) -> DataFrame:
    """Figures ``doc_id, id`` become artifacts without text."""
    hit = ids.select("doc_id", "id").distinct().withColumn("_hit", F.lit(True))
    yes = F.coalesce(F.col("_hit"), F.lit(False)) & (F.col("type") == "Figure")
    j = elems.join(hit, ["doc_id", "id"], "left")
    return j.withColumn("alt", F.when(~yes, F.col("alt"))).withColumn("type", F.when(yes, "Artifact").otherwise(F.col("type"))).select(elems.columns)


# redaction


def mark_redactions(annotations: DataFrame, hits: DataFrame, author: str = "") -> DataFrame:
    """Marks over ``doc_id, page, rect, seq``: annotations that say what is to go."""
    return append(annotations, hits.withColumn("subtype", F.lit("Redact")).withColumn("author", F.lit(author)))


def clear_redactions(annotations: DataFrame) -> DataFrame:
    return renumber(annotations.where(~F.col("subtype").eqNullSafe("Redact"))).select(annotations.columns)


def under_marks(items: DataFrame, marks: DataFrame, eps: float = 0.0) -> DataFrame:
    """Glyphs, words, images or annotations (rows with doc_id, page, rect) that a mark lies over."""
    from ..functions.geometry import overlaps

    m = marks.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), F.col("rect").alias("_r"))
    return items.join(m, (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")) & overlaps(F.col("rect"), F.col("_r"), eps), "left_semi")


def apply_redactions(items: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items without what marks lie over, annotations without marks and without what they lie over, what is left under them: no rows)."""
    from ..functions.geometry import overlaps

    marks = annotations.where(F.col("subtype") == "Redact")
    m = marks.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), F.col("rect").alias("_r"))

    def without(df: DataFrame) -> DataFrame:
        return df.join(m, (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")) & overlaps(F.col("rect"), F.col("_r"), 0.0), "left_anti")

    kept = without(items)
    others = without(annotations.where(~F.col("subtype").eqNullSafe("Redact")))
    return kept, renumber(others).select(annotations.columns), under_marks(kept, marks)


def redact_tags(elems: DataFrame, removed: DataFrame) -> DataFrame:
    """Structure elements of the content ``doc_id, id`` that was removed lose their texts."""
    hit = removed.select("doc_id", "id").distinct().withColumn("_hit", F.lit(True))
    texts = [c for c in ("alt", "actual_text", "title", "summary") if c in elems.columns]
    j = elems.join(hit, ["doc_id", "id"], "left")
    for c in texts:
        j = j.withColumn(c, F.when(F.col("_hit").isNull(), F.col(c)))
    return j.select(elems.columns)


# hidden information

#: What each category of hidden information takes away: table to condition of the rows that stay, or columns that become null.
HIDDEN: dict[str, dict[str, str | tuple[str, ...]]] = {
    "metadata": {"files": ("title", "author", "subject", "keywords", "creator", "producer")},
    "attachments": {"attachments": "false"},
    "comments": {"annotations": "subtype in ('Link', 'Widget')"},
    "scripts": {"scripts": "false", "files": ("has_javascript",)},
    "links": {"links": "kind <> 'uri'"},
    "bookmarks": {"outline": "false"},
    "form fields": {"fields": "false"},
    "hidden layers": {"layers": "visible"},
    "hidden text": {"glyphs": "coalesce(hidden, false) = false"},
}


def remove_hidden(tables: dict[str, DataFrame], categories: list[str]) -> dict[str, DataFrame]:
    """The tables without the hidden information of these categories. Tables and columns that aren't given are passed over."""
    out = dict(tables)
    for category in categories:
        for name, what in HIDDEN[category].items():
            if name not in out:
                continue
            if type(what) is str:
                out[name] = out[name].where(what)
            else:
                for c in what:
                    if c in out[name].columns:
                        out[name] = out[name].withColumn(c, F.lit(None).cast(out[name].schema[c].dataType))
    return out


def sanitize(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return remove_hidden(tables, list(HIDDEN))


def batch(tables: dict[str, DataFrame], steps: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> dict[str, DataFrame]:
    """Edits one after the other: (table, edit) with an edit that takes the table as it stands then. One lazy plan, all or nothing."""
    out = dict(tables)
    for name, step in steps:
        if name not in out:
            raise ValueError(f"no such table: {name}")
        out[name] = out[name].transform(step)
    return out


# measurements


def add_measurements(annotations: DataFrame, new: DataFrame) -> DataFrame:
    """``new``: doc_id, page, kind, points, seq: drawn as lines or polygons that the measurement table reads back."""
    shape = F.when(F.col("kind") == "distance", "Line").when(F.col("kind") == "perimeter", "PolyLine").otherwise("Polygon")
    return append(annotations, new.withColumn("subtype", shape).withColumn("intent", F.concat(F.initcap("kind"), F.lit("Dimension"))))


def set_scales(viewports: DataFrame, new: DataFrame) -> DataFrame:
    """``new``: doc_id, page, name, bbox, factor, unit; a viewport of the same name is replaced, others come last (``seq``)."""
    kept = viewports.join(new.select("doc_id", "page", "name").distinct(), ["doc_id", "page", "name"], "left_anti")
    last = kept.groupBy("doc_id", "page").agg((F.max("seq") + 1).alias("_next"))
    w = Window.partitionBy("doc_id", "page").orderBy("name")
    rows = new.dropDuplicates(["doc_id", "page", "name"]).withColumn("_k", F.row_number().over(w) - 1).join(last, ["doc_id", "page"], "left")
    return kept.unionByName(rows.withColumn("seq", (F.coalesce("_next", F.lit(0)) + F.col("_k")).cast("int")).drop("_k", "_next"))


def scales_at(points: DataFrame, viewports: DataFrame) -> DataFrame:
    """Points ``doc_id, page, id, x, y`` with ``factor, unit`` of the last viewport that holds them, or 1 and ``pt``."""
    v = viewports.select("doc_id", "page", "bbox", "seq", "factor", "unit")
    inside = (F.col("x") >= F.col("bbox")[0]) & (F.col("x") <= F.col("bbox")[2]) & (F.col("y") >= F.col("bbox")[1]) & (F.col("y") <= F.col("bbox")[3])
    hit = points.join(v, ["doc_id", "page"]).where(inside).groupBy("doc_id", "page", "id").agg(F.max(F.struct("seq", "factor", "unit")).alias("_s"))
    j = points.join(hit, ["doc_id", "page", "id"], "left")
    return j.select(*points.columns, F.coalesce("_s.factor", F.lit(1.0)).alias("factor"), F.coalesce("_s.unit", F.lit("pt")).alias("unit"))


def measurements(annotations: DataFrame, viewports: DataFrame) -> DataFrame:
    """``doc_id, page, index, kind, value, unit`` of all annotations with points, at the scale of the viewport their first point is in."""
    from ..functions import geometry

    kind = F.when(F.col("subtype") == "Line", "distance").when(F.col("subtype") == "PolyLine", "perimeter").when(F.col("subtype") == "Polygon", "area")
    m = annotations.where(kind.isNotNull() & (F.size("points") > 1)).withColumn("kind", kind).withColumn("id", F.col("index")).withColumn("x", F.col("points")[0]["x"]).withColumn("y", F.col("points")[0]["y"])
    s = scales_at(m.select("doc_id", "page", "id", "x", "y", "index", "kind", "points"), viewports)
    value = F.when(F.col("kind") == "area", geometry.area(F.col("points")) * F.col("factor") * F.col("factor")).otherwise(geometry.length(F.col("points")) * F.col("factor"))
    return s.select("doc_id", "page", "index", "kind", value.alias("value"), F.when(F.col("kind") == "area", F.concat("unit", F.lit("²"))).otherwise(F.col("unit")).alias("unit"))


#: What a vertex snaps to, nearest kind first.
SNAPS = ("endpoint", "intersection", "midpoint", "path")


def snap(points: DataFrame, segments: DataFrame, tolerance: float) -> DataFrame:
    """Points ``doc_id, page, id, x, y`` on ``segments`` ``doc_id, page, x0, y0, x1, y1``: ``snap, sx, sy`` or nulls.

    The best kind within the tolerance wins, then the nearest, then the smallest coordinates. Only segments whose box comes
    within the tolerance are looked at.
    """
    box = segments.select("doc_id", "page", F.struct("x0", "y0", "x1", "y1").alias("s"))
    t = F.lit(float(tolerance))
    near = (F.col("x") >= F.least("s.x0", "s.x1") - t) & (F.col("x") <= F.greatest("s.x0", "s.x1") + t) & (F.col("y") >= F.least("s.y0", "s.y1") - t) & (F.col("y") <= F.greatest("s.y0", "s.y1") + t)
    hit = points.select("doc_id", "page", "id", "x", "y").join(box, ["doc_id", "page"]).where(near)
    s, x, y = F.col("s"), F.col("x"), F.col("y")
    dx, dy = s["x1"] - s["x0"], s["y1"] - s["y0"]
    along = F.least(F.greatest(F.coalesce(F.try_divide((x - s["x0"]) * dx + (y - s["y0"]) * dy, dx * dx + dy * dy), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))

    def spot(kind: str, sx: Column, sy: Column) -> Column:
        return F.struct(F.lit(SNAPS.index(kind)).alias("k"), F.sqrt((sx - x) * (sx - x) + (sy - y) * (sy - y)).alias("d"), sx.alias("sx"), sy.alias("sy"))

    each = F.array(spot("endpoint", s["x0"], s["y0"]), spot("endpoint", s["x1"], s["y1"]), spot("midpoint", (s["x0"] + s["x1"]) / 2, (s["y0"] + s["y1"]) / 2), spot("path", s["x0"] + along * dx, s["y0"] + along * dy))
    # segments that come near the point are few: their crossings are looked for among themselves
    both = hit.groupBy("doc_id", "page", "id", "x", "y").agg(F.collect_set("s").alias("near"))
    a, b = F.col("a"), F.col("b")
    ax, ay, bx, by = a["x1"] - a["x0"], a["y1"] - a["y0"], b["x1"] - b["x0"], b["y1"] - b["y0"]
    cross = ax * by - ay * bx
    u = F.try_divide((b["x0"] - a["x0"]) * by - (b["y0"] - a["y0"]) * bx, cross)
    v = F.try_divide((b["x0"] - a["x0"]) * ay - (b["y0"] - a["y0"]) * ax, cross)
    met = both.select("doc_id", "page", "id", "x", "y", F.explode("near").alias("a"), "near").select("doc_id", "page", "id", "x", "y", "a", F.explode("near").alias("b")).where((F.col("a") < F.col("b")) & u.between(0, 1) & v.between(0, 1))
    crossings = met.select("doc_id", "page", "id", spot("intersection", a["x0"] + u * ax, a["y0"] + u * ay).alias("c"))
    every = hit.select("doc_id", "page", "id", F.explode(each).alias("c")).unionByName(crossings).where(F.col("c.d") <= tolerance)
    best = every.groupBy("doc_id", "page", "id").agg(F.min("c").alias("c"))
    names = F.array(*(F.lit(k) for k in SNAPS))
    return points.join(best, ["doc_id", "page", "id"], "left").select(*points.columns, F.get(names, F.col("c.k")).alias("snap"), F.col("c.sx").alias("sx"), F.col("c.sy").alias("sy"))
