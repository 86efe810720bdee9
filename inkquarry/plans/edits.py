"""Queries of comments, edits, redaction and measurements.

The driver's tables have no annotations or bookmarks: they are read off events and pages by one rule, the same in SQL, so
that every operator runs over whole tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import actions, comments, edits, forms, pages
from ..operators.textlines import glyph_lines
from ..sources.tables import table
from .registry import Registry

R = Registry()
c = F.col

_A = """(SELECT CAST(event_id // 30 AS BIGINT) AS doc_id, CAST(event_id // 15 % 2 + 1 AS INTEGER) AS page, CAST(event_id % 15 AS INTEGER) AS index, 'n' || event_id AS name,
  CASE WHEN event_id % 3 <> 0 THEN 'n' || (event_id - event_id % 3) END AS in_reply_to,
  CASE WHEN event_id % 3 <> 0 THEN 'Text' ELSE (['Highlight', 'Ink', 'FreeText', 'Polygon', 'Line'])[event_id % 5 + 1] END AS subtype,
  CASE WHEN event_id % 12 = 3 THEN 'PolygonCloud' END AS intent, 'u' || user_id AS author, event_type || ' ' || user_id AS contents,
  CASE WHEN event_id % 3 <> 0 THEN CASE event_type WHEN 'purchase' THEN 'Accepted' WHEN 'error' THEN 'Rejected' WHEN 'click' THEN 'Marked' END END AS state,
  event_id % 11 = 0 AS locked, [event_id % 100, event_id % 90, event_id % 100 + 10, event_id % 90 + 10]::DOUBLE[] AS rect FROM events)"""


def _annotations(spark, d):
    e = c("event_id")
    answer = e % 3 != 0
    state = F.when(answer, F.when(c("event_type") == "purchase", "Accepted").when(c("event_type") == "error", "Rejected").when(c("event_type") == "click", "Marked"))
    kinds = F.array(*(F.lit(k) for k in ("Highlight", "Ink", "FreeText", "Polygon", "Line")))
    return table(spark, d, "events").select(
        F.floor(e / 30).cast("bigint").alias("doc_id"), (F.floor(e / 15) % 2 + 1).cast("int").alias("page"), (e % 15).cast("int").alias("index"), F.concat(F.lit("n"), e).alias("name"),
        F.when(answer, F.concat(F.lit("n"), e - e % 3)).alias("in_reply_to"), F.when(answer, "Text").otherwise(F.get(kinds, (e % 5).cast("int"))).alias("subtype"), F.when(e % 12 == 3, "PolygonCloud").alias("intent"),
        F.concat(F.lit("u"), "user_id").alias("author"), F.concat("event_type", F.lit(" "), "user_id").alias("contents"), state.alias("state"), (e % 11 == 0).alias("locked"),
        F.array(*((e % m + k).cast("double") for m, k in ((100, 0), (90, 0), (100, 10), (90, 10)))).alias("rect"),
    )


_P = "(SELECT DISTINCT doc_id, page FROM pdf_pages)"
_O = f"(SELECT doc_id, page, 'p' || page AS title, CASE WHEN (page - 1) % 4 = 0 THEN [(page - 1) // 4] ELSE [(page - 1) // 4, (page - 1) % 4 - 1] END::INTEGER[] AS path FROM {_P})"


def _outline(spark, d):
    k, r = F.floor((c("page") - 1) / 4).cast("int"), ((c("page") - 1) % 4).cast("int")
    p = table(spark, d, "pdf_pages").select("doc_id", "page").distinct()
    return p.select("doc_id", "page", F.concat(F.lit("p"), "page").alias("title"), F.when(r == 0, F.array(k)).otherwise(F.array(k, r - 1)).alias("path"))


# comments


@R.query(
    "comment_threads",
    f"""WITH a AS {_A} SELECT r.doc_id, r.page, r.index, CAST(row_number() OVER (PARTITION BY r.doc_id, r.page ORDER BY r.index) AS INTEGER) AS number,
          coalesce(any_value(t.n), 0) AS replies, any_value(t.status) AS status, coalesce(any_value(t.marked), false) AS marked
        FROM a r LEFT JOIN (SELECT doc_id, in_reply_to, CAST(count(*) FILTER (WHERE state IS NULL) AS BIGINT) AS n, arg_max(state, page * 1000 + index) FILTER (WHERE state IS NOT NULL AND state NOT IN ('Marked', 'Unmarked')) AS status,
          arg_max(state = 'Marked', page * 1000 + index) FILTER (WHERE state IN ('Marked', 'Unmarked')) AS marked FROM a WHERE in_reply_to IS NOT NULL GROUP BY ALL) t ON t.doc_id = r.doc_id AND t.in_reply_to = r.name
        WHERE r.in_reply_to IS NULL GROUP BY r.doc_id, r.page, r.index""",
)
def comment_threads(spark, d):
    return comments.threads(_annotations(spark, d)).select("doc_id", "page", "index", "number", c("replies").cast("bigint").alias("replies"), "status", "marked")


@R.query("comment_kinds", f"WITH a AS {_A} SELECT doc_id, page, index, CASE WHEN subtype = 'Polygon' AND intent = 'PolygonCloud' THEN 'Cloud' ELSE (MAP {{'Text': 'Sticky note', 'Highlight': 'Highlight', 'Ink': 'Pencil', 'FreeText': 'Text box', 'Polygon': 'Polygon', 'Line': 'Line'}})[subtype] END AS kind FROM a")
def comment_kinds(spark, d):
    return comments.kind(_annotations(spark, d)).select("doc_id", "page", "index", "kind")


@R.query("comment_search", f"WITH a AS {_A} SELECT DISTINCT r.doc_id, r.name FROM a r JOIN a x ON x.doc_id = r.doc_id AND (x.name = r.name OR x.in_reply_to = r.name) WHERE r.in_reply_to IS NULL AND contains(lower(x.contents), 'purchase 1')")
def comment_search(spark, d):
    return comments.search(_annotations(spark, d), "Purchase 1").select("doc_id", "name")


@R.query("comment_sort_author", f"WITH a AS {_A} SELECT doc_id, page, index, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY lower(author), page, index) AS INTEGER) AS place FROM a")
def comment_sort_author(spark, d):
    return comments.placed(_annotations(spark, d), "author").select("doc_id", "page", "index", "place")


@R.query("comment_sort_type", f"WITH a AS {_A} SELECT doc_id, page, index, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY kind, page, index) AS INTEGER) AS place FROM (SELECT *, CASE WHEN subtype = 'Polygon' AND intent = 'PolygonCloud' THEN 'Cloud' ELSE (MAP {{'Text': 'Sticky note', 'Highlight': 'Highlight', 'Ink': 'Pencil', 'FreeText': 'Text box', 'Polygon': 'Polygon', 'Line': 'Line'}})[subtype] END AS kind FROM a)")
def comment_sort_type(spark, d):
    return comments.placed(comments.kind(_annotations(spark, d)), "type").select("doc_id", "page", "index", "place")


@R.query("comment_summary", f"WITH a AS {_A} SELECT doc_id, page, string_agg(n || '. ' || author || ' (' || kind || '): ' || contents, chr(10) ORDER BY n) AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY index) AS n, CASE WHEN subtype = 'Polygon' AND intent = 'PolygonCloud' THEN 'Cloud' ELSE (MAP {{'Text': 'Sticky note', 'Highlight': 'Highlight', 'Ink': 'Pencil', 'FreeText': 'Text box', 'Polygon': 'Polygon', 'Line': 'Line'}})[subtype] END AS kind FROM a WHERE in_reply_to IS NULL) GROUP BY doc_id, page")
def comment_summary(spark, d):
    return comments.summary(_annotations(spark, d))


@R.query("comment_page_counts", f"WITH a AS {_A} SELECT doc_id, page, count(*) AS comments FROM a WHERE in_reply_to IS NULL GROUP BY ALL")
def comment_page_counts(spark, d):
    return comments.page_counts(_annotations(spark, d))


@R.query("comment_filter", f"""WITH a AS {_A}, s AS (SELECT doc_id, in_reply_to, arg_max(state, page * 1000 + index) FILTER (WHERE state IS NOT NULL AND state <> 'Marked') AS status FROM a WHERE in_reply_to IS NOT NULL GROUP BY ALL)
  SELECT r.doc_id, r.name FROM a r LEFT JOIN s ON s.doc_id = r.doc_id AND s.in_reply_to = r.name WHERE r.in_reply_to IS NULL AND r.subtype NOT IN ('Ink', 'Line') AND r.author <> 'u1' AND coalesce(s.status, '') <> 'Rejected'""")  # fmt: skip
def comment_filter(spark, d):
    t = comments.threads(comments.kind(_annotations(spark, d)))
    return comments.hide(t, kinds=["Pencil", "Line"], authors=["u1"], statuses=["Rejected"]).select("doc_id", "name")


@R.query("comment_import", f"WITH a AS {_A} SELECT doc_id, page, name, CASE WHEN index % 4 = 0 THEN 'new' ELSE contents END AS contents FROM a")
def comment_import(spark, d):
    a = _annotations(spark, d).select("doc_id", "page", "name", "contents", "index")
    return comments.upsert(a, a.where("index % 4 = 0").withColumn("contents", F.lit("new")), ["doc_id", "page", "name"]).select("doc_id", "page", "name", "contents")


# edits of annotations


@R.query("edit_comment_add", f"WITH a AS {_A} SELECT doc_id, page, index, author FROM a UNION ALL SELECT doc_id, page, CAST(max(index) + 1 AS INTEGER), 'new' FROM a GROUP BY doc_id, page")
def edit_comment_add(spark, d):
    a = _annotations(spark, d)
    new = a.select("doc_id", "page").distinct().select("doc_id", "page", F.lit("new").alias("author"), F.lit("Text").alias("subtype"), F.lit(1).alias("seq"))
    return edits.add_annotations(a, new).select("doc_id", "page", "index", "author")


@R.query("edit_comment_reply", f"WITH a AS {_A} SELECT doc_id, page, in_reply_to, contents FROM a UNION ALL SELECT doc_id, page, name, 'thanks' FROM a WHERE index % 6 = 0")
def edit_comment_reply(spark, d):
    a = _annotations(spark, d)
    said = a.where("index % 6 = 0").select("doc_id", "page", "index", F.lit("thanks").alias("contents"), F.lit("me").alias("author"))
    return edits.reply(a, said).select("doc_id", "page", "in_reply_to", "contents")


@R.query("edit_comment_status", f"WITH a AS {_A} SELECT doc_id, name, 'Completed' AS status FROM a WHERE in_reply_to IS NULL")
def edit_comment_status(spark, d):
    a = _annotations(spark, d)
    done = a.where("in_reply_to is null").select("doc_id", "page", "index", F.lit("Completed").alias("state"), F.lit("me").alias("author"))
    return comments.threads(edits.set_status(a, done)).select("doc_id", "name", "status")


@R.query("edit_comment_mark", f"WITH a AS {_A} SELECT doc_id, name, index % 2 = 0 AS marked FROM a WHERE in_reply_to IS NULL")
def edit_comment_mark(spark, d):
    a = _annotations(spark, d)
    marks = a.where("in_reply_to is null").select("doc_id", "page", "index", (c("index") % 2 == 0).alias("marked"), F.lit("me").alias("author"))
    return comments.threads(edits.mark(a, marks)).select("doc_id", "name", "marked")


@R.query("edit_comment_lock", f"WITH a AS {_A} SELECT doc_id, page, index, CASE WHEN index < 5 THEN true ELSE locked END AS locked FROM a")
def edit_comment_lock(spark, d):
    a = _annotations(spark, d)
    return edits.lock(a, a.where("index < 5").select("doc_id", "page", "index", F.lit(True).alias("locked"))).select("doc_id", "page", "index", "locked")


@R.query("edit_comment_move", f"WITH a AS {_A} SELECT doc_id, page, index, CASE WHEN index % 2 = 0 AND NOT locked THEN [rect[1] + 5, rect[2] - 3, rect[3] + 5, rect[4] - 3] ELSE rect END AS rect FROM a")
def edit_comment_move(spark, d):
    a = _annotations(spark, d)
    return edits.move(a, a.where("index % 2 = 0").select("doc_id", "page", "index", F.lit(5.0).alias("dx"), F.lit(-3.0).alias("dy"))).select("doc_id", "page", "index", "rect")


@R.query("edit_comment_resize", f"WITH a AS {_A} SELECT doc_id, page, index, CASE WHEN index % 2 = 1 AND NOT locked THEN [0, 0, 50, 60]::DOUBLE[] ELSE rect END AS rect FROM a")
def edit_comment_resize(spark, d):
    a = _annotations(spark, d)
    return edits.resize(a, a.where("index % 2 = 1").select("doc_id", "page", "index", F.array(*map(F.lit, (0.0, 0.0, 50.0, 60.0))).alias("rect"))).select("doc_id", "page", "index", "rect")


@R.query("edit_comment_style", f"WITH a AS {_A} SELECT doc_id, page, index, CASE WHEN subtype = 'Ink' AND NOT locked THEN 0.5 END::DOUBLE AS opacity, CASE WHEN subtype = 'Ink' AND NOT locked THEN 2.0 END::DOUBLE AS width FROM a")
def edit_comment_style(spark, d):
    a = _annotations(spark, d)
    return edits.style(a, a.where("subtype = 'Ink'").select("doc_id", "page", "index", F.lit(0.5).alias("opacity"), F.lit(2.0).alias("width"))).select("doc_id", "page", "index", "opacity", "width")


@R.query("edit_comment_info", f"WITH a AS {_A} SELECT doc_id, page, index, CASE WHEN author = 'u2' AND NOT locked THEN 'v2' ELSE author END AS author, CASE WHEN author = 'u2' AND NOT locked THEN 'about' END AS subject, CASE WHEN author = 'u2' AND NOT locked THEN 'said' ELSE contents END AS contents FROM a")
def edit_comment_info(spark, d):
    a = _annotations(spark, d)
    info = a.where("author = 'u2'").select("doc_id", "page", "index", F.lit("v2").alias("author"), F.lit("about").alias("subject"), F.lit("said").alias("contents"))
    return edits.set_annotation_info(a, info).select("doc_id", "page", "index", "author", "subject", "contents")


@R.query(
    "edit_comment_delete",
    f"""WITH RECURSIVE a AS {_A}, g AS (SELECT doc_id, page, index, name FROM a WHERE index IN (0, 6, 7) AND NOT locked UNION SELECT x.doc_id, x.page, x.index, x.name FROM a x JOIN g ON x.doc_id = g.doc_id AND x.in_reply_to = g.name)
        SELECT doc_id, page, name, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY index) - 1 AS INTEGER) AS index FROM a WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = a.doc_id AND g.name = a.name)""",
)
def edit_comment_delete(spark, d):
    a = _annotations(spark, d)
    return edits.delete_annotations(a, a.where("index in (0, 6, 7)")).select("doc_id", "page", "name", "index")


# bookmarks


@R.query("outline_list", f"WITH o AS {_O} SELECT doc_id, path, title, page FROM o")
def outline_list(spark, d):
    return _outline(spark, d).select("doc_id", "path", "title", "page")


@R.query("edit_bookmark_add", f"WITH o AS {_O} SELECT doc_id, title, CASE WHEN path[1] >= 1 THEN list_concat([path[1] + 1], path[2:]) ELSE path END::INTEGER[] AS path FROM o UNION ALL SELECT doc_id, 'new', [least(1, max(path[1]) + 1)]::INTEGER[] FROM o GROUP BY doc_id")
def edit_bookmark_add(spark, d):
    o = _outline(spark, d)
    new = o.select("doc_id").distinct().select("doc_id", F.expr("cast(array() as array<int>)").alias("parent"), F.lit(1).alias("position"), F.lit("new").alias("title"), F.lit(1).alias("page"))
    return edits.add_bookmarks(o, new).select("doc_id", "title", "path")


@R.query("edit_bookmark_rename", f"WITH o AS {_O} SELECT doc_id, path, CASE WHEN len(path) = 2 THEN 'below' ELSE title END AS title FROM o")
def edit_bookmark_rename(spark, d):
    o = _outline(spark, d)
    return edits.rename_bookmarks(o, o.where(F.size("path") == 2).select("doc_id", "path", F.lit("below").alias("title"))).select("doc_id", "path", "title")


@R.query("edit_bookmark_page", f"WITH o AS {_O} SELECT doc_id, path, CAST(CASE WHEN path[1] = 0 THEN 1 ELSE page END AS INTEGER) AS page FROM o")
def edit_bookmark_page(spark, d):
    o = _outline(spark, d)
    return edits.set_bookmark_pages(o, o.where(c("path")[0] == 0).select("doc_id", "path", F.lit(1).alias("page"))).select("doc_id", "path", "page")


@R.query("edit_bookmark_delete", f"WITH o AS {_O} SELECT doc_id, title, list_concat([path[1] - 1], path[2:])::INTEGER[] AS path FROM o WHERE path[1] > 0")
def edit_bookmark_delete(spark, d):
    o = _outline(spark, d)
    return edits.delete_bookmarks(o, o.select("doc_id").distinct().select("doc_id", F.array(F.lit(0)).alias("path"))).select("doc_id", "title", "path")


@R.query("edit_bookmark_move", f"WITH o AS {_O}, n AS (SELECT doc_id, max(path[1]) AS last FROM o GROUP BY doc_id) SELECT o.doc_id, title, CASE WHEN path[1] = 0 THEN list_concat([last], path[2:]) ELSE list_concat([path[1] - 1], path[2:]) END::INTEGER[] AS path FROM o JOIN n ON n.doc_id = o.doc_id")
def edit_bookmark_move(spark, d):
    o = _outline(spark, d)
    return edits.move_bookmarks(o, o.select("doc_id").distinct().select("doc_id", F.array(F.lit(0)).alias("path"), F.expr("cast(array() as array<int>)").alias("parent"), F.lit(999).alias("position"))).select("doc_id", "title", "path")


# links: one over the first glyph of every second page


_L = "(SELECT doc_id, page, 0 AS index, [0, 0, 300, 100]::DOUBLE[] AS rect, 'uri' AS kind, 'http://a.example/' || page AS uri FROM (SELECT DISTINCT doc_id, page FROM pdf_pages) WHERE page % 2 = 0)"


def _links(spark, d):
    p = table(spark, d, "pdf_pages").select("doc_id", "page").distinct().where("page % 2 = 0")
    return p.select("doc_id", "page", F.lit(0).alias("index"), F.array(*map(F.lit, (0.0, 0.0, 300.0, 100.0))).alias("rect"), F.lit("uri").alias("kind"), F.concat(F.lit("http://a.example/"), "page").alias("uri"))


def _urls(spark, d):
    """Addresses at a height that tells the pages apart: half of them lie under a link."""
    p = table(spark, d, "pdf_pages").select("doc_id", "page").distinct()
    top = F.when(c("page") % 3 == 0, 50.0).otherwise(400.0)
    return p.select("doc_id", "page", F.array(F.lit(10.0), top, F.lit(90.0), top + 10).alias("rect"), F.concat(F.lit("http://b.example/"), "page").alias("uri"), F.lit(1).alias("seq"))


@R.query("edit_link_add", f"SELECT doc_id, page, index, uri FROM {_L} UNION ALL SELECT doc_id, page, CAST(CASE WHEN page % 2 = 0 THEN 1 ELSE 0 END AS INTEGER), 'http://b.example/' || page FROM (SELECT DISTINCT doc_id, page FROM pdf_pages)")
def edit_link_add(spark, d):
    return edits.add_links(_links(spark, d), _urls(spark, d).withColumn("kind", F.lit("uri"))).select("doc_id", "page", "index", "uri")


@R.query("edit_link_set", f"SELECT doc_id, page, index, CASE WHEN page = 4 THEN 'http://c.example/' ELSE uri END AS uri FROM {_L}")
def edit_link_set(spark, d):
    k = _links(spark, d)
    return edits.edit_links(k, k.where("page = 4").select("doc_id", "page", "index", F.lit("http://c.example/").alias("uri"))).select("doc_id", "page", "index", "uri")


@R.query("edit_link_delete", f"SELECT doc_id, page, 0 AS index, 'http://b.example/' || page AS uri FROM (SELECT DISTINCT doc_id, page FROM pdf_pages)")
def edit_link_delete(spark, d):
    k = _links(spark, d)
    return edits.delete_links(edits.add_links(k, _urls(spark, d).withColumn("kind", F.lit("uri"))), k).select("doc_id", "page", "index", "uri")


@R.query("edit_links_remove", f"SELECT doc_id, page FROM {_L} WHERE page > 2")
def edit_links_remove(spark, d):
    k = _links(spark, d)
    return edits.remove_links(k, k.where("page = 2").select("doc_id", "page")).select("doc_id", "page")


@R.query("edit_links_from_urls", f"SELECT doc_id, page, index, uri FROM {_L} UNION ALL SELECT doc_id, page, CAST(CASE WHEN page % 2 = 0 THEN 1 ELSE 0 END AS INTEGER), 'http://b.example/' || page FROM (SELECT DISTINCT doc_id, page FROM pdf_pages) WHERE NOT (page % 2 = 0 AND page % 3 = 0)")
def edit_links_from_urls(spark, d):
    return edits.links_from_urls(_links(spark, d), _urls(spark, d)).select("doc_id", "page", "index", "uri")


# fields

_F = "(SELECT DISTINCT ON (doc_id, name) * FROM fields)"


def _fields(spark, d):
    return forms.once(table(spark, d, "fields"))


@R.query("edit_field_add", f"SELECT doc_id, name FROM {_F} UNION ALL SELECT DISTINCT doc_id, 'new.field' FROM fields")
def edit_field_add(spark, d):
    f = _fields(spark, d)
    new = f.select("doc_id", F.lit("new.field").alias("name"), F.lit("text").alias("kind")).unionByName(f.select("doc_id", "name", "kind"))
    return edits.add_fields(f, new).select("doc_id", "name")


@R.query("edit_field_props", f"SELECT doc_id, name, CASE WHEN kind = 'text' THEN 'tip' ELSE tooltip END AS tooltip, CAST(CASE WHEN kind = 'text' THEN 99 ELSE max_len END AS INTEGER) AS max_len FROM {_F}")
def edit_field_props(spark, d):
    f = _fields(spark, d)
    return edits.set_field_props(f, f.where("kind = 'text'").select("doc_id", "name", F.lit("tip").alias("tooltip"), F.lit(99).alias("max_len"))).select("doc_id", "name", "tooltip", "max_len")


@R.query("edit_field_duplicate", f"SELECT doc_id, name, page FROM {_F} UNION ALL SELECT doc_id, name || '_p2', 2 FROM {_F} WHERE page IS DISTINCT FROM 2")
def edit_field_duplicate(spark, d):
    f = _fields(spark, d)
    return edits.duplicate_fields(f, f.select("doc_id", "name", F.lit(2).alias("page"))).select("doc_id", "name", "page")


@R.query("edit_field_delete", f"SELECT doc_id, name FROM {_F} WHERE name <> 'applicant' AND NOT starts_with(name, 'applicant.')")
def edit_field_delete(spark, d):
    f = _fields(spark, d)
    return edits.delete_fields(f, f.select("doc_id", F.lit("applicant").alias("name")).distinct()).select("doc_id", "name")


@R.query("edit_tab_order", f"SELECT doc_id, name, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY rect[2] NULLS LAST, rect[1] NULLS LAST, name) - 1 AS INTEGER) AS tab FROM {_F}")
def edit_tab_order(spark, d):
    return edits.set_tab_order(_fields(spark, d), "row").select("doc_id", "name", "tab")


@R.query("edit_tab_order_columns", f"SELECT doc_id, name, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY rect[1] NULLS LAST, rect[2] NULLS LAST, name) - 1 AS INTEGER) AS tab FROM {_F}")
def edit_tab_order_columns(spark, d):
    return edits.set_tab_order(_fields(spark, d), "column").select("doc_id", "name", "tab")


@R.query("edit_tab_order_move", f"SELECT doc_id, name, CAST(CASE WHEN t = 0 AND n > 1 THEN 1 WHEN t = 1 THEN 0 ELSE t END AS INTEGER) AS tab FROM (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id, page ORDER BY name) - 1 AS t, count(*) OVER (PARTITION BY doc_id, page) AS n FROM {_F} WHERE page IS NOT NULL)")
def edit_tab_order_move(spark, d):
    f = edits.set_tab_order(_fields(spark, d).where("page is not null"), "structure")
    return edits.move_in_tab_order(f, f.where("tab = 0"), earlier=False).select("doc_id", "name", "tab")


# files, pages, structure

_D = "(SELECT DISTINCT ON (doc_id) * FROM pdf_files)"


@R.query("edit_info", f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Title ' || doc_id ELSE title END AS title, CASE WHEN doc_id % 2 = 1 THEN author END AS author FROM {_D}")
def edit_info(spark, d):
    f = table(spark, d, "pdf_files").dropDuplicates(["doc_id"])
    e = f.where("doc_id % 2 = 0")
    ch = e.select("doc_id", F.lit("title").alias("key"), F.concat(F.lit("Title "), "doc_id").alias("value")).unionByName(e.select("doc_id", F.lit("author").alias("key"), F.lit("").alias("value")))
    return edits.set_info(f, ch).select("doc_id", "title", "author")


@R.query("edit_page_box", "SELECT doc_id, page, CASE WHEN page = 1 AND w > 10 THEN [10, 20, least(w, 400), least(h, 500)]::DOUBLE[] END AS trim FROM (SELECT DISTINCT ON (doc_id, page) doc_id, page, width::DOUBLE AS w, height::DOUBLE AS h FROM pdf_pages)")
def edit_page_box(spark, d):
    p = pages.once(table(spark, d, "pdf_pages")).select("doc_id", "page", F.array(F.lit(0.0), F.lit(0.0), c("width").cast("double"), c("height").cast("double")).alias("media"))
    return edits.set_page_box(p, p.where("page = 1").select("doc_id", "page", F.array(*map(F.lit, (10.0, 20.0, 400.0, 500.0))).alias("rect")), "trim").select("doc_id", "page", "trim")


_E = "(SELECT DISTINCT doc_id, page AS id, CASE WHEN page % 2 = 0 THEN 'Figure' ELSE 'P' END AS type, CASE WHEN page % 3 = 0 THEN 'old' END AS alt FROM pdf_pages)"


def _elems(spark, d):
    p = table(spark, d, "pdf_pages").select("doc_id", c("page").alias("id")).distinct()
    return p.withColumn("type", F.when(c("id") % 2 == 0, "Figure").otherwise("P")).withColumn("alt", F.when(c("id") % 3 == 0, "old"))


@R.query("edit_alt_text", f"SELECT doc_id, id, CASE WHEN type = 'Figure' AND id < 5 THEN 'new' ELSE alt END AS alt FROM {_E}")
def edit_alt_text(spark, d):
    e = _elems(spark, d)
    return edits.set_alt_text(e, e.where("id < 5").select("doc_id", "id", F.lit("new").alias("alt"))).select("doc_id", "id", "alt")


@R.query("edit_decorative", f"SELECT doc_id, id, CASE WHEN type = 'Figure' AND id > 4 THEN 'Artifact' ELSE type END AS type, CASE WHEN NOT (type = 'Figure' AND id > 4) THEN alt END AS alt FROM {_E}")
def edit_decorative(spark, d):
    e = _elems(spark, d)
    return edits.mark_decorative(e, e.where("id > 4")).select("doc_id", "id", "type", "alt")


# redaction


_W = "(SELECT DISTINCT ON (doc_id, page, ord) doc_id, page, ord, text, rect FROM words WHERE rect IS NOT NULL)"
_HIT = f"(SELECT doc_id, page, rect FROM {_W} WHERE regexp_matches(text, '[0-9]'))"


def _words(spark, d):
    return table(spark, d, "words").where("rect is not null").dropDuplicates(["doc_id", "page", "ord"])


def _marks(spark, d):
    hits = _words(spark, d).where(c("text").rlike("[0-9]")).select("doc_id", "page", c("ord").alias("seq"), "rect")
    return edits.mark_redactions(_annotations(spark, d).where("false"), hits, "me")


@R.query("redact_mark", f"SELECT doc_id, page, rect, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) - 1 AS INTEGER) AS index, 'Redact' AS subtype FROM {_W} WHERE regexp_matches(text, '[0-9]')")
def redact_mark(spark, d):
    return _marks(spark, d).select("doc_id", "page", "rect", "index", "subtype")


@R.query("redact_clear", f"WITH a AS {_A} SELECT doc_id, page, name, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY index) - 1 AS INTEGER) AS index FROM a WHERE subtype <> 'Ink'")
def redact_clear(spark, d):
    a = _annotations(spark, d).withColumn("subtype", F.when(c("subtype") == "Ink", "Redact").otherwise(c("subtype")))
    return edits.clear_redactions(a).select("doc_id", "page", "name", "index")


@R.query("redact_under", f"SELECT w.doc_id, w.page, w.ord FROM {_W} w WHERE EXISTS (SELECT 1 FROM {_HIT} m WHERE m.doc_id = w.doc_id AND m.page = w.page AND w.rect[1] < m.rect[3] AND m.rect[1] < w.rect[3] AND w.rect[2] < m.rect[4] AND m.rect[2] < w.rect[4])")
def redact_under(spark, d):
    return edits.under_marks(_words(spark, d), _marks(spark, d)).select("doc_id", "page", "ord")


@R.query("redact_apply", f"SELECT w.doc_id, w.page, w.ord, w.text FROM {_W} w WHERE NOT EXISTS (SELECT 1 FROM {_HIT} m WHERE m.doc_id = w.doc_id AND m.page = w.page AND w.rect[1] < m.rect[3] AND m.rect[1] < w.rect[3] AND w.rect[2] < m.rect[4] AND m.rect[2] < w.rect[4])")
def redact_apply(spark, d):
    return edits.apply_redactions(_words(spark, d), _marks(spark, d))[0].select("doc_id", "page", "ord", "text")


@R.query("redact_verify", "SELECT doc_id, page, ord FROM words WHERE false")
def redact_verify(spark, d):
    return edits.apply_redactions(_words(spark, d), _marks(spark, d))[2].select("doc_id", "page", "ord")


@R.query("redact_tags", f"SELECT doc_id, id, CASE WHEN id > 3 THEN alt END AS alt FROM {_E}")
def redact_tags(spark, d):
    e = _elems(spark, d)
    return edits.redact_tags(e, e.where("id <= 3")).select("doc_id", "id", "alt")


@R.query("remove_hidden", f"SELECT doc_id, CAST(NULL AS VARCHAR) AS author, CAST(NULL AS BOOLEAN) AS has_javascript, file_size FROM {_D}")
def remove_hidden(spark, d):
    return edits.remove_hidden({"files": table(spark, d, "pdf_files").dropDuplicates(["doc_id"])}, ["metadata", "scripts"])["files"].select("doc_id", "author", "has_javascript", "file_size")


@R.query("sanitize", f"WITH a AS {_A} SELECT 'annotations' AS name, 0 AS rows UNION ALL SELECT 'fields', 0 UNION ALL SELECT 'outline', 0 UNION ALL SELECT 'links', 0 UNION ALL SELECT 'files', count(DISTINCT doc_id) FROM pdf_files")
def sanitize(spark, d):
    t = {"annotations": _annotations(spark, d), "fields": _fields(spark, d), "outline": _outline(spark, d), "links": _links(spark, d), "files": table(spark, d, "pdf_files").dropDuplicates(["doc_id"])}
    out = None
    for name, df in edits.sanitize(t).items():
        n = df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"))
        out = n if out is None else out.unionByName(n)
    return out


@R.query("edit_batch", f"WITH a AS {_A} SELECT doc_id, page, name, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY index) - 1 AS INTEGER) AS index, true AS locked FROM a WHERE subtype <> 'Ink'")
def edit_batch(spark, d):
    a = _annotations(spark, d).withColumn("subtype", F.when(c("subtype") == "Ink", "Redact").otherwise(c("subtype")))
    steps = [("annotations", edits.clear_redactions), ("annotations", lambda x: edits.lock(x, x.select("doc_id", "page", "index", F.lit(True).alias("locked"))))]
    return edits.batch({"annotations": a}, steps)["annotations"].select("doc_id", "page", "name", "index", "locked")


# pipelines


@R.query("action_page_numbers", f"SELECT doc_id, page, 'Page ' || page || ' of ' || max(page) OVER (PARTITION BY doc_id) AS footer FROM {_P}")
def action_page_numbers(spark, d):
    p = table(spark, d, "pdf_pages").select("doc_id", "page").distinct()
    return actions.run({"pages": p}, "Add Page Numbers")["pages"].select("doc_id", "page", "footer")


@R.query("action_distribution", f"SELECT doc_id, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS BOOLEAN) AS has_javascript FROM {_D}")
def action_distribution(spark, d):
    t = {"files": table(spark, d, "pdf_files").dropDuplicates(["doc_id"]), "fields": _fields(spark, d), "annotations": _annotations(spark, d)}
    return actions.run(t, "Prepare for Distribution")["files"].select("doc_id", "title", "has_javascript")


@R.query("action_titles", f"SELECT doc_id, 'One title' AS title FROM {_D}")
def action_titles(spark, d):
    return actions.run({"files": table(spark, d, "pdf_files").dropDuplicates(["doc_id"])}, [actions.set_title("One title")])["files"].select("doc_id", "title")


@R.query("action_script", "SELECT c_custkey AS doc_id, 'total' AS name, [CAST(c_custkey * 3 + c_nationkey AS VARCHAR)] AS value FROM customer UNION ALL SELECT c_custkey, 'a', [CAST(c_custkey AS VARCHAR)] FROM customer UNION ALL SELECT c_custkey, 'b', [CAST(c_nationkey AS VARCHAR)] FROM customer")
def action_script(spark, d):
    values = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.array(v.cast("string")).alias("value")) for n, v in (("a", c("c_custkey")), ("b", c("c_nationkey")), ("total", F.lit(None)))))).alias("x")
    f = table(spark, d, "customer").select(c("c_custkey").alias("doc_id"), values).select("doc_id", "x.*")
    return actions.run({"fields": f}, [actions.run_script("total", "var t = a * 3\nt + b")])["fields"].select("doc_id", "name", "value")


@R.query("action_fields", "SELECT c_custkey AS doc_id, CASE c_custkey % 2 WHEN 0 THEN 'Name_p1_l0' ELSE 'I agree_p1_l0' END AS name, CASE c_custkey % 2 WHEN 0 THEN 'text' ELSE 'checkbox' END AS kind FROM customer")
def action_fields(spark, d):
    lines = table(spark, d, "customer").select(c("c_custkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("line"), F.when(c("c_custkey") % 2 == 0, "Name: ______").otherwise("[ ] I agree").alias("text"))
    none = lines.where("false").select("doc_id", F.lit("").alias("name"), F.lit("").alias("kind"), "page")
    return actions.run({"lines": lines, "fields": none}, [actions.detect_fields()])["fields"].select("doc_id", "name", "kind")


@R.query("corpus_check", "SELECT c_name AS path, CASE WHEN c_custkey % 5 = 0 THEN 'open-error: no header' WHEN c_custkey % 5 = 1 THEN 'page-errors' ELSE 'ok' END AS status FROM customer")
def corpus_check(spark, d):
    k = c("c_custkey") % 5
    docs = table(spark, d, "customer").select(c("c_name").alias("path"), F.when(k > 0, "1.7").otherwise("").alias("pdf_version"), F.array().cast("array<string>").alias("warnings"))
    errors = table(spark, d, "customer").where(k == 1).select(c("c_name").alias("path"), F.explode(F.array(F.lit("pages"), F.lit("words"))).alias("table"))
    return actions.check(docs, errors)


# measurements: a line from corner to corner of every annotation, scales for halves of pages


_V = f"(SELECT doc_id, page, v.seq, v.factor, v.unit, v.bbox FROM {_P} p, (VALUES (0, 2.0::DOUBLE, 'm', [0, 0, 1000, 1000]::DOUBLE[]), (1, 0.5::DOUBLE, 'ft', [0, 0, 50, 1000]::DOUBLE[])) v(seq, factor, unit, bbox) WHERE page = 1)"


def _scales(spark, d):
    # a text page stands for a plan of its document
    p = _annotations(spark, d).select("doc_id", "page").distinct().where("page = 1")
    box = lambda x: F.array(F.lit(0.0), F.lit(0.0), F.lit(x), F.lit(1000.0))
    rows = p.select("doc_id", "page", F.lit("all").alias("name"), box(1000.0).alias("bbox"), F.lit(2.0).alias("factor"), F.lit("m").alias("unit"))
    rows = rows.unionByName(p.select("doc_id", "page", F.lit("left").alias("name"), box(50.0).alias("bbox"), F.lit(0.5).alias("factor"), F.lit("ft").alias("unit")))
    none = rows.where("false").withColumn("seq", F.lit(0))
    return edits.set_scales(none, rows)


@R.query("measure_scales", f"WITH a AS {_A} SELECT doc_id, page, name, CAST(seq AS INTEGER) AS seq FROM (SELECT DISTINCT doc_id, page FROM a WHERE page = 1), (VALUES ('all', 0), ('left', 1)) v(name, seq)")
def measure_scales(spark, d):
    return _scales(spark, d).select("doc_id", "page", "name", "seq")


_AT = f"WITH a AS {_A}, m AS (SELECT *, CASE WHEN page = 1 AND rect[1] <= 50 THEN 0.5 WHEN page = 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS factor, CASE WHEN page = 1 AND rect[1] <= 50 THEN 'ft' WHEN page = 1 THEN 'm' ELSE 'pt' END AS unit FROM a)"


@R.query("measure_scale_at", f"{_AT} SELECT doc_id, page, index AS id, factor, unit FROM m")
def measure_scale_at(spark, d):
    p = _annotations(spark, d).select("doc_id", "page", c("index").alias("id"), c("rect")[0].alias("x"), c("rect")[1].alias("y"))
    return edits.scales_at(p, _scales(spark, d)).select("doc_id", "page", "id", "factor", "unit")


def _measured(spark, d):
    r = c("rect")
    point = lambda i, j: F.struct(r[i].alias("x"), r[j].alias("y"))
    a = _annotations(spark, d)
    new = a.select("doc_id", "page", "rect", c("index").alias("seq"), F.when(c("index") % 3 == 0, "distance").when(c("index") % 3 == 1, "perimeter").otherwise("area").alias("kind"))
    new = new.withColumn("points", F.when(c("kind") == "distance", F.array(point(0, 1), point(2, 3))).otherwise(F.array(point(0, 1), point(2, 1), point(2, 3))))
    return edits.add_measurements(a.where("false"), new)


@R.query("measure_list", f"{_AT} SELECT doc_id, page, index, CASE index % 3 WHEN 0 THEN 'distance' WHEN 1 THEN 'perimeter' ELSE 'area' END AS kind, round(CASE index % 3 WHEN 0 THEN sqrt(200.0::DOUBLE) * factor WHEN 1 THEN 20.0 * factor ELSE 50.0 * factor * factor END, 6) AS value, CASE WHEN index % 3 = 2 THEN unit || '²' ELSE unit END AS unit FROM m")
def measure_list(spark, d):
    return edits.measurements(_measured(spark, d), _scales(spark, d)).withColumn("value", F.round("value", 6))


@R.query("measure_snap", f"WITH a AS {_A} SELECT doc_id, page, index AS id, 'endpoint' AS snap, rect[1] AS sx, rect[2] AS sy FROM a")
def measure_snap(spark, d):
    r = c("rect")
    a = _annotations(spark, d)
    segments = a.select("doc_id", "page", r[0].alias("x0"), r[1].alias("y0"), r[2].alias("x1"), r[3].alias("y1"))
    points = a.select("doc_id", "page", c("index").alias("id"), (r[0] + 0.25).alias("x"), r[1].alias("y"))
    return edits.snap(points, segments, 0.5).select("doc_id", "page", "id", "snap", "sx", "sy")


# patterns over lines and fields


@R.query(
    "pattern_lines",
    """SELECT 'email' AS pattern, CAST(sum(len(regexp_extract_all(' ' || v || ' ', '[^A-Za-z0-9._%+-]([A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,})[^A-Za-z0-9-]', 1))) AS BIGINT) AS hits
       FROM (SELECT unnest(value) AS v FROM (SELECT DISTINCT ON (doc_id, name) value FROM fields))""",
)
def pattern_lines(spark, d):
    v = _fields(spark, d).select(F.explode("value").alias("v"))
    return v.agg(F.lit("email").alias("pattern"), F.sum(F.size(text.emails(c("v")))).cast("bigint").alias("hits"))


@R.query("pattern_field_hits")
def pattern_field_hits(spark, d):
    v = _fields(spark, d).select("doc_id", "name", F.posexplode("value").alias("at", "v"))
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("pattern"), f(c("v")).alias("hits")) for k, f in text.PATTERNS.items()))).alias("p")
    return v.select("doc_id", "name", "at", kinds).select("doc_id", "name", "at", "p.pattern", F.explode("p.hits").alias("hit"))


@R.query("pattern_line_hits")
def pattern_line_hits(spark, d):
    lines = glyph_lines(table(spark, d, "glyphs"))
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("pattern"), f(c("text")).alias("hits")) for k, f in text.PATTERNS.items()))).alias("p")
    return lines.select("doc_id", "page", "line", kinds).select("doc_id", "page", "line", "p.pattern", F.explode("p.hits").alias("hit"))
