"""Queries of audits, text layout, form data and comparison reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import af, text
from ..operators import audit, comments, diff, forms, layout, pages, rules, sets
from ..operators.textlines import glyph_lines
from ..sources import formdata
from ..sources.tables import table
from .edits import _A, _L, _P, _annotations, _links
from .registry import Registry

R = Registry()
c = F.col

# space and tallies: parts stand for the objects of files


_NAMES = "['Images', 'Content Streams', 'Fonts', 'X Object Forms', 'Structure Info', 'Bookmarks', 'Thumbnails', 'Comments', 'Forms', 'Named Destinations', 'Color Spaces', 'Shadings', 'Patterns', 'Extended Graphics States', 'Embedded Files', 'Document Overhead']"
_CLAIMS = f"(SELECT l_orderkey AS doc_id, l_linenumber AS num, l_suppkey % 15 + 1 AS rank, CAST(floor(l_extendedprice) AS BIGINT) AS bytes FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey % 15 + 1, CAST(floor(l_extendedprice) AS BIGINT) FROM lineitem)"


@R.query("space_categories", f"""WITH o AS (SELECT doc_id, num, min((rank, bytes)) AS x FROM {_CLAIMS} GROUP BY ALL), p AS (SELECT doc_id, x[1] AS rank, sum(x[2]) AS bytes FROM o GROUP BY ALL), f AS (SELECT o_orderkey AS doc_id, CAST(floor(o_totalprice * 2) AS BIGINT) AS file_size FROM orders),
  r AS (SELECT f.doc_id, 16 AS rank, greatest(any_value(file_size) - coalesce(sum(p.bytes), 0), 0) AS bytes FROM f LEFT JOIN p ON p.doc_id = f.doc_id GROUP BY f.doc_id), u AS (SELECT * FROM p UNION ALL SELECT * FROM r)
  SELECT u.doc_id, ({_NAMES})[CAST(rank AS INTEGER)] AS category, CAST(bytes AS BIGINT) AS bytes, CASE WHEN file_size <> 0 THEN round(bytes::DOUBLE * 100 / file_size, 4) END AS percent FROM u JOIN f ON f.doc_id = u.doc_id""")  # fmt: skip
def space_categories(spark, d):
    names = F.array(*map(F.lit, audit.CATEGORIES))
    li = table(spark, d, "lineitem").select(c("l_orderkey").alias("doc_id"), c("l_linenumber").alias("num"), F.floor("l_extendedprice").cast("bigint").alias("bytes"), "l_suppkey", "l_partkey")
    claims = li.select("doc_id", "num", F.get(names, (c("l_suppkey") % 15).cast("int")).alias("category"), "bytes").unionByName(li.select("doc_id", "num", F.get(names, (c("l_partkey") % 15).cast("int")).alias("category"), "bytes"))
    files = table(spark, d, "orders").select(c("o_orderkey").alias("doc_id"), F.floor(c("o_totalprice") * 2).cast("bigint").alias("file_size"))
    return audit.space_by_category(claims, files)


@R.query("corpus_tally", "SELECT split_part(s, ':', 1) AS status, count(*) AS n FROM (SELECT CASE event_type WHEN 'error' THEN 'open-error: ' || user_id WHEN 'view' THEN NULL ELSE event_type END AS s FROM events) WHERE s IS NOT NULL GROUP BY 1")
def corpus_tally(spark, d):
    s = F.when(c("event_type") == "error", F.concat(F.lit("open-error: "), "user_id")).when(c("event_type") == "view", None).otherwise(c("event_type"))
    return audit.tally(table(spark, d, "events").select(s.alias("s")), "s")


@R.query("optimizer_report", "SELECT l_orderkey AS doc_id, count(*) AS images, count(*) FILTER (WHERE l_linenumber % 2 = 0) AS changed, CAST(sum(l_suppkey + 10) AS BIGINT) AS bytes_before, CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey ELSE l_suppkey + 10 END) AS BIGINT) AS bytes_after, CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN 10 ELSE 0 END) AS BIGINT) AS saved FROM lineitem GROUP BY l_orderkey")
def optimizer_report(spark, d):
    return audit.savings(table(spark, d, "lineitem").select(c("l_orderkey").alias("doc_id"), (c("l_suppkey") + 10).alias("before"), F.when(c("l_linenumber") % 2 == 0, c("l_suppkey")).alias("after")))


@R.query("range_digests", "SELECT doc_id, sha256(substr(h, 1, 10) || substr(h, 21, 5)) AS digest FROM (SELECT doc_id, md5(text) AS h FROM documents WHERE text IS NOT NULL)")
def range_digests(spark, d):
    data = F.md5("text").cast("binary")
    ranges = F.array(F.struct(F.lit(0).alias("at"), F.lit(10).alias("length")), F.struct(F.lit(20).alias("at"), F.lit(5).alias("length")))
    return table(spark, d, "documents").where("text is not null").select("doc_id", audit.digest(data, ranges).alias("digest"))


@R.query("image_resolution", "SELECT l_orderkey AS doc_id, l_suppkey AS image, round(min(least((l_quantity * 10) * 72.0 / (l_linenumber * 10), (l_quantity * 8) * 72.0 / (l_linenumber * 9))), 6) AS ppi FROM lineitem GROUP BY ALL")
def image_resolution(spark, d):
    q, n = c("l_quantity"), c("l_linenumber")
    uses = table(spark, d, "lineitem").select(c("l_orderkey").alias("doc_id"), c("l_suppkey").alias("image"), (q * 10).alias("pixels_x"), (q * 8).alias("pixels_y"), (n * 10).alias("width"), (n * -9).alias("height"))
    return audit.image_ppi(uses).withColumn("ppi", F.round("ppi", 6))


@R.query("combine_by_size", "SELECT c_custkey AS id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY size DESC NULLS LAST, lpad(CAST(c_custkey AS VARCHAR), 20, '0')) AS INTEGER) AS place FROM (SELECT *, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 7 END AS size FROM customer)")
def combine_by_size(spark, d):
    f = table(spark, d, "customer").select(c("c_custkey").alias("id"), c("c_nationkey").alias("folder"), F.concat(F.lit("File "), "c_custkey").alias("name"), F.when(c("c_custkey") % 5 > 0, c("c_custkey") % 7).alias("size"))
    return audit.combine_order(f, "size", descending=True, group="folder").select("id", "place")


@R.query("source_kinds", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'text' WHEN 3 THEN 'image' END AS kind FROM customer")
def source_kinds(spark, d):
    k = c("c_custkey") % 5
    data = F.when(k == 0, F.lit("junk %PDF-1.7").cast("binary")).when(k == 1, F.unhex(F.lit("FFD8FFE0"))).when(k == 3, F.unhex(F.lit("89504E470D0A1A0A00"))).otherwise(F.lit("BMW is no bitmap").cast("binary"))
    return table(spark, d, "customer").select("c_custkey", audit.sniff(F.when(k == 2, "NOTES.TXT").otherwise("x.bin"), data).alias("kind"))


# text layout


_G = "(SELECT DISTINCT ON (doc_id, page, ord) * FROM glyphs)"


@R.query("glyph_spans", f"""WITH g AS (SELECT *, coalesce(space_before, false) OR trim(coalesce(text, '')) = '' OR coalesce(trim(coalesce(p, '')) = '', true) OR k = 1 AS new FROM (SELECT *, lag(text) OVER w AS p, row_number() OVER w AS k FROM {_G} WINDOW w AS (PARTITION BY doc_id, page, line ORDER BY ord))),
  n AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id, page, line ORDER BY ord) AS word FROM g)
  SELECT doc_id, page, ord, min(ord) OVER v AS word_first, max(ord) OVER v AS word_last, min(ord) OVER l AS line_first, max(ord) OVER l AS line_last FROM n WINDOW v AS (PARTITION BY doc_id, page, line, word), l AS (PARTITION BY doc_id, page, line)""")  # fmt: skip
def glyph_spans(spark, d):
    return layout.glyph_spans(table(spark, d, "glyphs"))


@R.query("text_lines", f"""WITH g AS {_G}, t AS (SELECT doc_id, page, line, ltrim(string_agg(CASE WHEN space_before THEN ' ' || text ELSE text END, '' ORDER BY ord), ' ') AS text, [min(rect[1]), min(rect[2]), max(rect[3]), max(rect[4])] AS rect FROM g GROUP BY ALL),
  s AS (SELECT doc_id, page, line, size, count(*) AS n FROM (SELECT *, round((rect[4] - rect[2])::FLOAT * 2) / 2 AS size FROM g) GROUP BY ALL) SELECT t.*, (SELECT arg_max(size, (n, -size)) FROM s WHERE s.doc_id = t.doc_id AND s.page = t.page AND s.line = t.line)::DOUBLE AS size FROM t""")  # fmt: skip
def text_lines(spark, d):
    return layout.text_lines(table(spark, d, "glyphs")).withColumn("size", c("size").cast("double"))


@R.query("text_blocks")
def text_blocks(spark, d):
    return layout.text_blocks(layout.text_lines(table(spark, d, "glyphs")))


@R.query("nearest_glyphs", "SELECT doc_id, page, arg_min(ord, (d, ord)) AS ord FROM (SELECT doc_id, page, ord, greatest(rect[1] - 200, 200 - rect[3], 0) + 3 * greatest(rect[2] - 300, 300 - rect[4], 0) AS d FROM glyphs WHERE rect IS NOT NULL) GROUP BY ALL")
def nearest_glyphs(spark, d):
    return layout.nearest(table(spark, d, "glyphs"), 200.0, 300.0).select("doc_id", "page", "ord")


@R.query("body_sizes", "SELECT doc_id, arg_max(size, (n, -size)) AS size FROM (SELECT doc_id, round(len(text) % 7 + 6.0, 1)::DOUBLE AS size, sum(len(text)) AS n FROM (SELECT doc_id, page, line, ltrim(string_agg(CASE WHEN space_before THEN ' ' || text ELSE text END, '' ORDER BY ord), ' ') AS text FROM (SELECT DISTINCT ON (doc_id, page, ord) * FROM glyphs) GROUP BY ALL) GROUP BY ALL) GROUP BY doc_id")
def body_sizes(spark, d):
    lines = glyph_lines(table(spark, d, "glyphs"))
    return layout.body_size(lines.withColumn("size", (F.length("text") % 7 + 6).cast("double")))


@R.query("heading_levels", "SELECT doc_id, page, line, CASE WHEN size >= 16 THEN 1 WHEN size >= 12.5 OR (page % 2 = 0 AND len(text) < 80 AND NOT regexp_matches(text, '[.,;:]$')) THEN 2 END AS level FROM (SELECT *, len(text) % 20 AS size FROM (SELECT doc_id, page, line, ltrim(string_agg(CASE WHEN space_before THEN ' ' || text ELSE text END, '' ORDER BY ord), ' ') AS text FROM (SELECT DISTINCT ON (doc_id, page, ord) * FROM glyphs) GROUP BY ALL))")
def heading_levels(spark, d):
    lines = glyph_lines(table(spark, d, "glyphs"))
    return lines.select("doc_id", "page", "line", layout.heading_level((F.length("text") % 20).cast("double"), F.lit(10.0), c("page") % 2 == 0, c("text")).alias("level"))


@R.query("word_segments", "SELECT doc_id, page, ord, CAST(sum((coalesce(rect[1] - p > 30, false))::INT) OVER (PARTITION BY doc_id, page, line ORDER BY ord) AS BIGINT) AS segment FROM (SELECT *, lag(rect[3]) OVER (PARTITION BY doc_id, page, line ORDER BY ord) AS p FROM (SELECT DISTINCT ON (doc_id, page, ord) * FROM words))")
def word_segments(spark, d):
    return layout.segments(table(spark, d, "words").dropDuplicates(["doc_id", "page", "ord"]), 30.0).select("doc_id", "page", "ord", "segment")


@R.query("text_export", "SELECT doc_id, string_agg(rtrim(text), chr(12) ORDER BY page) AS text FROM (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY line) AS text FROM (SELECT doc_id, page, line, ltrim(string_agg(CASE WHEN space_before THEN ' ' || text ELSE text END, '' ORDER BY ord), ' ') AS text FROM (SELECT DISTINCT ON (doc_id, page, ord) * FROM glyphs) GROUP BY ALL) GROUP BY ALL) GROUP BY doc_id")
def text_export(spark, d):
    return layout.text_export(table(spark, d, "glyphs"))


@R.query("search_context", "SELECT doc_id, substr(text, CAST(greatest(instr(lower(text), 'railway') - 1 - 36, 0) + 1 AS INTEGER), CAST(instr(lower(text), 'railway') - 1 - greatest(instr(lower(text), 'railway') - 1 - 36, 0) + 7 + 36 AS INTEGER)) AS around FROM documents WHERE contains(lower(text), 'railway')")
def search_context(spark, d):
    at = F.get(text.find(c("text"), "railway"), F.lit(0))
    return table(spark, d, "documents").withColumn("at", at).where("at is not null").select("doc_id", text.context(c("text"), c("at"), 7).alias("around"))


@R.query("pretty_dates", "SELECT doc_id, strftime(m, '%Y-%m-%d %H:%M') AS shown FROM (SELECT DISTINCT doc_id, CAST(modified_at AT TIME ZONE 'UTC' AS TIMESTAMP) AS m FROM pdf_files)")
def pretty_dates(spark, d):
    return table(spark, d, "pdf_files").select("doc_id", "modified_at").distinct().select("doc_id", text.pretty_date(text.pdf_date(c("modified_at"))).alias("shown"))


@R.query("decoded_text", "SELECT p_partkey, p_name AS wide, p_name AS utf8, p_name AS plain FROM part")
def decoded_text(spark, d):
    n = c("p_name")
    return table(spark, d, "part").select("p_partkey", text.decode_text(F.concat(F.unhex(F.lit("FEFF")), F.encode(n, "UTF-16BE"))).alias("wide"), text.decode_text(F.concat(F.unhex(F.lit("EFBBBF")), F.encode(n, "UTF-8"))).alias("utf8"), text.decode_text(F.encode(n, "UTF-8")).alias("plain"))


@R.query("url_hosts", "SELECT doc_id, page, kind, uri FROM " + _L + " WHERE page > 4")
def url_hosts(spark, d):
    k = _links(spark, d).where("page > 4")
    return k.where(text.url_policy(c("uri"))["allowed"]).select("doc_id", "page", "kind", "uri")


# form data: what is written is read again


_F = "(SELECT DISTINCT ON (doc_id, name) * FROM fields)"
_SENT = f"(SELECT doc_id, name, unnest(value) AS value FROM {_F} WHERE kind IN ('text', 'checkbox', 'radio', 'list', 'combo') AND len(value) > 0)"


def _written(df, column: str, ending: str):
    return df.select(F.concat(c("doc_id").cast("string"), F.lit(ending)).alias("path"), c(column).cast("binary").alias("content"))


@R.query("import_xfdf", f"SELECT doc_id, name, coalesce(value, '') AS value FROM {_SENT}")
def import_xfdf(spark, d):
    read = formdata.parse(_written(forms.to_xfdf(table(spark, d, "fields")), "xml", ".xfdf"))
    return read.select(F.substring_index("path", ".", 1).cast("bigint").alias("doc_id"), "name", "value")


@R.query("import_fdf", f"SELECT doc_id, name, CASE WHEN kind IN ('checkbox', 'radio') AND coalesce(array_to_string(value, ', '), '') = '' THEN 'Off' ELSE coalesce(array_to_string(value, ', '), '') END AS value FROM {_F} WHERE kind IN ('text', 'checkbox', 'radio', 'list', 'combo')")
def import_fdf(spark, d):
    read = formdata.parse(_written(forms.to_fdf(table(spark, d, "fields")), "fdf", ".fdf"))
    return read.select(F.substring_index("path", ".", 1).cast("bigint").alias("doc_id"), "name", "value")


@R.query("import_comments", f"WITH a AS {_A} SELECT doc_id, page, name, author, in_reply_to, state, contents || ' <&>' AS contents, rect FROM a")
def import_comments(spark, d):
    a = _annotations(spark, d).withColumn("contents", F.concat("contents", F.lit(" <&>")))
    read = formdata.comments(_written(forms.to_xfdf(table(spark, d, "fields"), a), "xml", ".xfdf"))
    return read.select(F.substring_index("path", ".", 1).cast("bigint").alias("doc_id"), "page", "name", "author", "in_reply_to", "state", "contents", "rect")


@R.query("import_csv", "SELECT c_custkey, 'name' AS name, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'a \"b\", c', c_mktsegment || chr(10) || c_nationkey FROM customer")
def import_csv(spark, d):
    q = lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    body = F.concat(F.lit('name,"a ""b"", c"\r\n'), q(c("c_name")), F.lit(","), q(F.concat("c_mktsegment", F.lit("\n"), c("c_nationkey").cast("string"))), F.lit("\r\nsecond,record\r\n"))
    files = table(spark, d, "customer").select(F.concat("c_custkey", F.lit(".csv")).alias("path"), body.cast("binary").alias("content"))
    return formdata.parse(files).select(F.substring_index("path", ".", 1).cast("bigint").alias("c_custkey"), "name", "value")


@R.query("import_xml", "SELECT c_custkey, 'person.name' AS name, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'person.nation', CAST(c_nationkey AS VARCHAR) FROM customer UNION ALL SELECT c_custkey, 'note', '<&>' FROM customer")
def import_xml(spark, d):
    body = F.concat(F.lit("<?xml version='1.0'?><form><person><name>"), "c_name", F.lit("</name><nation>"), c("c_nationkey").cast("string"), F.lit("</nation></person><note>&lt;&amp;&gt;</note></form>"))
    files = table(spark, d, "customer").select(F.concat("c_custkey", F.lit(".xml")).alias("path"), body.cast("binary").alias("content"))
    return formdata.parse(files).select(F.substring_index("path", ".", 1).cast("bigint").alias("c_custkey"), "name", "value")


@R.query("import_datasets", "SELECT c_custkey AS doc_id, 'form1.name' AS name, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'form1.total', CAST(c_nationkey AS VARCHAR) FROM customer")
def import_datasets(spark, d):
    body = F.concat(F.lit("<xfa:datasets xmlns:xfa='http://www.xfa.org/schema/xfa-data/1.0/'><xfa:data><form1><name>"), "c_name", F.lit("</name><total>"), c("c_nationkey").cast("string"), F.lit("</total></form1></xfa:data></xfa:datasets>"))
    return formdata.datasets(table(spark, d, "customer").select(c("c_custkey").alias("doc_id"), body.alias("xml"))).select("doc_id", "name", "value")


@R.query("form_apply", f"SELECT doc_id, name, CASE WHEN kind = 'text' AND (max_len IS NULL OR max_len <= 0 OR max_len >= 3) THEN ['abc'] ELSE value END AS value FROM {_F}")
def form_apply(spark, d):
    f = table(spark, d, "fields")
    given = f.where("kind = 'text'").select("doc_id", "name", F.lit("abc").alias("value"))
    return forms.apply_values(f, given)[0].select("doc_id", "name", "value")


# comparison and sets


@R.query("changes_listed", "SELECT c_custkey AS pair_id, 0 AS seq, 'replaced' AS kind, 'old' AS old_text, 'new' AS new_text FROM customer UNION ALL SELECT c_custkey, 1, 'inserted', '', 'end' FROM customer")
def changes_listed(spark, d):
    k = table(spark, d, "customer").select(c("c_custkey").alias("pair_id"), "c_name")
    a, b = k.select("pair_id", F.concat("c_name", F.lit(" is old here")).alias("text")), k.select("pair_id", F.concat("c_name", F.lit(" is new here end")).alias("text"))
    return diff.first_changes(diff.compare(a, b), 2).select("pair_id", "seq", "kind", "old_text", "new_text")


@R.query("change_report", "SELECT c_custkey AS pair_id, '~ old -> new' || chr(10) || '+ end' AS text FROM customer")
def change_report(spark, d):
    k = table(spark, d, "customer").select(c("c_custkey").alias("pair_id"), "c_name")
    a, b = k.select("pair_id", F.concat("c_name", F.lit(" is old here")).alias("text")), k.select("pair_id", F.concat("c_name", F.lit(" is new here end")).alias("text"))
    return diff.report(diff.compare(a, b))


@R.query("visual_changes", "SELECT c_custkey AS pair_id, 0 AS x0, 0 AS y0, 8 AS x1, 8 AS y1 FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 32, 8, 40, 16 FROM customer WHERE c_custkey % 3 = 0")
def visual_changes(spark, d):
    k = c("c_custkey")
    pixel = lambda n: F.repeat(F.lit("00000000"), n)
    first = F.when(k % 2 == 0, "FF000000").otherwise("00000000")
    late = F.when(k % 3 == 0, "000000FF").otherwise("00000005")
    b = F.concat(first, pixel(47 + 48 * 9 + 34), late, pixel(48 * 16 - 48 * 10 - 35))
    pairs = table(spark, d, "customer").select(k.alias("pair_id"), *(F.lit(v).alias(n) for n, v in (("width_a", 48), ("height_a", 16), ("width_b", 48), ("height_b", 16))), F.unhex(pixel(48 * 16)).alias("a"), F.unhex(b).alias("b"))
    return diff.visual_regions(pairs)


@R.query("dangling_links", f"SELECT l.doc_id, l.page FROM {_L} l WHERE NOT EXISTS (SELECT 1 FROM pdf_pages p WHERE p.doc_id = l.doc_id AND p.page = l.page + 1)")
def dangling_links(spark, d):
    links = _links(spark, d).withColumn("target", F.concat_ws("/", "doc_id", c("page") + 1))
    there = table(spark, d, "pdf_pages").select(F.concat_ws("/", "doc_id", "page").alias("target"))
    return sets.dangling(links, there, "target").select("doc_id", "page")


@R.query("unlinked_pages", f"SELECT p.doc_id, p.page FROM {_P} p WHERE NOT EXISTS (SELECT 1 FROM {_L} l WHERE l.doc_id = p.doc_id AND l.page + 1 = p.page)")
def unlinked_pages(spark, d):
    links = _links(spark, d).select(F.concat_ws("/", "doc_id", c("page") + 1).alias("target"))
    there = table(spark, d, "pdf_pages").select("doc_id", "page").distinct().withColumn("target", F.concat_ws("/", "doc_id", "page"))
    return sets.unreferenced(there, links, "target").select("doc_id", "page")


@R.query("comment_status_counts", f"WITH a AS {_A} SELECT status, count(*) AS n FROM (SELECT r.doc_id, r.name, (SELECT arg_max(x.state, x.page * 1000 + x.index) FROM a x WHERE x.doc_id = r.doc_id AND x.in_reply_to = r.name AND x.state IS NOT NULL AND x.state <> 'Marked') AS status FROM a r WHERE r.in_reply_to IS NULL) GROUP BY status")
def comment_status_counts(spark, d):
    return comments.threads(_annotations(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


@R.query("pages_by_label", f"WITH l AS (SELECT doc_id, page, CASE WHEN page < 3 THEN (['i', 'ii'])[page] ELSE CAST(page - 2 AS VARCHAR) END AS label FROM {_P}) SELECT doc_id, coalesce(min(CASE WHEN label = '2' THEN page END), max(CASE WHEN page = 2 THEN 2 END)) AS page FROM l GROUP BY doc_id HAVING coalesce(min(CASE WHEN label = '2' THEN page END), max(CASE WHEN page = 2 THEN 2 END)) IS NOT NULL")
def pages_by_label(spark, d):
    p = table(spark, d, "pdf_pages").select("doc_id", "page").distinct()
    labelled = p.withColumn("label", F.when(c("page") < 3, F.get(F.array(F.lit("i"), F.lit("ii")), c("page") - 1)).otherwise((c("page") - 2).cast("string")))
    wanted = p.select("doc_id", F.lit("2").alias("wanted")).distinct()
    return pages.by_label(labelled, wanted).select("doc_id", "page")


@R.query("combine_selected", f"SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY source, pos) AS INTEGER) AS page FROM (SELECT doc_id, 0 AS source, page, CASE page WHEN 2 THEN 0 WHEN 1 THEN 1 END AS pos FROM {_P} WHERE page IN (1, 2) UNION ALL SELECT doc_id, 1 AS source, page, 0 AS pos FROM {_P} WHERE page = 3)")
def combine_selected(spark, d):
    p = pages.once(table(spark, d, "pdf_pages")).select("doc_id", "page")
    return pages.combine_selected([(p, [2, 1]), (p, [3])]).select("doc_id", "source", "page")


@R.query("field_properties", f"""SELECT doc_id, name, kind AS type, coalesce(array_to_string(value, ', '), '') AS value_as_string, coalesce(flags & 1 <> 0, false) AS read_only, coalesce(flags & 2 <> 0, false) AS required, CASE WHEN max_len > 0 THEN max_len END AS char_limit, CAST(coalesce(len(options), 0) AS INTEGER) AS num_items,
  list_transform(coalesce(options, []), lambda o: coalesce(o.export_value, o.display_text)) AS export_values, list_filter(list_transform(coalesce(value, []), lambda v: CAST(list_position(list_transform(coalesce(options, []), lambda o: coalesce(o.export_value, o.display_text)), v) - 1 AS INTEGER)), lambda i: i >= 0) AS current_indices,
  kind IN ('checkbox', 'radio') AND len(coalesce(value, [])) > 0 AND coalesce(value[1], 'Off') NOT IN ('Off', '') AS checked FROM {_F}""")  # fmt: skip
def field_properties(spark, d):
    return forms.properties(forms.once(table(spark, d, "fields")))


@R.query("field_items", f"SELECT doc_id, name, options[-1].display_text AS item FROM {_F} WHERE kind IN ('list', 'combo')")
def field_items(spark, d):
    return forms.item_at(forms.once(table(spark, d, "fields")).where(c("kind").isin("list", "combo")), -1, export=False)


@R.query("device_colours", "SELECT l_orderkey AS doc_id, bool_or(l_linenumber % 7 IN (1, 2)) AS device_rgb, bool_or(l_linenumber % 7 = 3) AS device_cmyk FROM lineitem GROUP BY ALL")
def device_colours(spark, d):
    op = F.when(c("l_linenumber") % 7 == 1, "rg").when(c("l_linenumber") % 7 == 2, "G").when(c("l_linenumber") % 7 == 3, "k").otherwise("re")
    return audit.device_colours(table(spark, d, "lineitem").select(c("l_orderkey").alias("doc_id"), op.alias("op")))


@R.query("declared_standards", "SELECT c_custkey AS doc_id, CASE c_custkey % 3 WHEN 0 THEN '2b' WHEN 1 THEN '4' END AS archive, CASE WHEN c_custkey % 2 = 0 THEN '1' END AS accessible FROM customer")
def declared_standards(spark, d):
    k = c("c_custkey")
    entry = lambda key, v: F.struct(F.lit(key).alias("key"), v.cast("string").alias("value"))
    x = F.explode(F.array(entry("dc:title", F.lit("t")), entry("pdfaid:part", F.when(k % 3 == 0, " 2").when(k % 3 == 1, "4")), entry("pdfaid:conformance", F.when(k % 3 == 0, "B")), entry("pdfuaid:part", F.when(k % 2 == 0, "1")))).alias("x")
    return audit.declared(table(spark, d, "customer").select(k.alias("doc_id"), x).select("doc_id", "x.*").where("value is not null"))


@R.query("script_numbers", "SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS whole, CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey // 4 AS VARCHAR) ELSE CAST(c_custkey // 4 AS VARCHAR) || ([ '.25', '.5', '.75' ])[c_custkey % 4] END AS part, c_custkey AS coerced FROM customer")
def script_numbers(spark, d):
    k = c("c_custkey").cast("double")
    return table(spark, d, "customer").select("c_custkey", af.js_number(k).alias("whole"), af.js_number(k / 4).alias("part"), audit.whole(k).alias("coerced"))


@R.query("accessibility_html", "SELECT doc_id, true AS complete FROM (SELECT DISTINCT doc_id FROM pdf_files)")
def accessibility_html(spark, d):
    report = rules.check(table(spark, d, "pdf_files").select("doc_id", "title", "tagged").distinct())
    html = rules.report_html(report)
    return html.select("doc_id", (F.size(F.split("html", "<tr>")) == len(rules.RULES) + 1).alias("complete"))


_N = """(SELECT c_custkey AS k, CAST(200 + c_custkey % 700 AS VARCHAR) AS a, CAST(300 + c_custkey % 600 AS VARCHAR) AS b, lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS c, lpad(CAST(c_custkey % 999 AS VARCHAR), 3, '0') AS area, lpad(CAST(1 + c_custkey % 99 AS VARCHAR), 2, '0') AS grp, lpad(CAST(1 + c_custkey % 9999 AS VARCHAR), 4, '0') AS serial,
  CAST(1 + c_custkey % 12 AS VARCHAR) AS m, CAST(1 + c_custkey % 28 AS VARCHAR) AS dd, CAST(1990 + c_custkey % 40 AS VARCHAR) AS y, lpad(CAST(c_custkey * 7919 + 400000000000000 AS VARCHAR), 15, '0') AS base FROM customer)"""


@R.query("patterns_in_sentences", f"""WITH n AS {_N}, s AS (SELECT *, list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 1 THEN (CAST(base[i] AS INTEGER) * 2) // 10 + (CAST(base[i] AS INTEGER) * 2) % 10 ELSE CAST(base[i] AS INTEGER) END)) AS total FROM n)
  SELECT k, ['(' || a || ') ' || b || '-' || c, '+1 ' || a || '.' || b || '.' || c] AS phone, CASE WHEN area IN ('000', '666') OR area >= '900' THEN []::VARCHAR[] ELSE [area || '-' || grp || '-' || serial] END AS ssn, [m || '/' || dd || '/' || y, y || '-' || m || '-' || dd, dd || ' March ' || y] AS date,
    ['u' || k || '.x@h' || k % 7 || '.test'] AS email, [base[1:4] || ' ' || base[5:8] || ' ' || base[9:12] || ' ' || base[13:15] || CAST((10 - total % 10) % 10 AS VARCHAR)] AS card FROM s""")  # fmt: skip
def patterns_in_sentences(spark, d):
    """Sentences that are made to hold what is found, and near misses beside it."""
    k = c("c_custkey")
    s = lambda x: x.cast("string")
    a, b, e = s(200 + k % 700), s(300 + k % 600), F.lpad(s(k % 10000), 4, "0")
    area, group, serial = F.lpad(s(k % 999), 3, "0"), F.lpad(s(1 + k % 99), 2, "0"), F.lpad(s(1 + k % 9999), 4, "0")
    m, day, y = s(1 + k % 12), s(1 + k % 28), s(1990 + k % 40)
    base = F.lpad(s(k * 7919 + 400000000000000), 15, "0")
    check = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(base, i.cast("string"))), text.luhn), F.lit(0))
    card = F.concat_ws(" ", *(F.substring(check, i, 4) for i in (1, 5, 9, 13)))
    wrong = F.concat(F.substring(check, 1, 15), s((F.substring(check, 16, 1).cast("int") + 1) % 10))
    line = F.concat
    t = table(spark, d, "customer").select(
        k.alias("k"), line(F.lit("Ring ("), a, F.lit(") "), b, F.lit("-"), e, F.lit(" or +1 "), a, F.lit("."), b, F.lit("."), e, F.lit(", never "), a, b, e, F.lit(".")).alias("phone"), line(F.lit("Held: "), area, F.lit("-"), group, F.lit("-"), serial, F.lit(", not "), area, F.lit("-"), group, F.lit("-1.")).alias("ssn"),
        line(F.lit("Seen "), m, F.lit("/"), day, F.lit("/"), y, F.lit(", "), y, F.lit("-"), m, F.lit("-"), day, F.lit(" and "), day, F.lit(" March "), y, F.lit("; ratio "), m, F.lit("/"), day, F.lit(".")).alias("date"), line(F.lit("To u"), k, F.lit(".x@h"), k % 7, F.lit(".test, not u"), k, F.lit("@h.")).alias("email"), line(F.lit("Paid by "), card, F.lit("; refused: "), wrong, F.lit(".")).alias("card"),
    )
    return t.select("k", text.phones(c("phone")).alias("phone"), text.ssns(c("ssn")).alias("ssn"), text.dates(c("date")).alias("date"), text.emails(c("email")).alias("email"), text.cards(c("card")).alias("card"))


@R.query("paragraphs_of_lines", "SELECT c_custkey AS doc_id, 1 AS page, 0 AS block, 0 AS first_line, 2 AS last_line, c_name || ' goes onward and ends' AS text FROM customer UNION ALL SELECT c_custkey, 1, 1, 3, 3, 'Heading' FROM customer UNION ALL SELECT c_custkey, 1, 2, 4, 4, 'far below' FROM customer")
def paragraphs_of_lines(spark, d):
    """Three lines at one distance, a heading in another size, a line far below."""
    box = lambda y, wide, high: F.array(*(F.lit(float(x)) for x in (20, y, 20 + wide, y + high)))
    lines = [(F.concat("c_name", F.lit(" goes on-")), 40, 300, 10), (F.lit("ward"), 53, 280, 10), (F.lit("and ends"), 66, 90, 10), (F.lit("Heading"), 90, 120, 18), (F.lit("far below"), 300, 80, 10)]
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("line"), t.alias("text"), box(y, w, h).alias("rect"), F.lit(float(h)).alias("size")) for i, (t, y, w, h) in enumerate(lines)))).alias("x")
    return layout.text_blocks(table(spark, d, "customer").select(c("c_custkey").alias("doc_id"), F.lit(1).alias("page"), rows).select("doc_id", "page", "x.*"))
